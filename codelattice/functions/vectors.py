"""Dense vectors as array columns; computed in double precision on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_d(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 where a vector is null, zero, or the lengths differ."""
    n = norm(a) * norm(b)
    return F.when((F.size(_d(a)) == F.size(_d(b))) & (n > 0), dot(a, b) / n).otherwise(F.lit(0.0))


def normalised(a: Column | str) -> Column:
    """The vector over its length; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(_d(a), lambda x: x / n)).otherwise(_d(a))


def clamped(score: Column) -> Column:
    """Ten times the score, kept between 0 and 10."""
    return F.least(F.greatest(score * 10, F.lit(0.0)), F.lit(10.0))
