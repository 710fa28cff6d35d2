"""Ranking measures and the constants of the guided search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gain(relevance: Column, rank: Column) -> Column:
    """What a result at ``rank`` (from 1) adds to the discounted cumulative gain; nothing unless relevant."""
    return F.when(relevance > 0, relevance / F.log2(rank + 1)).otherwise(F.lit(0.0))


def dcg(relevances: Column) -> Column:
    """Discounted cumulative gain of a ranked array of relevances."""
    parts = F.transform(relevances, lambda r, i: F.when(r > 0, r / F.log2(i + 2)).otherwise(F.lit(0.0)))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def adaptive_k(modules: Column) -> Column:
    """Children to expand at once for a repository of so many modules; tens are rounded half to even."""
    return F.when(modules < 20, F.greatest(F.lit(1), F.floor(modules / 2))).otherwise(F.least(F.bround(modules / 10) * 5, F.lit(200)) + 15).cast("int")


def exploration(k: Column, damping: float = 8.0) -> Column:
    """The exploration weight 1 / (damping * sqrt(ln(4k)))."""
    return 1.0 / (damping * F.sqrt(F.log(4 * k)))


def retrieval_score(total: Column, visits: Column, cosine: Column, alpha: float) -> Column:
    """Blend of a node's mean reward and its similarity; 0 for a node never visited."""
    return F.when(visits > 0, alpha * total / visits + (1 - alpha) * 10 * cosine).otherwise(F.lit(0.0))


def at_sixth(score: Column) -> Column:
    """A score at six places, halves up as of the double itself (rounding of the printed decimal differs between engines)."""
    return F.floor(score * 1_000_000 + 0.5) / 1_000_000


def uct(reward: Column, visits: Column, parent_visits: Column, weight: float, expanded: Column | None = None) -> Column:
    """Upper confidence bound of a visited child; null for one never visited, 0 for one that is fully ``expanded``."""
    bound = F.when(visits > 0, reward / visits + weight * F.sqrt(2 * F.log(F.greatest(parent_visits, F.lit(1))) / visits))
    return bound if expanded is None else F.when(F.coalesce(expanded, F.lit(False)), F.lit(0.0)).otherwise(bound)
