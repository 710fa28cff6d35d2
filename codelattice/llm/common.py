"""What several operators of this subpackage share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written

#: Rows a table may have to be sent whole to every task; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000

WORD = re.compile(r"[A-Za-z0-9_]+")


def table(spark: SparkSession, at: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{at}/{name}.parquet")


def picked(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns.  A column is taken by its exact name, else by its name in another case; columns that differ from
    it by case alone, or any other extra columns, take no part."""
    have = df.columns
    at = [have.index(n) if n in have else [c.lower() for c in have].index(n.lower()) for n in names]
    if len({c.lower() for c in have}) < len(have):
        df = df.toDF(*(f"_{i}" for i in range(len(have))))
    return df.select(*(F.col(f"`{df.columns[i]}`").alias(n) for i, n in zip(at, names)))


def batches(rows: Callable[[dict[str, list]], dict[str, list]], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow from one on columns as Python lists."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                out = rows({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return run


def with_code(docs: DataFrame) -> DataFrame:
    """Rows of docs that hold code: neither null nor empty."""
    return docs.where(F.length("code") > 0)


def sized(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """The rows, written once; to be broadcast if they are no more than ``rows`` (BROADCAST_ROWS if not given), else left to the optimiser."""
    kept = written(df, name)
    return F.broadcast(kept) if kept.count() <= (BROADCAST_ROWS if rows is None else rows) else kept
