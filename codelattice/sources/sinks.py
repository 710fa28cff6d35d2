"""Sinks: result files, keyed tracking tables, resuming, and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..session import written


def write_json(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def upserted(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """The old rows whose key is not in the new ones, and the new ones; of rows with one key the last in column order stays."""
    latest = new.groupBy(*keys).agg(F.max(F.struct(*[F.col(c) for c in new.columns if c not in keys])).alias("x")).select(*keys, "x.*") if len(new.columns) > len(keys) else new.distinct()
    return old.join(latest, list(keys), "left_anti").unionByName(latest.select(*old.columns))


def upsert_table(path: str, new: DataFrame, *keys: str) -> None:
    """Read, merge and write back a tracking table; the merged rows are written aside first, so a lost task loses nothing."""
    old = read_or_empty(new.sparkSession, path, new.schema)
    written(upserted(old, new, *keys), "upsert").write.mode("overwrite").parquet(path)


def upsert_partitions(path: str, new: DataFrame, by: str) -> None:
    """Replace only the partitions that the new rows have."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def pending(todo: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """What is left to do: rows whose key is not among those done."""
    return todo.join(done.select(*keys).distinct(), list(keys), "left_anti")


def snapshot(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The graph as two tables, partitioned by repo."""
    nodes.write.mode("overwrite").partitionBy("repo").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def top_repos(tracking: DataFrame, metric: str, n: int = 10) -> DataFrame:
    return tracking.orderBy(F.desc_nulls_last(metric), "repo").limit(n)
