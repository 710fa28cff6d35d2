"""Source files arriving in a folder, parsed and merged into a graph snapshot batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.parse import parse_files
from ..sources.sinks import upsert_table

FILES = "repo string, path string, content string, file_ord int"


def arriving(spark: SparkSession, folder: str) -> DataFrame:
    """files(repo, path, content, file_ord) as Parquet files are put into a folder."""
    return spark.readStream.schema(FILES).parquet(folder)


def ingest(files: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Parses arriving files; a file delivered again replaces its records.  Stops when all that is there is done; a batch that is
    run twice after a failure has the same result, as files are replaced by key."""

    def batch(part: DataFrame, _: int) -> None:
        latest = part.groupBy("repo", "path").agg(F.max_by(F.struct("content", "file_ord"), F.coalesce("file_ord", F.lit(-1))).alias("x")).select("repo", "path", "x.*")
        upsert_table(target, parse_files(latest), "repo", "path")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_rates(events: DataFrame, every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by type in fixed windows; works on streams and on tables."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "value")
    )
