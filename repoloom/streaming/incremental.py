"""Keep a project's index current from a folder into which file records are dropped (an extension of batch indexing)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

RECORDS = "project_id string, path string, language string, content string, scanned_at timestamp"


def file_records(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """A stream of file records written as JSON lines."""
    return spark.readStream.schema(RECORDS).option("maxFilesPerTrigger", max_files).json(folder)


def latest(batch: DataFrame) -> DataFrame:
    """Of each path the record scanned last."""
    best = batch.groupBy("project_id", "path").agg(F.max_by(F.struct("language", "content", "scanned_at"), "scanned_at").alias("r"))
    return best.select("project_id", "path", "r.*")


def run(stream: DataFrame, checkpoint: str, reindex: Callable[[DataFrame, int], None], once: bool = True) -> StreamingQuery:
    """Hand the newest record of each touched path to ``reindex``, batch by batch, exactly once per checkpoint."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: reindex(latest(batch), n))
    return (writer.trigger(availableNow=True) if once else writer).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per window and type over an event-time stream or table; rows later than ``late`` may be left out of a stream."""
    base = events.withWatermark("ts", late) if events.isStreaming else events
    return base.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")
