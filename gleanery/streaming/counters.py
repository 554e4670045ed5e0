"""Counters over streams: a visit counts once a user and day; late rows go with the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.sources.engine import inspect

LATE = "2 hours"


def daily_people(events: DataFrame, *, late: str = LATE) -> DataFrame:
    """``window, n``: users of each day, each counted once; works on streams and on tables."""
    day = F.window("ts", "1 day")
    seen = events.withWatermark("ts", late).select("user_id", F.date_trunc("day", "ts").alias("day"), "ts") if events.isStreaming else events.select("user_id", F.date_trunc("day", "ts").alias("day"), "ts")
    once = seen.dropDuplicatesWithinWatermark(["user_id", "day"]) if events.isStreaming else seen.dropDuplicates(["user_id", "day"])
    return once.groupBy(day).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("day"), "n")


def type_counts(events: DataFrame, *, late: str = LATE) -> DataFrame:
    """``day, event_type, n`` in tumbling days."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("day"), "event_type", "n")


def watched(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of the files that arrive in a folder: the same decoders behind a stream."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)
    return inspect(files.select(F.md5(F.encode("path", "UTF-8")).alias("file_id"), F.col("path").alias("name"), "content")).where("row in ('fact', 'problem', 'file')")


def run_once(stream: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """All that is there now, through the stream, as a table in memory."""
    w = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    (w.option("checkpointLocation", checkpoint) if checkpoint else w).start().awaitTermination()
    return stream.sparkSession.table(name)
