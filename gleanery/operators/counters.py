"""Visit counters, daily caps, day series and top lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

DAILY_CAP = 300


def visit_counts(events: DataFrame) -> DataFrame:
    """``period, metric, value, n``: people by day and month and first seen, and events by type and day."""
    day, month = F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "yyyy-MM")
    people = lambda p, m: events.select(p.alias("period"), "user_id").distinct().groupBy("period").agg(F.count(F.lit(1)).alias("n")).select("period", F.lit(m).alias("metric"), F.lit("").alias("value"), "n")
    new = events.groupBy("user_id").agg(F.min("ts").alias("ts")).groupBy(day.alias("period")).agg(F.count(F.lit(1)).alias("n"))
    kinds = events.groupBy(day.alias("period"), F.col("event_type").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return (
        people(day, "day").unionByName(people(month, "month"))
        .unionByName(new.select("period", F.lit("new").alias("metric"), F.lit("").alias("value"), "n"))
        .unionByName(kinds.select("period", F.lit("type").alias("metric"), "value", "n"))
    )


def merged_counts(table: DataFrame, more: DataFrame) -> DataFrame:
    """Counters after an upsert: equal keys add up."""
    return table.unionByName(more).groupBy("period", "metric", "value").agg(F.sum("n").alias("n"))


def daily_cap(rows: DataFrame, ts: str, order: list[str], cap: int = DAILY_CAP) -> DataFrame:
    """The first ``cap`` rows of each day."""
    day = F.to_date(F.col(ts))
    return rows.withColumn("day", day).withColumn("rn", F.row_number().over(W.partitionBy("day").orderBy(ts, *order))).where(F.col("rn") <= cap)


def sparkline(rows: DataFrame, ts: str, days: int = 30, levels: int = 8) -> DataFrame:
    """The last ``days`` days without gaps, each with its count and its level from 0 to ``levels``."""
    n = rows.groupBy(F.to_date(F.col(ts)).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    last = n.agg(F.max("day").alias("last"))
    series = last.select(F.explode(F.sequence(F.date_sub("last", days - 1), F.col("last"))).alias("day"))
    full = series.join(n, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))
    top = F.max("n").over(W.partitionBy(F.lit(0)))  # over at most ``days`` rows
    return full.select("day", "n", F.floor(levels * F.col("n") / F.greatest(top, F.lit(1)) + 0.5).cast("int").alias("level"))


def top_by_sum(rows: DataFrame, key: str, value: str, most: int = 5) -> DataFrame:
    return rows.groupBy(key).agg(F.sum(value).alias("total")).orderBy(F.desc("total"), key).limit(most)
