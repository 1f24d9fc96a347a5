"""Consumer lag on streams: positions of groups meet the ends of partitions as both arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidelog.operators import lag
from tidelog.streaming.reading import WATERMARK


def consumer_lag(committed: DataFrame, ends: DataFrame, within: str = "0 seconds", watermark: str = WATERMARK) -> DataFrame:
    """``lag`` of every commit (group, topic, partition, ts, committed) for which an end (topic, partition, ts, end_offset)
    of a time at most ``within`` before or after it arrives, whichever of the two comes first.

    Both sides have a watermark and the times a bound, so Spark drops a row from state once no partner can come any more.
    A commit without an end gives no row, as on static data.
    """
    commits = committed.withWatermark("ts", watermark).select("group", "topic", "partition", "ts", "committed")
    known = ends.withWatermark("ts", watermark).select(
        F.col("topic").alias("__topic"), F.col("partition").alias("__partition"), F.col("ts").alias("end_ts"), "end_offset")
    near = F.expr(f"end_ts >= ts - interval {within} and end_ts <= ts + interval {within}")
    met = commits.join(known, (F.col("topic") == F.col("__topic")) & (F.col("partition") == F.col("__partition")) & near)
    behind = F.greatest(F.col("end_offset") - F.col("committed"), F.lit(0).cast("bigint"))
    return met.drop("__topic", "__partition").withColumn("lag", behind)


def lag_summary(lags: DataFrame, window: str = "1 minute", warning: int = lag.WARNING_LAG, critical: int = lag.CRITICAL_LAG) -> DataFrame:
    """Totals per group and window of the commits' times, in append mode behind ``consumer_lag``."""
    summed = lags.groupBy(F.window("ts", window).alias("w"), "group").agg(
        F.count(F.lit(1)).alias("partitions"), F.sum("lag").alias("total_lag"), F.max("lag").alias("max_lag"),
        F.expr("sum(lag) div count(1)").alias("average_lag"), F.count_if(F.col("lag") > warning).alias("above_warning"),
        F.count_if(F.col("lag") > critical).alias("above_critical"))
    return summed.select(F.col("w.start").alias("start"), *[c for c in summed.columns if c != "w"])


def lag_alerts(lags: DataFrame, warning: int = lag.WARNING_LAG, critical: int = lag.CRITICAL_LAG) -> DataFrame:
    """Commits whose lag is above a bound: a filter, so without state of its own."""
    return lag.lag_alerts(lags, warning, critical)
