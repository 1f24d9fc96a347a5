"""Windowed aggregates with a watermark.

Records later than the watermark are dropped by Spark. In append mode a window is written
once the watermark has passed its end, so the newest windows are held back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidelog.operators import errors, filters, sizes
from tidelog.streaming.reading import WATERMARK


def timed(df: DataFrame, time: str = "timestamp", watermark: str = WATERMARK) -> DataFrame:
    return df.withWatermark(time, watermark)


def windowed_counts(df: DataFrame, *by: str | Column, time: str = "timestamp", window: str = "1 minute",
                    slide: str | None = None, watermark: str = WATERMARK) -> DataFrame:
    grouped = timed(df, time, watermark).groupBy(F.window(time, window, slide or window).alias("w"), *by)
    counted = grouped.agg(F.count(F.lit(1)).alias("records"))
    return counted.select(F.col("w.start").alias("start"), *[c for c in counted.columns if c not in ("w",)])


def reason_counts(df: DataFrame, as_of=None, window: str = "1 minute") -> DataFrame:
    """Dropped and kept records per window, topic and reason."""
    reason = F.coalesce(filters.composite_reason(as_of), F.lit("KEEP")).alias("reason")
    return windowed_counts(df, "topic", reason, window=window)


def size_stats(df: DataFrame, window: str = "1 minute") -> DataFrame:
    sized = timed(sizes.with_size(df)).groupBy(F.window("timestamp", window).alias("w"), "topic").agg(
        F.count("size").alias("messages"), F.sum("size").alias("total_bytes"),
        F.max("size").alias("max_size"), F.min("size").alias("min_size"))
    return sized.select(F.col("w.start").alias("start"), "topic", "messages", "total_bytes", "max_size", "min_size")


def error_counts(failures: DataFrame, window: str = "1 minute") -> DataFrame:
    counted = timed(failures, "failed_at").groupBy(F.window("failed_at", window).alias("w"), "topic").agg(
        F.count_if(errors.is_class(errors.VALIDATION)).alias("validation_errors"),
        F.count_if(errors.is_class(errors.NON_RECOVERABLE)).alias("non_recoverable_errors"),
        F.count_if(errors.is_class(errors.RECOVERABLE)).alias("recoverable_errors"))
    return counted.select(F.col("w.start").alias("start"), "topic", "validation_errors",
                          "non_recoverable_errors", "recoverable_errors")


def hot_partitions(df: DataFrame, threshold: int) -> DataFrame:
    return windowed_counts(df, "topic", "partition", window="1 second").filter(F.col("records") > threshold)


def limited_counts(failures: DataFrame, limit: int) -> DataFrame:
    """How many failures of a topic minute the limit held back."""
    counted = windowed_counts(failures, "topic", time="failed_at")
    return counted.filter(F.col("records") > limit).withColumn("limited", F.col("records") - limit)


def compact_latest(df: DataFrame) -> DataFrame:
    """Newest record per key, for update or complete mode."""
    newest = df.filter(F.col("key").isNotNull()).groupBy("topic", "key").agg(
        F.max_by(F.struct(*df.columns), F.struct("timestamp", "partition", "offset")).alias("row"))
    return newest.select("row.*")


def deduplicated(df: DataFrame, correlation: Column, watermark: str = WATERMARK) -> DataFrame:
    """One record per topic and correlation id within the watermark delay; records without an id all stay."""
    named = timed(df.withColumn("correlation_id", correlation), watermark=watermark)
    once = named.filter(F.col("correlation_id").isNotNull()).dropDuplicatesWithinWatermark(["topic", "correlation_id"])
    return once.union(named.filter(F.col("correlation_id").isNull()))
