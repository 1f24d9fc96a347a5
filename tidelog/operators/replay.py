"""Reading a log again from chosen positions, and keeping only the newest per key.

Start positions are one row per topic partition. They are measured first, so that joining
them does not shuffle the log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tidelog.session import measured

PLACE = ["topic", "partition"]


def _now(as_of) -> Column:
    return F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")


def from_starts(df: DataFrame, starts: DataFrame) -> DataFrame:
    """Records at or after ``start`` of their partition; partitions without one are left out."""
    begun = df.join(measured(starts.select(*PLACE, "start")), PLACE)
    return begun.filter(F.col("offset") >= F.col("start")).select(*df.columns)


def replay_offset(df: DataFrame, topic: str, partition: int, offset: int) -> DataFrame:
    """All three conditions reach the scan of the log files."""
    return df.filter((F.col("topic") == topic) & (F.col("partition") == partition)
                     & (F.col("offset") >= offset))


def timestamp_starts(df: DataFrame, at: Column) -> DataFrame:
    """Earliest offset at or after a time; partitions without one start at their end."""
    return df.filter(F.col("timestamp") >= at).groupBy(*PLACE).agg(F.min("offset").alias("start"))


def replay_timestamp(df: DataFrame, at) -> DataFrame:
    moment = at if isinstance(at, Column) else F.lit(at).cast("timestamp")
    return from_starts(df, timestamp_starts(df, moment))


def replay_time_ago(df: DataFrame, ago: str, as_of=None) -> DataFrame:
    return replay_timestamp(df, _now(as_of) - F.expr(f"INTERVAL {ago}"))


def replay_beginning(df: DataFrame) -> DataFrame:
    return df


def replay_end(df: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """What comes after the end of the log as it is (or as ``ends`` has it)."""
    if ends is None:
        ends = df.groupBy(*PLACE).agg(F.max("offset").alias("end"))
    return from_starts(df, ends.withColumn("start", F.col("end") + 1))


def replay_relative(df: DataFrame, positions: DataFrame, delta: int) -> DataFrame:
    """From the present ``position`` of each partition, moved either way."""
    moved = F.greatest(F.col("position") + delta, F.lit(0).cast("bigint"))
    return from_starts(df, positions.withColumn("start", moved))


def replay_conditional(df: DataFrame, trigger: Column, target: str, value=None) -> DataFrame:
    """The earliest record that meets ``trigger`` decides where its partition starts again:
    target OFFSET, TIMESTAMP, BEGINNING, END or RELATIVE to the record."""
    first = df.filter(trigger).groupBy(*PLACE).agg(F.min("offset").alias("hit"))
    if target == "OFFSET":
        starts = first.withColumn("start", F.lit(value).cast("bigint"))
    elif target == "RELATIVE":
        starts = first.withColumn("start", F.col("hit") + value)
    elif target == "BEGINNING":
        starts = first.withColumn("start", F.lit(0).cast("bigint"))
    elif target == "TIMESTAMP":
        found = timestamp_starts(df, F.lit(value).cast("timestamp"))
        starts = found.join(first.select(*PLACE), PLACE, "left_semi")
    elif target == "END":
        ends = df.groupBy(*PLACE).agg((F.max("offset") + 1).alias("start"))
        starts = ends.join(first.select(*PLACE), PLACE, "left_semi")
    else:
        raise ValueError(f"unknown target {target}")
    return from_starts(df, starts)


def compact_latest(df: DataFrame) -> DataFrame:
    """Newest record of each key; records without key are not compacted away.

    Only keys, places and times are aggregated (combining before the shuffle, so a hot key
    sends one row per task); the values of the winners are then picked by their places.
    """
    return at_places(df.filter(F.col("key").isNotNull()), ["topic", "key"], F.max).unionByName(
        df.filter(F.col("key").isNull()))


def compacted(df: DataFrame, as_of=None, delay_hours: int = 24) -> DataFrame:
    """The newest record of each key. A null value deletes its key: it stays itself for ``delay_hours``, so that
    those who follow the log see it, and then goes. Records without key stay."""
    now = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    gone = F.col("key").isNotNull() & F.col("value").isNull() & (
        F.col("timestamp") < now - F.make_interval(hours=F.lit(delay_hours)))
    return compact_latest(df).filter(~gone)


def at_places(df: DataFrame, by: list[str], best: Callable[[Column], Column]) -> DataFrame:
    """The first or last record (``best`` is min or max of time, partition, offset) per group."""
    winners = df.groupBy(*by).agg(best(F.struct("timestamp", "partition", "offset")).alias("w"))
    places = measured(winners.select("topic", "w.partition", "w.offset"))
    return df.join(places, [*PLACE, "offset"], "left_semi").select(*df.columns)


def topic_catalog(df: DataFrame) -> DataFrame:
    """Partitions of each topic with first and next offset, records and time span."""
    return df.groupBy(*PLACE).agg(
        F.min("offset").alias("first_offset"), (F.max("offset") + 1).alias("end_offset"),
        F.count(F.lit(1)).alias("records"), F.min("timestamp").alias("first_time"),
        F.max("timestamp").alias("last_time"))
