"""Dead-letter logs: browsing, reprocessing, retention and analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidelog.functions.headers import add_headers, header, header_map, has_header, last_header, no_headers
from tidelog.functions.text import instant_text
from tidelog.operators.sizes import record_size

# Name parts, retention and alert bounds.
DLT_PARTS = [".dlt", ".poison-pill"]
RETENTION_DAYS = 7
CRITICAL_MESSAGES = 10000
PROBLEM_MESSAGES = 100
TOP = 10


def _now(as_of) -> Column:
    return F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")


def is_dlt_topic(topic: Column) -> Column:
    return topic.contains(DLT_PARTS[0]) | topic.contains(DLT_PARTS[1])


def dlt_topics(df: DataFrame) -> DataFrame:
    return df.filter(is_dlt_topic(F.col("topic"))).select("topic").distinct()


def original_topic(by_name: bool = False) -> Column:
    """Topic a dead letter came from: its header, else the name up to the first ``.dlt``
    (which for ``orders-topic.validation.dlt`` is not a real topic)."""
    name = F.when(F.col("topic").contains(".dlt"), F.substring_index("topic", ".dlt", 1))
    return name if by_name else F.coalesce(last_header(F.col("headers"), "dlt.original-topic"), name)


def dlt_browse(dlt: DataFrame, topic: str, limit: int, match: Column | None = None) -> DataFrame:
    """The first ``limit`` matching records, headers as a map."""
    rows = dlt.filter(F.col("topic") == topic)
    if match is not None:
        rows = rows.filter(match)
    return rows.orderBy("partition", "offset").limit(limit).withColumn("headers", header_map(F.col("headers")))


def classify(dlt: DataFrame, match: Column | None = None, limit: int = 0) -> DataFrame:
    """``status`` per record of one dead-letter topic: SKIPPED_FILTER, SKIPPED_INVALID (no
    enhanced headers) or REPROCESSED. With a ``limit`` reading stops after that many
    reprocessed records in (partition, offset) order; what follows is NOT_REACHED."""
    chosen = F.lit(True) if match is None else match
    status = F.when(~chosen, "SKIPPED_FILTER").when(
        ~has_header(F.col("headers"), "dlt.enhanced.version"), "SKIPPED_INVALID").otherwise("REPROCESSED")
    rows = dlt.withColumn("status", status)
    if limit <= 0:
        return rows
    place = F.struct("partition", "offset")
    taken = rows.filter("status = 'REPROCESSED'").select("partition", "offset").orderBy(
        "partition", "offset").limit(limit)
    end = taken.agg(F.when(F.count(F.lit(1)) == limit, F.max(place)).alias("end")).scalar()
    beyond = F.coalesce(place > end, F.lit(False))
    return rows.withColumn("status", F.when(beyond, "NOT_REACHED").otherwise(F.col("status")))


def reprocessed(classified: DataFrame, as_of=None, by_name: bool = False) -> DataFrame:
    """New records for the original topics. They carry three headers of their own only;
    partition and offset are given by the sink."""
    fresh = add_headers(
        no_headers(), header("dlt.reprocessed", F.lit("true")),
        header("dlt.reprocessed.timestamp", instant_text(_now(as_of))),
        header("dlt.original.topic", F.col("topic")))
    return classified.filter("status = 'REPROCESSED'").select(
        original_topic(by_name).alias("topic"), "key", "value", fresh.alias("headers"),
        _now(as_of).alias("timestamp"), F.col("partition").alias("source_partition"),
        F.col("offset").alias("source_offset"))


def reprocess_summary(classified: DataFrame, *by: str) -> DataFrame:
    return classified.groupBy(*by).agg(
        F.count_if(F.col("status") == "REPROCESSED").alias("processed"),
        F.count_if(F.col("status").startswith("SKIPPED")).alias("skipped"))


def retained(dlt: DataFrame, as_of=None, days: int = RETENTION_DAYS) -> DataFrame:
    return dlt.filter(F.col("timestamp") >= _now(as_of) - F.expr(f"INTERVAL {days} DAYS"))


def retention_report(dlt: DataFrame, as_of=None, days: int = RETENTION_DAYS) -> DataFrame:
    old = F.col("timestamp") < _now(as_of) - F.expr(f"INTERVAL {days} DAYS")
    return dlt.groupBy("topic").agg(F.count_if(old).alias("deleted"), F.count_if(~old).alias("kept"))


def topic_stats(dlt: DataFrame) -> DataFrame:
    return dlt.groupBy("topic").agg(
        F.count(F.lit(1)).alias("messages"), F.sum(record_size()).alias("size_bytes"),
        F.max("timestamp").alias("last_activity"))


def active_stats(stats: DataFrame, active: DataFrame) -> DataFrame:
    """Statistics of topics that still exist."""
    return stats.join(active.select("topic").distinct(), "topic", "left_semi")


def top_topics(stats: DataFrame, n: int | None = TOP) -> DataFrame:
    """The ``n`` fullest topics, or all of them for None."""
    ordered = stats.orderBy(F.desc("messages"), "topic")
    return ordered if n is None else ordered.limit(n)


def problem_topics(stats: DataFrame, threshold: int = PROBLEM_MESSAGES, n: int | None = TOP) -> DataFrame:
    """Of the ``n`` fullest topics (None: of all), those with at least ``threshold`` messages."""
    return top_topics(stats, n).filter(F.col("messages") >= threshold)


def error_types(dlt: DataFrame) -> DataFrame:
    name = F.coalesce(last_header(F.col("headers"), "dlt.exception-class"),
                      last_header(F.col("headers"), "dlt-exception-class"))
    return dlt.groupBy(name.alias("error_type")).agg(F.count(F.lit(1)).alias("errors"))


def top_errors(types: DataFrame, n: int = TOP) -> DataFrame:
    return types.orderBy(F.desc("errors"), "error_type").limit(n)


def overview(stats: DataFrame, critical: int = CRITICAL_MESSAGES) -> DataFrame:
    """All dead-letter topics in one row."""
    total = F.coalesce(F.sum("messages"), F.lit(0).cast("bigint"))
    return stats.agg(
        F.count(F.lit(1)).alias("topics"), total.alias("messages"),
        F.coalesce(F.sum("size_bytes"), F.lit(0).cast("bigint")).alias("size_bytes"),
        F.count_if(F.col("messages") > critical).alias("critical_topics"),
        F.coalesce(F.floor(F.sum("messages") / F.count(F.lit(1))), F.lit(0)).cast("bigint")
        .alias("average_messages"),
        F.min("last_activity").alias("oldest_activity"), F.max("last_activity").alias("newest_activity"))
