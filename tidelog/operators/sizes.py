"""Byte sizes of records and batches: measures, classes, statistics, throughput, advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Per-record, per-header and per-batch overhead, class bounds, bucket bounds.
RECORD_OVERHEAD = 30
HEADER_OVERHEAD = 8
BATCH_OVERHEAD = 50
KIB = 1024
SMALL_BELOW = 1 * KIB
MEDIUM_BELOW = 100 * KIB
LARGE_BELOW = 1024 * KIB
TINY_BELOW = 100
RECORD_BUCKETS = [1024, 10240, 102400, 1048576]
BATCH_BUCKETS = [10240, 102400, 1048576, 10485760]
POLL_SIZE = 500
CHUNK_BYTES = 65536

# Advice texts.
OVERSIZED_ADVICE = [
    "Consider message compression",
    "Split large messages into smaller chunks",
    "Use external storage with message references",
]
LARGE_ADVICE = ["Consider enabling compression", "Review if all fields are necessary"]
TINY_ADVICE = ["Consider batching small messages"]
MANY_OVERSIZED = "High number of oversized messages detected - consider optimization"
LARGE_AVERAGE = "Large average message size - enable compression"
MANY_SMALL = "Many small messages - consider batching"


def value_size(value: Column) -> Column:
    return F.coalesce(F.octet_length(value), F.lit(0)).cast("bigint")


def headers_size(headers: Column) -> Column:
    def one(total: Column, h: Column) -> Column:
        body = F.coalesce(F.octet_length(h["value"]), F.lit(0))
        return total + F.octet_length(h["key"]) + body + F.lit(HEADER_OVERHEAD)

    folded = F.aggregate(headers, F.lit(0).cast("bigint"), one)
    return F.coalesce(folded, F.lit(0).cast("bigint"))


def record_size() -> Column:
    return (
        value_size(F.col("key")) + value_size(F.col("value"))
        + headers_size(F.col("headers")) + F.lit(RECORD_OVERHEAD)
    )


def with_size(df: DataFrame) -> DataFrame:
    return df.withColumn("size", record_size())


def batch_number(poll_size: int = POLL_SIZE) -> Column:
    """A batch is one poll: the next ``poll_size`` offsets of a partition."""
    return F.expr(f"offset div {poll_size}")


def micro_batches(df: DataFrame, poll_size: int = POLL_SIZE) -> DataFrame:
    return df.withColumn("batch", batch_number(poll_size))


def size_category(size: Column) -> Column:
    return (
        F.when(size < SMALL_BELOW, "SMALL").when(size < MEDIUM_BELOW, "MEDIUM")
        .when(size < LARGE_BELOW, "LARGE").otherwise("OVERSIZED")
    )


def size_path(size: Column) -> Column:
    """Processing path: large and oversized records go the same way."""
    return F.when(size < SMALL_BELOW, "small").when(size < MEDIUM_BELOW, "medium").otherwise("large")


def size_route(df: DataFrame) -> DataFrame:
    size = F.col("size")
    return with_size(df).withColumn("path", size_path(size)).withColumn(
        "oversized_warning", size > LARGE_BELOW)


def format_size(size: Column) -> Column:
    def scaled(power: int, unit: str) -> Column:
        return F.format_string(f"%.1f {unit}", size / F.lit(float(KIB**power)))

    return (
        F.when(size < KIB, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < KIB**2, scaled(1, "KB")).when(size < KIB**3, scaled(2, "MB"))
        .otherwise(scaled(3, "GB"))
    )


def _stats(size: Column) -> list[Column]:
    zero = F.lit(0).cast("bigint")
    return [
        F.count(size).alias("messages"),
        F.coalesce(F.sum(size), zero).alias("total_bytes"),
        F.coalesce(F.sum(size) / F.count(size), F.lit(0.0)).alias("average_size"),
        F.coalesce(F.max(size), zero).alias("max_size"),
        F.coalesce(F.min(size), zero).alias("min_size"),
    ]


def _categories(size: Column) -> list[Column]:
    return [
        F.count_if(size_category(size) == name).alias(f"{name.lower()}_messages")
        for name in ("SMALL", "MEDIUM", "LARGE", "OVERSIZED")
    ]


def size_stats(df: DataFrame, *by: str) -> DataFrame:
    return with_size(df).groupBy(*by).agg(*_stats(F.col("size")))


def batch_sizes(df: DataFrame, poll_size: int = POLL_SIZE) -> DataFrame:
    """Bytes of each batch: values with record overhead, plus the batch's own."""
    return micro_batches(df, poll_size).groupBy("topic", "partition", "batch").agg(
        F.count(F.lit(1)).alias("messages"),
        (F.sum(value_size(F.col("value")) + RECORD_OVERHEAD) + BATCH_OVERHEAD).alias("batch_bytes"),
    )


def category_counts(df: DataFrame, *by: str) -> DataFrame:
    return with_size(df).groupBy(*by, size_category(F.col("size")).alias("category")).agg(
        F.count(F.lit(1)).alias("messages"))


def size_histogram(df: DataFrame, *by: str, size: Column | None = None,
                   bounds: list[int] = RECORD_BUCKETS) -> DataFrame:
    """Cumulative counts: how many records are no larger than each bound."""
    size = record_size() if size is None else size
    return df.groupBy(*by).agg(
        *[F.count_if(size <= b).alias(f"le_{b}") for b in bounds], F.count(size).alias("le_inf"))


def size_summary(df: DataFrame, poll_size: int = POLL_SIZE) -> DataFrame:
    """Statistics, class counts and mean batch size in one row: batches are aggregated
    first and their partial results combined, so the log is read once."""
    size = F.col("size")
    batches = micro_batches(with_size(df), poll_size).groupBy("topic", "partition", "batch").agg(
        *_stats(size), *_categories(size),
        (F.sum(value_size(F.col("value")) + RECORD_OVERHEAD) + BATCH_OVERHEAD).alias("batch_bytes"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("bigint"))
    mean = F.coalesce(F.sum("total_bytes") / F.sum("messages"), F.lit(0.0))
    return batches.agg(
        total("messages").alias("messages"), total("total_bytes").alias("total_bytes"),
        mean.alias("average_size"), F.coalesce(F.max("max_size"), F.lit(0)).alias("max_size"),
        F.coalesce(F.min("min_size"), F.lit(0)).alias("min_size"),
        *[total(f"{c}_messages").alias(f"{c}_messages")
          for c in ("small", "medium", "large", "oversized")],
        mean.alias("average_record_size"),
        F.coalesce(F.sum("batch_bytes") / F.count("batch_bytes"), F.lit(0.0)).alias("average_batch_size"),
    )


def batch_throughput(df: DataFrame, poll_size: int = POLL_SIZE) -> DataFrame:
    """Bytes per second of each batch, from the time its records span."""
    span = F.unix_millis(F.max("timestamp")) - F.unix_millis(F.min("timestamp"))
    totals = micro_batches(with_size(df), poll_size).groupBy("topic", "partition", "batch").agg(
        F.count(F.lit(1)).alias("messages"), F.sum("size").alias("total_bytes"),
        span.alias("span_ms"),
    )
    return totals.withColumn("bytes_per_second", bytes_per_second())


def bytes_per_second() -> Column:
    return F.when(F.col("span_ms") == 0, F.col("total_bytes")).otherwise(
        F.expr("total_bytes * 1000 div nullif(span_ms, 0)"))


def size_timing(df: DataFrame, duration_ms: Column) -> DataFrame:
    rows = with_size(df).select(size_path(F.col("size")).alias("path"), duration_ms.alias("ms"))
    return rows.groupBy("path").agg(
        F.count("ms").alias("calls"), F.sum("ms").alias("total_ms"), F.max("ms").alias("max_ms"),
        (F.sum("ms") / F.count("ms")).alias("mean_ms"))


def suggestions(size: Column) -> Column:
    def texts(lines: list[str]) -> Column:
        return F.array(*[F.lit(x) for x in lines])

    return (
        F.when(size > LARGE_BELOW, texts(OVERSIZED_ADVICE))
        .when(size > MEDIUM_BELOW, texts(LARGE_ADVICE))
        .when(size < TINY_BELOW, texts(TINY_ADVICE))
        .otherwise(F.array().cast("array<string>"))
    )


def size_recommendations(summary: DataFrame) -> DataFrame:
    """One row per piece of advice that the summary row gives rise to."""
    advice = F.array_compact(F.array(
        F.when(F.col("oversized_messages") > 0, MANY_OVERSIZED),
        F.when(F.col("average_record_size") > MEDIUM_BELOW, LARGE_AVERAGE),
        F.when(F.col("small_messages") > F.col("messages") * 0.8, MANY_SMALL),
    ))
    return summary.select(F.explode(advice).alias("recommendation"))


def split_chunks(df: DataFrame, message_id: Column, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Large values as numbered byte chunks; an empty or null value has none. A value is encoded once and
    cut once, so the work grows with its size."""
    total = F.ceil(F.octet_length("value") / chunk_bytes).cast("int")
    cut = df.select("topic", "partition", "offset", message_id.alias("message_id"),
                    total.alias("total_chunks"), F.encode(F.col("value"), "UTF-8").alias("__raw")).filter("total_chunks > 0")
    begins = F.sequence(F.lit(0), F.col("total_chunks") - 1)
    pieces = F.get(F.transform(F.array("__raw"), lambda raw: F.transform(
        begins, lambda k: F.substring(raw, k * chunk_bytes + 1, F.lit(chunk_bytes)))), F.lit(0))
    return cut.select("topic", "partition", "offset", "message_id", "total_chunks",
                      F.posexplode(pieces).alias("chunk", "data"))


# The shape of a generated message.
GENERATED_PREFIX = ['{"id":', ',"timestamp":', ',"data":"']
GENERATED_SUFFIX = '"}'
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def generated_message(target: Column, index: Column, at_ms: Column) -> Column:
    """A JSON message of ``target`` bytes (longer only if its frame alone is)."""
    first, second, third = GENERATED_PREFIX
    head = F.concat(F.lit(first), index.cast("string"), F.lit(second), at_ms.cast("string"),
                    F.lit(third))
    fill = F.greatest(F.lit(0), target - (F.octet_length(head) + 2)).cast("int")
    repeats = F.ceil(fill / len(ALPHABET)).cast("int")
    body = F.substr(F.repeat(F.lit(ALPHABET), repeats), F.lit(1), fill)
    return F.concat(head, body, F.lit(GENERATED_SUFFIX))


def generate_messages(spark, size: int, count: int, topic: str, at_ms: int = 0) -> DataFrame:
    """Test records ``test-key-0`` ... of one size; ``count`` rows spread over the cluster."""
    index = F.col("id")
    return spark.range(count).select(
        F.lit(topic).alias("topic"), F.concat(F.lit("test-key-"), index).alias("key"),
        generated_message(F.lit(size), index, F.lit(at_ms)).alias("value"))
