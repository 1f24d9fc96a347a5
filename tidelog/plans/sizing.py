"""Queries of the size family."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.operators import sizes
from tidelog.plans.registry import query
from tidelog.sources.derive import Tables

_CATEGORY = """CASE WHEN size < 1024 THEN 'SMALL' WHEN size < 102400 THEN 'MEDIUM'
  WHEN size < 1048576 THEN 'LARGE' ELSE 'OVERSIZED' END"""
_PATH = "CASE WHEN size < 1024 THEN 'small' WHEN size < 102400 THEN 'medium' ELSE 'large' END"
_ID = 'topic, p AS "partition", o AS "offset"'


def _scaled(divisor: int, unit: str) -> str:
    tenths = f"CAST(floor(size / {divisor}.0 * 10 + 0.5) AS BIGINT)"
    return f"({tenths} // 10) || '.' || ({tenths} % 10) || ' {unit}'"


_FORMAT = f"""CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN {_scaled(1024, 'KB')}
  WHEN size < 1073741824 THEN {_scaled(1048576, 'MB')} ELSE {_scaled(1073741824, 'GB')} END"""


@query("record_size", "sized", f"SELECT {_ID}, size FROM sized")
def record_size(t: Tables):
    return t.payloads().select("topic", "partition", "offset", sizes.record_size().alias("size"))


@query("size_stats", "sized", """SELECT topic, count(*) AS messages,
  CAST(sum(size) AS BIGINT) AS total_bytes, CAST(sum(size) AS DOUBLE) / count(*) AS average_size,
  max(size) AS max_size, min(size) AS min_size FROM sized GROUP BY topic""")
def size_stats(t: Tables):
    return sizes.size_stats(t.payloads(), "topic")


@query("batch_size", "logs", """SELECT topic, p AS "partition", o // 500 AS batch,
  count(*) AS messages, CAST(sum(coalesce(strlen(value), 0) + 30) + 50 AS BIGINT) AS batch_bytes
  FROM logs GROUP BY ALL""")
def batch_size(t: Tables):
    return sizes.batch_sizes(t.all_logs())


@query("micro_batches", "logs", """SELECT topic, p AS "partition", o // 500 AS batch,
  count(*) AS messages, min(o) AS first_offset, max(o) AS last_offset FROM logs GROUP BY ALL""")
def micro_batches(t: Tables):
    return sizes.micro_batches(t.all_logs()).groupBy("topic", "partition", "batch").agg(
        F.count(F.lit(1)).alias("messages"), F.min("offset").alias("first_offset"),
        F.max("offset").alias("last_offset"))


@query("size_category", "sized",
       f"SELECT topic, {_CATEGORY} AS category, count(*) AS messages FROM sized GROUP BY ALL")
def size_category(t: Tables):
    return sizes.category_counts(t.payloads(), "topic")


@query("size_histogram", "sized", """SELECT topic, count(*) FILTER (size <= 1024) AS le_1024,
  count(*) FILTER (size <= 10240) AS le_10240, count(*) FILTER (size <= 102400) AS le_102400,
  count(*) FILTER (size <= 1048576) AS le_1048576, count(*) AS le_inf FROM sized GROUP BY topic""")
def size_histogram(t: Tables):
    return sizes.size_histogram(t.payloads(), "topic")


@query("batch_size_histogram", "sized", """SELECT topic, count(*) FILTER (b <= 10240) AS le_10240,
  count(*) FILTER (b <= 102400) AS le_102400, count(*) FILTER (b <= 1048576) AS le_1048576,
  count(*) FILTER (b <= 10485760) AS le_10485760, count(*) AS le_inf
  FROM (SELECT topic, sum(strlen(value) + 30) + 50 AS b FROM sized GROUP BY topic, p, o // 500) GROUP BY topic""")
def batch_size_histogram(t: Tables):
    batches = sizes.batch_sizes(t.payloads())
    return sizes.size_histogram(batches, "topic", size=F.col("batch_bytes"), bounds=sizes.BATCH_BUCKETS)


_SUMMARY = f"""SELECT count(*) AS messages, CAST(sum(size) AS BIGINT) AS total_bytes,
  CAST(sum(size) AS DOUBLE) / count(*) AS average_size, max(size) AS max_size, min(size) AS min_size,
  count(*) FILTER ({_CATEGORY} = 'SMALL') AS small_messages,
  count(*) FILTER ({_CATEGORY} = 'MEDIUM') AS medium_messages,
  count(*) FILTER ({_CATEGORY} = 'LARGE') AS large_messages,
  count(*) FILTER ({_CATEGORY} = 'OVERSIZED') AS oversized_messages,
  CAST(sum(size) AS DOUBLE) / count(*) AS average_record_size,
  (SELECT CAST(sum(b) AS DOUBLE) / count(*) FROM (SELECT sum(strlen(value) + 30) + 50 AS b
     FROM sized GROUP BY topic, p, o // 500)) AS average_batch_size FROM sized"""


@query("size_summary", "sized", _SUMMARY)
def size_summary(t: Tables):
    return sizes.size_summary(t.payloads())


@query("size_recommendations", "sized notifications_log", f"""SELECT unnest(list_filter([
  CASE WHEN max(size) >= 1048576 THEN '{sizes.MANY_OVERSIZED}' END,
  CASE WHEN avg(size) > 102400 THEN '{sizes.LARGE_AVERAGE}' END,
  CASE WHEN count(*) FILTER (size < 1024) > count(*) * 0.8 THEN '{sizes.MANY_SMALL}' END],
  lambda x: x IS NOT NULL)) AS recommendation
  FROM (SELECT size FROM sized
    UNION ALL SELECT strlen(key) + strlen(value) + 30 FROM notifications_log)""")
def size_recommendations(t: Tables):
    rows = t.payloads().unionByName(t.notifications_log())
    return sizes.size_recommendations(sizes.size_summary(rows))


@query("batch_throughput", "sized", """SELECT topic, "partition", batch, messages, total_bytes,
  span_ms, CASE WHEN span_ms = 0 THEN total_bytes ELSE total_bytes * 1000 // span_ms END
    AS bytes_per_second
  FROM (SELECT topic, p AS "partition", o // 500 AS batch, count(*) AS messages,
    CAST(sum(size) AS BIGINT) AS total_bytes, (epoch_us(max(ts)) // 1000) - (epoch_us(min(ts)) // 1000) AS span_ms
    FROM sized GROUP BY ALL)""")
def batch_throughput(t: Tables):
    return sizes.batch_throughput(t.payloads())


@query("size_timing", "sized", f"""SELECT {_PATH} AS path, count(*) AS calls,
  CAST(sum(strlen(value) // 50) AS BIGINT) AS total_ms, max(strlen(value) // 50) AS max_ms,
  CAST(sum(strlen(value) // 50) AS DOUBLE) / count(*) AS mean_ms FROM sized GROUP BY ALL""")
def size_timing(t: Tables):
    # the tables hold no durations; one millisecond per 50 bytes stands in
    return sizes.size_timing(t.payloads(), F.expr("octet_length(value) div 50"))


@query("format_size", "sized", f"SELECT {_ID}, {_FORMAT} AS formatted FROM sized")
def format_size(t: Tables):
    return t.payloads().select(
        "topic", "partition", "offset", sizes.format_size(sizes.record_size()).alias("formatted"))


@query("size_route", "sized",
       f"SELECT {_ID}, size, {_PATH} AS path, size > 1048576 AS oversized_warning FROM sized")
def size_route(t: Tables):
    return sizes.size_route(t.payloads()).select(
        "topic", "partition", "offset", "size", "path", "oversized_warning")


@query("size_suggestions", "sized", f"""SELECT {_ID}, CASE
  WHEN size > 1048576 THEN '{'; '.join(sizes.OVERSIZED_ADVICE)}'
  WHEN size > 102400 THEN '{'; '.join(sizes.LARGE_ADVICE)}'
  WHEN size < 100 THEN '{'; '.join(sizes.TINY_ADVICE)}' ELSE '' END AS suggestions FROM sized""")
def size_suggestions(t: Tables):
    return t.payloads().select(
        "topic", "partition", "offset",
        F.array_join(sizes.suggestions(sizes.record_size()), "; ").alias("suggestions"))


@query("split_chunks", "payloads", """SELECT topic, p AS "partition", o AS "offset", message_id,
  CAST(total_chunks AS INTEGER) AS total_chunks, CAST(chunk AS INTEGER) AS chunk,
  CAST(least(65536, bytes - chunk * 65536) AS INTEGER) AS chunk_bytes
  FROM (SELECT *, unnest(range(0, total_chunks)) AS chunk
    FROM (SELECT topic, p, o, topic || ':' || p || ':' || o AS message_id, strlen(value) AS bytes,
            (strlen(value) + 65535) // 65536 AS total_chunks FROM payloads))""")
def split_chunks(t: Tables):
    mid = F.concat_ws(":", "topic", "partition", "offset")
    chunks = sizes.split_chunks(t.payloads(), mid)
    return chunks.withColumn("chunk_bytes", F.octet_length("data")).drop("data")


@query("generate_messages", "orders_log", """SELECT k AS id, strlen(head) + fill + 2 AS bytes,
  md5(head || substr(repeat('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(fill // 26 + 1 AS BIGINT)), 1,
    CAST(fill AS BIGINT)) || '"}') AS digest
  FROM (SELECT k, head, greatest(0, 100 + k % 900 - (strlen(head) + 2)) AS fill
    FROM (SELECT k, '{"id":' || k || ',"timestamp":' || (epoch_us(ts) // 1000) || ',"data":"' AS head
          FROM orders_log))""")
def generate_messages(t: Tables):
    """One generated message per order, sizes between 100 and 999 bytes."""
    k = F.col("offset") * 3 + F.col("partition")
    rows = t.orders_log().select(k.alias("id"), F.unix_millis("timestamp").alias("at"))
    made = rows.withColumn(
        "text", sizes.generated_message(F.lit(100) + F.col("id") % 900, F.col("id"), F.col("at")))
    return made.select("id", F.octet_length("text").cast("bigint").alias("bytes"),
                       F.md5("text").alias("digest"))
