"""Writing records to logs kept as files, one folder per topic, and reading them back."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidelog import schema
from tidelog.operators.indexing import rank_within
from tidelog.operators.replay import at_places
from tidelog.session import measured

PLACE = ["topic", "partition"]
#: Topics of a batch up to which the folders to read are named one by one.
MOST_TOPICS = 1000


def next_offsets(records: DataFrame, existing: DataFrame | None, order: Sequence[str]) -> DataFrame:
    """Offsets of new records: on from the last one of their partition, in ``order``."""
    ranked = rank_within(records, list(order), group=PLACE, name="__rank")
    if existing is None:
        return ranked.withColumn("offset", F.col("__rank")).drop("__rank")
    ends = measured(existing.groupBy(*PLACE).agg(F.max("offset").alias("__end")))
    placed = ranked.join(ends, PLACE, "left")
    after = F.coalesce(F.col("__end") + 1, F.lit(0).cast("bigint")) + F.col("__rank")
    return placed.withColumn("offset", after).drop("__rank", "__end")


def batch_records(records: DataFrame, topic: str) -> DataFrame:
    """A batch maps keys to messages, so each key goes out once, with its last message. As in a map, null
    is one key among others. Records that have not been published have no place of their own yet, so it is
    whole rows that are compared."""
    last = records.groupBy("key").agg(
        F.max_by(F.struct(*records.columns), F.struct("timestamp", "partition", "offset")).alias("row"))
    return last.select("row.*").withColumn("topic", F.lit(topic))


def deduplicated(records: DataFrame, correlation: Column) -> DataFrame:
    """One record per topic and correlation id, the first by time and position; records without an id are no
    copies of each other and all stay."""
    alone = F.when(F.col("__id").isNull(), F.struct("partition", "offset"))
    named = records.withColumn("__id", correlation).withColumn("__alone", alone)
    return at_places(named, ["topic", "__id", "__alone"], F.min).drop("__id", "__alone")


def committed(records: DataFrame, markers: DataFrame) -> DataFrame:
    """Records of transactions that have a commit marker (of the marked attempt, where there are several)."""
    by = [c for c in ("txn_id", "attempt") if c in markers.columns]
    return records.join(markers.select(*by), by, "left_semi")


# ---- files ------------------------------------------------------------------------------

def read_log(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """A log folder; filters on topic prune folders, those on offset and time row groups."""
    return spark.read.schema(schema.LOG).format(file_format).load(path)


def read_kafka(spark: SparkSession, servers: str, topics: str) -> DataFrame:
    """The same columns from a broker, where the Kafka package is on the class path."""
    raw = (
        spark.read.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("subscribe", topics).option("includeHeaders", "true")
        .option("startingOffsets", "earliest").load()
    )
    return raw.select("topic", "partition", "offset", F.col("key").cast("string").alias("key"),
                      F.col("value").cast("string").alias("value"), "headers", "timestamp")


def publish(records: DataFrame, path: str, order: Sequence[str] = ("timestamp", "key", "value"),
            mode: str = "append", file_format: str = "parquet") -> None:
    """Append records, with offsets that go on from what the folder holds. Rows are sorted
    by position inside each file, so that reading from an offset can skip row groups.

    ``order`` decides the offsets and must tell all records of a partition apart that differ; records
    that are equal in it may change places in a rerun. Only the folders of the topics that arrive are
    read for their end offsets. A batch written twice is appended twice.
    """
    spark = records.sparkSession
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    existing = None
    if files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(files):
        topics = [r.topic for r in records.select("topic").distinct().limit(MOST_TOPICS + 1).collect()]
        existing = read_log(spark, path, file_format)
        if len(topics) <= MOST_TOPICS:
            existing = existing.filter(F.col("topic").isin(topics))
    placed = next_offsets(records, existing, order)
    write_log(placed, path, mode, file_format)


def write_log(placed: DataFrame, path: str, mode: str = "append", file_format: str = "parquet") -> None:
    (placed.select("topic", "partition", "offset", "key", "value", "headers", "timestamp")
     .repartitionByRange(*PLACE, "offset").sortWithinPartitions(*PLACE, "offset")
     .write.mode(mode).partitionBy("topic").format(file_format).save(path))


def publish_batch(records: DataFrame, topic: str, path: str,
                  order: Sequence[str] = ("timestamp", "key", "value")) -> None:
    publish(batch_records(records, topic), path, order)


def publish_counts(records: DataFrame, error: Column) -> DataFrame:
    """Sent and failed records by topic and error."""
    return records.groupBy("topic", error.alias("error")).agg(F.count(F.lit(1)).alias("records"))


def publish_atomic(parts: Sequence[DataFrame], path: str, txn_id: str) -> None:
    """Records of several topics, all or nothing for readers of ``read_committed``.

    Every try writes to a folder of its own and then adds a marker that names it; the newest marker of a
    transaction counts. So a try that fails half-way changes nothing, also when an earlier one of the
    same transaction has been committed. ``clean_transactions`` removes what no marker names any more.
    """
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    attempt = uuid.uuid4().hex
    whole.drop("txn_id", "attempt").write.parquet(f"{path}/data/txn_id={txn_id}/attempt={attempt}")
    spark = whole.sparkSession
    spark.range(1).select(F.lit(attempt).alias("attempt"), F.current_timestamp().alias("committed_at")).write.mode(
        "append").parquet(f"{path}/markers/txn_id={txn_id}")


def markers(spark: SparkSession, path: str) -> DataFrame:
    """The attempt that counts of each committed transaction."""
    read = spark.read.schema("attempt string, committed_at timestamp, txn_id string").parquet(f"{path}/markers")
    return read.groupBy("txn_id").agg(F.max_by("attempt", F.struct("committed_at", "attempt")).alias("attempt"))


def read_committed(spark: SparkSession, path: str) -> DataFrame:
    records = spark.read.schema(f"{schema.LOG}, txn_id string, attempt string").parquet(f"{path}/data")
    return committed(records, measured(markers(spark, path))).drop("attempt")


def clean_transactions(spark: SparkSession, path: str) -> int:
    """Remove the data of attempts that a newer marker of their transaction has replaced; gives their number.
    Attempts without any marker stay: their writer may still be at work."""
    read = spark.read.schema("attempt string, committed_at timestamp, txn_id string").parquet(f"{path}/markers")
    old = read.select("txn_id", "attempt").distinct().join(markers(spark, path), ["txn_id", "attempt"], "left_anti")
    jvm, conf, removed = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    for row in old.toLocalIterator():
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/data/txn_id={row.txn_id}/attempt={row.attempt}")
        removed += bool(folder.getFileSystem(conf).delete(folder, True))
    return removed
