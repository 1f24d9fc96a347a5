"""Streams of log records, and running a stream over everything there is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidelog import schema
from tidelog.session import use_utc

WATERMARK = "10 minutes"


def read_stream(spark: SparkSession, path: str, layout: str = schema.LOG, files_per_trigger: int = 100,
                file_format: str = "parquet") -> DataFrame:
    """New files of a log folder. The number of files per trigger bounds a micro-batch."""
    reader = use_utc(spark).readStream.schema(layout).format(file_format)
    return reader.option("maxFilesPerTrigger", files_per_trigger).load(path)


def read_kafka_stream(spark: SparkSession, servers: str, topics: str, offsets_per_trigger: int = 1_000_000) -> DataFrame:
    """The same columns from a broker, where the Kafka package is on the class path."""
    raw = (
        use_utc(spark).readStream.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("subscribe", topics).option("includeHeaders", "true")
        .option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", offsets_per_trigger).load()
    )
    return raw.selectExpr("topic", "partition", "offset", "cast(key as string) as key",
                          "cast(value as string) as value", "headers", "timestamp")


def run_available(df: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None],
                  mode: str = "append") -> StreamingQuery:
    """Process what is there now, one micro-batch after the other, and stop."""
    query = (
        df.writeStream.outputMode(mode).foreachBatch(handle)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def write_files(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append-mode results as files; the file sink writes each micro-batch exactly once."""
    query = (
        df.writeStream.outputMode("append").format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query
