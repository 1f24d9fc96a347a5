"""Appending to a log exactly once, also from a stream and from several writers.

A batch is written to a folder of its own, with it the end offset of every partition as it is then, and at last a small
marker file is put in its place under the next version number, which fails if there is one already. What no marker
names does not exist for readers. So a crash on the way changes nothing; a batch that comes again is known by
its writer's last batch; of two writers the later one starts anew from what the other has left. Offsets go on from
the ends of the last version: the history is never read. The marker is put in place by a rename that does not
overwrite, as file systems of clusters and disks have it; plain object stores do not.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidelog import schema
from tidelog.operators.indexing import rank_within
from tidelog.session import durable, measured
from tidelog.sources.sinks import PLACE, batch_records

ENDS = "topic string, partition int, end bigint"
WRITERS = "writer string, batch bigint"
#: Digits of a version in the name of its marker, so that names sort as numbers do.
DIGITS = 18


class Files:
    """The few calls on the folder's file system that Spark's readers and writers do not have."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, path.rstrip("/")
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.options = spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def names(self, folder: str) -> list[str]:
        path = self.at(folder)
        files = path.getFileSystem(self.conf)
        return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []

    def version(self, number: int) -> str:
        return f"{number:0{DIGITS}d}"

    def partition(self, column: str, value: str) -> str:
        """The folder of a value of a partition column."""
        return f"{column}={self.jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)}"

    def delete(self, name: str) -> bool:
        return bool(self.at(name).getFileSystem(self.conf).delete(self.at(name), True))

    def put(self, name: str, content: str) -> bool:
        """A file of this name with that line, whole or not at all, unless there is one."""
        new = self.at(f"_new-{uuid.uuid4().hex}")
        out = new.getFileSystem(self.conf).create(new, True)
        out.writeBytes(f"{content}\n")
        out.close()
        place = self.at(name)
        place.getFileSystem(self.conf).mkdirs(place.getParent())
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self.conf).rename(new, place, self.options)
        except Py4JJavaError as error:
            new.getFileSystem(self.conf).delete(new, False)
            if error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise
        return True


def newest(spark: SparkSession, files: Files) -> tuple[int, str | None]:
    """The last version and the attempt that has the ends and writers as of then."""
    names = [n for n in files.names("versions") if n.isdigit()]
    if not names:
        return -1, None
    return int(names[-1]), spark.read.text(f"{files.path}/versions/{names[-1]}").first()[0].split()[:2][-1]


def marks(spark: SparkSession, files: Files) -> DataFrame:
    """(version, at, attempt, rewritten, upto) per marker: of a rewrite, its topic, and the version up to which it
    replaces what was there of that topic; of an append both are null."""
    if not files.names("versions"):
        return spark.createDataFrame([], "version bigint, at timestamp, attempt string, rewritten string, upto bigint")
    part = F.split("value", " ")
    return measured(spark.read.text(f"{files.path}/versions").select(
        F.col("_metadata.file_name").cast("bigint").alias("version"), F.col("_metadata.file_modification_time").alias("at"),
        part[0].alias("attempt"), F.url_decode(F.get(part, F.lit(2))).alias("rewritten"), F.get(part, F.lit(3)).cast("bigint").alias("upto")))


def live(rows: DataFrame, marked: DataFrame) -> DataFrame:
    """Those of the rows (topic, attempt and others) that count by these markers: appends behind the last rewrite of
    their topic, and what that one has written."""
    last = marked.filter("rewritten is not null").groupBy(F.col("rewritten").alias("topic")).agg(
        F.max_by(F.struct(F.col("attempt").alias("by"), "upto"), "version").alias("__last"))
    own = marked.select("attempt", F.col("version").alias("__version"), F.col("rewritten").alias("__rewritten"))
    appended: Column = F.col("__rewritten").isNull() & (F.col("__version") > F.coalesce("__last.upto", F.lit(-1)))
    return rows.join(own, "attempt").join(measured(last), "topic", "left").filter(
        appended | F.coalesce(F.col("attempt") == F.col("__last.by"), F.lit(False))).select(*rows.columns)


def _state(spark: SparkSession, files: Files, layout: str, kind: str, attempt: str | None) -> DataFrame:
    return spark.read.schema(layout).parquet(f"{files.path}/{kind}/attempt={attempt}") if attempt else spark.createDataFrame([], layout)


def append_once(records: DataFrame, path: str, writer: str, batch: int,
                order: Sequence[str] = ("timestamp", "key", "value")) -> bool:
    """Append a batch of records of any topics; gives False if this writer's batch is there already.

    Records get the offsets behind the last ones of their partition, in ``order``, which must tell all records of a
    partition apart that differ. Batches of a writer come with rising numbers. Records of all topics become visible at once.
    """
    spark, files = records.sparkSession, Files(records.sparkSession, path)
    ranked = grown = None
    while True:
        version, last = newest(spark, files)
        writers = _state(spark, files, WRITERS, "writers", last)
        if not writers.filter((F.col("writer") == writer) & (F.col("batch") >= batch)).isEmpty():
            return False
        if ranked is None:
            ranked = durable(rank_within(records, list(order), group=PLACE, name="__rank"))
            grown = measured(ranked.groupBy(*PLACE).agg(F.count(F.lit(1)).alias("__more")))
        ends = _state(spark, files, ENDS, "ends", last)
        attempt = uuid.uuid4().hex
        placed = ranked.join(ends, PLACE, "left").withColumn(
            "offset", F.coalesce("end", F.lit(0).cast("bigint")) + F.col("__rank"))
        (placed.select("topic", "partition", "offset", "key", "value", "headers", "timestamp")
         .repartitionByRange(*PLACE, "offset").sortWithinPartitions(*PLACE, "offset")
         .write.partitionBy("topic").parquet(f"{files.path}/data/attempt={attempt}"))
        total = F.coalesce("end", F.lit(0).cast("bigint")) + F.coalesce("__more", F.lit(0).cast("bigint"))
        ends.join(grown, PLACE, "full").select(*PLACE, total.alias("end")).write.parquet(f"{files.path}/ends/attempt={attempt}")
        own = spark.createDataFrame([(writer, batch)], WRITERS)
        writers.filter(F.col("writer") != writer).unionByName(own).coalesce(1).write.parquet(f"{files.path}/writers/attempt={attempt}")
        if files.put(f"versions/{files.version(version + 1)}", attempt):
            return True
        for kind in ("data", "ends", "writers"):  # another writer was first: its offsets come before these
            files.delete(f"{kind}/attempt={attempt}")


def appender(path: str, writer: str, order: Sequence[str] = ("timestamp", "key", "value"),
             one_topic: str | None = None) -> Callable[[DataFrame, int], None]:
    """Handler for ``foreachBatch``: each micro-batch once, whatever is tried again. With ``one_topic`` a micro-batch
    is a map from keys to messages that goes to that topic. ``writer`` names the query and outlives its restarts."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        append_once(batch_records(batch, one_topic) if one_topic else batch, path, writer, batch_id, order)

    return handle


def read_appended(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """All committed records, now or as of a version; the markers name their folders. What is committed or
    rewritten afterwards changes nothing for those who read the result."""
    files = Files(spark, path)
    marked = marks(spark, files)
    read = spark.read.schema(f"{schema.LOG}, attempt string").parquet(f"{files.path}/data")
    return live(read, marked if upto is None else marked.filter(F.col("version") <= upto)).drop("attempt")
