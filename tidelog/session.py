"""Session settings, the one way this package cuts lineage, and how it gets to executors."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def use_utc(spark: SparkSession) -> SparkSession:
    """Log timestamps are instants; every operator reads and prints them in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


_LOCAL = re.compile(r"local(\[.*\])?$")
_WRITTEN: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """Folder that all executors see: the one the cluster names in ``spark.checkpoint.dir``.
    Only a local session without that setting (tests, a laptop) gets a temporary one."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named is None and context.getCheckpointDir() is None:
        if not _LOCAL.match(context.master):
            raise RuntimeError("intermediate tables need a folder that all executors share: set spark.checkpoint.dir")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidelog-"))
    return named or context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """The rows written as a table in the shared folder, and that table.

    Later jobs read the same rows with the same values, whatever executors are lost, and
    each of them only the columns it needs.
    """
    folder = f"{shared_folder(df.sparkSession).rstrip('/')}/tidelog-{uuid.uuid4().hex}"
    for folders in _WRITTEN:
        folders.append(folder)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextmanager
def tables_removed(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that operators write inside the ``with`` block when it ends. Results that read
    them must have been used or written by then."""
    folders: list[str] = []
    _WRITTEN.append(folders)
    try:
        yield
    finally:
        _WRITTEN.remove(folders)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for folder in folders:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, where it is neither installed nor on their path."""
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tidelog-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, Path(root.name) / file.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))


def measured(df: DataFrame) -> DataFrame:
    """A result that is expected to be much smaller than its input, written first.

    Before it runs, an aggregate counts as large as its input, and joining it would shuffle
    the big side. Of a written table the planner knows the true size: it broadcasts it below
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles both sides above.
    """
    return durable(df)
