"""Rewriting a topic of a log that ``appending`` keeps: compaction with tombstones, and retention.

What stays of a topic is written to a folder of its own, then a marker is put in its place under the next version number,
like that of an append. It names the topic and the version up to which the new folder replaces what was there; appends
that came in between go on counting. So readers see the topic as it was or as it is, a crash on the way changes
nothing, and of two rewrites of a topic at one time the later one gives up. Replaced folders are removed in a step of
their own, once nobody can be reading them any more.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidelog import schema
from tidelog.operators.deadletter import RETENTION_DAYS, retained
from tidelog.operators.replay import compacted
from tidelog.session import tables_removed
from tidelog.sources.appending import Files, live, marks, newest, read_appended
from tidelog.sources.sinks import PLACE


def rewrite(spark: SparkSession, path: str, topic: str, rule: Callable[[DataFrame], DataFrame]) -> bool:
    """Replace the records of a topic by those that ``rule`` leaves of them, at the places they have.

    Gives False, and changes nothing, if another rewrite of the topic came first. Only this topic is read and written;
    the ends of its partitions stay, so offsets are never used twice. A topic that does not exist is rewritten as empty.
    """
    files = Files(spark, path)

    def last_rewrite():
        return marks(spark, files).filter(F.col("rewritten") == topic).agg(F.max("version")).first()[0]

    before, (upto, _) = last_rewrite(), newest(spark, files)
    if upto < 0:
        return False
    attempt = uuid.uuid4().hex
    with tables_removed(spark):
        kept = rule(read_appended(spark, path, upto).filter(F.col("topic") == topic))
        (kept.select("topic", "partition", "offset", "key", "value", "headers", "timestamp")
         .repartitionByRange(*PLACE, "offset").sortWithinPartitions(*PLACE, "offset")
         .write.partitionBy("topic").parquet(f"{files.path}/data/attempt={attempt}"))
    while last_rewrite() == before:
        version, state = newest(spark, files)
        if files.put(f"versions/{files.version(version + 1)}", f"{attempt} {state} {quote(topic, safe='')} {upto}"):
            return True
    files.delete(f"data/attempt={attempt}")
    return False


def compact(spark: SparkSession, path: str, topic: str, as_of=None, delay_hours: int = 24) -> bool:
    """Keep the newest record of each key; a null value deletes its key, and goes itself after ``delay_hours``."""
    return rewrite(spark, path, topic, lambda log: compacted(log, as_of, delay_hours))


def expire(spark: SparkSession, path: str, topic: str, as_of=None, days: int = RETENTION_DAYS) -> bool:
    """Keep the records of the last ``days``."""
    return rewrite(spark, path, topic, lambda log: retained(log, as_of, days))


def remove_replaced(spark: SparkSession, path: str, topic: str, grace_seconds: int = 86400) -> int:
    """Remove the folders of a topic that a rewrite at least ``grace_seconds`` old has replaced; gives their number.
    The grace is what readers may take: those that began before the rewrite still read the old folders."""
    files = Files(spark, path)
    old = F.current_timestamp() - F.make_interval(secs=F.lit(grace_seconds)) >= F.col("at")
    of_topic = marks(spark, files).withColumn("topic", F.lit(topic))
    last = of_topic.filter((F.col("rewritten") == topic) & old).agg(F.max("version")).first()[0]
    if last is None:
        return 0
    # as readers of that version would: later appends and rewrites are not looked at
    then = of_topic.filter(F.col("version") <= last)
    dead = then.join(live(then, then).select("attempt"), "attempt", "left_anti").filter(
        F.col("rewritten").isNull() | (F.col("rewritten") == topic))
    folder = files.partition("topic", topic)
    return sum(files.delete(f"data/attempt={r.attempt}/{folder}") for r in dead.select("attempt").toLocalIterator())
