"""Logs written to folders and read back."""

import datetime as dt
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tidelog import schema, session
from tidelog.sources import sinks
from tidelog.streaming.consume import consume_batch

NOW = dt.datetime(2024, 1, 31)


def records(spark, n, topic="orders-topic", start=0):
    rows = [(topic, i % 2, 0, f"k{i}", f"v{i}", [("h", b"1")], NOW + dt.timedelta(seconds=i)) for i in range(start, start + n)]
    return spark.createDataFrame(rows, schema.LOG)


def test_offsets_go_on(spark, tmp_path):
    path = str(tmp_path / "log")
    sinks.publish(records(spark, 10), path)
    sinks.publish(records(spark, 6, start=10).unionByName(records(spark, 2, "other")), path)
    log = sinks.read_log(spark, path)
    places = sorted((r.topic, r.partition, r.offset) for r in log.collect())
    assert places == sorted([("orders-topic", p, o) for p in (0, 1) for o in range(8)] + [("other", p, 0) for p in (0, 1)])
    first = log.filter("topic = 'orders-topic' and partition = 0 and offset = 7").first()
    assert first.key == "k14" and bytes(first.headers[0].value) == b"1"
    plan = log.filter("topic = 'other' and offset >= 0")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(topic" in plan and "PushedFilters: [IsNotNull(offset), GreaterThanOrEqual(offset" in plan


def test_json_log(spark, tmp_path):
    path = str(tmp_path / "json")
    sinks.publish(records(spark, 4), path, file_format="json")
    assert sinks.read_log(spark, path, "json").count() == 4


def test_batch_sends_each_key_once(spark, tmp_path):
    twice = records(spark, 5).unionByName(records(spark, 5))
    sinks.publish_batch(twice, "batch", str(tmp_path / "b"))
    assert sinks.read_log(spark, str(tmp_path / "b")).count() == 5


def test_only_marked_transactions_are_read(spark, tmp_path):
    path = str(tmp_path / "txn")
    parts = [records(spark, 3, t) for t in ("orders-topic", "payments-topic", "notifications-topic")]
    sinks.publish_atomic(parts, path, "tx-1")
    sinks.publish_atomic(parts, path, "tx-1")  # a rerun replaces
    records(spark, 4).write.parquet(f"{path}/data/txn_id=tx-2/attempt=a")  # no marker: its writer died
    got = sinks.read_committed(spark, path)
    assert got.count() == 9 and got.select("topic").distinct().count() == 3
    assert sinks.clean_transactions(spark, path) == 1 and sinks.read_committed(spark, path).count() == 9


def test_a_failing_rerun_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "txn")
    sinks.publish_atomic([records(spark, 10)], path, "tx-1")
    broken = records(spark, 10).withColumn("value", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        sinks.publish_atomic([broken], path, "tx-1")
    assert sinks.read_committed(spark, path).count() == 10


def test_records_without_an_id_are_no_copies(spark):
    ids = F.when(F.col("key").isin("k0", "k1", "k2"), None).when(F.col("key") > "k6", "same").otherwise(F.col("key"))
    rows = records(spark, 10).withColumn("offset", F.monotonically_increasing_id())
    kept = sorted(r.key for r in sinks.deduplicated(rows, ids).collect())
    assert kept == [f"k{k}" for k in range(8)]


def test_tables_go_and_clusters_need_a_shared_folder(spark, monkeypatch):
    with session.tables_removed(spark):
        table = session.durable(spark.range(5))
        folder = table.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
        assert table.count() == 5 and os.path.isdir(folder)
    assert not os.path.isdir(folder)

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())


def test_runs_from_another_folder(tmp_path):
    """The package is sent to the workers where they cannot import it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from tidelog import session
from tidelog.operators.breaker import circuit_breaker
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
session.ship(spark)
rows = spark.createDataFrame([("k", 1, False)], "key string, seq long, ok boolean").selectExpr("*", "timestamp_seconds(seq) as ts")
print("STATE", circuit_breaker(rows).first().state)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "STATE CLOSED" in done.stdout, done.stderr[-2000:]


def test_consumed_batch_splits(spark, tmp_path):
    path = str(tmp_path / "out")
    batch = records(spark, 4).withColumn("value", F.when(F.col("key") == "k1", " ").when(
        F.col("key") == "k2", "RETRY_ERROR").otherwise(F.col("value")))
    consume_batch(batch, path, 7)
    topics = {r.topic: r["count"] for r in sinks.read_committed(spark, path).groupBy("topic").count().collect()}
    assert topics == {"orders-topic": 2, "orders-topic.validation.dlt": 1, "orders-topic.recoverable.dlt": 1}
