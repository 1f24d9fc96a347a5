"""Batches appended exactly once: reruns, crashes, two writers, streams."""

import pytest
from pyspark.sql import functions as F

from test_sinks import records
from tidelog import schema
from tidelog.sources import appending, sinks
from tidelog.streaming.reading import read_stream, run_available


def places(spark, path):
    return sorted((r.topic, r.partition, r.offset, r.key) for r in appending.read_appended(spark, path).collect())


def test_a_batch_that_comes_again_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    assert appending.append_once(records(spark, 10), path, "q", 0)
    assert appending.append_once(records(spark, 6, start=10).unionByName(records(spark, 2, "other")), path, "q", 1)
    before = places(spark, path)
    assert not appending.append_once(records(spark, 6, start=10), path, "q", 1)
    assert not appending.append_once(records(spark, 9), path, "q", 0)
    assert places(spark, path) == before
    assert [p[:3] for p in before] == sorted([("orders-topic", p, o) for p in (0, 1) for o in range(8)] + [("other", p, 0) for p in (0, 1)])
    assert appending.append_once(records(spark, 0), path, "q", 2) and places(spark, path) == before


@pytest.mark.parametrize("stage", ["data", "ends", "marker"])
def test_a_crash_on_the_way_changes_nothing(spark, tmp_path, monkeypatch, stage):
    path = str(tmp_path / "log")
    appending.append_once(records(spark, 4), path, "q", 0)
    before, ends = places(spark, path), spark.read.text(f"{path}/versions").count()
    with monkeypatch.context() as m:
        if stage == "marker":
            m.setattr(appending.Files, "put", lambda *a: 1 / 0)
        else:
            bad = F.udf(lambda k: 1 / 0, "string")
            m.setattr(appending, "rank_within", lambda df, *a, **k: df.withColumn("__rank", F.lit(0)).withColumn(
                "value" if stage == "data" else "partition", bad("key").cast(df.schema["value" if stage == "data" else "partition"].dataType)))
        with pytest.raises(Exception):
            appending.append_once(records(spark, 6, start=4), path, "q", 1)
    assert places(spark, path) == before and spark.read.text(f"{path}/versions").count() == ends
    assert appending.append_once(records(spark, 6, start=4), path, "q", 1)
    assert [p[2] for p in places(spark, path)] == [*range(5), *range(5)]


def test_the_later_of_two_writers_goes_on_behind_the_other(spark, tmp_path, monkeypatch):
    """Both see version 0; the one that comes second finds the place taken and takes new offsets."""
    path = str(tmp_path / "log")
    appending.append_once(records(spark, 2), path, "a", 0)
    plain, raced = appending.newest, []

    def late(session, files):
        seen = plain(session, files)
        if not raced:
            raced.append(1)
            assert appending.append_once(records(spark, 4, start=2), path, "b", 0)
        return seen

    monkeypatch.setattr(appending, "newest", late)
    assert appending.append_once(records(spark, 6, start=6), path, "a", 1)
    got = places(spark, path)
    assert [p[:3] for p in got] == [("orders-topic", p, o) for p in (0, 1) for o in range(6)]
    assert {p[3] for p in got if p[2] < 3} == {f"k{i}" for i in range(6)}
    assert len(list((tmp_path / "log" / "data").glob("attempt=*"))) == 3


def test_the_history_is_not_read(spark, tmp_path):
    path = str(tmp_path / "log")
    appending.append_once(records(spark, 4), path, "q", 0)
    for file in (tmp_path / "log" / "data").rglob("*.parquet"):
        file.write_bytes(b"not a table any more")
    assert appending.append_once(records(spark, 4, start=4), path, "q", 1)
    ends = {r.end for r in spark.read.parquet(*map(str, (tmp_path / "log" / "ends").glob("*"))).collect()}
    assert ends == {2, 4}


def test_a_stream_that_starts_again(spark, tmp_path):
    """The second run has lost its checkpoint: its micro-batches come again and are known. As in one go on static data."""
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(3):
        records(spark, 5, start=5 * k).coalesce(1).write.mode("append").parquet(source)
    for run in range(2):
        stream = read_stream(spark, source, schema.LOG, files_per_trigger=1)
        run_available(stream, str(tmp_path / f"check{run}"), appending.appender(path, "orders"))
    sinks.publish(records(spark, 15), str(tmp_path / "one"))
    want = sorted((r.topic, r.partition, r.offset, r.key) for r in sinks.read_log(spark, str(tmp_path / "one")).collect())
    assert places(spark, path) == want


def test_a_stream_of_maps(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    records(spark, 6).unionByName(records(spark, 6)).coalesce(1).write.parquet(source)
    run_available(read_stream(spark, source, schema.LOG), str(tmp_path / "check"), appending.appender(path, "q", one_topic="batch"))
    assert sorted(p[3] for p in places(spark, path)) == [f"k{i}" for i in range(6)]
