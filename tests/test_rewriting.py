"""Topics rewritten: compaction with tombstones, retention, readers, writers and crashes beside it."""

import datetime as dt

import pytest

from test_sinks import NOW
from tidelog import schema
from tidelog.sources import appending, rewriting

TOPIC = "orders topic/ü"


def log(spark, rows, topic=TOPIC):
    return spark.createDataFrame([(topic, 0, 0, k, v, [], NOW + dt.timedelta(hours=h)) for k, v, h in rows], schema.LOG)


def held(spark, path, topic=TOPIC):
    return sorted((r.offset, r.key, r.value) for r in appending.read_appended(spark, path).filter(f"topic = '{topic}'").collect())


@pytest.fixture
def path(spark, tmp_path):
    where = str(tmp_path / "log")
    appending.append_once(log(spark, [("a", "1", 0), ("b", "1", 1), (None, "x", 2), ("c", "1", 3)]).unionByName(
        log(spark, [("a", "other", 0), ("a", "other too", 1)], "other")), where, "w", 0)
    appending.append_once(log(spark, [("a", "2", 4), ("b", None, 5), ("d", None, 40)]), where, "w", 1)
    return where


def folders(tmp_path):
    return {p.name for p in (tmp_path / "log" / "data").glob("attempt=*/topic=orders*/*.parquet")}


def test_compaction(spark, path, tmp_path):
    old = appending.read_appended(spark, path).filter(f"topic = '{TOPIC}'")
    before, size = sorted(r.offset for r in old.collect()), len(folders(tmp_path))
    assert rewriting.compact(spark, path, TOPIC, NOW + dt.timedelta(hours=48))
    want = [(2, None, "x"), (3, "c", "1"), (4, "a", "2"), (6, "d", None)]
    assert held(spark, path) == want and len(held(spark, path, "other")) == 2
    # who began to read before goes on with what was there, until it is removed
    assert sorted(r.offset for r in old.collect()) == before == list(range(7))
    assert rewriting.remove_replaced(spark, path, TOPIC) == 0
    assert rewriting.remove_replaced(spark, path, TOPIC, 0) == 2 and rewriting.remove_replaced(spark, path, TOPIC, 0) == 0
    assert len(folders(tmp_path)) < size + 1 and held(spark, path) == want and len(held(spark, path, "other")) == 2
    # offsets go on, batches are still known, and a second rewrite takes the first one's place
    assert not appending.append_once(log(spark, [("a", "again", 1)]), path, "w", 1)
    assert appending.append_once(log(spark, [("a", "3", 60)]), path, "w", 2)
    assert held(spark, path) == [*want, (7, "a", "3")]
    assert rewriting.compact(spark, path, TOPIC, NOW + dt.timedelta(hours=96))
    assert held(spark, path) == [(2, None, "x"), (3, "c", "1"), (7, "a", "3")]
    assert rewriting.remove_replaced(spark, path, TOPIC, 0) == 2 and held(spark, path)[-1] == (7, "a", "3")


def test_retention(spark, path):
    assert rewriting.expire(spark, path, TOPIC, NOW + dt.timedelta(hours=28), days=1)
    assert [o for o, _, _ in held(spark, path)] == [4, 5, 6]
    assert rewriting.expire(spark, path, TOPIC, NOW + dt.timedelta(days=99), days=1) and held(spark, path) == []
    assert appending.append_once(log(spark, [("z", "1", 0)]), path, "w", 2) and held(spark, path) == [(7, "z", "1")]
    assert rewriting.expire(spark, path, "missing", NOW, days=1) and len(held(spark, path, "other")) == 2


@pytest.mark.parametrize("stage", ["data", "marker"])
def test_a_crash_on_the_way_changes_nothing(spark, path, monkeypatch, stage):
    before = held(spark, path)
    with monkeypatch.context() as m:
        if stage == "data":
            m.setattr(rewriting, "compacted", lambda *a: 1 / 0)
        else:
            m.setattr(appending.Files, "put", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            rewriting.compact(spark, path, TOPIC, NOW)
    assert held(spark, path) == before
    assert rewriting.compact(spark, path, TOPIC, NOW) and len(held(spark, path)) == 5


@pytest.mark.parametrize("other", ["append", "rewrite"])
def test_others_at_the_same_time(spark, path, other):
    """An append while a topic is rewritten counts as well; of two rewrites the later one gives up."""
    def late(rows):
        kept = rows.filter("key = 'a'")
        if other == "append":
            assert appending.append_once(log(spark, [("b", "late", 9)]), path, "w", 2)
        else:
            assert rewriting.compact(spark, path, TOPIC, NOW)
        return kept

    assert rewriting.rewrite(spark, path, TOPIC, late) == (other == "append")
    keys = [k for _, k, _ in held(spark, path)]
    assert keys == (["a", "a", "b"] if other == "append" else [None, "c", "a", "b", "d"])
    assert appending.append_once(log(spark, [("e", "1", 9)]), path, "w", 3)
    assert held(spark, path)[-1][:2] == (8 if other == "append" else 7, "e")
