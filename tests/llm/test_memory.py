"""What a Python worker holds while it goes from lot to lot, and what it gives back."""

from types import SimpleNamespace

import pyarrow as pa
import pytest

from tidelog.llm import common, mixing


class Rows:
    """Keeps the function that an operator has run by Spark."""

    sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda value: SimpleNamespace(value=value)))

    def select(self, *_):
        return self

    filter = coalesce = groupBy = agg = orderBy = limit = select

    def collect(self):
        return []

    def mapInArrow(self, run, _):
        self.run = run
        return self


def ran(kind):
    rows, told = Rows(), SimpleNamespace(value=mixing.Classes([], []))
    if kind == "class_words":
        mixing.class_words(rows)
    else:
        getattr(mixing, kind)(rows, told)
    return rows.run


@pytest.mark.parametrize("kind", ["class_words", "_counted", "_asked"])
def test_a_lot_is_gone_before_the_next_is_read(spark, monkeypatch, kind):
    """Lots of about 3 MB of words, of which few differ: what comes out is small."""
    monkeypatch.setattr(mixing, "HELD", 100_000)
    text = " ".join(f"{k % 50:025d}" for k in range(100_000))
    held = []

    def batches():
        for _ in range(4):
            held.append(pa.total_allocated_bytes())
            yield pa.RecordBatch.from_pydict({"text": pa.array([text]), "learned": pa.array([True]),
                                              "block": pa.array([0], pa.int64())})

    out = [row for batch in ran(kind)(batches()) for row in batch.column("word").to_pylist()]
    assert len(set(out)) in (50, 51) and len(out) == 4 * len(set(out))
    # the last batch may still be there, its words may not
    assert max(held) - held[0] < 4_000_000


@pytest.mark.parametrize("kind", ["class_words", "_counted", "_asked"])
def test_a_worker_gives_memory_back_after_a_task(spark, monkeypatch, kind):
    times = []
    monkeypatch.setattr(common, "let_go", lambda: times.append(1))
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["a b"]), "learned": pa.array([True]), "block": pa.array([0], pa.int64())})
    assert list(ran(kind)(iter([batch]))) and times == [1]


def test_lots_of_a_block_change_no_score(spark, monkeypatch):
    docs = spark.createDataFrame([(k, " ".join(f"w{k * j % 31} the" for j in range(k % 7))) for k in range(40)],
                                 "doc_id bigint, text string").union(spark.sql("select null, null"))
    whole = sorted(map(str, mixing.score(docs).collect()))
    monkeypatch.setattr(mixing, "PLACED", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(map(str, mixing.score(docs).collect())) == whole and len(whole) == 41
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
