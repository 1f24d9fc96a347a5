"""Columns that have the names used inside keep their values."""

import pytest

from tidelog.llm import decontaminate, line_dedup, near_copies

NAMES = ["__text", "__d", "__kept", "__own", "__own_text", "__left", "__all", "__row", "_metadata", "row", "d", "lines", "kept",
         "c0", "c1", "a.b", "C3", "text_"]


@pytest.fixture
def clashing(spark):
    rows = [(1, "one line of text here\nand a second line of it"), (2, "one line of text here\nsomething else now"),
            (3, "one line of text here\nsomething else now"), (4, None), (None, "")]
    return spark.createDataFrame([(*r, *(f"{n} {k}" for n in NAMES)) for k, r in enumerate(rows)],
                                 ["doc_id", "Text", *NAMES]).repartition(2)


def others(frame):
    return sorted(tuple(r)[2:] for r in frame.collect())


def test_line_dedup(clashing):
    done = line_dedup.without_repeated_lines(clashing)
    assert done.columns == clashing.columns and done.schema == clashing.schema and others(done) == others(clashing)
    assert {r[0]: r[1] for r in done.collect()} == {1: "one line of text here\nand a second line of it", 2: "something else now",
                                                    3: "", 4: None, None: ""}
    report = {r.doc_id: (r.n_lines, r.removed) for r in line_dedup.line_report(clashing).collect()}
    assert report == {1: (2, []), 2: (2, [0]), 3: (2, [0, 1]), 4: (1, []), None: (1, [])}


def test_near_copies(clashing):
    kept = near_copies.keep_one(clashing)
    assert kept.columns == clashing.columns and kept.schema == clashing.schema
    assert {r[0] for r in kept.collect()} == {1, 2, 4}
    assert set(others(kept)) < set(others(clashing))


def test_decontamination(spark, clashing):
    tests = spark.createDataFrame([(1, "something else now")], "item_id bigint, text string")
    clean = decontaminate.keep_clean(clashing.withColumnRenamed("Text", "text"), tests)
    assert {r[0] for r in clean.collect()} == {1, 4, None} and clean.columns[2:] == clashing.columns[2:]
