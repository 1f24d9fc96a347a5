"""Benchmark items of which a document holds the question alone, or the parts in several places."""

import random
import re

import pytest

from tidelog.llm import decontaminate, queries

QUESTION = "which of the old harbour towns was the first to build a stone bridge over the northern river?"
ANSWER = "it was the small town of eastmouth in the year after the great flood of the century"
ITEM = f"{QUESTION} {ANSWER}"
FILLER = " ".join(f"other{k}" for k in range(400))


@pytest.fixture
def tables(spark):
    rows = [(1, f"{FILLER} {ITEM} {FILLER}"), (2, f"{FILLER} {QUESTION} {FILLER}"), (3, f"{QUESTION} {FILLER} {ANSWER}"),
            (4, f"{FILLER} {ANSWER}"), (5, FILLER), (6, f"{ANSWER} {FILLER} {FILLER} {QUESTION}")]
    return (spark.createDataFrame(rows, "doc_id bigint, text string"),
            spark.createDataFrame([(7, ITEM), (8, "So it is. " + ANSWER.replace("the", "a"))], "item_id bigint, text string"))


def test_split_items_are_found(tables):
    found = {(r.doc_id, r.item_id): r for r in decontaminate.find(*tables).collect()}
    assert set(found) == {(1, 7), (3, 7), (6, 7)}
    assert all(r.question_overlap == 1 and r.answer_overlap == 1 and 0.8 <= r.overlap < 1.01 for r in found.values())


def test_a_question_alone_is_a_leak(tables, spark, tmp_path):
    found = {(r.doc_id, r.item_id): r for r in decontaminate.find(*tables, least_question=0.8).collect()}
    assert set(found) == {(1, 7), (2, 7), (3, 7), (6, 7)}
    assert (found[2, 7].question_overlap, found[2, 7].answer_overlap) == (1, 0)
    assert {r.doc_id for r in decontaminate.keep_clean(*tables, least_question=0.8).collect()} == {4, 5}
    for name, frame in zip(("documents", "benchmark"), tables, strict=True):
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    assert {r.doc_id for r in queries.QUERIES["op2_decontamination"](spark, str(tmp_path)).collect()} == {1, 2, 3, 6}


def spread(words, parts, gap):
    """The words in so many parts, with ``gap`` other words between them."""
    size = -(-len(words) // parts)
    between = " ".join(f"gap{k}" for k in range(gap))
    return f" {between} ".join(" ".join(words[k:k + size]) for k in range(0, len(words), size))


def test_unequal_and_scattered_parts_against_all_pairs(spark):
    rng = random.Random(4)
    common = [f"word{k}" for k in range(60)]

    def run(n, rare):
        return [rng.choice(common) if rng.random() > rare else f"rare{rng.randrange(10**6)}" for _ in range(n)]

    items, rows = [], []
    for k, (asked, told, rare) in enumerate([(13, 30, 0.9), (13, 60, 0.5), (40, 5, 0.3), (8, 200, 0.8), (60, 60, 0.5), (120, 0, 0.4),
                                             (4, 30, 0.5), (90, 3, 0.9), (12, 1, 0.5)]):
        question, answer = run(asked, rare / 2), run(told, rare)
        items.append((k, " ".join(question) + ("? " + " ".join(answer) if told else "")))
        filler = run(900, 0.02)
        for text in (question, answer, question[:-2], question[: asked // 2]):
            rows.append(" ".join([*filler, *text, *filler]))
        rows += [spread(question + answer, parts, 600) for parts in (2, 3, 4) if len(question + answer) >= 40 * parts]
        rows += [spread(question + answer, 4, 600)] if len(question + answer) == 120 else []
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").repartition(3)
    tests = spark.createDataFrame(items, "item_id bigint, text string")
    want = {}
    for d, text in enumerate(rows):
        bag = text.lower().split()
        there = {n: set(zip(*(bag[k:] for k in range(n)))) for n in range(1, 6)}
        for i, item in items:
            q, a = (re.findall(r"\w+", part) for part in (item.split("? ") + [""])[:2])

            def part(some, there=there):
                wanted = {tuple(some)} if len(some) < 5 else {tuple(some[k:k + 5]) for k in range(len(some) - 4)}
                return sum(s in there[len(s)] for s in wanted) / len(wanted) if some else 0.0

            if part(q + a) >= 0.8 or (len(q) >= 5 and part(q) >= 0.8):
                want[d, i] = (part(q + a), part(q), part(a))
    found = {(r.doc_id, r.item_id): (r.overlap, r.question_overlap, r.answer_overlap)
             for r in decontaminate.find(docs, tests, least_question=0.8).collect()}
    assert found == want and len(want) >= 20
    whole = {p for p, (overlap, _, _) in want.items() if overlap >= 0.8}
    assert {(r.doc_id, r.item_id) for r in decontaminate.find(docs, tests).collect()} == whole
