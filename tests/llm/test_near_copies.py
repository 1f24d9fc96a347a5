"""The near-dedup stage of the pipeline against all pairs of shingle sets."""

import random

import corpus_pipeline
import numpy as np
import pytest

from tidelog.llm import near_copies, simhash


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return 9 * len(a & b) >= 4 * (len(a) + len(b))


def kept(rows):
    """Numbers of the rows that are first in their component of near copies."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if alike(sets[a], sets[b]):
                root[find(a)] = find(b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(k)
    return {min(g, key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k)) for g in groups.values()}


def edited(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def near(n=150, seed=3):
    """Variants of few texts, of which few are within 2 bits of a fingerprint, and texts of common passages."""
    rng = random.Random(seed)
    bases = [[f"w{rng.randrange(4000)}" for _ in range(rng.choice([6, 40, 120, 400]))] for _ in range(8)]
    passages = [[f"p{k}x{j}" for j in range(30)] for k in range(6)]
    rows = []
    for i in range(n):
        words = bases[rng.randrange(8)] if i % 3 else sum(rng.sample(passages, 4), [])
        rows.append((i, edited(rng, words, rng.randrange(max(1, len(words) // 40) + 1))))
    return rows


@pytest.mark.parametrize("pivots", [1, 8])
def test_keeps_the_first_of_all_near_copies(spark, pivots):
    rows = near()
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r.doc_id for r in near_copies.keep_one(frame, pivots=pivots).collect()}
    assert got == kept(rows) and len(got) < len(rows) - 40


def test_stage_takes_a_copy_at_a_similarity_of_0_8(spark, folder):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(200)]
    texts = [" ".join(words), *(edited(rng, words, 4) for _ in range(6)), edited(rng, words, 40)]
    near = [alike(shingles(texts[0]), shingles(t)) for t in texts]
    assert near == [True] * 7 + [False]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    assert sorted(r.doc_id for r in stage(spark, frame, folder).collect()) == [0, 7]


def test_stage_links_fingerprints_within_two_bits(spark, folder):
    """A long text with other words in a row at one place: few shingles of a set are common, but these repeat."""
    common = " ".join("w%d" % (k % 7) for k in range(4000))
    texts = [common, common + " " + " ".join(f"x{k}" for k in range(40)), " ".join(f"y{k}" for k in range(300)), None]
    prints = [simhash.fingerprint(t, 5) for t in texts]
    assert (prints[0] ^ prints[1]).bit_count() <= 2 and not alike(shingles(texts[0]), shingles(texts[1]))
    frame = spark.createDataFrame([(k + 1, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    assert sorted(r.doc_id for r in stage(spark, frame, folder).collect()) == [1, 3, 4]
    assert sorted(r.doc_id for r in near_copies.keep_one(frame).collect()) == [1, 2, 3, 4]


def test_stage_finds_what_both_methods_link(spark, folder):
    rows = near()
    prints, sets = [simhash.fingerprint(t, 5) for _, t in rows], [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if alike(sets[a], sets[b]) or (prints[a] ^ prints[b]).bit_count() <= 2:
                old, new = sorted((root[a], root[b]))[::-1]
                root = [new if r == old else r for r in root]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    assert {r.doc_id for r in stage(spark, frame, folder).collect()} == set(root)


def test_levels_come_as_one_byte_for_each_bucket(spark):
    texts = ["a b c d e f", "a b c d e g", "a b c d e f h i"]
    frame = spark.createDataFrame(list(enumerate(texts)), "row bigint, text string").repartition(2)
    seen = np.zeros(1 << near_copies.BUCKET_BITS, int)
    for t in texts:
        np.add.at(seen, (near_copies.shingles(t, 5) >> np.uint64(64 - near_copies.BUCKET_BITS)).astype(int), 1)
    levels = near_copies._levels(frame, len(texts), 5)
    assert levels.dtype == np.uint8 and np.array_equal(levels, (8 * np.log2(1 + seen)).astype(np.uint8))


def test_rows_are_decided_one_by_one(spark):
    rows = [(1, "one text of a few words here"), (9, "one text of a few words here"), (9, "another text that nobody else has"),
            (None, "one text of a few words here"), (None, "a text without an id that is alone"),
            (12, "the same id and the same text"), (12, "the same id and the same text"), (20, ""), (21, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    got = sorted(((r.doc_id, r.text) for r in near_copies.keep_one(frame).collect()), key=str)
    assert got == sorted([rows[0], rows[2], rows[4], rows[5], rows[7]], key=str)
