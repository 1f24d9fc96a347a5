"""The near-dedup stage does the links of op4, counts all texts, and meets few pairs with all their shingles."""

import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_exploded_sides import broadcast_sides
from test_near_copies import alike, edited, kept, shingles

from tidelog.llm import near_copies, simhash


def test_stage_links_what_the_fingerprints_of_op4_link(spark, folder):
    rng = random.Random(0)
    text = " ".join(f"w{rng.randrange(2)}" for _ in range(80))
    texts = [text, text + " " + " ".join(f"x{k}" for k in range(14)), " ".join(f"y{k}" for k in range(50))]
    within = [(simhash.fingerprint(texts[0], size) ^ simhash.fingerprint(texts[1], size)).bit_count() <= 2 for size in (3, 5)]
    assert within == [True, False] and not alike(shingles(texts[0]), shingles(texts[1]))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    later = [r.doc_id for r in simhash.near_duplicates(frame).filter("doc_id <> component_id").collect()]
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    assert later == [1] and sorted(r.doc_id for r in stage(spark, frame, folder).collect()) == [0, 2]


def test_shingles_of_all_texts_are_counted(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "SAMPLE_DOCS", 2, raising=False)
    texts = ["one two three four five"] * 30
    frame = spark.createDataFrame(list(enumerate(texts)), "row bigint, text string")
    levels = near_copies._levels(frame, len(texts), 5)
    assert sorted(levels)[-2:] == [0, int(8 * np.log2(31))]
    assert not near_copies._levels(frame.limit(0), 0, 5).any()


def test_sketches_never_differ_in_more_places_than_sets_in_elements():
    rng = np.random.default_rng(4)
    for n, common, other in ((0, 0, 3), (1, 1, 0), (64, 60, 70), (500, 450, 40), (1000, 1000, 300), (700, 100, 5000), (3, 3, 0)):
        every = rng.integers(0, 2**64, n + other, np.uint64, endpoint=False)
        a, b = every[:n], np.concatenate((every[:common], every[n:]))
        apart = near_copies.apart(near_copies.sketch(a), near_copies.sketch(b))
        assert apart == near_copies.apart(near_copies.sketch(b), near_copies.sketch(a)) <= n - common + other
        assert near_copies.apart(near_copies.sketch(a), near_copies.sketch(a)) == 0
    for n in (64, 300, 1000, 1025):  # and tell sets without common elements apart
        a, b = rng.integers(0, 2**64, (2, n), np.uint64)
        assert near_copies.apart(near_copies.sketch(a), near_copies.sketch(b)) * 9 > 2 * n


@pytest.mark.parametrize("pivots", [1, 8])
def test_few_pairs_meet_with_all_shingles(spark, monkeypatch, pivots):
    """Texts of common passages share shingles without being near copies; of a text with many variants one pair each is enough."""
    rng = random.Random(11)
    passages = [[f"p{k}x{j}" for j in range(30)] for k in range(20)]
    base = [f"w{k}" for k in range(300)]
    texts = [" ".join(sum(rng.sample(passages, 6), [])) for _ in range(120)] + [edited(rng, base, 2) for _ in range(60)]
    rows = list(enumerate(texts))
    met, verified = [], near_copies._verified

    def counted(pairs, *rest):
        met.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(near_copies, "_verified", counted)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert {r.doc_id for r in near_copies.keep_one(frame, pivots=pivots).collect()} == kept(rows)
    assert sum(met) < 150


def test_links_broadcast_nothing_exploded(spark):
    prints = spark.range(500).select(F.xxhash64("id").alias("fp"))
    assert not [p for p in broadcast_sides(simhash.links(prints, 2)) if "explode" in p]
