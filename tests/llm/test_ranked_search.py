"""Ranked search against scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np

from tidelog.llm import ranked_search


def terms(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def expected(docs, items, top=50):
    """(item_id, rank, doc_id, score), one document after the other."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    total, words = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for i, bag, n in bags:
            score, m = 0, 100 - 50 + 50 * n * total // words
            for t in set(terms(text)) & set(bag):
                w = math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
                score += w * (1000000000 * bag[t] // (1000 * bag[t] + 20 * m))
            if score > 0 and i is not None:
                scores.append((-score, i))
        out += [(item, k + 1, i, -s) for k, (s, i) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def found(docs, items, **how):
    return sorted((tuple(r) for r in ranked_search.search(docs, items, **how).collect()), key=str)


def test_whole_tables(spark, folder, documents):
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    assert found(docs, items) == expected(documents, [(r.item_id, r.text) for r in items.collect()])


def test_messy_rows_ties_and_repeated_items(spark, messy):
    asked = [(1, "The SAME text, twice!"), (1, "The SAME text, twice!"), (2, None), (None, "cat w5 the"), (4, ""), (5, " .,- "),
             (6, "中文 straße 🙂 İ"), (7, "x" * 150_000), (8, "12345"), (9, "nowhere")]
    items = spark.createDataFrame(asked, "item_id bigint, text string").selectExpr("*", "'x' as doc_id", "1 as score", "2 as query")
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    assert found(messy, items, top=3) == expected(rows, asked, 3)
    assert found(messy, items.limit(0)) == [] and found(messy.limit(0), items) == []


def test_lots_of_queries(spark, folder, documents, monkeypatch):
    monkeypatch.setattr(ranked_search, "LOT_BYTES", 2000)
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    assert found(docs, items, top=5) == expected(documents, [(r.item_id, r.text) for r in items.collect()], 5)


def test_windows_are_skipped_without_losing_answers(monkeypatch):
    """Many short windows, long and short lists: the same answers as all sums, with few candidates named."""
    monkeypatch.setattr(ranked_search, "STRIDE", 16)
    rng = np.random.default_rng(3)
    n, vocabulary = 2000, 40
    lengths = rng.integers(5, 400, n)
    times = np.where(rng.random((n, vocabulary)) < np.geomspace(0.9, 0.002, vocabulary), rng.integers(1, 5, (n, vocabulary)), 0)
    docs, which = np.nonzero(times)
    ids = rng.permutation(n) * 3
    weights = np.array([ranked_search.weight(n, d) for d in (times > 0).sum(axis=0)])
    shard = ranked_search.Shard(ids, lengths, docs, which, times[docs, which], weights, n, int(lengths.sum()))
    length = 50 + 50 * lengths * n // lengths.sum()
    parts = weights * (10**9 * times // (1000 * times + 20 * length[:, None]))
    offered = []
    whole = ranked_search.window
    monkeypatch.setattr(ranked_search, "window", lambda *a: offered.append(1) or whole(*a))
    for seed in range(30):
        query = np.array(sorted(random.Random(seed).sample(range(vocabulary), 8)))
        best = ranked_search.Best(10)
        shard.search(query, best)
        scores = parts[:, query].sum(axis=1)
        order = np.lexsort((ids, -scores))[:10]
        assert list(zip(best.ids, best.scores, strict=True)) == [(ids[k], scores[k]) for k in order if scores[k] > 0]
    assert len(offered) < 0.9 * 30 * shard.windows
