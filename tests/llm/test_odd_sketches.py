"""Near-duplicates by bands and odd sketches against all pairs of full sets."""

import random

import numpy as np
import pytest

from tidelog.llm import odd_sketches


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def expected(rows):
    """(doc_id, n_shingles, component_id, kept) of every row, by comparing all pairs of rows."""
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    out = []
    for k, (i, _) in enumerate(rows):
        c = low.get(find(k))
        out.append((i, len(sets[k]), c, i == c))
    return sorted(out, key=str)


def texts(rng, n, passages=False):
    """Variants of few texts around the limit, and texts made of common passages without near copies."""
    bases = [[f"w{rng.randrange(3000)}" for _ in range(rng.choice([4, 7, 60, 300]))] for _ in range(7)]
    common = [[f"p{k}x{j}" for j in range(30)] for k in range(12)]
    out = []
    for i in range(n):
        words = list(rng.choice(bases)) if not passages or i % 3 else sum(rng.sample(common, 6), [])
        for _ in range(rng.randrange(len(words) // 50 + 2)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
        out.append((i * 3, rng.choice([" ", "\n", " \t "]).join(words).title()))
    return out


def found(frame, **how):
    return sorted((tuple(r) for r in odd_sketches.near_duplicates(frame, **how).collect()), key=str)


@pytest.mark.parametrize("block", [4, 4096])
def test_components_equal_those_of_all_pairs(spark, block):
    rows = texts(random.Random(1), 160, passages=True)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert found(frame, block=block) == expected(rows)


def test_messy_rows(spark, messy):
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    assert found(messy) == expected(rows)
    assert found(messy.limit(0)) == []


def test_whole_table(spark, folder, documents):
    assert found(spark.read.parquet(f"{folder}/documents.parquet")) == expected(documents)


def test_a_large_group_costs_few_pairs(spark):
    """Copies meet as one set; near copies give pairs in proportion to their number."""
    rng = random.Random(8)
    base = [f"w{k}" for k in range(200)]
    made = {}
    for n in (100, 400):
        rows = []
        for i in range(n):
            words = list(base)
            words[rng.randrange(200)] = f"new{i}"
            rows += [(i, " ".join(words)), (i + 1000, " ".join(base))]
        frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
        sets = odd_sketches.numbered(odd_sketches.digests(frame, 5).dropDuplicates(["d1", "d2"]).drop("doc_id")).withColumnRenamed("__row", "row")
        made[n] = odd_sketches.links(sets, frame, 5, 85, 4096).count()
        assert sets.count() == n + 1
        assert {r.component_id for r in odd_sketches.near_duplicates(frame).collect()} == {0}
    assert made[400] < 6 * made[100]


def test_sketches_estimate_high_similarities():
    """Bits that differ follow the law from which the limit comes: links pass, unlike sets do not."""
    rng = np.random.default_rng(0)
    limit = odd_sketches.most_bits()
    for similarity, passes in ((0.9, True), (0.86, True), (0.5, False)):
        for _ in range(60):
            n = 400
            both = int(similarity * n)
            own = rng.integers(0, 2**64, n, dtype=np.uint64)
            a, b = own[:both + (n - both) // 2], np.concatenate([own[:both], own[both + (n - both) // 2:]])
            bits = odd_sketches.odd_sketches(np.stack([odd_sketches.samples(x) for x in (a, b)])).view(np.uint64)
            assert (np.bitwise_count(bits[0] ^ bits[1]).sum() <= limit) == passes
    assert (1 - 0.85 ** odd_sketches.ROWS) ** odd_sketches.BANDS < 1e-7
