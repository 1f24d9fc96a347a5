"""Line dedup, SimHash near-duplicates, components and benchmark leaks against all pairs."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

import brute
from tidelog.llm import decontaminate, line_dedup, simhash
from tidelog.llm.components import components


def variants(seed=1, n=60):
    """Texts of shared lines, each changed a little, so that word lists are long."""
    rng = random.Random(seed)
    words = [f"v{k}" for k in range(300)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 30))] for _ in range(8)]
    out = []
    for i in range(n):
        lines = []
        for _ in range(rng.randint(0, 5)):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                line[rng.randrange(len(line))] = rng.choice(words)
            lines.append(rng.choice(["", " "]) + "  ".join(line).title())
        out.append((i * 7, "\n".join([*lines, "\t"])))
    return out


@pytest.mark.parametrize("pivots", [1, 16])
def test_line_dedup(spark, pivots):
    rows = variants()
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute.removed_lines(rows)
    got = {r.doc_id: set(r.removed) for r in line_dedup.line_report(frame, pivots).collect()}
    assert got == {i: want[i] for i, _ in rows}
    texts = {r.doc_id: r.text for r in line_dedup.without_repeated_lines(frame, pivots).collect()}
    assert texts == dict(brute.without_lines(rows))


def test_line_dedup_of_messy_rows(messy):
    done = line_dedup.without_repeated_lines(messy)
    assert done.columns == messy.columns
    rows = done.collect()
    assert len(rows) == messy.count()
    text = {}
    for r in rows:
        text.setdefault(r.doc_id, []).append(r.text)
    assert text[2] == [None] and text[3] == [""] and text[4] == [" \t\n \n"]
    assert text[9] == ["the same text twice over"] * 2 and text[10] == [""]
    assert None in text[None] and "the lost one has no number at all" in text[None]
    assert len(text[7][0]) == 150_000 and text[8][0].startswith("w0 the of")
    assert line_dedup.without_repeated_lines(messy.limit(0)).count() == 0


def test_hash_and_fingerprints(spark, documents):
    for text in ("", "abc", "ünï cödé", "x" * 100):
        assert simhash.fingerprint(text) == brute.fingerprint(text, 3)
        assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest(text.encode(), 42)
    for _, text in documents[:40]:
        assert simhash.fingerprint(text) == brute.fingerprint(text, 3)


@pytest.mark.parametrize("crowded", [1, 32])
def test_near_duplicates(spark, documents, crowded):
    rows = list(documents[:80])
    rng = random.Random(2)
    for k in range(60):
        words = rows[k % 6][1].split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = "changed"
        rows.append((10_000 + k, " ".join(words)))
    rows += [(20_000, None), (20_001, "  "), (20_002, "")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(frame, crowded=crowded).collect()}
    assert got == brute.simhash_components(rows)
    assert len({c for _, c in got.values()}) < len(rows) - 40


def flipped(value, rng, bits):
    for b in rng.sample(range(64), bits):
        value ^= 1 << b
    return value - (1 << 64) if value >= 1 << 63 else value


@pytest.mark.parametrize("radius", [0, 1, 2])
@pytest.mark.parametrize("crowded", [1, 4, 1000])
def test_links_connect_all_within_radius(spark, radius, crowded):
    rng = random.Random(radius * 10 + crowded)
    some = {flipped(rng.getrandbits(64), rng, 0) for _ in range(4)}
    while len(some) < 120:
        some.add(flipped(rng.choice(sorted(some)) % (1 << 64), rng, rng.randint(1, 3)))
    rows = sorted(some)
    frame = spark.createDataFrame([(v,) for v in rows], "fp bigint")
    got = dict(map(tuple, components(simhash.links(frame, radius, crowded), "a", "b").collect()))
    root = {v: v for v in rows}
    for _ in rows:
        for a in rows:
            for b in rows:
                if ((a ^ b) % (1 << 64)).bit_count() <= radius and root[b] < root[a]:
                    root[a] = root[b]
        if all(root[a] == root[root[a]] for a in rows):
            pass
    assert {v: got.get(v, v) for v in rows} == root


def test_components_of_chains_and_empty_graphs(spark):
    links = [(k, k + 1) for k in range(200)] + [(500, 501), (501, 500), (7, 7), (None, 3)] + [(1000, 1000 + k) for k in range(300)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b").collect()))
    assert got == ({k: 0 for k in range(201)} | {500: 500, 501: 500} | {1000 + k: 1000 for k in range(300)})
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def test_near_duplicates_of_messy_rows(messy):
    rows = simhash.near_duplicates(messy).collect()
    assert len(rows) == messy.count()
    assert {r.component_id for r in rows if r.fingerprint == "0" * 16} == {2}
    assert {r.component_id for r in rows if r.doc_id in (9, 10)} == {9}
    kept = simhash.keep_one(messy)
    assert kept.columns == messy.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id in (2, 3, 4, 9, 10)) == [2, 9, 9]
    assert simhash.near_duplicates(messy.limit(0)).count() == 0


def leaky(documents, items):
    rng = random.Random(4)
    rows = list(documents[:60])
    for k, (_, text) in enumerate(items):
        words = rows[k % 60][1].split()
        at = rng.randrange(len(words))
        part = text.upper().replace(" ", ",\n") if k % 3 == 0 else text
        if k % 4 == 1:
            part = " ".join(part.split()[:len(part.split()) * 2 // 3])
        rows.append((50_000 + k, " ".join([*words[:at], part, *words[at:]])))
    return rows


def test_leaks(spark, documents, folder):
    items = sorted(tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect())
    items += [(900, "two words"), (901, " ".join(f"long{k} item{k % 7}" for k in range(90))), (902, None), (None, "no id")]
    rows = leaky(documents, items[:42])
    docs, tests = (spark.createDataFrame(rows, "doc_id bigint, text string"),
                   spark.createDataFrame(items, "item_id bigint, text string"))
    found = decontaminate.find(docs, tests).collect()
    assert {(r.doc_id, r.item_id) for r in found} == brute.leaks(rows, [x for x in items if x[0] is not None])
    assert all(0.5 <= r.score < 1.01 and 0.8 <= r.overlap <= 1 for r in found) and len(found) > 30
    clean = {r.doc_id for r in decontaminate.keep_clean(docs, tests).collect()}
    assert clean == {i for i, _ in rows} - {r.doc_id for r in found}


def test_all_above_the_threshold_are_found(documents):
    """Block-max skipping against scores computed in full."""
    rng = random.Random(6)
    items = [(k, " ".join(rng.choice(documents)[1].split()[:rng.randint(3, 60)])) for k in range(80)]
    (index,) = decontaminate.indexes(items)
    texts = [decontaminate.words(t) for _, t in documents[:30]] + [decontaminate.words(t) for _, t in items[:20]]
    got = {(d, start, item) for d, start, item, _ in index.search(texts, 0.3)}
    want = set()
    for d, words in enumerate(texts):
        for w in range(max(1, -(-len(words) // 64) - 1)):
            terms = {index.terms[x] for x in words[64 * w:64 * w + 128] if x in index.terms}
            for item in range(len(items)):
                score = sum(index.impact[p] for t in terms for p in range(index.starts[t], index.starts[t + 1])
                            if index.items[p] == item)
                if score >= 0.3:
                    want.add((d, 64 * w, item))
    assert got == want and len(want) > 20


def test_leaks_of_messy_rows(spark, messy):
    tests = spark.createDataFrame([(1, "the same text twice over"), (2, ""), (3, None)], "item_id bigint, text string")
    found = decontaminate.find(messy, tests)
    assert sorted(r.doc_id for r in found.collect()) == [9, 9, 10]
    kept = decontaminate.keep_clean(messy, tests)
    assert kept.columns == messy.columns and kept.count() == messy.count() - 3
    assert decontaminate.find(messy.limit(0), tests).count() == 0
    assert decontaminate.find(messy, tests.limit(0)).count() == 0
    assert decontaminate.keep_clean(messy, tests.limit(0)).count() == messy.count()
