"""Language models, language identification and page extraction."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from tidelog.llm import extract, labelled_pages, language, mixing
from tidelog.llm.blocks import leaf_blocks
from tidelog.llm.common import words_of


def is_held_out(doc_id, modulus, remainder):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % modulus == remainder


# ---- language identification ----

def ppm(words, word, order):
    """Code length of a word and its blank, in nats, by counting anew."""
    total = 0.0
    text = b" " + word + b" "
    trained = [b" " + w + b" " for w in words]
    for at in range(1, len(text)):
        for k in range(min(order, at), -1, -1):
            context = text[at - k:at]
            seen = Counter(t[j] for t in trained for j in range(1, len(t)) if j >= k and t[j - k:j] == context)
            if not seen:
                continue
            n, d = sum(seen.values()), len(seen)
            if seen[text[at]]:
                total += math.log((n + d) / seen[text[at]])
                break
            total += math.log((n + d) / d)
        else:
            total += math.log(256)
    return total


def test_code_lengths_are_exact():
    words = {0: [b"the", b"then", b"the", b"other"], 1: [b"die", b"der", "größe".encode(), b"der"]}
    rows = np.concatenate([np.stack([np.full(len(k), lang), d, k, n], 1) for lang, some in words.items()
                           for d, k, n in [language.context_counts(some, 3)]])
    model = language.Model(["en", "de"], 3, rows)
    asked = [b"the", b"there", b"xyz", "ö".encode(), b"d", b"derderder"]
    got = model.code_lengths(asked)
    for word, costs in zip(asked, got, strict=True):
        assert costs == pytest.approx([ppm(words[0], word, 3), ppm(words[1], word, 3)], rel=1e-5)


def test_language_of_held_out_documents(spark, folder):
    docs = spark.read.parquet(f"{folder.replace('0.001', '0.01')}/documents.parquet")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == is_held_out(r.doc_id, 3, 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.99


def test_language_of_messy_rows(messy):
    rows = language.identify(messy).collect()
    assert len(rows) == messy.count()
    found = {r.doc_id: (r.lang_pred, r.score) for r in rows}
    assert found[2] == found[3] == found[4] == found[11] == ("und", 0.0)
    learned = {r.lang for r in messy.collect() if r.lang is not None and not is_held_out(r.doc_id, 3, 1)}
    assert {r.lang_pred for r in rows} <= learned | {"und"}
    kept = language.keep_identified(messy)
    assert kept.columns == messy.columns
    assert {2, 3, 4, 11}.isdisjoint(r.doc_id for r in kept.collect())
    assert language.identify(messy.limit(0)).count() == 0
    unlabelled = messy.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(unlabelled).collect()} == {"und"}


# ---- context mixing ----

def test_tree_has_each_edge_once():
    words = sorted([b"Athe", b"Athen", b"Ato", b"Bto", b"Bx", b"Athere"])
    tree = mixing.Tree(words, np.arange(1.0, 7.0))
    edges = {}
    for w, n in zip(words, range(1, 7), strict=True):
        text = w + b" "
        for k in range(len(text)):
            edges[text[:k + 1]] = edges.get(text[:k + 1], 0) + n
    assert sorted(zip(tree.weight, tree.symbol.tolist(), strict=True)) == sorted((n, e[-1]) for e, n in edges.items())
    assert tree.sum_by_word(np.ones(len(tree.symbol))).tolist() == [len(w) + 1 for w in words]
    zeros, ones = tree.prefix_counts(0)
    assert (zeros + ones)[tree.depth == 0].tolist() == [21.0] * 2


def test_model_is_a_distribution():
    """The bits of a byte after a beginning: probabilities over all next bytes add up to one."""
    words = sorted([b"Athe", b"Athen", b"Ato", b"Btor"])
    mixer = mixing.Mixer(np.random.default_rng(1).integers(0, 9, (mixing.ORDERS, 1 << mixing.SLOT_BITS, 2)).astype(np.float32))
    mixer.learn(mixing.Tree(words, np.ones(4)))
    own = {w: 1 for w in words}
    every = sorted({*words, *(b"Ato" + bytes([k]) for k in range(33, 256))})
    bits = dict(zip(every, mixer.code_lengths(mixing.Tree(every, np.array([float(own.get(w, 0)) for w in every]))), strict=True))
    # all words Ato?, each followed by a blank, share what comes before and differ in one byte
    sums = sum(2.0 ** -bits[b"Ato" + bytes([k])] for k in range(33, 256))
    assert 0 < sums < 1


def test_base_scores_and_gain(spark, folder):
    docs = spark.read.parquet(f"{folder.replace('0.001', '0.01')}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    c = brute.word_counts(t for i, t in texts.items() if not is_held_out(i, 7, 2))
    total, distinct = sum(c.values()), len(c)
    gain = []
    for r in mixing.score(docs).collect():
        tokens = [*texts[r.doc_id].encode().lower().split(), "end"]
        base = sum(math.log10((c[t] + 1) / (total + distinct + 1)) for t in tokens)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (
            is_held_out(r.doc_id, 7, 2), len(tokens), sum(c[t] > 0 for t in tokens), total)
        assert r.base_score == pytest.approx(base) and r.score < 0
        if r.held_out:
            gain.append(r.score - base)
    assert sum(gain) > 0


def test_classes_are_fitted_on_all_documents(spark):
    """The words of all 12,300 documents are ranked by all their occurrences, and one document in forty makes a class."""
    rng = random.Random(2)
    rows = [(k, " ".join(f"a{rng.randrange(40)}" for _ in range(20))) for k in range(12_000)]
    rows += [(50_000 + k, " ".join(f"b{rng.randrange(10)}" for _ in range(20))) for k in range(300)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    counts = Counter(w.encode() for _, t in rows for w in t.split())
    found = mixing.classes(frame)
    assert found.words.to_pylist() == sorted(counts, key=lambda w: (-counts[w], w))
    own = found.of(mixing.Words(pa.array([t for _, t in rows] + [None, ""])))
    assert len({*own[:12_000]}) <= 2 and not {*own[:12_000]} & {*own[12_000:-2]} and own[-1] == own[-2] == 0


def test_words_of_arrays():
    texts = ["One two  ONE", None, "", " \t\x0b", "a\x1cb\u00a0c d\r\né\x85 É", "end"]
    words = mixing.Words(pa.chunked_array([texts[:2], texts[2:]], pa.string()))
    found = [[] for _ in texts]
    for of, w in zip(words.of, words.flat.to_pylist(), strict=True):
        found[of].append(w)
    assert found == [words_of(t) for t in texts]
    groups = {k: (texts.tolist(), some.to_pylist(), which.tolist()) for k, texts, some, which in
              words.by_group(np.array([1, 0, 0, 1, 0, 1]))}
    assert groups == {0: ([1, 2, 4], found[4], [3, 4, 5, 6]), 1: ([0, 3, 5], [*found[0], b"end"], [0, 1, 2, 7])}


def test_what_is_learned_last_does_not_decide():
    """Weights of words in order, the words of one beginning last, cost about as much as in a mixed order."""
    rng = np.random.default_rng(4)
    words = sorted({bytes([65 + c]) + b"".join(bytes([97 + x]) for x in rng.integers(3 * c, 3 * c + 6, rng.integers(2, 7)))
                    for c in range(7) for _ in range(300)})
    n = np.round(2000 / (1 + rng.permutation(len(words)))) + 1
    whole = mixing.Tree(words, n)
    tables = np.zeros((mixing.ORDERS, 2, 1 << mixing.SLOT_BITS), np.float32)
    for order in range(1, mixing.ORDERS + 1):
        for bit in range(8):
            np.add.at(tables[order - 1], (whole.symbol >> (7 - bit) & 1, whole.slots(order, bit)), whole.weight)
    base, costs = (n * (np.log2(n.sum()) - np.log2(n))).sum(), []
    for order in (np.arange(len(words)), rng.permutation(len(words))):
        mixer = mixing.Mixer(tables.transpose(0, 2, 1))
        for lot in np.array_split(order, 20):
            mixer.learn(mixing.Tree([words[k] for k in sorted(lot)], n[sorted(lot)]))
        mixer.weights = mixer.passed[:, :-1] / np.maximum(mixer.passed[:, -1:], 1)
        costs.append((mixer.code_lengths(whole) * n).sum())
    assert max(costs) < 1.05 * min(costs) and max(costs) < 1.5 * base


def test_slot_rows_do_not_grow_with_partitions(spark):
    words = sorted(f"A{k * 7919:x}".encode() for k in range(3000))
    counts = spark.createDataFrame([(w, 1) for w in words], "word binary, c bigint")
    few, many = (counts.repartitionByRange(n, "word").sortWithinPartitions("word") for n in (1, 40))
    assert mixing.slot_sums(many, len(words)).count() == mixing.slot_sums(few, len(words)).count()
    assert np.array_equal(mixing.context_tables(many, len(words)), mixing.context_tables(few, len(words)))


def test_scores_of_messy_rows(spark, messy):
    rows = mixing.score(messy).collect()
    assert len(rows) == messy.count()
    assert {(r.n_tokens, r.n_known) for r in rows if r.doc_id in (2, 3, 4)} == {(1, 1)}
    assert len({r.score for r in rows if r.doc_id in (9, 10)}) == 1 and all(math.isfinite(r.score) for r in rows)
    assert mixing.score(messy.limit(0)).count() == 0
    alone = spark.createDataFrame([(None, "nothing to learn from")], "doc_id bigint, text string")
    (row,) = mixing.score(alone).collect()
    assert row.held_out and row.train_tokens == 0 and row.n_known == 0 and row.base_score == pytest.approx(0.0)


# ---- pages ----

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<nav><ul><li><a href="/">Home</a><li><a href=x>News</a></ul></nav><!-- <p>no</p> -->
<article><h1>A title &amp; more</h1><p>First  paragraph&nbsp;with<br>a break, and <a href="/y">a link</a>.<p>Second &lt;one&gt;
goes on &copy here.<ul><li>One item of a list.</li><li>Another item, with words.</ul><p></article>
<section id="comments"><h2>Comments</h2><div class="comment"><p>I liked this text a lot, thank you.</p></div></section>
<footer>&copy; 2020 Example</footer>"""


def test_blocks_and_text():
    assert [b.text for b in leaf_blocks(PAGE)][:4] == ["Home", "News", "A title & more",
                                                       "First paragraph with a break, and a link."]
    model = extract.train(labelled_pages.pages(extract.TRAINING_PAGES))
    assert extract.main_text(PAGE, model) == "\n\n".join([
        "A title & more", "First paragraph with a break, and a link.", "Second <one> goes on © here.",
        "One item of a list.", "Another item, with words."])
    for odd in ("", "<", "<p", "plain", "<a href='x>y", "</p></div>", "<script>", "<!--", "<p>" * 3000, "&am", "<p>a" + "<b>" * 5000):
        assert isinstance(extract.main_text(odd, model), str)


def test_held_out_labels_and_viterbi():
    model = extract.train(labelled_pages.pages(extract.TRAINING_PAGES))
    right = total = 0
    for page in labelled_pages.pages(150, seed=77):
        blocks = leaf_blocks(page)
        rows = extract.features(blocks)
        labels = model.decode(rows)
        right += sum(a == b.label for a, b in zip(labels, blocks, strict=True))
        total += len(blocks)
        if 0 < len(blocks) <= 8:  # against all paths
            def value(path, rows=rows):
                return sum(model.weights.get(n, (0, 0))[y] for y, row in zip(path, rows, strict=True) for n in row) + sum(
                    model.moves[a][b] for a, b in zip(path, path[1:], strict=False))

            paths = [[k >> t & 1 for t in range(len(blocks))] for k in range(1 << len(blocks))]
            assert value(labels) == pytest.approx(max(map(value, paths)))
    assert right / total > 0.98


def test_pages_of_messy_rows(spark):
    rows = [(1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "u", "<article><p>" + "long text, " * 50_000 + "end.</p></article>"),
            (3, "u", PAGE), (1, "u", PAGE)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    got = extract.extract(frame)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = got.collect()
    assert len(found) == 6 and all(r.n_chars == len(r.text) for r in found)
    assert {r.text for r in found if r.page_id in (2, None)} == {""}
    assert max(r.n_chars for r in found) > 500_000
    assert extract.extract(frame.limit(0)).count() == 0
