"""Language identification by prediction by partial matching (PPM) on bytes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidelog.llm.common import arrays, has_letter, held_out, nonempty, strings
from tidelog.session import durable

#: Longest context in bytes, at most 6. Contexts reach back to the blank before a word.
ORDER = 4
#: Labelled documents learned from, per language (the expected number of a sample by hash).
SAMPLE_DOCS = 3000
#: Languages whose statistics are held in one model; more of them have several models.
LANGUAGES_AT_ONCE = 200
UNKNOWN = "und"
#: Distinct words whose code lengths a worker keeps, for one model; bounds memory, not results.
KEPT_WORDS = 150_000
#: Bytes of words that are taken apart at once; bounds memory, not results.
LOT_BYTES = 1 << 18


def words(text: str) -> list[bytes]:
    return text.lower().encode().split()


def _windows(some: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of the words, each word between blanks: symbol, the bytes before it as one number
    (the nearest in the lowest place), and how many there are in its word, up to ``order``."""
    flat = np.frombuffer(b" " + b" ".join(some) + b" ", np.uint8).astype(np.int64)
    blank = flat == 32
    place = np.arange(len(flat))
    since = place - np.maximum.accumulate(np.where(blank, place, 0))
    # the blank that ends a word is predicted from the word, and begins the next one's contexts
    depth = np.zeros(len(flat), np.int64)
    depth[1:] = np.minimum(since[:-1] + 1, order)
    before = np.zeros(len(flat), np.int64)
    for k in range(order, 0, -1):
        earlier = np.zeros(len(flat), np.int64)
        earlier[k:] = flat[:-k]
        before = before << 8 | np.where(depth >= k, earlier, 0)
    return flat[1:], before[1:], depth[1:]


def _lots(some: list[bytes]) -> Iterator[list[bytes]]:
    """The words in order, about LOT_BYTES at a time."""
    ends = np.cumsum([len(w) + 1 for w in some])
    cuts = np.searchsorted(ends, np.arange(LOT_BYTES, ends[-1] if some else 0, LOT_BYTES), side="right")
    for begin, end in pairwise([0, *dict.fromkeys(cuts.tolist()), len(some)]):
        if begin < end:
            yield some[begin:end]


def context_counts(some: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(depth, context and symbol as one number, count) over words, all depths up to ``order``."""
    parts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(order + 1)]
    for lot in _lots(some):
        symbol, before, depth = _windows(lot, order)
        for k in range(order + 1):
            there = depth >= k
            parts[k].append(np.unique((before[there] & ((1 << 8 * k) - 1)) << 8 | symbol[there], return_counts=True))
    levels, keys, counts = [], [], []
    for k, found in enumerate(parts):
        key, of = np.unique(np.concatenate([f[0] for f in found] or [np.zeros(0, np.int64)]), return_inverse=True)
        n = np.concatenate([f[1] for f in found] or [np.zeros(0, np.int64)])
        levels.append(np.full(len(key), k))
        keys.append(key)
        counts.append(np.bincount(of, n, len(key)).astype(np.int64))
    return np.concatenate(levels), np.concatenate(keys), np.concatenate(counts)


class Model:
    """Frozen statistics: for each depth the sorted keys of the context trees of all languages, and
    per language the code length (in nats) of a symbol in its context and of the escape from it."""

    def __init__(self, languages: list[str], order: int, rows: np.ndarray):
        """rows: (language, depth, key, count) as columns of an integer array."""
        self.languages, self.order, self.levels = languages, order, []
        n = len(languages)
        for k in range(order + 1):
            lang, _, key, count = rows[rows[:, 1] == k].T if len(rows) else np.zeros((4, 0), np.int64)
            keys, at = np.unique(key, return_inverse=True)
            seen = np.zeros((len(keys), n))
            np.add.at(seen, (at, lang), count)
            contexts, of = np.unique(keys >> 8, return_inverse=True)
            total, distinct = np.zeros((len(contexts), n)), np.zeros((len(contexts), n))
            np.add.at(total, of, seen)
            np.add.at(distinct, of, seen > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                hit = np.where(seen > 0, np.log(total + distinct)[of] - np.log(seen), np.nan)
                escape = np.where(total > 0, np.log(total + distinct) - np.log(distinct), 0.0)
            self.levels.append((keys, hit.astype(np.float32), contexts, escape.astype(np.float32)))

    def code_lengths(self, some: list[bytes]) -> np.ndarray:
        """Exact code length in nats of each word and the blank after it, a column per language.

        A symbol is coded in its longest context that the language has seen; one not seen there
        costs the escape and is tried in the next shorter context, at last as one byte of 256.
        """
        n = len(self.languages)
        symbol, before, depth = _windows(some, self.order)
        cost, open_ = np.zeros((len(symbol), n), np.float32), np.ones((len(symbol), n), bool)
        for k in range(self.order, -1, -1):
            keys, hit, contexts, escape = self.levels[k]
            if not len(keys):
                continue
            there = np.flatnonzero((depth >= k) & open_.any(1))
            context = before[there] & ((1 << 8 * k) - 1)
            key = context << 8 | symbol[there]
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            known = (keys[at] == key)[:, None] & ~np.isnan(hit[at]) & open_[there]
            up = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            leave = np.where((contexts[up] == context)[:, None] & open_[there] & ~known, escape[up], 0)
            cost[there] += np.where(known, hit[at], leave)
            open_[there] &= ~known
        cost += open_ * np.float32(np.log(256))
        ends = np.cumsum([len(w) + 1 for w in some])
        return np.add.reduceat(cost, np.concatenate(([0], ends[:-1])), axis=0) if some else cost


class Models:
    """Models of LANGUAGES_AT_ONCE languages each, side by side: every language takes part."""

    def __init__(self, lots: list[Model]):
        self.lots, self.languages = lots, [name for lot in lots for name in lot.languages]

    def code_lengths(self, some: list[bytes]) -> np.ndarray:
        return np.concatenate([lot.code_lengths(some) for lot in self.lots], axis=1)


class Scorer:
    """Code lengths of texts; those of a word are worked out once and kept."""

    def __init__(self, model: Model | Models):
        self.model, self.place, self.costs = model, {}, np.zeros((0, len(model.languages)), np.float32)
        self.most = KEPT_WORDS * LANGUAGES_AT_ONCE // max(LANGUAGES_AT_ONCE, len(model.languages))

    def lengths(self, word_lists: list[list[bytes]]) -> np.ndarray:
        if len(self.place) > self.most:
            self.place, self.costs = {}, self.costs[:0]
        new = list({w for some in word_lists for w in some if w not in self.place})
        if new:
            self.place.update(zip(new, range(len(self.costs), len(self.costs) + len(new)), strict=True))
            parts = [self.model.code_lengths(lot) for lot in _lots(new)]
            self.costs = np.concatenate([self.costs, *parts])
        out = np.zeros((len(word_lists), len(self.model.languages)))
        for k, some in enumerate(word_lists):
            out[k] = self.costs[np.fromiter(map(self.place.__getitem__, some), np.int64, len(some))].sum(
                axis=0, dtype=np.float64)
        return out


def train(labelled: DataFrame, order: int = ORDER, sample_docs: int = SAMPLE_DOCS) -> Models:
    """Statistics of (doc_id, text, lang) rows.

    Of each language about ``sample_docs`` rows are learned from, chosen by a hash of the id so that
    the choice depends on nothing else; their texts are counted whole. Rows without text or language
    are passed over. The counts of the context trees are summed by Spark; their number is
    bounded by the sample, so the finished trees of LANGUAGES_AT_ONCE languages fit on the driver.
    """
    rows = labelled.filter("lang is not null")
    sizes = durable(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    languages = sorted(r.lang for r in sizes.select("lang").collect())
    share = (F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("sample")).cast("double")
             / 2.0**64 + 0.5)
    sizes = sizes.withColumnRenamed("lang", "of")
    sample = rows.join(sizes, F.col("lang") == F.col("of")).filter(share * F.col("n") < sample_docs).select("lang", "text")
    numbers = {name: k for k, name in enumerate(languages)}
    schema = pa.schema([("language", pa.int32()), ("depth", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])

    def count(batches):
        for batch in nonempty(batches):
            by: dict[int, list[bytes]] = {}
            for lang, text in zip(strings(batch, "lang"), strings(batch, "text"), strict=True):
                by.setdefault(numbers[lang], []).extend(words(text))
            for language, some in by.items():
                depth, key, n = context_counts(some, order)
                yield arrays(schema, {"language": np.full(len(key), language), "depth": depth, "key": key, "n": n})

    counted = sample.mapInArrow(count, "language int, depth int, key bigint, n bigint").groupBy(
        "language", "depth", "key").agg(F.sum("n").alias("n"))
    starts = range(0, max(1, len(languages)), LANGUAGES_AT_ONCE)
    if len(starts) > 1:
        counted = durable(counted)
    lots = []
    for at in starts:
        own = counted.filter(F.col("language").between(at, at + LANGUAGES_AT_ONCE - 1)).select(
            F.col("language") - at, "depth", "key", "n").toPandas()
        lots.append(Model(languages[at:at + LANGUAGES_AT_ONCE], order, own.to_numpy(np.int64).reshape(-1, 4)))
    return Models(lots)


def told(scorer: Scorer, texts: list[str | None]) -> tuple:
    """Names with ``und`` behind them, and per text the number of its name, score, bits per byte."""
    names = np.array([*scorer.model.languages, UNKNOWN], object)
    split = [words(t) if has_letter(t) and len(names) > 1 else [] for t in texts]
    some = np.array([bool(s) for s in split])
    best, score = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
    bits = np.full(len(texts), np.nan)
    if some.any():
        nats = scorer.lengths([s for s in split if s])
        lowest = nats.min(1, keepdims=True)
        best[some] = nats.argmin(1)
        score[some] = 1 / np.exp(lowest - nats).sum(1)
        bits[some] = lowest[:, 0] / np.log(2) / [sum(map(len, s)) + len(s) for s in split if s]
    return names, best, score, bits


def predict(docs: DataFrame, model: Model | Models) -> DataFrame:
    """(doc_id, lang_pred, score, bits_per_byte) per row.

    The language in which the whole text has the shortest code; ties go to the first name in order.
    ``score`` is its share among all languages' likelihoods. A text that is null or has no letter, and any
    text of a model without languages, gets ``und`` and score 0. Null ids stay null; equal rows come out
    once each; only ``doc_id`` and ``text`` are read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()),
                        ("bits_per_byte", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in nonempty(batches):
            names, best, score, bits = told(_scorer(shared), strings(batch, "text"))
            yield arrays(schema, {"doc_id": batch.column("doc_id"), "lang_pred": names[best], "score": score,
                                  "bits_per_byte": pa.array(bits, from_pandas=True)})

    rows = docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text")
    return rows.mapInArrow(run, "doc_id bigint, lang_pred string, score double, bits_per_byte double")


_SCORERS: dict = {}


def _scorer(shared) -> Scorer:
    """One scorer per model and worker process, so that kept words outlive a task."""
    key = id(shared.value)
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(shared.value)
    return _SCORERS[key]


def training_fold(doc_id: Column) -> Column:
    """Documents that are never learned from: crc32 of the id modulo 3 is 1."""
    return held_out(doc_id, 3, 1)


def identify(docs: DataFrame, order: int = ORDER, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Learn from the training fold of ``docs`` and predict the language of all of them."""
    model = train(docs.filter(~training_fold(F.col("doc_id"))).select("doc_id", "text", "lang"), order, sample_docs)
    out = training_fold(F.col("doc_id"))
    return predict(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score", "bits_per_byte")


def keep_identified(docs: DataFrame, least_score: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose language is told with at least ``least_score``, with all their
    columns. What goes is what ``predict`` calls ``und`` or cannot tell apart. No shuffle: rows
    are dropped where they are read."""
    model = train(docs.filter(~training_fold(F.col("doc_id"))).select("doc_id", "text", "lang"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in nonempty(batches):
            _, best, score, _ = told(_scorer(shared), strings(batch, "text"))
            yield batch.filter(pa.array((best < len(model_names)) & (score >= least_score)))

    model_names = model.languages
    return docs.mapInArrow(run, docs.schema)
