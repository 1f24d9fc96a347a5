"""Ranked lexical search: term-at-a-time over short lists, document-at-a-time over the rest."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidelog.llm.common import arrays, nonempty, written

#: Answers per query.
TOP = 50
#: Bytes of queries that are asked together; more are asked in further passes, so that what is
#: broadcast and what the driver holds at once has a bound.
LOT_BYTES = 4 << 20
#: Documents and postings that a task holds as one shard; either closes it.
SHARD_DOCS, SHARD_POSTINGS = 1 << 16, 4 << 20
#: Documents between two entries of a list's table of bounds.
STRIDE = 1024
#: A list is short if at most one document in so many of the shard is on it.
SHORT = 16
#: Term weights: floor(1000 ln((2 N + 2) / (2 df + 1))). A document's length counts half.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of characters beyond ASCII, A-Z in lower case; of null, none."""
    return text.translate(_FOLD).split() if text else []


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Shard:
    """Lists of the documents of one shard, by term. Documents are numbered in the order of their ids."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, documents: np.ndarray, which: np.ndarray,
                 times: np.ndarray, weights: np.ndarray, total: int, words: int):
        by_id = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[by_id] = np.arange(len(ids))
        self.ids = ids[by_id]
        length = 100 - 50 + (50 * lengths * total) // max(words, 1)
        part = weights[which] * ((10**9 * times) // (1000 * times + 20 * length[documents]))
        documents = place[documents]
        order = np.argsort(which * len(ids) + documents, kind="stable")
        which, self.documents, self.parts = which[order], documents[order], part[order]
        self.starts = np.searchsorted(which, np.arange(len(weights) + 1))
        self.windows = -(-len(ids) // STRIDE)
        cell = which * self.windows + self.documents // STRIDE
        first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else np.zeros(0, np.int64)
        self.cell_window = self.documents[first] // STRIDE
        self.cell_top = np.maximum.reduceat(self.parts, first) if len(first) else first
        self.cell_starts = np.searchsorted(which[first], np.arange(len(weights) + 1))

    def list_of(self, term: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(documents, parts of scores, largest part in each window) of a long list."""
        own, cells = (slice(s[term], s[term + 1]) for s in (self.starts, self.cell_starts))
        tops = np.zeros(self.windows, np.int64)
        tops[self.cell_window[cells]] = self.cell_top[cells]
        return self.documents[own], self.parts[own], tops

    def accumulated(self, some: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The short lists added up term at a time: one list like any other, with bounds of its own."""
        slices = [slice(self.starts[t], self.starts[t + 1]) for t in some]
        documents = np.concatenate([self.documents[s] for s in slices])
        documents, sums = summed(documents, np.concatenate([self.parts[s] for s in slices]))
        tops = np.zeros(self.windows, np.int64)
        np.maximum.at(tops, documents // STRIDE, sums)
        return documents, sums, tops

    def search(self, query: np.ndarray, best: Best) -> None:
        """Offer every document that can be among the best: what is left out scores less than the worst held."""
        sizes = self.starts[query + 1] - self.starts[query]
        short = [int(t) for t, n in zip(query, sizes) if 0 < n * SHORT <= len(self.ids)]
        lists = [self.list_of(int(t)) for t, n in zip(query, sizes) if n * SHORT > len(self.ids)]
        if short:
            lists.append(self.accumulated(short))
        if not lists:
            return
        tops = np.stack([t for _, _, t in lists])
        reach = tops.sum(axis=0)
        edges = np.arange(self.windows + 1) * STRIDE
        cuts = [np.searchsorted(d, edges) for d, _, _ in lists]
        for w in np.flatnonzero(reach):
            if reach[w] < best.least:
                continue
            there = [(int(tops[k, w]), *(v[cuts[k][w]:cuts[k][w + 1]] for v in lists[k][:2]))
                     for k in range(len(lists)) if tops[k, w]]
            best.offer(self.ids, *window(sorted(there, key=lambda x: x[0]), best.least))


def summed(documents: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents once each, in order, with the sum of their parts."""
    order = np.argsort(documents, kind="stable")
    documents = documents[order]
    first = np.flatnonzero(np.concatenate(([True], documents[1:] != documents[:-1])))
    return documents[first], np.add.reduceat(parts[order], first)


def window(lists: list[tuple[int, np.ndarray, np.ndarray]], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a window that score ``least`` or more, given (largest part, documents, parts) by largest part.

    Lists that cannot reach ``least`` together name no candidates. They are looked up for the candidates
    of the others, the largest first, as long as a candidate can still reach it.
    """
    bounds = np.cumsum([top for top, _, _ in lists])
    few = int(np.searchsorted(bounds, least))  # lists 0 .. few - 1 stay below
    few = min(few, len(lists) - 1)
    found, scores = summed(*(np.concatenate([x[k] for x in lists[few:]]) for k in (1, 2)))
    for k in range(few - 1, -1, -1):
        open_ = scores + bounds[k] >= least
        found, scores = found[open_], scores[open_]
        if not len(found):
            break
        _, documents, parts = lists[k]
        at = np.minimum(np.searchsorted(documents, found), len(documents) - 1)
        scores = scores + np.where(documents[at] == found, parts[at], 0)
    good = scores >= least
    return found[good], scores[good]


class Best:
    """The best answers of a query so far, equal scores by the smaller id."""

    def __init__(self, top: int):
        self.top, self.least = top, 1
        self.ids = self.scores = np.zeros(0, np.int64)

    def offer(self, ids: np.ndarray, places: np.ndarray, scores: np.ndarray) -> None:
        if not len(places):
            return
        ids, scores = np.concatenate([self.ids, ids[places]]), np.concatenate([self.scores, scores])
        kept = np.lexsort((ids, -scores))[:self.top]
        self.ids, self.scores = ids[kept], scores[kept]
        if len(kept) == self.top:
            self.least = max(1, int(self.scores[-1]))


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, times) of every document with a term: how many terms it has, and those of the
    vocabulary with their occurrences."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())),
                        ("times", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, size = shared.value.get, len(shared.value) + 1
        for batch in nonempty(batches):
            for at in range(0, batch.num_rows, 100):
                some = batch.slice(at, 100)
                sizes, known = [], []
                for text in some.column("text").to_pylist():
                    words = terms(text)
                    sizes.append(len(words))
                    known.append(np.fromiter(filter(None, map(get, words)), np.int64))
                owner = np.repeat(np.arange(len(sizes)), [len(k) for k in known])
                key, times = np.unique(owner * size + np.concatenate(known), return_counts=True)
                offsets = np.searchsorted(key // size, np.arange(len(sizes) + 1)).astype(np.int32)
                found = [pa.ListArray.from_arrays(offsets, pa.array(v, t)) for v, t in (
                    (key % size - 1, pa.int32()), (times, pa.int64()))]
                out = pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(sizes, pa.int64()), *found], schema=schema)
                yield out.filter(pa.array(np.array(sizes) > 0))

    rows = docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(cast(text as string) as binary) as text")
    return rows.mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, times array<bigint>")


def answers(lists: DataFrame, queries: list[np.ndarray], weights: np.ndarray, total: int, words: int, top: int) -> DataFrame:
    """(query, doc_id, score): the best of each task's documents for every query."""
    shared = lists.sparkSession.sparkContext.broadcast((queries, weights))
    schema = pa.schema([("query", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, known = shared.value
        best = [Best(top) for _ in asked]
        held: list[pa.RecordBatch] = []

        def close() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            which, times = (table.column(c).chunk(0) for c in ("terms", "times"))
            documents = np.repeat(np.arange(table.num_rows), np.diff(which.offsets.to_numpy()))
            shard = Shard(table.column("doc_id").to_numpy(), table.column("n").to_numpy(), documents,
                          which.flatten().to_numpy().astype(np.int64), times.flatten().to_numpy(), known, total, words)
            for query, own in zip(asked, best, strict=True):
                shard.search(query, own)
            held.clear()

        rows = entries = 0
        for batch in nonempty(batches):
            held.append(batch)
            rows, entries = rows + batch.num_rows, entries + len(batch.column("terms").flatten())
            if rows >= SHARD_DOCS or entries >= SHARD_POSTINGS:
                close()
                rows = entries = 0
        if held:
            close()
        for k, own in enumerate(best):
            if len(own.ids):
                yield arrays(schema, {"query": np.full(len(own.ids), k, np.int32), "doc_id": own.ids, "score": own.scores})

    named = lists.filter("doc_id is not null and size(terms) > 0")
    return named.mapInArrow(run, "query int, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of every item with a score above 0, ties by smaller doc_id.

    One pass over the texts gives each document's occurrences of the queries' terms; counts of documents and
    terms come from that table. Each task then turns its documents into shards with a list per term. Of a
    query, the short lists are added up term at a time; their sums are one more list, and all
    lists are gone through document at a time, window by window: a window whose bounds stay below the
    worst of the ``top`` held so far is skipped, and in the others only lists that can reach it together
    name candidates. The best of all tasks are merged.

    Scores are 64-bit integers. Documents without a term count nowhere; those with a null doc_id count in the
    statistics and are no answers; rows that share an id are answers of their own. Null or empty items
    have no answers; a null item_id is kept; equal items have the answers once for each row. Empty tables
    give no rows; other columns are not read.
    """
    asked = items.selectExpr("cast(item_id as bigint) as item_id", "cast(text as string) as text").filter("text is not null")
    texts = written(asked.select("text").distinct())
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    lots = max(1, -(-size // LOT_BYTES))
    spark, found = docs.sparkSession, []
    for k in range(lots):
        lot = [r.text for r in texts.filter(F.pmod(F.xxhash64("text"), F.lit(lots).cast("bigint")) == k).collect()]
        bags = [sorted(set(terms(t.encode()))) for t in lot]
        vocabulary = {t: n + 1 for n, t in enumerate(sorted({t for bag in bags for t in bag}))}
        queries = [np.array([vocabulary[t] - 1 for t in bag], np.int64) for bag in bags]
        lists = written(postings(docs, vocabulary))
        total, words = lists.agg(F.count(F.lit(1)), F.sum("n")).first()
        counts = lists.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toArrow()
        df = dict(zip(counts.column("term").to_pylist(), counts.column("df").to_pylist(), strict=True))
        weights = np.array([weight(total, df.get(n, 0)) for n in range(len(vocabulary))], np.int64)
        order = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
        merged = answers(lists, queries, weights, total, words or 0, top).withColumn(
            "rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        names = spark.createDataFrame(list(enumerate(lot)), "query int, text string")
        answered = merged.join(names, "query").join(asked, "text").select("item_id", "rank", "doc_id", "score")
        found.append(written(answered) if lots > 1 else answered)
    whole = found[0]
    for more in found[1:]:
        whole = whole.union(more)
    return whole
