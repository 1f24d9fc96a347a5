"""Benchmark decontamination: a BM25 index of test items, asked with every training passage."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from tidelog.llm.common import arrays, nonempty, plain_names, strings

#: Bytes of test items that one index holds; more items are taken in several passes, each with an
#: index of its own, so what is broadcast has a bound.
LOT_BYTES = 16 << 20
#: Share of an item's own score that a passage must reach to be verified.
LEAST_SCORE = 0.5
#: Share of an item's shingles that a document must have.
LEAST_OVERLAP = 0.8
#: Share of a question's shingles that tells a leak on its own, for questions of SHINGLE words or more.
LEAST_QUESTION = 0.8
SHINGLE = 5
#: Words of a segment: segments of longer items are looked for on their own, since parts of an item may lie apart.
SEGMENT = 24
#: Passages of items up to 64 words have 128 words and start every 64; longer items double both.
LEAST_STRIDE = 64
K1, B = 1.2, 0.75
BLOCK = 16

_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    """Words in lower case, without punctuation."""
    return _WORD.findall(text.lower()) if text else []


def shingles(some: list[str]) -> set[tuple[str, ...]]:
    """Runs of five words; of fewer words, all of them; of none, nothing."""
    if len(some) <= SHINGLE:
        return {tuple(some)} if some else set()
    return set(zip(*(some[k:] for k in range(SHINGLE)), strict=False))


def parts(text: str) -> tuple[list[str], list[str]]:
    """Question and answer of an item: its last sentence or line is the answer; an item of one
    sentence is all question."""
    cut = [m.end() for m in re.finditer(r"[.?!:]\s+|\n+", text.rstrip())]
    return (words(text[:cut[-1]]), words(text[cut[-1]:])) if cut else (words(text), [])


def pieces(bag: list[str], question: int) -> list[tuple[int, int]]:
    """What of an item is looked for, as ranges of its words: the whole, its question of so many words if
    there is more to it, and of an item longer than one its segments of SEGMENT words."""
    n, out = len(bag), [(0, len(bag))]
    if SHINGLE <= question < n:
        out.append((0, question))
    if n > SEGMENT:
        parts = n // SEGMENT
        out += [(k * SEGMENT, (k + 1) * SEGMENT if k < parts - 1 else n) for k in range(parts)]
    return list(dict.fromkeys(out))


class Index:
    """Test items whose passages have one length, by term.

    The index holds an entry for each of the pieces of an item. Every posting has its BM25 impact as a
    share of the entry's score for its own text, so one threshold holds for all. Postings are sorted by
    entry, entries lie in blocks of BLOCK, and for every term and block the largest impact is known.
    """

    def __init__(self, items: list[tuple[int, str]], stride: int):
        self.stride, self.ids = stride, np.array([i for i, _ in items], np.int64)
        both = [parts(t) for _, t in items]
        self.questions = [shingles(q) for q, _ in both]
        self.answers = [shingles(a) for _, a in both]
        self.asks = [len(q) >= SHINGLE for q, _ in both]
        bags = [words(t) for _, t in items]
        self.shingles = [shingles(b) for b in bags]
        cut = [(k, bag[low:high]) for k, (bag, (q, _)) in enumerate(zip(bags, both, strict=True))
               for low, high in pieces(bag, len(q))]
        #: the item of every entry
        self.of = np.array([k for k, _ in cut])
        #: whether an entry is its item as a whole: the first of its pieces
        self.whole = np.diff(self.of, prepend=-1) > 0
        mean = sum(map(len, bags)) / len(bags)
        lists: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, piece) in enumerate(cut):
            for term, n in Counter(piece).items():
                lists[term].append((k, n))
        self.terms = {t: k for k, t in enumerate(lists)}
        self.starts = np.concatenate(([0], np.cumsum([len(p) for p in lists.values()])))
        self.entries = np.array([k for p in lists.values() for k, _ in p])
        frequency = np.array([n for p in lists.values() for _, n in p], float)
        size = np.array([len(piece) for _, piece in cut], float)
        # rare is what is in few items, however many pieces they have
        among = Counter(t for bag in bags for t in set(bag))
        df = np.array([among[t] for t in lists], float)
        idf = np.log(1 + (len(items) - df + 0.5) / (df + 0.5))
        held = np.diff(self.starts)
        impact = np.repeat(idf, held) * frequency * (K1 + 1) / (
            frequency + K1 * (1 - B + B * size[self.entries] / mean))
        own = np.bincount(self.entries, impact, len(cut))
        self.impact = impact / own[self.entries]
        self.block = self.entries // BLOCK
        self._split(held, len(cut))

    def _split(self, df: np.ndarray, n: int) -> None:
        """Terms in most entries come last: as long as all of them together stay under half the
        threshold in every block, a passage cannot be found by them alone, and their
        lists are read only for what the rarer terms have found."""
        blocks = -(-n // BLOCK)
        term = np.repeat(np.arange(len(df)), df)
        bound, late = np.zeros(n), np.zeros(len(df), bool)
        for t in np.argsort(-df, kind="stable"):
            own = slice(self.starts[t], self.starts[t + 1])
            with_it = bound.copy()
            with_it[self.entries[own]] += self.impact[own]
            if with_it.max() >= LEAST_SCORE / 2:
                break
            bound, late[t] = with_it, True
        self.late = late
        #: per late term the impacts by entry
        self.late_lists = {int(t): dict(zip(self.entries[(own := slice(self.starts[t], self.starts[t + 1]))].tolist(),
                                            self.impact[own].tolist(), strict=True)) for t in np.flatnonzero(late)}
        #: what late terms can add to an entry: the largest of its block
        self.rest = np.maximum.reduceat(bound, np.arange(0, n, BLOCK)).repeat(BLOCK)[:n]
        #: per term, its largest impact in each block that it occurs in, and in any
        entry, of = np.unique(term * blocks + self.block, return_inverse=True)
        self.block_top = np.zeros(len(entry))
        np.maximum.at(self.block_top, of, self.impact)
        self.block_of = entry % blocks
        self.block_starts = np.searchsorted(entry, np.arange(len(df) + 1) * blocks)
        self.limit = np.maximum.reduceat(self.block_top, self.block_starts[:-1])
        self.blocks = blocks

    @property
    def items(self) -> np.ndarray:
        """Per posting the item that it is of as a whole; -1 for postings of its other pieces."""
        return np.where(self.whole, self.of, -1)[self.entries]

    def search(self, word_lists: list[list[str]], least: float = LEAST_SCORE):
        """All (document, first word, item, score) whose score for the whole item reaches ``least``."""
        for d, start, entry, score in self.search_pieces(word_lists, least):
            if self.whole[entry]:
                yield d, start, int(self.of[entry]), score

    def search_pieces(self, word_lists: list[list[str]], least: float = LEAST_SCORE):
        """All (document, first word, entry, score) whose score reaches ``least``, passages in order.

        Block-max WAND for many passages at once: a passage is passed over if its terms' bounds cannot
        reach the threshold, then its blocks are by the terms' block bounds, then early terms
        are added up by entry and held against what late terms can still add, and only then are
        the scores of what is left completed.
        """
        sizes = np.array([len(w) for w in word_lists])
        windows = np.maximum(1, -(-sizes // self.stride) - 1)
        first = np.concatenate(([0], np.cumsum(windows)))
        flat = np.fromiter(map(self.terms.get, chain.from_iterable(word_lists), repeat(-1)), np.int64, sizes.sum())
        owner = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        hit = np.flatnonzero(flat >= 0)
        hit = hit[~self.late[flat[hit]]]
        half, doc, term = at[hit] // self.stride, owner[hit], flat[hit]
        # word half h is in the passages h - 1 and h
        in_first = half < windows[doc]
        in_second = half > 0
        passage = np.concatenate([(first[doc] + half)[in_first], (first[doc] + half - 1)[in_second]])
        term = np.concatenate([term[in_first], term[in_second]])
        # 0. most passages cannot reach it even if words that they repeat counted again
        reach = np.bincount(passage, self.limit[term], first[-1]) + self.rest.max()
        kept = (reach >= least - 1e-9)[passage]
        keys = _distinct(passage[kept] * len(self.terms) + term[kept], first[-1] * len(self.terms))
        passage, term = keys // len(self.terms), keys % len(self.terms)
        if not len(keys):
            return
        # 1. passages by the sum of their terms' largest impacts
        reach = np.bincount(passage, self.limit[term], first[-1]) + self.rest.max()
        kept = reach[passage] >= least
        passage, term = passage[kept], term[kept]
        # 2. blocks of a passage by the sum of its terms' block bounds
        entry, of = _expand(self.block_starts, term)
        cells, bound = _sums(passage[of] * self.blocks + self.block_of[entry], self.block_top[entry], first[-1] * self.blocks)
        if not len(cells):
            return
        cells = cells[bound + self.rest[cells % self.blocks * BLOCK] >= least - 1e-9]
        # 3. early terms' postings in those blocks, added up by passage and entry
        posting, of = _expand(self.starts, term)
        passage, n = passage[of], len(self.of)
        inside = _among(passage * self.blocks + self.block[posting], cells, first[-1] * self.blocks)
        posting, passage = posting[inside], passage[inside]
        if not len(posting):
            return
        key, early = _sums(passage * n + self.entries[posting], self.impact[posting], first[-1] * n)
        good = np.flatnonzero(early + self.rest[key % n] >= least - 1e-9)
        # 4. complete scores of what is left
        begins, seen, late = np.cumsum(sizes) - sizes, -1, []
        for window, entry, score in zip((key[good] // n).tolist(), (key[good] % n).tolist(), early[good].tolist(), strict=True):
            if window != seen:
                d = int(np.searchsorted(first, window, side="right") - 1)
                start = (window - int(first[d])) * self.stride
                end = min(start + 2 * self.stride, int(sizes[d]))
                there = {t for t in flat[begins[d] + start:begins[d] + end].tolist() if t >= 0}
                seen, late = window, [self.late_lists[t] for t in there if t in self.late_lists]
            rest = 0.0
            for own in late:
                rest += own.get(entry, 0.0)
            if score + rest >= least:
                yield d, start, entry, score + rest


def _expand(starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All entries of the lists of these rows, and for each the place of its row."""
    count = starts[rows + 1] - starts[rows]
    of = np.repeat(np.arange(len(rows)), count)
    return np.arange(count.sum()) + np.repeat(starts[rows] - (np.cumsum(count) - count), count), of


def _dense(n: int, size: int) -> bool:
    """Whether an array of ``size`` costs less than sorting n keys, in time and, up to a bound, in memory."""
    return size <= min(1 << 24, 16 * n)


def _distinct(keys: np.ndarray, size: int) -> np.ndarray:
    """The different keys, all below ``size``, in order."""
    if not _dense(len(keys), size):
        return np.unique(keys)
    there = np.zeros(size, bool)
    there[keys] = True
    return np.flatnonzero(there)


def _sums(keys: np.ndarray, numbers: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, all below ``size``, in order, and the sum of the numbers of each."""
    if not _dense(len(keys), size):
        some, of = np.unique(keys, return_inverse=True)
        return some, np.bincount(of, numbers, len(some))
    some = _distinct(keys, size)
    return some, np.bincount(keys, numbers, size)[some]


def _among(keys: np.ndarray, some: np.ndarray, size: int) -> np.ndarray:
    """Whether each key, all below ``size``, is one of some."""
    if not _dense(len(keys), size):
        return np.isin(keys, some)
    there = np.zeros(size, bool)
    there[some] = True
    return there[keys]


def share(wanted: set, there: set) -> float:
    return len(wanted & there) / len(wanted) if wanted else 0.0


def indexes(items: list[tuple[int, str]]) -> list[Index]:
    """Items by the length of the passages that surely hold them: each kind has its index."""
    kinds = defaultdict(list)
    for item, text in sorted(items, key=lambda r: (r[0], r[1])):
        n = len(words(text))
        if n:
            stride = LEAST_STRIDE
            while stride < n:
                stride *= 2
            kinds[stride].append((item, text))
    return [Index(some, stride) for stride, some in sorted(kinds.items())]


def leaks(found: list[Index], texts: list[str | None], least_overlap: float, least_question: float | None = None):
    """(document, item id, first word, score, overlaps of whole, question, answer): the best passage of each
    document and item, if the document holds enough of the item's or of its question's shingles."""
    word_lists = [words(t) for t in texts]
    best: dict[tuple[int, int], tuple] = {}
    for index in found:
        # the parts of an item may lie far from each other, so its shares are those of the document
        of, shares, runs = -1, {}, {}
        for d, start, entry, score in index.search_pieces(word_lists):
            item = int(index.of[entry])
            whole, question, answer = index.shingles[item], index.questions[item], index.answers[item]
            wanted = whole | question | answer
            if d != of:
                of, shares, runs = d, {}, {}
            if item not in shares:
                there = shingles_of(word_lists[d], wanted, runs)
                shares[item] = share(whole, there), share(question, there), share(answer, there)
            overlap, asked, _ = shares[item]
            if overlap >= least_overlap or (least_question is not None and index.asks[item] and asked >= least_question):
                there = shingles_of(word_lists[d][start:start + 2 * index.stride], wanted, {})
                key, rank = (d, int(index.ids[item])), (overlap, share(whole, there), score, -start)
                if key not in best or rank > best[key][0]:
                    best[key] = (rank, (key[1], start, score, *shares[item]))
    return [(d, *row) for (d, _), (_, row) in sorted(best.items())]


def shingles_of(passage: list[str], wanted: set, runs: dict[int, set]) -> set:
    """Those of the wanted shingles that a passage has, at their own lengths; ``runs`` has those of the passage
    by length, as far as they have been asked for."""
    for size in {len(s) for s in wanted} - runs.keys():
        runs[size] = set(zip(*(passage[k:] for k in range(size)), strict=False))
    return {s for s in wanted if s in runs[len(s)]}


def _lots(benchmark: DataFrame) -> list[Broadcast]:
    rows = benchmark.selectExpr("cast(item_id as bigint) as item_id", "cast(text as string) as text").filter(
        "item_id is not null and text is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    lots = -(-size // LOT_BYTES)
    context = benchmark.sparkSession.sparkContext
    out = []
    for k in range(lots):
        lot = F.pmod(F.xxhash64("item_id"), F.lit(lots).cast("bigint")) == k
        out.append(context.broadcast([(r.item_id, r.text) for r in rows.filter(lot).collect()]))
    return out


_BUILT: dict = {}


def _built(lot: Broadcast) -> list[Index]:
    """The indexes of a lot, built once in a worker process."""
    key = id(lot.value)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = (lot.value, indexes(lot.value))
    return _BUILT[key][1]


def find(docs: DataFrame, benchmark: DataFrame, least_overlap: float = LEAST_OVERLAP,
         least_question: float | None = None) -> DataFrame:
    """(doc_id, item_id, first_word, score, overlap, question_overlap, answer_overlap): test items in documents.

    Every document is cut into overlapping passages long enough to hold an item whole. Each passage
    asks the index of test items, which holds each item as a whole, its question, and segments of SEGMENT
    words; all items of which one of these reaches LEAST_SCORE of its BM25 score for its own text are
    verified: the document must have at least ``least_overlap`` of the item's word
    shingles, in one place or in several, or, if it is given, ``least_question`` of those of its question.
    A question of fewer than SHINGLE words counts only within its item. An answer is no leak on its own, as
    it may be common knowledge; its share tells a question that came with its answer. The row has the passage with
    most shingles, where it starts (in words), the score of the best piece there, and the shares of the
    whole, the question and the answer that the document holds. Missed can only be an item that lies scattered
    in parts so small that no passage has half the score of the question or of any segment.

    Documents are read once per LOT_BYTES of items, without a shuffle. Null or empty texts and
    items are found nowhere; a null item id is passed over; a null doc_id stays null; equal rows of
    documents come out once each, equal items once. Only the columns named above are read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int64()),
                        ("score", pa.float64()), ("overlap", pa.float64()), ("question_overlap", pa.float64()),
                        ("answer_overlap", pa.float64())])
    columns = ("doc_id bigint, item_id bigint, first_word bigint, score double, overlap double, "
               "question_overlap double, answer_overlap double")
    rows = docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text")
    whole = docs.sparkSession.createDataFrame([], columns)
    for lot in _lots(benchmark):
        def run(batches, lot=lot):
            for batch in nonempty(batches):
                ids = batch.column("doc_id").to_pylist()
                found = leaks(_built(lot), strings(batch, "text"), least_overlap, least_question)
                if found:
                    rows = [(ids[d], *rest) for d, *rest in found]
                    yield arrays(schema, dict(zip(schema.names, zip(*rows, strict=True), strict=True)))

        whole = whole.union(rows.mapInArrow(run, columns))
    return whole


def keep_clean(docs: DataFrame, benchmark: DataFrame, least_overlap: float = LEAST_OVERLAP,
               least_question: float | None = None) -> DataFrame:
    """The rows of ``docs`` in which ``find`` finds no test item, with all their columns, filtered where they are read.

    Rows are judged one by one: equal rows and rows of one id stay or go by their own text. Null and empty
    texts hold nothing and stay, as all rows do if there are no test items. Other columns may have any names.
    """
    columns = docs.columns
    docs, (text,) = plain_names(docs, "text")
    for lot in _lots(benchmark):
        def run(batches, lot=lot):
            for batch in nonempty(batches):
                dirty = {d for d, *_ in leaks(_built(lot), strings(batch, text), least_overlap, least_question)}
                yield batch.filter(pa.array([k not in dirty for k in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs.toDF(*columns)
