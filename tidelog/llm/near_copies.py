"""Near copies of whole documents: SimHash fingerprints and an exact similarity join on word shingles."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tidelog.llm import simhash
from tidelog.llm.common import arrays, nonempty, plain_names, strings, words_of, written
from tidelog.llm.components import components
from tidelog.session import durable

#: Texts are near copies if the Jaccard similarity of their shingles is at least 0.8: 9 x common >= 4 x (a + b).
NUMERATOR, DENOMINATOR = 4, 9
#: Shingles are ordered by how often their bucket is met in all documents. The order decides what is compared
#: first, not what is found.
BUCKET_BITS = 22
#: Documents at the head of a shingle's list that all others of the list are compared with first.
PIVOTS = 8
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_LAST_BITS = np.uint64(64 - BUCKET_BITS)


def shingles(text: str | None, size: int) -> np.ndarray:
    """Different hashes of the runs of ``size`` words, sorted; of fewer words, of all of them; of none, nothing."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    one = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(size, len(words))
    out = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        out = (out ^ out >> np.uint64(29)) * _MULTIPLIER + one[k:len(words) - size + 1 + k]
    return np.unique((out ^ out >> np.uint64(32)) * _MULTIPLIER)


def sketch(hashes: np.ndarray) -> bytes:
    """Parities of the elements of a set that fall on each place, of which there are a power of two and at least as
    many as elements. The sketches of two sets differ in no more places than the sets do in elements."""
    bits = max(64, 1 << max(len(hashes) - 1, 0).bit_length())
    place = ((hashes ^ hashes >> np.uint64(29)) * _MULTIPLIER >> np.uint64(32)).astype(np.int64) & bits - 1
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def apart(one: bytes, other: bytes) -> int:
    """In how many places two sketches differ, the longer one folded to the length of the other."""
    short, long = sorted((one, other), key=len)
    bits, folded = 8 * len(long), int.from_bytes(long, "little")
    while bits > 8 * len(short):
        bits //= 2
        folded = folded >> bits ^ folded & (1 << bits) - 1
    return (int.from_bytes(short, "little") ^ folded).bit_count()


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` written, with the number of each row in ``__row``: its file and its place in it."""
    file = F.col("_metadata.file_name")
    part, piece = F.regexp_extract(file, r"^part-(\d+)", 1), F.regexp_extract(file, r"-c(\d+)\.", 1)
    number = F.shiftleft(part.cast("bigint"), 42) + F.shiftleft(F.coalesce(piece.try_cast("bigint"), F.lit(0)), 34)
    return durable(docs).select("*", (number + F.col("_metadata.row_index")).alias("__row"))


def _mapped(texts: DataFrame, fn, **types: str) -> DataFrame:
    """``fn(row numbers, lists of shingle hashes)`` gives columns of these types."""
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64()), "binary": pa.binary()}
    schema = pa.schema([(k, kinds[v]) for k, v in types.items()])

    def run(batches):
        for batch in nonempty(batches):
            # a long text has many hashes: what is held together has a bound
            for at in range(0, batch.num_rows, 100):
                some = batch.slice(at, 100)
                out = fn(some.column("row").to_pylist(), strings(some, "text"))
                yield arrays(schema, dict(zip(types, out, strict=True)))

    return texts.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in types.items()))


def _digests(texts: DataFrame, size: int, prints: tuple[int, ...] = ()) -> DataFrame:
    """(row, n, d1, d2, odd, fp3, ...): how many shingles a text has, two sums over them that tell equal sets, their
    sketch, and SimHash fingerprints of the text over runs of as many words as ``prints`` says."""

    def digest(rows, some):
        sets = [shingles(t, size) for t in some]
        sums = np.array([[s.sum(dtype=np.uint64), ((s ^ s >> np.uint64(31)) * _MULTIPLIER ^ s).sum(dtype=np.uint64)]
                         for s in sets], np.uint64).view(np.int64)
        of = (np.array([simhash.fingerprint(t, words) for t in some], np.uint64).view(np.int64) for words in prints)
        return rows, [len(s) for s in sets], sums[:, 0], sums[:, 1], [sketch(s) for s in sets], *of

    return _mapped(texts, digest, row="bigint", n="int", d1="bigint", d2="bigint", odd="binary",
                   **{f"fp{words}": "bigint" for words in prints})


def _fingerprint_links(prints: DataFrame, firsts: DataFrame, radius: int) -> DataFrame:
    """(a, b): links that connect all first rows of a shingle set with a text whose fingerprint differs in at most
    ``radius`` bits. Copies of a text meet as one row before anything is joined; a fingerprint stands for its
    smallest row."""
    held = written(prints.groupBy("n", "d1", "d2", "fp").agg(F.count(F.lit(1)).alias("rows")).join(
        firsts.select("n", "d1", "d2", F.col("first.row").alias("row")), ["n", "d1", "d2"]).select("fp", "row"))
    lowest = written(held.groupBy("fp").agg(F.min("row").alias("low"), F.count(F.lit(1)).alias("rows")))
    same = held.join(lowest.filter("rows > 1"), "fp").filter("row <> low").select(F.col("low").alias("a"), F.col("row").alias("b"))
    found = written(simhash.links(lowest.select("fp"), radius))
    of_a, of_b = (lowest.select(F.col("fp").alias(c), F.col("low").alias(f"low_{c}")) for c in "ab")
    return written(same.union(found.join(of_a, "a").join(of_b, "b").select("low_a", "low_b")))


def _levels(texts: DataFrame, total: int, size: int) -> np.ndarray:
    """How common the shingles of each bucket are in all of the ``total`` texts, in 256 steps."""
    if not total:
        return np.zeros(1 << BUCKET_BITS, np.uint8)
    part_bits = min(12, BUCKET_BITS)
    schema = pa.schema([("part", pa.int32()), ("places", pa.binary()), ("n", pa.binary())])

    def run(batches):
        seen = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in nonempty(batches):
            for text in strings(batch, "text"):
                np.add.at(seen, (shingles(text, size) >> _LAST_BITS).astype(np.int64), 1)
        for part, some in enumerate(seen.reshape(-1, 1 << part_bits)):
            there = np.flatnonzero(some)
            if len(there):
                yield arrays(schema, {"part": [part], "places": [there.astype(np.uint16).tobytes()], "n": [some[there].tobytes()]})

    def put_together(some: pa.Table) -> pa.Table:
        # a byte for each bucket, so that the driver gets no more than the table it hands out
        part = some.column("part")[0].as_py()
        at, of = (np.frombuffer(b"".join(some.column(c).to_pylist()), kind) for c, kind in (("places", np.uint16), ("n", np.int64)))
        n = np.bincount(at, of, 1 << part_bits)
        levels = np.minimum(255, 8 * np.log2(1 + n)).astype(np.uint8)
        return pa.table({"part": pa.array([part], pa.int32()), "levels": pa.array([levels.tobytes()], pa.binary())})

    found = texts.mapInArrow(run, "part int, places binary, n binary").groupBy("part").applyInArrow(
        put_together, "part int, levels binary")
    out = np.zeros((1 << BUCKET_BITS - part_bits, 1 << part_bits), np.uint8)
    for row in found.toArrow().to_pylist():
        out[row["part"]] = np.frombuffer(row["levels"], np.uint8)
    return out.ravel()


def _lists(texts: DataFrame, levels: np.ndarray, size: int) -> DataFrame:
    """(h, row, n, place): the rarest shingles of each text, so many that near copies share one of them."""
    shared = texts.sparkSession.sparkContext.broadcast(levels)

    def prefix(rows, some):
        parts = []
        for row, text in zip(rows, some, strict=True):
            hashes = shingles(text, size)
            n = len(hashes)
            first = n - (4 * n + 4) // 5 + 1 if n else 0
            order = np.argsort(shared.value[(hashes >> _LAST_BITS).astype(np.int64)], kind="stable")[:first]
            parts.append((hashes[order].view(np.int64), np.full(first, row), np.full(first, n), np.arange(first)))
        return tuple(map(np.concatenate, zip(*parts, strict=True)))

    return _mapped(texts, prefix, h="bigint", row="bigint", n="int", place="int")


def _may_match(n, place, a_n, a_place, least):
    """Length and position: what two texts can have in common before and behind a shared shingle."""
    common = least(place, a_place) + 1 + least(n - place - 1, a_n - a_place - 1)
    return common * DENOMINATOR >= (n + a_n) * NUMERATOR


def _candidates(lists: DataFrame, pivots: int) -> DataFrame:
    """(a, b, h, n, place): pairs of each list's first ``pivots`` texts with all others of it, the rest null; with a
    null ``a``, the texts of the list behind those."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("h", pa.int64()), ("n", pa.int32()), ("place", pa.int32())])

    def run(batches):
        head = None
        for batch in nonempty(batches):
            now = [batch.column(c).to_numpy() for c in ("h", "row", "n", "place")]
            done = 0 if head is None else len(head[0])
            h, row, n, place = now if head is None else map(np.concatenate, zip(head, now, strict=True))
            starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            begin = np.repeat(starts, np.diff(starts, append=len(h)))
            rank = np.arange(len(h)) - begin
            for k in range(pivots):
                at = np.flatnonzero(rank > k)
                at = at[at >= done]
                to = begin[at] + k
                good = _may_match(n[at].astype(np.int64), place[at], n[to].astype(np.int64), place[to], np.minimum)
                at, to = at[good], to[good]
                if len(at):
                    none = {f.name: pa.nulls(len(at), f.type) for f in schema}
                    yield arrays(schema, none | {"a": row[to], "b": row[at]})
            late = np.flatnonzero(rank >= pivots)
            late = late[late >= done]
            if len(late):
                yield arrays(schema, {"a": pa.nulls(len(late), pa.int64()), "b": row[late], "h": h[late], "n": n[late],
                                      "place": place[late]})
            keep = slice(starts[-1], starts[-1] + pivots)
            head = [v[keep] for v in (h, row, n, place)]

    return lists.repartition("h").sortWithinPartitions("h", "row").mapInArrow(
        run, "a bigint, b bigint, h bigint, n int, place int")


def _close(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The (a, b) that sketches do not tell apart: texts alike differ in at most a ninth of both texts' shingles.

    A sketch has a 64th to a 32nd of the bytes of a text's hashes, and unlike texts differ in about half of its places.
    So of the many pairs that share a shingle, whose number grows faster than that of the texts, only near copies and
    few others meet with all their shingles.
    """
    of = [sketches.select(F.col("row").alias(c), F.col("n").alias(f"n_{c}"), F.col("odd").alias(f"odd_{c}")) for c in "ab"]
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in nonempty(batches):
            ends = (batch.column(c).to_pylist() for c in ("n", "odd_a", "odd_b"))
            good = [apart(x, y) * DENOMINATOR <= n * (DENOMINATOR - 2 * NUMERATOR) for n, x, y in zip(*ends, strict=True)]
            yield arrays(schema, {c: batch.column(c).to_numpy()[good] for c in "ab"})

    return pairs.join(of[0], "a").join(of[1], "b").select(
        "a", "b", (F.col("n_a").cast("bigint") + F.col("n_b")).alias("n"), "odd_a", "odd_b").mapInArrow(run, "a bigint, b bigint")


def _verified(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """The (a, b) whose similarity is high enough, by all their shingles."""
    ends = written(pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct())

    def whole(rows, some):
        return rows, [shingles(t, size).view(np.int64) for t in some]

    sets = written(_mapped(texts.join(ends, "row", "left_semi"), whole, row="bigint", own="array<bigint>"))
    of_a, of_b = (sets.select(F.col("row").alias(c), F.col("own").alias(f"of_{c}")) for c in "ab")
    common = F.size(F.array_intersect("of_a", "of_b"))
    return pairs.join(of_a, "a").join(of_b, "b").filter(
        common * DENOMINATOR >= (F.size("of_a") + F.size("of_b")) * NUMERATOR).select("a", "b")


def _connecting(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Pairs that are near copies and connect all that are: each text's first pair is verified, then what is left
    between texts that these do not connect."""
    pairs = written(pairs)
    if pairs.isEmpty():
        return pairs
    lead = written(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    found = written(_verified(lead, texts, size))
    roots = written(components(found, "a", "b"))
    of = [roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab"]
    left = written(pairs.join(lead, ["a", "b"], "left_anti").join(of[0], "a", "left").join(of[1], "b", "left").filter(
        F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b"))
    return found if left.isEmpty() else found.union(_verified(left, texts, size))


def links(texts: DataFrame, total: int, size: int, pivots: int = PIVOTS, sketches: DataFrame | None = None) -> DataFrame:
    """(a, b): links that connect all of these texts, (row, text) of different shingle sets, that are near copies.

    Near copies share one of the rarest fifth of their shingles. Each shingle's list is first compared
    with its first texts, which connects the many variants of one text. In what is behind them, only
    texts that are not yet connected are compared: those outside a list's largest component with all of it.
    ``sketches`` (row, n, odd) of ``_digests`` are made if they are not given.
    """
    if sketches is None:
        sketches = written(_digests(texts, size).select("row", "n", "odd"))
    first = written(_candidates(_lists(texts, _levels(texts, total, size), size), pivots))
    found = written(_connecting(_close(first.filter("a is not null").select("a", "b").distinct(), sketches), texts, size))
    late = first.filter("a is null").select("h", F.col("b").alias("row"), "n", "place")
    if late.isEmpty():
        return found
    roots = components(found, "a", "b")
    rooted = written(late.join(roots, F.col("row") == F.col("node"), "left").select(
        "h", "row", "n", "place", F.coalesce("root", "row").alias("root")))
    sizes = rooted.groupBy("h", "root").agg(F.count(F.lit(1)).alias("members"))
    main = sizes.groupBy("h").agg(F.max(F.struct("members", "root")).alias("most"), F.count(F.lit(1)).alias("roots")).filter(
        "roots > 1").select("h", F.col("most.root").alias("main"))
    open_ = rooted.join(main, "h")
    other = open_.select("h", *[F.col(c).alias(f"a_{c}") for c in ("row", "n", "place", "root")])
    once: Column = (F.col("row") < F.col("a_row")) | (F.col("a_root") == F.col("main"))
    second = open_.filter("root <> main").join(other, "h").filter(
        (F.col("root") != F.col("a_root")) & once & _may_match(*map(F.col, ("n", "place", "a_n", "a_place")), F.least)).select(
        F.least("row", "a_row").alias("a"), F.greatest("row", "a_row").alias("b")).distinct()
    return found.union(_connecting(_close(second, sketches), texts, size))


def keep_one(docs: DataFrame, size: int = 5, pivots: int = PIVOTS, radius: int | None = None,
             prints_of: tuple[int, ...] | None = None) -> DataFrame:
    """The rows of ``docs`` that are the first of their group of near copies, with all their columns.

    Texts are linked if the Jaccard similarity of their word shingles, by hashes of 64 bits, is at least 0.8;
    with a ``radius`` also those whose SimHash fingerprints differ in at most so many bits. Fingerprints are over runs
    of ``size`` words, or over runs of each of the numbers of words in ``prints_of``, any of which links.
    Texts without words are alike. Each group keeps the row with the smallest id, rows without one last and
    of one id the first as written. Rows are decided one by one, so copies that share an id or have none go
    too, and a row stays if only another text with its id goes. Other columns may have any names.
    """
    named, (doc_id, text) = plain_names(docs, "doc_id", "text")
    rows, order = numbered(named), ("nameless", "doc_id", "row")
    texts = rows.select(F.col("__row").alias("row"), F.col(text).cast("string").alias("text"))
    ids = rows.select("__row", F.col(doc_id).cast("bigint").alias("doc_id"))
    sizes = () if radius is None else prints_of or (size,)
    prints = written(_digests(texts, size, sizes).join(ids, F.col("row") == F.col("__row")).select(
        F.col("doc_id").isNull().alias("nameless"), "doc_id", "row", "n", "d1", "d2", "odd", *(f"fp{words}" for words in sizes)))
    firsts = written(prints.groupBy("n", "d1", "d2").agg(
        F.min(F.struct(*order)).alias("first"), F.count(F.lit(1)).alias("rows")))
    copies = written(prints.join(firsts.filter("rows > 1"), ["n", "d1", "d2"]).filter("row <> first.row").select("row"))
    linked = [_fingerprint_links(prints.withColumnRenamed(f"fp{words}", "fp"), firsts, radius) for words in sizes]
    found = links(texts.join(copies, "row", "left_anti"), firsts.count(), size, pivots, prints.select("row", "n", "odd"))
    roots = written(components(reduce(DataFrame.union, linked, found), "a", "b"))
    members = written(prints.join(roots, F.col("row") == F.col("node")).select(F.struct(*order).alias("own"), "root"))
    lowest = members.groupBy("root").agg(F.min("own").alias("lowest"))
    later = members.join(lowest, "root").filter("own <> lowest").select("own.row")
    gone = written(copies.union(later).withColumnRenamed("row", "__row"))
    return rows.join(gone, "__row", "left_anti").select(*named.columns).toDF(*docs.columns)
