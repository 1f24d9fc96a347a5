"""Near-duplicates by MinHash bands, with odd sketches to tell which candidates are worth a full comparison."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidelog.llm.common import arrays, nonempty, strings, written
from tidelog.llm.components import components
from tidelog.llm.near_copies import numbered, shingles

#: Documents are linked if 100 x common >= 85 x all of their shingles.
PERCENT = 85
#: A link shares all samples of a band with probability 0.85 ** ROWS, so that none of the bands shows it
#: has the probability (1 - 0.85 ** ROWS) ** BANDS, about 4e-8.
ROWS, BANDS = 6, 36
SAMPLES = ROWS * BANDS
#: Bits of an odd sketch, and the probability with which the sketches of a link may differ in more bits than allowed.
BITS, TAIL = 1024, 1e-9
#: Members of a band's group that one task compares with each other; larger groups are dealt to more tasks.
BLOCK = 4096
#: Bits of the odd sketch of a whole set. Two of them never differ in more bits than the sets do in elements.
WHOLE_BITS = 2048
_WORDS, _WHOLE_WORDS = BITS // 64, WHOLE_BITS // 64
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SALTS = np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
#: odd factors, each a permutation of the 32-bit numbers
_FACTORS = ((_SALTS ^ _SALTS >> np.uint64(29)) * _MULTIPLIER >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


@cache
def most_bits(percent: int = PERCENT) -> int:
    """In how many bits the sketches of two sets of that similarity differ, but for a probability of TAIL.

    Each sample differs with probability 1 - J and then flips two bits; the number of bits that an odd number
    of flips leaves set is a chain whose distribution is followed exactly.
    """
    differ = np.zeros(SAMPLES + 1)
    differ[0] = 1.0
    p = 1 - percent / 100
    for k in range(SAMPLES):
        differ[1:k + 2] = differ[1:k + 2] * (1 - p) + differ[:k + 1] * p
        differ[0] *= 1 - p
    at = np.arange(BITS + 1)
    now, law = np.zeros(BITS + 1), np.zeros(BITS + 1)
    now[0] = 1.0
    for share in differ:
        law += share * now
        for _ in range(2):
            up, down = now * (1 - at / BITS), now * at / BITS
            now = np.concatenate(([0.0], up[:-1])) + np.concatenate((down[1:], [0.0]))
    beyond = law[::-1].cumsum()[::-1]  # P(at least so many)
    return int(np.flatnonzero(beyond > TAIL)[-1])


def samples(hashes: np.ndarray) -> np.ndarray:
    """MinHash samples of a set of 64-bit hashes: for each factor the smallest product."""
    own = (hashes >> np.uint64(32)).astype(np.uint32)
    best = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(own), 1024):
        np.minimum(best, (own[at:at + 1024, None] * _FACTORS).min(axis=0), out=best)
    return best


def band_keys(mins: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of every row of samples."""
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _MULTIPLIER, (len(mins), BANDS)).copy()
    cut = mins.reshape(len(mins), BANDS, ROWS)
    for k in range(ROWS):
        key = ((key ^ key >> np.uint64(31)) + cut[:, :, k]) * _MULTIPLIER
    return (key ^ key >> np.uint64(32)).view(np.int64)


def odd_sketches(mins: np.ndarray) -> np.ndarray:
    """Bitmaps of the rows of samples, as 64-bit words: a bit is set if an odd number of samples falls on it."""
    mixed = ((mins.astype(np.uint64) + _SALTS) * _MULTIPLIER)
    place = ((mixed ^ mixed >> np.uint64(32)) * _MULTIPLIER >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)
    flat = (np.arange(len(mins))[:, None] * BITS + place).ravel()
    odd = (np.bincount(flat, minlength=len(mins) * BITS) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(len(mins), BITS), axis=1, bitorder="little").view(np.int64)


def whole_sketch(hashes: np.ndarray) -> np.ndarray:
    """The odd sketch of all elements of a set, without samples: exact as long as few elements differ."""
    place = ((hashes ^ hashes >> np.uint64(29)) * _MULTIPLIER >> np.uint64(64 - WHOLE_BITS.bit_length() + 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=WHOLE_BITS) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def _lists(values: np.ndarray) -> pa.ListArray:
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))


def digests(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, t1, t2, n, d1, d2, bands, bits, whole): hashes of the text, the number of shingles, two sums that tell
    equal sets, the keys of the bands and the odd sketches of the samples and of the whole set."""
    kind = pa.list_(pa.int64())
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "t1", "t2", "n", "d1", "d2")] + [
        (c, kind) for c in ("bands", "bits", "whole")])

    def run(batches):
        for batch in nonempty(batches):
            for at in range(0, batch.num_rows, 100):
                some = batch.slice(at, 100)
                mins = np.zeros((some.num_rows, SAMPLES), np.uint32)
                whole = np.zeros((some.num_rows, _WHOLE_WORDS), np.int64)
                sums, sizes = np.zeros((some.num_rows, 2), np.uint64), []
                for k, text in enumerate(strings(some, "text")):
                    own = shingles(text, size)
                    sizes.append(len(own))
                    if len(own):
                        mins[k], whole[k] = samples(own), whole_sketch(own)
                        sums[k] = own.sum(dtype=np.uint64), ((own ^ own >> np.uint64(31)) * _MULTIPLIER ^ own).sum(dtype=np.uint64)
                columns = {c: some.column(c) for c in ("doc_id", "t1", "t2")} | {
                    "n": pa.array(sizes, pa.int64()), "d1": pa.array(sums[:, 0].view(np.int64).copy()),
                    "d2": pa.array(sums[:, 1].view(np.int64).copy()),
                    "bands": _lists(band_keys(mins)), "bits": _lists(odd_sketches(mins)), "whole": _lists(whole)}
                yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema], schema=schema)

    return _texts(docs, "cast(doc_id as bigint) as doc_id").mapInArrow(
        run, "doc_id bigint, t1 bigint, t2 bigint, n bigint, d1 bigint, d2 bigint, bands array<bigint>, bits array<bigint>, "
        "whole array<bigint>")


def _texts(docs: DataFrame, *more: str) -> DataFrame:
    """The texts and two hashes by which one is found again."""
    text = docs.selectExpr(*more, "cast(text as string) as text")
    return text.select("*", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))


def _alike(a: Column, b: Column, common: Column, percent: int) -> Column:
    return common * 100 >= (a + b - common) * percent


def _differ(a: str, b: str, words: int) -> Column:
    return sum((F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(words)), F.lit(0))


def close(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and odd sketches do not tell apart.

    Sets that are similar enough differ in at most (100 - percent) / (100 + percent) of their sizes' sum, which
    bounds the bits of whole sketches without exception; those of samples tell large sets apart.
    """
    side = sets.select("row", "n", "bits", "whole")
    of = [side.select(*[F.col(c).alias(f"{c}_{s}") for c in side.columns]) for s in "ab"]
    both = pairs.join(of[0], F.col("a") == F.col("row_a")).join(of[1], F.col("b") == F.col("row_b"))
    return both.filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent).filter(
        _differ("bits_a", "bits_b", _WORDS) <= most_bits(percent)).filter(
        _differ("whole_a", "whole_b", _WHOLE_WORDS) * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent)).select("a", "b")


def confirmed(pairs: DataFrame, sets: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose full sets of shingles are similar enough."""
    ends = pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct()
    wanted = written(sets.join(ends, "row", "left_semi").select("t1", "t2", "row"))
    schema = pa.schema([("row", pa.int64()), ("own", pa.list_(pa.int64()))])

    def whole(batches):
        for batch in nonempty(batches):
            for at in range(0, batch.num_rows, 100):
                some = batch.slice(at, 100)
                yield arrays(schema, {"row": some.column("row"), "own": [
                    shingles(t, size).view(np.int64) for t in strings(some, "text")]})

    # equal texts have equal hashes; one of them is enough
    texts = _texts(docs).join(wanted, ["t1", "t2"]).select("row", "text").dropDuplicates(["row"])
    full = written(texts.mapInArrow(whole, "row bigint, own array<bigint>"))
    of_a, of_b = (full.select(F.col("row").alias(c), F.col("own").alias(f"of_{c}")) for c in "ab")
    common = F.size(F.array_intersect("of_a", "of_b")).cast("bigint")
    return pairs.join(of_a, "a").join(of_b, "b").filter(
        _alike(F.size("of_a"), F.size("of_b"), common, percent)).select("a", "b")


def within(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): members of one group, (key, i, j, n, row, root, bits, whole), of different roots that may be a link.

    Groups come sorted by size, so a member meets only those that are not too large for it.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    most = most_bits(percent)

    def compared(n, row, root, bits, whole):
        last = np.searchsorted(n, n * 100 // percent, side="right")
        for at in range(0, len(n), 64):
            end = int(last[min(at + 63, len(n) - 1)])
            if end <= at + 1:
                continue
            one = slice(at, min(at + 64, len(n)))
            differ = np.bitwise_count(bits[one, None] ^ bits[None, at:end]).sum(axis=2, dtype=np.int64)
            left, right = np.nonzero(differ <= most)
            left, right = left + at, right + at
            good = (right > left) & (right < last[left]) & (root[left] != root[right])
            left, right = left[good], right[good]
            apart = np.bitwise_count(whole[left] ^ whole[right]).sum(axis=1, dtype=np.int64)
            good = apart * (100 + percent) <= (n[left] + n[right]) * (100 - percent)
            left, right = row[left[good]], row[right[good]]
            if len(left):
                yield arrays(schema, {"a": np.minimum(left, right), "b": np.maximum(left, right)})

    def run(batches):
        held = None
        for batch in nonempty(batches):
            keys = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")], axis=1)
            now = [batch.column(c).to_numpy() for c in ("n", "row", "root")]
            now += [batch.column(c).flatten().to_numpy().view(np.uint64).reshape(-1, w)
                    for c, w in (("bits", _WORDS), ("whole", _WHOLE_WORDS))] + [keys]
            held = now if held is None else [np.concatenate(v) for v in zip(held, now, strict=True)]
            keys = held[-1]
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for start, end in zip([0, *edges], edges, strict=False):
                yield from compared(*(v[start:end] for v in held[:-1]))
            if len(edges):
                held = [v[edges[-1]:] for v in held]
        if held is not None:
            yield from compared(*held[:-1])

    return members.mapInArrow(run, "a bigint, b bigint")


def links(sets: DataFrame, docs: DataFrame, size: int, percent: int, block: int) -> DataFrame:
    """(a, b): links that connect all of these different sets, (row, n, t1, t2, bands, bits, whole), that are linked."""
    entries = sets.select(F.explode("bands").alias("key"), "row")
    groups = written(entries.groupBy("key").agg(F.min("row").alias("pivot"), F.count(F.lit(1)).alias("members")).filter("members > 1"))
    shared = written(entries.join(groups, "key"))
    star = shared.filter("row <> pivot").select(F.col("pivot").alias("a"), F.col("row").alias("b")).distinct()
    first = written(close(star, sets, percent))
    found = written(confirmed(first, sets, docs, size, percent))
    roots = written(components(found, "a", "b"))
    rooted = written(shared.join(roots, F.col("row") == F.col("node"), "left").select(
        "key", "row", "members", F.coalesce("root", "row").alias("root")))
    open_ = written(rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key"))
    salts = F.ceil(F.col("members") / block).cast("bigint")
    dealt = rooted.join(open_, "key").withColumn("own", F.pmod(F.xxhash64("row"), salts)).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)))
    members = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "row", "root").join(
        sets.select("row", "n", "bits", "whole"), "row")
    order = ["key", "i", "j", "n", "row"]
    late = within(members.repartition("key", "i", "j").sortWithinPartitions(*order).select(*order, "root", "bits", "whole"), percent)
    second = written(late.distinct().join(first, ["a", "b"], "left_anti"))
    return found.union(confirmed(second, sets, docs, size, percent))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per document, with the smallest id its links reach.

    A document's set has the runs of ``size`` words, or all of its words if there are fewer, as 64-bit hashes.
    Documents are linked if 100 x common >= ``percent`` x all. Equal sets meet by their digests and go on as one.
    Sets that share a band of MinHash samples are candidates: first each with the smallest of its band's group, then,
    where that leaves a group in several components, those of different components with each other. The xor of two
    odd sketches, of samples and of whole sets, tells most candidates apart; what is left is confirmed on full sets. A link is missed only if no
    band shows it or its sketches lie in the tail of their law, with probability of less than 1e-7.

    A group of copies costs one set, a group of near copies one pair for each band and member. Texts without
    words (null, empty, blank) have an empty set and are linked with nothing. Null ids stay null and are passed
    over as component ids if there is another; ``kept`` is whether the two ids are the same. Rows that share
    an id are documents of their own. Equal rows come out once each; an empty table gives no rows; other columns are not read.
    """
    prints = written(digests(docs, size))
    first = F.min(F.struct("t1", "t2", "bands", "bits", "whole")).alias("first")
    sets = numbered(prints.filter("n > 0").groupBy("n", "d1", "d2").agg(first, F.min("doc_id").alias("first_id")).select(
        "n", "d1", "d2", "first_id", "first.*")).withColumnRenamed("__row", "row")
    roots = written(components(links(sets, docs, size, percent, block), "a", "b"))
    named = written(sets.join(roots, F.col("row") == F.col("node"), "left").select(
        "n", "d1", "d2", "first_id", F.coalesce("root", "row").alias("root")))
    lowest = named.groupBy("root").agg(F.min("first_id").alias("lowest"))
    of = named.join(lowest, "root").select("n", "d1", "d2", "lowest")
    found = prints.select("doc_id", "n", "d1", "d2").join(of, ["n", "d1", "d2"], "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("lowest")).otherwise(
        F.col("doc_id")).alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
