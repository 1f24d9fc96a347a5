"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tidelog.llm.common import arrays, nonempty, strings, words_of, written
from tidelog.llm.components import components

#: Two segments of 32 bits: fingerprints that differ in at most 2 or 3 bits differ in at most one
#: bit in one of them, so balls of radius 1 around each segment find every link.
SEGMENT_BITS = 32
SEED = 42
#: Members of a table entry above which its links are found through shared points instead of pairs.
CROWDED = 32
_BLOCK = 1 << 15


def fingerprint(text: str | None, size: int = 3) -> int:
    """Bits set in over half of the hashes of the word shingles, as an unsigned number."""
    words = words_of(text)
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False))
    hashes = np.array([digest(s, SEED) for s in shingles], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        block = hashes[at:at + _BLOCK]
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp): fingerprints as signed 64-bit numbers. Null and empty texts have 0."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in nonempty(batches):
            found = np.array([fingerprint(t, size) for t in strings(batch, "text")], np.uint64)
            yield arrays(schema, {"doc_id": batch.column("doc_id"), "fp": found.view(np.int64)})

    rows = docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text")
    return rows.mapInArrow(run, "doc_id bigint, fp bigint")


def _segment(number: int, fp: Column) -> Column:
    return F.shiftrightunsigned(fp, SEGMENT_BITS) if number else fp.bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))


def _flips(fp: Column, first: int, last: int) -> Column:
    """The fingerprint, and it with one of the bits from ``first`` up to ``last`` flipped."""
    bits = [1 << k if k < 63 else -(1 << 63) for k in range(first, last)]
    return F.explode(F.array(fp, *[fp.bitwiseXOR(F.lit(b)) for b in bits]))


def links(prints: DataFrame, radius: int = 2, crowded: int = CROWDED) -> DataFrame:
    """(a, b): links that connect all fingerprints that differ in at most ``radius`` (0 to 2) bits.

    ``prints`` has distinct fingerprints in ``fp``. A table holds each fingerprint under both
    of its 32-bit segments. Every fingerprint asks for the 33 values of the ball of radius 1 around
    each of its segments, and what it fetches is verified by its whole distance.

    An entry with more than ``crowded`` members would give all their pairs. There, those who ask
    and the members name the points of the ball of radius 1 around their whole fingerprint
    instead: two fingerprints differ in at most 2 bits exactly if they share such a point. Each
    one is linked to the smallest that names the point, so such a group costs 65 rows per
    fingerprint and loses no connection.
    """
    if not 0 <= radius <= 2:
        raise ValueError("radius must be 0, 1 or 2")
    entries, asked = [], []
    for k in (0, 1):
        segment = _segment(k, F.col("fp"))
        entries.append(prints.select(F.lit(k).alias("segment"), segment.alias("value"), "fp"))
        ball = prints.select("fp", _flips(F.col("fp"), k * SEGMENT_BITS, (k + 1) * SEGMENT_BITS).alias("near"))
        asked.append(ball.select(F.lit(k).alias("segment"), _segment(k, F.col("near")).alias("value"), "fp"))
    entry, ask, key = entries[0].union(entries[1]), asked[0].union(asked[1]), ["segment", "value"]
    sizes = written(entry.groupBy(*key).agg(F.count(F.lit(1)).alias("members")))
    full = sizes.filter(F.col("members") > crowded).select(*key)
    # only a table value that exists can be fetched; each fetched entry says whether it is crowded
    held = entry.hint("merge").join(sizes, key).select(
        *key, F.col("fp").alias("found"), (F.col("members") > crowded).alias("full"))
    # Spark takes exploded rows for as many as before and would send them to the driver and all executors, hence the hints
    fetched = ask.hint("merge").join(held.filter("not full"), key)
    pairs = fetched.filter((F.col("fp") < F.col("found")) & (
        F.bit_count(F.col("fp").bitwiseXOR(F.col("found"))) <= radius)).select(
        F.col("fp").alias("a"), F.col("found").alias("b"))
    members = ask.join(full, key, "left_semi").select("fp").distinct()
    if radius == 2:
        points = members.select("fp", _flips(F.col("fp"), 0, 64).alias("point"))
    else:  # within one bit: a pair is named by either end
        points = members.select("fp", (_flips(F.col("fp"), 0, 64) if radius else F.col("fp")).alias("point"))
    lowest = points.groupBy("point").agg(F.min("fp").alias("low"), F.count(F.lit(1)).alias("n"))
    shared = lowest.filter("n > 1").select("point", "low")
    star = points.hint("merge").join(shared, "point").filter(
        (F.col("fp") != F.col("low")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("low"))) <= radius))
    if radius == 1:
        members_at = members.select(F.col("fp").alias("point"))
        star = points.hint("merge").join(members_at, "point").filter("fp <> point").select("fp", F.col("point").alias("low"))
    return pairs.union(star.select(F.col("low").alias("a"), F.col("fp").alias("b"))).distinct()


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 2, crowded: int = CROWDED) -> DataFrame:
    """One row per document: its fingerprint (``fp`` and 16 hex digits) and component.

    Documents are linked whose fingerprints differ in at most ``radius`` bits; ``component_id`` is
    the smallest id reachable. Copies meet as one fingerprint before anything is joined, so a
    group of any size costs one row, and documents without words (fingerprint 0) are linked like
    any others. Null ids stay null and are passed over as component ids if there is another;
    equal rows come out once each; an empty table gives no rows; other columns are not read.
    """
    prints = written(fingerprints(docs, size))
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = written(components(links(distinct.select("fp"), radius, crowded), "a", "b"))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of = rooted.join(lowest, "root").select(F.col("fp").alias("own"), "component_id")
    return prints.join(of, F.col("fp") == F.col("own")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp")


def keep_one(docs: DataFrame, size: int = 3, radius: int = 2) -> DataFrame:
    """The documents that are the first of their component, with all their columns. Documents
    with a null id are kept."""
    found = near_duplicates(docs, size, radius)
    later = written(found.filter("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(later, "doc_id", "left_anti")
