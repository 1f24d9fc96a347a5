"""Hash functions that must agree bit for bit with other producers of the same log."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

def string_hash(c: Column) -> Column:
    """The 31-multiplier hash over UTF-16 units, signed 32-bit, as a bigint; null stays null.

    Spark strings become JVM strings at this call, whose own hash is this very function.
    """
    hashed = F.java_method(F.lit("java.util.Objects"), F.lit("hashCode"), c).cast("bigint")
    return F.when(c.isNotNull(), hashed)


# Seed, multiplier and shift of the murmur2 variant log clients use for keys.
MURMUR2_SEED = 0x9747B28C
MURMUR2_M = 0x5BD1E995
MURMUR2_R = 24


def murmur2_same_length(rows: np.ndarray) -> np.ndarray:
    """murmur2 of many byte strings of one length at once: ``rows`` is uint8[count, length]."""
    count, length = rows.shape
    m = np.uint32(MURMUR2_M)
    h = np.full(count, np.uint32(MURMUR2_SEED) ^ np.uint32(length), dtype=np.uint32)
    whole = length // 4
    words = np.ascontiguousarray(rows[:, : whole * 4]).view("<u4").reshape(count, whole)
    for column in range(whole):
        k = words[:, column].astype(np.uint32) * m
        k ^= k >> np.uint32(MURMUR2_R)
        h = (h * m) ^ (k * m)
    tail = rows[:, whole * 4:].astype(np.uint32)
    if tail.shape[1]:
        for i in range(tail.shape[1]):
            h ^= tail[:, i] << np.uint32(8 * i)
        h *= m
    h ^= h >> np.uint32(13)
    h *= m
    h ^= h >> np.uint32(15)
    return h.view(np.int32)


@F.arrow_udf(T.IntegerType())
def murmur2(keys: pa.Array) -> pa.Array:
    """Signed murmur2 of the UTF-8 bytes; null stays null. Reads the Arrow buffers as they
    are and works on all keys of one length at a time, so no key becomes a Python object."""
    raw = keys.cast(pa.large_binary())
    _, offset_buffer, data_buffer = raw.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[raw.offset: raw.offset + len(raw) + 1]
    data = np.frombuffer(data_buffer or b"", dtype=np.uint8)
    missing = np.asarray(raw.is_null())
    lengths = np.where(missing, -1, np.diff(offsets))
    out = np.zeros(len(raw), dtype=np.int32)
    for length in np.unique(lengths[lengths >= 0]):
        where = np.flatnonzero(lengths == length)
        out[where] = murmur2_same_length(data[offsets[where][:, None] + np.arange(length)])
    return pa.array(out, mask=missing)


def key_partition(key: Column, partitions: int) -> Column:
    return (murmur2(key).bitwiseAND(F.lit(0x7FFFFFFF)) % F.lit(partitions)).cast("int")
