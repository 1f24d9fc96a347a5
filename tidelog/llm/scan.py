"""Products of a group's rows in order, by levels, so that no task holds a whole group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidelog.llm.common import nonempty, written

#: Rows of a group that one task takes in order; so many are one row of the next level.
FAN = 1000
Product = Callable[[np.ndarray, np.ndarray], np.ndarray]
_KIND = pa.list_(pa.int64())


def _in_order(rows: DataFrame, *more: str) -> DataFrame:
    return rows.repartition("key", "part").sortWithinPartitions("key", "part", "number").select(
        "key", "part", "number", "value", *more)


def _products(rows: DataFrame, product: Product) -> DataFrame:
    """(key, number, value): the product of the rows of each part."""
    schema = pa.schema([("key", pa.string()), ("number", pa.int64()), ("value", _KIND)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = total = None
        for batch in nonempty(batches):
            for key, part, value in zip(*(batch.column(c).to_pylist() for c in ("key", "part", "value")), strict=True):
                own = np.array(value, np.int64)
                if (key, part) == place:
                    total = product(total, own)
                    continue
                if place is not None:
                    yield pa.RecordBatch.from_pylist([{"key": place[0], "number": place[1], "value": total}], schema=schema)
                place, total = (key, part), own
        if place is not None:
            yield pa.RecordBatch.from_pylist([{"key": place[0], "number": place[1], "value": total}], schema=schema)

    return _in_order(rows).mapInArrow(run, "key string, number bigint, value array<bigint>")


def before(rows: DataFrame, product: Product, identity: list[int], fan: int = FAN) -> DataFrame:
    """(key, number, value): the product of all rows of a key before each of its rows (key, number, value).

    ``product`` is associative and keeps the length of its arrays; numbers are dense and begin at 0. Parts
    of ``fan`` rows are multiplied, then parts of these, until a key has one; then each level hands what
    came before to the one below. The rounds grow with the logarithm of a key's rows.
    """
    parts = rows.withColumn("part", F.expr(f"number div {fan}"))
    if (rows.agg(F.max("number")).first()[0] or 0) < fan:
        begun = parts.withColumn("start", F.array(*[F.lit(v).cast("bigint") for v in identity]))
    else:
        starts = before(written(_products(parts, product)), product, identity, fan)
        begun = parts.join(starts.select("key", F.col("number").alias("part"), F.col("value").alias("start")), ["key", "part"])
    schema = pa.schema([("key", pa.string()), ("number", pa.int64()), ("value", _KIND)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = total = None
        for batch in nonempty(batches):
            out = []
            columns = (batch.column(c).to_pylist() for c in ("key", "part", "number", "value", "start"))
            for key, part, number, value, start in zip(*columns, strict=True):
                if (key, part) != place:
                    place, total = (key, part), np.array(start, np.int64)
                out.append({"key": key, "number": number, "value": total})
                total = product(total, np.array(value, np.int64))
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return written(_in_order(begun, "start").mapInArrow(run, "key string, number bigint, value array<bigint>"))
