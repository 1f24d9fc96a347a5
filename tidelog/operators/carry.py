"""The last marked row before each row, without putting a group into one task.

``last(value, ignore nulls)`` over a window puts a whole group on one executor. Here rows are range-partitioned
on group + order; each task carries marks forward through its own rows, and a small table of what each task
ends with (one row per task and group in it) supplies what comes from the tasks before.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tidelog.session import durable, measured


def _changes(batch: pa.RecordBatch, group: Sequence[str]) -> np.ndarray:
    """Whether a row begins a group; two nulls are alike. The first row says True."""
    out = np.zeros(batch.num_rows, bool)
    out[0] = True
    for name in group:
        own = batch.column(name)
        a, b = own.slice(1), own.slice(0, len(own) - 1)
        unlike = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        nulls = own.is_null().to_numpy(zero_copy_only=False)
        out[1:] |= unlike | (nulls[1:] != nulls[:-1])
    return out


def _forward(group: Sequence[str], mark: str, values: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, row, held = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            begins, n = _changes(batch, group), batch.num_rows
            marks = pc.fill_null(batch.column(mark), False).to_numpy(zero_copy_only=False)
            start = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
            last = np.maximum.accumulate(np.where(marks, np.arange(n), -1))
            # place 0 is what the batch before ended with, if it goes on here
            goes_on = held is not None and all(held[0][k] == batch.column(g)[0].as_py() for k, g in enumerate(group))
            before = np.where((start == 0) & goes_on & (held is not None and held[1] is not None), 0, -1)
            at = np.where(last >= start, last + 1, before)
            picked = pa.array(np.maximum(at, 0), mask=at < 0)
            found = []
            for k, v in enumerate(values):
                own = batch.column(v)
                first = pa.array([held[1][k] if held is not None and held[1] is not None else None], own.type)
                found.append(pa.concat_arrays([first, own]).take(picked))
            known = pa.array(at >= 0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *found, known, pa.array(np.full(n, task)), pa.array(np.arange(row, row + n))],
                names=[*batch.schema.names, *[f"__last_{v}" for v in values], "__known", "__task", "__row"])
            held = ([batch.column(g)[n - 1].as_py() for g in group],
                    [f[n - 1].as_py() for f in found] if at[n - 1] >= 0 else None)
            row += n

    return run


def carried(df: DataFrame, group: Sequence[str], order: Sequence[str], mark: str, values: Sequence[str]) -> DataFrame:
    """Add ``last_<value>`` for each of ``values``: that of the last row at or before a row, in ``order`` within
    ``group``, whose ``mark`` is true; null where there is none. Rows that are equal in ``order`` may come in any
    order, so it must say whether a mark comes before or behind what it is for.

    However few or large the groups are, a task holds its share of all rows; rows written first, so that both
    passes see the same split.
    """
    layout = [*group, *order]
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    ddl = ", ".join([*[f"`{c}` {t}" for c, t in types.items()], *[f"`__last_{v}` {types[v]}" for v in values],
                     "__known boolean, __task bigint, __row bigint"])
    laid = durable(df.repartitionByRange(*layout).sortWithinPartitions(*layout).mapInArrow(_forward(group, mark, values), ddl))
    held = F.when(F.col("__known"), F.struct(*[F.col(f"__last_{v}") for v in values]))
    ends = laid.groupBy("__task", *group).agg(F.max_by(held, "__row").alias("__end"), F.count_if(~F.col("__known")).alias("__open"))
    # at most one row per task for each group, so this window stays small
    earlier = Window.partitionBy(*group).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    came = measured(ends.withColumn("__came", F.last("__end", ignorenulls=True).over(earlier)).filter(
        "__open > 0 and __came is not null").select(F.col("__task").alias("__at"), *[F.col(g).alias(f"__of_{g}") for g in group], "__came"))
    match = ~F.col("__known") & (F.col("__task") == F.col("__at"))
    for g in group:
        match = match & F.col(g).eqNullSafe(F.col(f"__of_{g}"))
    return laid.join(came, match, "left").select(
        *df.columns, *[F.coalesce(f"__last_{v}", F.col("__came").getField(f"__last_{v}")).alias(f"last_{v}") for v in values])
