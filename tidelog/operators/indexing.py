"""Dense positions in a sorted log without ever putting a group into one task.

``row_number`` over a window puts a whole group, or with no group the whole table, on one
executor. Here the rows are range-partitioned on group + order, so a group that holds a
third of the data spreads over a third of the tasks. Each task numbers its own rows and a
small table of block sizes (one row per task and group in it) supplies what came before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidelog.session import durable, measured

ARRIVAL = ("timestamp", "topic", "partition", "offset")
PLACE = ("topic", "partition", "offset")
_TASK_BITS = 33  # layout of monotonically_increasing_id: task number above, row number below


def rank_within(
    df: DataFrame,
    order: Sequence[str | Column],
    group: Sequence[str] = (),
    name: str = "rank",
    identity: Sequence[str] = (),
) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... in ``order`` within ``group``. ``order`` must break all ties.

    The laid-out rows are written before they are counted: both the numbering and the block
    sizes have to see the same split, also when an executor is lost in between. Where
    ``identity`` names columns that are unique and never null, only those and the columns of
    group and order are laid out, and the numbers are joined back to the (wide) rows.
    """
    if identity:
        narrow = list(dict.fromkeys([*identity, *group, *order]))
        numbers = rank_within(df.select(*narrow), order, group, name).select(*identity, name)
        return df.join(numbers, list(identity)).select(*df.columns, name)
    keys = list(group)
    layout = [*keys, *order]
    laid = durable(
        df.repartitionByRange(*layout)
        .sortWithinPartitions(*layout)
        .withColumn("__row", F.monotonically_increasing_id())
    )
    blocks = laid.groupBy(F.shiftright("__row", _TASK_BITS).alias("__task"), *keys).agg(
        F.count(F.lit(1)).alias("__rows"), F.min("__row").alias("__first")
    )
    # at most one row per task for each group, so this window stays small
    earlier = Window.partitionBy(*keys).orderBy("__task")
    starts = measured(blocks.select(
        "__task",
        *[F.col(k).alias(f"__{k}") for k in keys],
        (F.sum("__rows").over(earlier) - F.col("__rows") - F.col("__first")).alias("__shift"),
    ))
    match = F.shiftright(laid["__row"], _TASK_BITS) == starts["__task"]
    for k in keys:
        match = match & laid[k].eqNullSafe(starts[f"__{k}"])
    return laid.join(starts, match).select(
        *[laid[c] for c in df.columns], (F.col("__row") + F.col("__shift")).alias(name)
    )


def arrival_index(df: DataFrame, name: str = "arrival") -> DataFrame:
    """Position of each record in the order in which the log received it. Only the places
    and times of the records are sorted, not their values."""
    return rank_within(df, ARRIVAL, name=name, identity=PLACE)


def running_total(df: DataFrame, value: str, rank: str, group: Sequence[str], name: str,
                  chunk: int = 100_000) -> DataFrame:
    """Add ``name``: sum of ``value`` up to and with each row, in ``rank`` order within ``group``.

    ``rank`` is dense, so ``chunk`` bounds the rows of every window; the totals of the chunks
    are ``chunk`` times fewer and are summed in a second, small window.
    """
    keys = [*group, "__chunk"]
    cut = df.withColumn("__chunk", F.expr(f"`{rank}` div {chunk}"))
    upto = Window.partitionBy(*group).orderBy("__chunk")
    before = cut.groupBy(*keys).agg(F.sum(value).alias("__sum")).select(
        *keys, (F.sum("__sum").over(upto) - F.col("__sum")).alias("__before"))
    inside = Window.partitionBy(*keys).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    summed = cut.withColumn("__inside", F.sum(value).over(inside)).join(before, keys)
    return summed.select(*df.columns, (F.col("__inside") + F.col("__before")).alias(name))
