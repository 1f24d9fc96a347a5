"""Allocation of many units of work to the owners that serve their queue.

``units`` has ``queue`` and ``unit``; ``owners`` has one row per queue it serves. Both are
numbered within their queue (see ``indexing``), each strategy turns owners into positions,
and an equi-join or, for blocks of positions, a merge (see ``carry``) brings both together. Neither a queue nor the owners of one are ever held
in one task, and no side is forced to be broadcast: small ones are measured first and the
planner decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidelog.operators.carry import carried
from tidelog.operators.indexing import rank_within, running_total
from tidelog.session import durable, measured

# Shares of the priority levels and factors of the workload score.
PRIORITY_SHARES = [("HIGH", 0.5), ("MEDIUM", 0.3), ("LOW", 0.2)]
BATCH_FACTOR = 1.2  # capability BATCH_PROCESSING on queues named "batch"
STREAM_FACTOR = 1.2  # capability REAL_TIME on queues named "stream"
BULK_FACTOR = 1.1  # preference HIGH_THROUGHPUT on queues named "bulk"


def _ranked(units: DataFrame, *group: str) -> DataFrame:
    return rank_within(units, ["unit"], group=group or ("queue",), name="__rank")


def _queue_sizes(units: DataFrame) -> DataFrame:
    return units.groupBy("queue").agg(F.count(F.lit(1)).alias("__units"))


def _numbered(owners: DataFrame, *group: str) -> DataFrame:
    """Owners of a group in name order: 0, 1, ..."""
    return rank_within(owners.select(*group, "owner"), ["owner"], group=group, name="__turn")


def _group_sizes(owners: DataFrame, *group: str) -> DataFrame:
    return measured(owners.groupBy(*group).agg(F.count(F.lit(1)).alias("__of")))


def _blocks(units: DataFrame, owners: DataFrame, weight: Column) -> DataFrame:
    """Per owner, heaviest first, the positions [__from, __end) it gets: round(share x units)
    of them, never more than what is left."""
    weighed = owners.select("queue", "owner", weight.alias("__weight"))
    ranked = rank_within(weighed, [F.desc("__weight"), "owner"], group=["queue"], name="__turn")
    totals = measured(weighed.groupBy("queue").agg(
        F.sum("__weight").alias("__total"), F.count(F.lit(1)).alias("__of")).join(_queue_sizes(units), "queue"))
    quota = F.floor(
        F.col("__weight").cast("double") / F.col("__total").cast("double") * F.col("__units") + 0.5)
    quotas = ranked.join(totals, "queue").withColumn("__quota", quota)
    return (
        running_total(quotas, "__quota", "__turn", ["queue"], "__sum")
        .withColumn("__from", F.least("__units", F.col("__sum") - F.col("__quota")))
        .withColumn("__end", F.least("__units", "__sum"))
        .select("queue", "owner", "__turn", "__of", "__from", "__end")
    )


def _by_weight(units: DataFrame, owners: DataFrame, weight: Column) -> DataFrame:
    """Each owner a block in proportion to its weight; units beyond all blocks go round in the same order.

    Units and the starts of blocks are laid out together by position, and each start is carried forward to the
    units behind it, over the borders of tasks too. So neither a heavy owner nor many light ones make a large task.
    """
    ranked = _ranked(units)
    blocks = durable(_blocks(units, owners, weight))  # one row per owner, read three times
    per_queue = measured(blocks.groupBy("queue").agg(F.max("__end").alias("__settled"), F.max("__of").alias("__of")))
    starts = blocks.filter("__end > __from").select(
        "queue", F.col("__from").alias("__rank"), F.lit(True).alias("__start"), F.col("owner").alias("__owner"))
    both = starts.unionByName(ranked.withColumn("__start", F.lit(False)), allowMissingColumns=True).withColumn(
        "__unit", ~F.col("__start"))
    met = carried(both, ["queue"], ["__rank", "__unit"], "__start", ["__owner"]).filter("__unit")
    placed = met.join(per_queue, "queue", "left")
    columns = [*units.columns, "owner"]
    taken = placed.filter("__rank < __settled").withColumn("owner", F.col("last___owner"))
    over_all = placed.filter("__rank >= __settled or __settled is null").withColumn(
        "__seat", F.expr("(__rank - __settled) % __of"))
    return taken.select(columns).unionByName(_seat(over_all, blocks, [], units).select(columns))


def alloc_capacity(units: DataFrame, owners: DataFrame) -> DataFrame:
    return _by_weight(units, owners, F.col("capacity").cast("decimal(28,4)"))


def workload_score() -> Column:
    """Capacity raised by what the owner is good at. Kept in decimals so that the total of
    all scores does not depend on the order of summing."""
    def factor(listed: str, word: str, in_queue: str, by: float) -> Column:
        hit = F.array_contains(listed, word) & F.col("queue").contains(in_queue)
        return F.when(hit, F.lit(str(by)).cast("decimal(4,2)")).otherwise(
            F.lit("1").cast("decimal(4,2)"))

    return (
        F.col("capacity").cast("decimal(12,0)")
        * factor("capabilities", "BATCH_PROCESSING", "batch", BATCH_FACTOR)
        * factor("capabilities", "REAL_TIME", "stream", STREAM_FACTOR)
        * factor("preferences", "HIGH_THROUGHPUT", "bulk", BULK_FACTOR)
    )


def alloc_workload(units: DataFrame, owners: DataFrame) -> DataFrame:
    return _by_weight(units, owners, workload_score())


def alloc_locality(units: DataFrame, owners: DataFrame) -> DataFrame:
    """Units go round the owners in their own rack, or all owners if it has none."""
    ranked = _ranked(units, "queue", "rack")
    pools = owners.select("queue", "rack", "owner").withColumn(
        "rack", F.explode(F.array("rack", F.lit("*"))))
    sizes = _group_sizes(pools, "queue", "rack")
    own, everyone = sizes.alias("own"), sizes.filter("rack = '*'").alias("every")
    u = ranked.alias("u")
    sited = (
        u.join(own, (F.col("u.queue") == F.col("own.queue")) & (F.col("u.rack") == F.col("own.rack")), "left")
        .join(everyone, F.col("u.queue") == F.col("every.queue"), "left")
        .select("u.*", F.when(F.col("own.__of").isNotNull(), F.col("u.rack")).otherwise("*").alias("__pool"),
                F.coalesce("own.__of", "every.__of").alias("__of"))
        .withColumn("__seat", F.expr("__rank % __of"))
    )
    seats = _numbered(pools, "queue", "rack").withColumnRenamed("rack", "__pool")
    return _seat(sited, seats, ["__pool"], units)


def _seat(sited: DataFrame, numbered: DataFrame, also: list[str], units: DataFrame) -> DataFrame:
    """Left join on queue, the further columns and the seat number; no seat, no owner.

    Units without a seat get a negative one of their own: as nulls they would all meet in one
    task, and they can be a third of a queue.
    """
    seats = numbered.select(
        F.col("queue").alias("__q"), *[F.col(c).alias(f"{c}_") for c in also],
        F.col("__turn").alias("__no"), "owner")
    seat = F.coalesce("__seat", -1 - F.col("__rank"))
    match = (F.col("queue") == F.col("__q")) & (seat == F.col("__no"))
    for c in also:
        match = match & F.col(c).eqNullSafe(F.col(f"{c}_"))
    return sited.join(seats, match, "left").select(*units.columns, "owner")


def alloc_priority(units: DataFrame, owners: DataFrame) -> DataFrame:
    """Each level takes its share of what the levels above left, at least one unit. What
    remains after the last level stays without owner."""
    ranked = _ranked(units)
    levels = owners.groupBy("queue").agg(*[
        F.count_if(F.col("priority") == level).alias(f"__{level}") for level, _ in PRIORITY_SHARES])
    shares = _queue_sizes(units).join(levels, "queue")
    left, start = F.col("__units"), F.lit(0).cast("bigint")
    columns = []
    for level, share in PRIORITY_SHARES:
        wanted = F.greatest(F.lit(1), F.floor(left * F.lit(share))).cast("bigint")
        take = F.when((F.col(f"__{level}") > 0) & (left > 0), wanted).otherwise(0)
        columns += [start.alias(f"__{level}_from"), (start + take).alias(f"__{level}_end")]
        left, start = left - take, start + take
    bounds = measured(shares.select("queue", *[f"__{level}" for level, _ in PRIORITY_SHARES], *columns))
    level_of, seat = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    for level, _ in reversed(PRIORITY_SHARES):
        inside = (F.col("__rank") >= F.col(f"__{level}_from")) & (F.col("__rank") < F.col(f"__{level}_end"))
        level_of = F.when(inside, level).otherwise(level_of)
        seat = F.when(inside, (F.col("__rank") - F.col(f"__{level}_from")) % F.col(f"__{level}")).otherwise(seat)
    sited = ranked.join(bounds, "queue", "left").withColumn("__seat", seat).withColumn("__level", level_of)
    numbered = _numbered(owners.withColumnRenamed("priority", "__level"), "queue", "__level")
    return _seat(sited, numbered, ["__level"], units)


def alloc_region(units: DataFrame, owners: DataFrame) -> DataFrame:
    """Even blocks over the regions in name order, the first ones one larger; round the
    owners inside a region."""
    ranked = _ranked(units)
    # a queue has few regions, whatever the number of owners in them
    regions = _group_sizes(owners, "queue", "region").withColumn(
        "__region", F.row_number().over(Window.partitionBy("queue").orderBy("region")) - 1)
    counts = regions.groupBy("queue").agg(F.count(F.lit(1)).alias("__regions"))
    even = measured(_queue_sizes(units).join(counts, "queue").select(
        "queue", F.expr("__units div __regions").alias("__each"),
        (F.col("__units") % F.col("__regions")).alias("__extra")))
    placed = ranked.join(even, "queue", "left").withColumn("__big", F.expr("__extra * (__each + 1)"))
    placed = placed.withColumn("__region", F.expr(
        "if(__rank < __big, __rank div (__each + 1), __extra + (__rank - __big) div nullif(__each, 0))"
    )).withColumn("__pos", F.expr(
        "if(__rank < __big, __rank % (__each + 1), (__rank - __big) % nullif(__each, 0))"))
    sited = placed.join(regions.select("queue", "__region", "__of"), ["queue", "__region"], "left")
    sited = sited.withColumn("__seat", F.expr("__pos % __of"))
    seats = _numbered(owners, "queue", "region").join(
        regions.select("queue", "region", "__region"), ["queue", "region"])
    return _seat(sited, seats, ["__region"], units)


def alloc_sticky(units: DataFrame, owners: DataFrame, previous: str = "previous_owner") -> DataFrame:
    """Units keep a previous owner that still serves the queue; the rest go round."""
    valid = owners.select(F.col("queue").alias("__q"), F.col("owner").alias("__valid"))
    known, new = units.filter(F.col(previous).isNotNull()), units.filter(F.col(previous).isNull())
    checked = known.join(
        valid, (F.col("queue") == F.col("__q")) & (F.col(previous) == F.col("__valid")), "left"
    ).drop("__q")
    kept = checked.filter("__valid is not null").withColumnRenamed("__valid", "owner")
    free = checked.filter("__valid is null").drop("__valid").unionByName(new)
    numbered, sizes = _numbered(owners, "queue"), _group_sizes(owners, "queue")
    rest = _ranked(free)
    sited = rest.join(sizes, "queue", "left").withColumn("__seat", F.expr("__rank % __of"))
    return kept.unionByName(_seat(sited, numbered, [], units))


def unassigned(units: DataFrame, allocation: DataFrame) -> DataFrame:
    """Units that got no owner."""
    owned = allocation.filter("owner is not null").select("queue", "unit")
    return units.join(owned, ["queue", "unit"], "left_anti")
