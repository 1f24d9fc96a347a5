"""Record -> partition functions: eight strategies over ``partitions`` target partitions.

All return the log with ``target_partition``. Strategies that count arrivals need the
position of each record (see ``indexing``); the others are expressions on the record.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidelog.functions.hashing import key_partition, string_hash
from tidelog.operators.indexing import ARRIVAL, PLACE, arrival_index, rank_within
from tidelog.session import measured

# Defaults of the strategies.
REGIONS = ["us-east", "us-west", "eu", "asia"]
CUSTOMER_PREFIXES = ["CUSTOMER-", "customer-"]
CUSTOMER_SEED = 12345
HIGH_PRIORITIES = ["HIGH", "CRITICAL"]
DEFAULT_PRIORITY = "NORMAL"
PRIORITY_RATIO = 0.2
STICKY_PARTITIONS = 1
TIME_WINDOW_MS = 60000
LOAD_THRESHOLD = 1000

TARGET = "target_partition"


def _check(partitions: int) -> int:
    if partitions <= 0:
        raise ValueError("no partitions available")
    return partitions


def _in_turn(df: DataFrame, partitions: int) -> DataFrame:
    indexed = arrival_index(df, "__arrival")
    turn = (F.col("__arrival") % partitions).cast("int")
    return indexed.withColumn(TARGET, turn).drop("__arrival")


def _or_hash(df: DataFrame, partitions: int, applies: Column, target: Column) -> DataFrame:
    """``target`` where it ``applies``, else the key hash; records with neither take turns.
    Only the places of those last ones are sorted, and their (few) turns joined to the records."""
    settled = applies | F.col("key").isNotNull()
    hashed = key_partition(F.when(~applies, F.col("key")), partitions)
    own = [F.col(c).alias(f"__{c}") for c in PLACE]
    turns = measured(rank_within(df.filter(~settled).select(*ARRIVAL), ARRIVAL, name="__turn").select(
        *own, (F.col("__turn") % partitions).cast("int").alias("__turn")))
    placed = df.withColumn(TARGET, F.when(applies, target.cast("int")).otherwise(hashed))
    match = [F.col(c) == F.col(f"__{c}") for c in PLACE]
    return placed.join(turns, match, "left").select(*df.columns, F.coalesce(TARGET, "__turn").alias(TARGET))


def _key_hash_size() -> Column:
    """|hash(key)| computed in 64 bits, so the smallest 32-bit value stays positive."""
    return F.abs(F.coalesce(string_hash(F.col("key")), F.lit(0).cast("bigint")))


def part_round_robin(df: DataFrame, partitions: int) -> DataFrame:
    return _in_turn(df, _check(partitions))


def part_hash(df: DataFrame, partitions: int) -> DataFrame:
    return _or_hash(df, _check(partitions), F.lit(False), F.lit(None))


def part_sticky(df: DataFrame, partitions: int, producer: Column,
                sticky: int = STICKY_PARTITIONS) -> DataFrame:
    """Each (topic, producer) keeps the partition it got on its first record."""
    width = min(sticky, _check(partitions))
    named = df.withColumn("__producer", producer)
    first = named.groupBy("topic", "__producer").agg(
        F.min(F.struct(*ARRIVAL)).alias("__first"))
    ranked = measured(rank_within(first, ["__first", "__producer"], name="__newcomer").select(
        F.col("topic").alias("__topic"), F.col("__producer").alias("__name"),
        (F.col("__newcomer") % width).cast("int").alias(TARGET)))
    match = (named["topic"] == ranked["__topic"]) & named["__producer"].eqNullSafe(ranked["__name"])
    return named.join(ranked, match).drop("__producer", "__topic", "__name")


def part_customer(df: DataFrame, partitions: int, seed: int = CUSTOMER_SEED) -> DataFrame:
    key = F.col("key")
    customer = F.when(
        key.startswith(CUSTOMER_PREFIXES[0]) | key.startswith(CUSTOMER_PREFIXES[1]), key
    ).otherwise(F.get_json_object("value", "$.customerId"))
    mixed = string_hash(customer).bitwiseXOR(F.lit(seed).cast("bigint"))
    return _or_hash(df, _check(partitions), customer.isNotNull(), F.abs(mixed) % partitions)


def part_geo(df: DataFrame, partitions: int, regions: Sequence[str] = REGIONS) -> DataFrame:
    """Each region owns a block of partitions. Blocks are equal, so when the number of
    partitions is no multiple of the regions the last partitions stay unused."""
    each = max(1, _check(partitions) // len(regions))
    region = F.lower(F.get_json_object("value", "$.region"))
    known = [r.lower() for r in regions]
    at = F.array_position(F.array(*[F.lit(r) for r in known]), region)
    place = F.least((at - 1) * each + _key_hash_size() % each, F.lit(partitions - 1))
    return _or_hash(df, partitions, F.coalesce(region.isin(known), F.lit(False)), place)


def part_priority(df: DataFrame, partitions: int, ratio: float = PRIORITY_RATIO) -> DataFrame:
    reserved = max(1, int(_check(partitions) * ratio))
    normal = partitions - reserved
    priority = F.coalesce(F.get_json_object("value", "$.priority"), F.lit(DEFAULT_PRIORITY))
    high = F.upper(priority).isin(HIGH_PRIORITIES)
    if normal <= 0:
        return _or_hash(df, partitions, high, _key_hash_size() % reserved)
    block = F.when(high, F.lit(reserved)).otherwise(F.lit(normal))
    start = F.when(high, F.lit(0)).otherwise(F.lit(reserved))
    return _or_hash(df, partitions, F.lit(True), start + _key_hash_size() % block)


def part_time(df: DataFrame, partitions: int, window_ms: int = TIME_WINDOW_MS) -> DataFrame:
    slot = F.expr(f"unix_millis(timestamp) div {window_ms}")
    return df.withColumn(TARGET, (slot % _check(partitions)).cast("int"))


def part_load_aware(df: DataFrame, partitions: int, loads: Sequence[int] | DataFrame | None = None,
                    threshold: int = LOAD_THRESHOLD) -> DataFrame:
    """Least-loaded partition of the topic first, lowest number on ties; in turn once all are above the
    threshold. ``loads`` are the present counts: one per partition for every topic alike, or rows of (topic,
    partition, load), added up; partitions without a row have no load.

    Between two loads that occur in a topic the same partitions take one record each in turn, so its slots
    are a few segments, as many as there are different loads: a record's place in its topic lies in one, and
    its place in the segment tells the partition. The threshold does not add to the rows.
    """
    _check(partitions)
    topics = measured(df.select("topic").distinct())
    if isinstance(loads, DataFrame):
        each = loads.filter(F.col("partition").between(0, partitions - 1)).groupBy(
            F.col("topic").alias("__of"), F.col("partition").cast("int").alias("__at")).agg(F.sum("load").cast("bigint").alias("__load"))
        given = each.groupBy("__of").agg(F.map_from_entries(F.collect_list(F.struct("__at", "__load"))).alias("__loads"))
        topics = topics.join(given, F.col("topic") == F.col("__of"), "left")
        load = F.coalesce(F.try_element_at("__loads", F.col("__target")), F.lit(0).cast("bigint"))
    else:
        if loads is not None and len(loads) != partitions:
            raise ValueError("one load per partition")
        load = F.get(F.array(*[F.lit(x).cast("bigint") for x in (loads or [0] * partitions)]), F.col("__target"))
    # one row per topic and partition, then one per topic and different load: windows are as small as that
    free = topics.withColumn("__target", F.explode(F.sequence(F.lit(0), F.lit(partitions - 1)))).select(
        F.col("topic").alias("__topic"), "__target", load.alias("__load")).filter(F.col("__load") <= threshold)
    upwards = Window.partitionBy("__topic").orderBy("__load")
    levels = free.groupBy("__topic", "__load").agg(F.collect_list("__target").alias("__new")).select(
        "__topic", "__load", F.array_sort(F.flatten(F.collect_list("__new").over(upwards))).alias("__open"),
        F.coalesce(F.lead("__load").over(upwards), F.lit(threshold + 1).cast("bigint")).alias("__until"))
    wide = levels.withColumn("__slots", (F.col("__until") - F.col("__load")) * F.size("__open"))
    ends = F.sum("__slots").over(upwards)
    segments = measured(wide.select("__topic", "__open", (ends - F.col("__slots")).alias("__from"), ends.alias("__end")))
    # the last segment of a topic goes on: what comes behind all slots takes turns over all partitions
    last = segments.groupBy("__topic").agg(F.max("__end").alias("__filled"))
    whole = topics.join(last, F.col("topic") == F.col("__topic"), "left").select(
        F.col("topic").alias("__topic"), F.sequence(F.lit(0), F.lit(partitions - 1)).alias("__open"),
        F.coalesce("__filled", F.lit(0).cast("bigint")).alias("__from"), F.lit((1 << 63) - 1).alias("__end"))
    spans = measured(segments.unionByName(whole))
    arrived = rank_within(df.select(*ARRIVAL), ARRIVAL, group=["topic"], name="__arrival")
    inside = (F.col("topic") == F.col("__topic")) & (F.col("__arrival") >= F.col("__from")) & (F.col("__arrival") < F.col("__end"))
    turn = ((F.col("__arrival") - F.col("__from")) % F.size("__open")).cast("int")
    placed = arrived.join(spans, inside).select(*PLACE, F.get("__open", turn).alias(TARGET))
    return df.join(placed, list(PLACE)).select(*df.columns, TARGET)


STRATEGIES = {
    "ROUND_ROBIN": part_round_robin,
    "HASH": part_hash,
    "STICKY": part_sticky,
    "CUSTOMER_AWARE": part_customer,
    "GEOGRAPHIC": part_geo,
    "PRIORITY": part_priority,
    "TIME_BASED": part_time,
    "LOAD_AWARE": part_load_aware,
}


def part_by(strategy: str, df: DataFrame, partitions: int, **params) -> DataFrame:
    """Strategy by name, in any case; unknown names mean HASH."""
    return STRATEGIES.get(strategy.upper(), part_hash)(df, partitions, **params)


def part_distribution(df: DataFrame, partition: str = TARGET) -> DataFrame:
    """Records per topic and partition, with the totals of the topic."""
    counts = df.groupBy("topic", partition).agg(F.count(F.lit(1)).alias("records"))
    totals = counts.groupBy("topic").agg(
        F.sum("records").alias("total_records"), F.count(F.lit(1)).alias("partitions_used"))
    return counts.join(totals, "topic")
