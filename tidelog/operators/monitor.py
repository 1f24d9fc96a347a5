"""Balance of partitions over consumers, rebalances, hot partitions, capacity, and the advice
that follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidelog.operators.sizes import record_size
from tidelog.session import measured

# Bounds, weights and texts of the health rules.
HOT_RECORDS_PER_SECOND = 1000
SKEW_ALERT = 2.0
REBALANCE_WINDOW = "1 hour"
REBALANCE_SCALE = 10.0
RECENT_WINDOW = "5 minutes"
RECENT_REBALANCES = 3
UTILIZATION_WEIGHT, STABILITY_WEIGHT = 0.7, 0.3
RECOMMENDATIONS = [
    ("PARTITION_DISTRIBUTION", "HIGH", "High Partition Skew Detected",
     "Partition distribution is uneven across consumers",
     "Consider using LOAD_BALANCED assignment strategy or rebalancing consumer group",
     "currentSkew", "idealSkew", "< 1.5"),
    ("CONSUMER_UTILIZATION", "MEDIUM", "Low Consumer Utilization",
     "Consumers are not effectively utilizing available resources",
     "Optimize partition assignment or consider reducing consumer count",
     "currentUtilization", "targetUtilization", "> 0.8"),
    ("ASSIGNMENT_EFFICIENCY", "MEDIUM", "Suboptimal Assignment Efficiency",
     "Partition assignment strategy is not optimal for current workload",
     "Consider switching to WORKLOAD_AWARE or AFFINITY_BASED assignment strategy",
     "currentEfficiency", "targetEfficiency", "> 0.8"),
    ("REBALANCING_FREQUENCY", "HIGH", "Frequent Rebalancing Detected",
     "Consumer group is rebalancing too frequently",
     "Increase session timeout, enable sticky assignment, or investigate consumer stability",
     "totalRebalances", "recommendedFrequency", "< 5 per hour"),
]
PLAN = [
    ("REBALANCE_PARTITIONS", "High partition skew detected", "1.5"),
    ("OPTIMIZE_CONSUMER_ASSIGNMENT", "Low consumer utilization", "0.8"),
    ("CHANGE_ASSIGNMENT_STRATEGY", "Low assignment efficiency", "WORKLOAD_AWARE"),
]


def _now(as_of) -> Column:
    return F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")


# ---- skew and hot partitions ------------------------------------------------------------

def skew_of(value: str) -> Column:
    """Largest over average; 0 where there is nothing."""
    average = F.sum(value) / F.count(value)
    return F.coalesce(F.when(average != 0, F.max(value) / average), F.lit(0.0))


def partition_skew(df: DataFrame) -> DataFrame:
    """Skew of records over the partitions of each topic, and over all partitions."""
    counts = df.groupBy("topic", "partition").agg(F.count(F.lit(1)).alias("records"))
    return counts.rollup("topic").agg(
        F.grouping("topic").cast("boolean").alias("overall"), skew_of("records").alias("skew"),
        F.count(F.lit(1)).alias("partitions"), F.sum("records").alias("records"))


def hot_partitions(df: DataFrame, threshold: int = HOT_RECORDS_PER_SECOND) -> DataFrame:
    """Seconds in which a partition got more than ``threshold`` records."""
    seconds = df.groupBy("topic", "partition", F.date_trunc("second", "timestamp").alias("second")).agg(
        F.count(F.lit(1)).alias("records"))
    return seconds.filter(F.col("records") > threshold)


# ---- membership ---------------------------------------------------------------------------

def rebalance_events(members: DataFrame) -> DataFrame:
    """Snapshots whose set of members differs from the previous snapshot of the group.

    Sets are compared member by member in an equi-join, never gathered: a consumer that was
    there before is expected again, whatever side misses it makes the snapshot a rebalance.
    """
    present = members.select("group", "ts", "consumer_id").distinct()
    # the window runs over snapshots, not members
    by_time = Window.partitionBy("group").orderBy("ts")
    snapshots = measured(present.select("group", "ts").distinct().select(
        "group", "ts", F.lead("ts").over(by_time).alias("next_ts"), F.lag("ts").over(by_time).alias("last_ts")))
    tagged = present.join(snapshots, ["group", "ts"])
    # a member that stays is once "expected" and once "present" at the next snapshot
    seen = tagged.filter("last_ts is not null").select("group", "ts", "consumer_id")
    expected = tagged.filter("next_ts is not null").select("group", F.col("next_ts").alias("ts"), "consumer_id")
    changed = (
        seen.unionByName(expected).groupBy("group", "ts", "consumer_id")
        .agg(F.count(F.lit(1)).alias("sides")).filter("sides = 1")
    )
    return changed.groupBy("group", "ts").agg(F.count(F.lit(1)).alias("members_changed"))


def rebalance_frequency(events: DataFrame, as_of=None) -> DataFrame:
    """One row: groups whose last rebalance is within the hour (a tenth each, at most 1), and
    whether more than three happened within five minutes."""
    now = _now(as_of)
    last = events.groupBy("group").agg(F.max("ts").alias("last"))
    within = lambda span: F.count_if(F.col("last") > now - F.expr(f"INTERVAL {span}"))
    return last.agg(
        F.count(F.lit(1)).alias("rebalanced_groups"),
        F.least(F.lit(1.0), within(REBALANCE_WINDOW) / REBALANCE_SCALE).alias("frequency"),
        (within(RECENT_WINDOW) > RECENT_REBALANCES).alias("too_often"))


def latest_members(members: DataFrame) -> DataFrame:
    """Members of the last snapshot of each group."""
    last = measured(members.groupBy("group").agg(F.max("ts").alias("ts")))
    return members.join(last, ["group", "ts"], "left_semi")


def utilization_of(skew: Column, consumers: Column) -> Column:
    return F.when((consumers == 0) | (skew == 0), 0.0).otherwise(
        F.greatest(F.lit(0.0), F.lit(1.0) - (skew - F.lit(1.0))))


def monitor_stats(members: DataFrame, events: DataFrame, as_of=None, by_group: bool = False) -> DataFrame:
    """Skew, utilization, efficiency and sizes, per group or over all of them.

    Members and rebalances meet in one aggregate of their union, so no join is needed.
    Over all groups ``total_rebalances`` counts groups that rebalanced, per group its events.
    """
    now = _now(as_of)
    last = events.groupBy("group").agg(F.max("ts").alias("last"), F.count(F.lit(1)).alias("rebalances"))
    current = latest_members(members).select("group", "consumer_id", F.col("partitions").cast("bigint").alias("partitions"))
    both = current.unionByName(last.select("group", "last", "rebalances"), allowMissingColumns=True)
    keys = ["group"] if by_group else []
    recent = F.count_if(F.col("last") > now - F.expr(f"INTERVAL {REBALANCE_WINDOW}"))
    rebalances = F.coalesce(F.sum("rebalances"), F.lit(0).cast("bigint")) if by_group else F.count("last")
    sums = both.groupBy(*keys).agg(
        skew_of("partitions").alias("skew"), F.count("consumer_id").alias("active_consumers"),
        F.coalesce(F.sum("partitions"), F.lit(0).cast("bigint")).alias("monitored_partitions"),
        rebalances.alias("total_rebalances"),
        F.least(F.lit(1.0), recent / REBALANCE_SCALE).alias("rebalance_frequency"))
    used = utilization_of(F.col("skew"), F.col("active_consumers"))
    efficiency = F.when(F.col("active_consumers") == 0, 1.0).otherwise(
        F.col("utilization") * UTILIZATION_WEIGHT + (F.lit(1.0) - F.col("rebalance_frequency")) * STABILITY_WEIGHT)
    return sums.withColumn("utilization", used).withColumn("efficiency", efficiency)


# ---- rules over the statistics ---------------------------------------------------------------

def partition_health(stats: DataFrame) -> DataFrame:
    skew, used, eff = F.col("skew"), F.col("utilization"), F.col("efficiency")
    overall = (F.when((skew > 3.0) | (used < 0.4) | (eff < 0.5), "UNHEALTHY")
               .when((skew > 2.0) | (used < 0.6) | (eff < 0.7), "DEGRADED").otherwise("HEALTHY"))
    return (
        stats.withColumn("health", overall)
        .withColumn("distribution", F.when(skew <= 2.0, "HEALTHY").otherwise("UNHEALTHY"))
        .withColumn("utilization_state", F.when(used > 0.6, "HEALTHY").otherwise("DEGRADED"))
        .withColumn("efficiency_state", F.when(eff > 0.7, "HEALTHY").otherwise("DEGRADED"))
    )


def _conditions() -> list[Column]:
    return [F.col("skew") > 2.0, F.col("utilization") < 0.6, F.col("efficiency") < 0.7,
            F.col("total_rebalances") > 10]


def partition_recommendations(stats: DataFrame) -> DataFrame:
    """One row per piece of advice: what is wrong, what to do, and under ``metrics`` by name the present value
    and the one to reach."""
    current = [F.col("skew"), F.col("utilization"), F.col("efficiency"), F.col("total_rebalances")]
    rows = []
    for hit, now, (kind, severity, title, description, todo, measure, goal, wanted) in zip(
            _conditions(), current, RECOMMENDATIONS):
        metrics = F.create_map(F.lit(measure), now.cast("string"), F.lit(goal), F.lit(wanted))
        texts = zip(("type", "severity", "title", "description", "recommendation"),
                    (kind, severity, title, description, todo))
        rows.append(F.when(hit, F.struct(*[F.lit(text).alias(name) for name, text in texts], metrics.alias("metrics"))))
    return stats.withColumn("advice", F.explode(F.array_compact(F.array(*rows)))).select(
        *stats.columns, "advice.*")


def optimization_plan(stats: DataFrame) -> DataFrame:
    current = [F.col("skew"), F.col("utilization"), F.col("efficiency")]
    steps = [
        F.when(hit, F.struct(F.lit(action).alias("action"), F.lit(reason).alias("reason"),
                             now.alias("current"), F.lit(goal).alias("goal")))
        for hit, now, (action, reason, goal) in zip(_conditions(), current, PLAN)]
    return stats.withColumn("step", F.explode(F.array_compact(F.array(*steps)))).select(
        *stats.columns, "step.*")


def partition_detail(stats: DataFrame, skew_threshold: float = SKEW_ALERT) -> DataFrame:
    used, eff = F.col("utilization"), F.col("efficiency")
    return (
        stats.withColumn("skew_status", F.when(F.col("skew") > skew_threshold, "WARNING").otherwise("OK"))
        .withColumn("utilization_status", F.when(used > 0.8, "GOOD").otherwise("NEEDS_IMPROVEMENT"))
        .withColumn("efficiency_status", F.when(eff > 0.8, "EXCELLENT").when(eff > 0.6, "GOOD")
                    .otherwise("NEEDS_IMPROVEMENT"))
        .withColumn("partitions_per_consumer", F.when(
            F.col("active_consumers") > 0, F.col("monitored_partitions") / F.col("active_consumers")).otherwise(0.0))
    )


# ---- capacity ---------------------------------------------------------------------------------

# Bounds of the sizing rules (bytes, milliseconds, records).
RECORDS_PER_PARTITION = 10000
MAX_PARTITIONS = 48
POLL_BUDGET_MS = 30000


def capacity_plan(df: DataFrame, processing_ms: int = 10, consumers: int = 3, growth: int = 1,
                  low_latency: bool = False, durable: bool = False) -> DataFrame:
    """Settings for each topic from its observed rate and mean size; whole-number arithmetic.
    A topic whose rate rounds to zero gets no settings. ``growth`` multiplies the rate."""
    span = F.greatest(F.expr("unix_millis(max(timestamp)) - unix_millis(min(timestamp))"), F.lit(1))
    seen = df.groupBy("topic").agg(
        F.count(F.lit(1)).alias("records"), F.sum(record_size()).alias("bytes"), span.alias("span_ms"))
    seen = seen.withColumn("rate", F.expr(f"records * {growth} * 1000 div span_ms")).withColumn(
        "mean_size", F.expr("bytes div records"))
    per_second = "1000 div nullif(rate, 0)"
    if low_latency:
        plan = {
            "batch_size": "greatest(1024, mean_size * 2)", "linger_ms": "0", "buffer_memory": "33554432",
            "max_poll_records": f"least(50, greatest(1, {per_second}))", "max_poll_interval_ms": "120000",
            "session_timeout_ms": "10000", "fetch_min_bytes": "1", "concurrency": "1"}
    else:
        poll = min(5000, max(100, POLL_BUDGET_MS // processing_ms))
        plan = {
            "batch_size": f"greatest(16384, mean_size * least(100, greatest(10, {per_second})))",
            "linger_ms": "20" if durable else "100",
            "buffer_memory": "greatest(67108864, rate * mean_size * 2)",
            "max_poll_records": str(poll), "max_poll_interval_ms": str(max(300000, poll * processing_ms * 2)),
            "session_timeout_ms": "30000", "fetch_min_bytes": "greatest(1024, least(1048576, rate * 50))",
            "concurrency": "greatest(1, least(12, rate div 1000))"}
    plan["partitions"] = (f"least({MAX_PARTITIONS}, greatest(greatest(1, rate div {RECORDS_PER_PARTITION}), "
                          f"{consumers}))")
    plan["replication"] = "3" if durable else "2"
    settings = [F.expr(f"if(rate > 0, cast({e} as bigint), null)").alias(n) for n, e in plan.items()]
    acks = "1" if low_latency or not durable else "all"
    return seen.select(
        "topic", "rate", "mean_size", *settings, F.when(F.col("rate") > 0, acks).alias("acks"),
        F.when(F.col("rate") > 0, "none" if low_latency else "snappy").alias("compression"))
