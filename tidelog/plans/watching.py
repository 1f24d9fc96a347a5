"""Queries of replay, lag, membership, balance and metric series."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidelog.operators import lag, monitor, replay, series, sizes
from tidelog.plans.registry import query
from tidelog.session import shared_folder
from tidelog.sources import appending, sinks
from tidelog.sources.derive import AS_OF, Tables

_ID = ["topic", "partition", "offset"]
_SQL_ID = 'topic, p AS "partition", o AS "offset"'
_SPAN = 'topic, p AS "partition", count(*) AS records, min(o) AS first_offset, max(o) AS last_offset'


def _span(df):
    return df.groupBy("topic", "partition").agg(
        F.count(F.lit(1)).alias("records"), F.min("offset").alias("first_offset"),
        F.max("offset").alias("last_offset"))


# ---- sources ---------------------------------------------------------------------------------

@query("scan_topic", "logs", f"SELECT {_SQL_ID}, key, value FROM logs WHERE topic = 'orders-topic'")
def scan_topic(t: Tables):
    return t.all_logs().filter("topic = 'orders-topic'").select(*_ID, "key", "value")


@query("scan_unified", "logs", f"""SELECT {_SQL_ID}, CASE topic WHEN 'orders-topic' THEN 'order' ELSE 'payment' END AS route
  FROM logs WHERE topic IN ('orders-topic', 'payments-topic')""")
def scan_unified(t: Tables):
    rows = t.all_logs().filter(F.col("topic").isin("orders-topic", "payments-topic"))
    route = F.when(F.col("topic") == "orders-topic", "order").otherwise("payment")
    return rows.select(*_ID, route.alias("route"))


@query("topic_catalog", "logs", """SELECT topic, p AS "partition", min(o) AS first_offset, max(o) + 1 AS end_offset,
  count(*) AS records, (epoch_us(min(ts)) // 1000) AS first_ms, (epoch_us(max(ts)) // 1000) AS last_ms FROM logs GROUP BY ALL""")
def topic_catalog(t: Tables):
    rows = replay.topic_catalog(t.all_logs())
    return rows.select("topic", "partition", "first_offset", "end_offset", "records",
                       F.unix_millis("first_time").alias("first_ms"), F.unix_millis("last_time").alias("last_ms"))


@query("replay_offset", "logs", f"SELECT {_SQL_ID}, key FROM logs WHERE topic = 'payments-topic' AND p = 1 AND o >= 200")
def replay_offset(t: Tables):
    return replay.replay_offset(t.all_logs(), "payments-topic", 1, 200).select(*_ID, "key")


def _from_time(at: str) -> str:
    return f"""SELECT {_SPAN} FROM logs JOIN (SELECT topic, p, min(o) AS start FROM logs
    WHERE ts >= {at} GROUP BY ALL) USING (topic, p) WHERE o >= start GROUP BY ALL"""


@query("replay_timestamp", "logs", _from_time("TIMESTAMP '2024-01-30 06:00:00'"))
def replay_timestamp(t: Tables):
    return _span(replay.replay_timestamp(t.all_logs(), "2024-01-30 06:00:00"))


@query("replay_time_ago", "logs", _from_time(f"TIMESTAMP '{AS_OF}' - INTERVAL 36 HOUR"))
def replay_time_ago(t: Tables):
    return _span(replay.replay_time_ago(t.all_logs(), "36 hours", AS_OF))


@query("replay_beginning", "logs", f"SELECT {_SPAN} FROM logs GROUP BY ALL")
def replay_beginning(t: Tables):
    return _span(replay.replay_beginning(t.all_logs()))


@query("replay_end", "logs", """SELECT topic, count(*) AS records_after_end FROM logs JOIN (SELECT topic, p,
  (max(o) * 9) // 10 AS e FROM logs GROUP BY ALL) USING (topic, p) WHERE o > e GROUP BY topic""")
def replay_end(t: Tables):
    """What came after an earlier end, at nine tenths of each partition."""
    log = t.all_logs()
    ends = log.groupBy("topic", "partition").agg(F.expr("max(offset) * 9 div 10").alias("end"))
    return replay.replay_end(log, ends).groupBy("topic").agg(F.count(F.lit(1)).alias("records_after_end"))


@query("replay_relative", "logs", f"""SELECT {_SPAN} FROM logs JOIN (SELECT topic, p, max(o) // 2 - 100 AS start
  FROM logs GROUP BY ALL) USING (topic, p) WHERE o >= greatest(start, 0) GROUP BY ALL""")
def replay_relative(t: Tables):
    """A hundred records back from the middle of each partition."""
    log = t.all_logs()
    positions = log.groupBy("topic", "partition").agg(F.expr("max(offset) div 2").alias("position"))
    return _span(replay.replay_relative(log, positions, -100))


@query("replay_conditional", "logs", f"""SELECT {_SPAN} FROM logs JOIN (SELECT topic, p, min(o) - 5 AS start FROM logs
  WHERE contains(value, 'PAYMENT_SERVICE_DOWN') GROUP BY ALL) USING (topic, p) WHERE o >= start GROUP BY ALL""")
def replay_conditional(t: Tables):
    trigger = F.col("value").contains("PAYMENT_SERVICE_DOWN")
    return _span(replay.replay_conditional(t.all_logs(), trigger, "RELATIVE", -5))


@query("compact_latest", "orders_log", f"""SELECT {_SQL_ID}, key FROM (SELECT *, row_number() OVER (PARTITION BY key
  ORDER BY ts DESC, p DESC, o DESC) AS r FROM orders_log) WHERE r = 1 OR key IS NULL""")
def compact_latest(t: Tables):
    return replay.compact_latest(t.orders_log()).select(*_ID, "key")


@query("compact_tombstones", "orders_log", f"""SELECT {_SQL_ID}, key, value IS NULL AS tombstone FROM (SELECT *,
  row_number() OVER (PARTITION BY key ORDER BY ts DESC, p DESC, o DESC) AS r FROM orders_log)
  WHERE key IS NULL OR (r = 1 AND (value IS NOT NULL OR ts >= TIMESTAMP '{AS_OF}' - INTERVAL 12 HOUR))""")
def compact_tombstones(t: Tables):
    """What a rewrite leaves of the orders; a null value stands for a deleted key for 12 hours."""
    left = replay.compacted(t.orders_log(), AS_OF, 12)
    return left.select(*_ID, "key", F.col("value").isNull().alias("tombstone"))


# ---- sinks: what would be written ------------------------------------------------------------

@query("publish", "notifications_log payments_log", f"""SELECT 'notifications-topic' AS topic, p AS "partition",
  1 + (SELECT max(o) FROM notifications_log n WHERE n.p = q.p) + row_number() OVER (PARTITION BY p ORDER BY ts, o) - 1
    AS "offset", key, value FROM payments_log q""")
def publish(t: Tables):
    """Payments appended to the notification log: offsets go on after its end."""
    incoming = t.payments_log().withColumn("topic", F.lit("notifications-topic"))
    placed = sinks.next_offsets(incoming, t.notifications_log(), ["timestamp", "offset"])
    return placed.select("topic", "partition", "offset", "key", "value")


@query("publish_batch", "orders_log", f"""SELECT 'batch-topic' AS topic, key, p AS "partition", o AS "offset", value
  FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, p DESC, o DESC) AS r FROM orders_log
    WHERE key IS NOT NULL) WHERE r = 1""")
def publish_batch(t: Tables):
    """A batch is a map: one record per key goes out, the last one given."""
    sent = sinks.batch_records(t.orders_log().filter("key is not null"), "batch-topic")
    return sent.select("topic", "key", "partition", "offset", "value")


@query("publish_atomic", "orders_log", """SELECT txn_id, count(*) AS records, count(DISTINCT topic) AS topics FROM (
    SELECT 'tx-' || (k % 97) AS txn_id, unnest(['orders-topic', 'payments-topic', 'notifications-topic']) AS topic
    FROM orders_log) WHERE txn_id <> 'tx-13' GROUP BY txn_id""")
def publish_atomic(t: Tables):
    """Three records per order in one transaction; readers see committed ones only, and
    transaction 13 has no marker."""
    k = F.col("offset") * 3 + F.col("partition")
    orders = t.orders_log().withColumn("txn_id", F.concat(F.lit("tx-"), k % 97))
    written = orders.withColumn("topic", F.explode(F.array(
        F.lit("orders-topic"), F.lit("payments-topic"), F.lit("notifications-topic"))))
    markers = orders.filter("txn_id <> 'tx-13'").select("txn_id").distinct()
    return sinks.committed(written, markers).groupBy("txn_id").agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct("topic").alias("topics"))


@query("append_once", "logs", """SELECT topic, p AS "partition",
  row_number() OVER (PARTITION BY topic, p ORDER BY o % 3, ts NULLS FIRST, key NULLS FIRST, value NULLS FIRST) - 1 AS "offset", key, value FROM logs""")
def append_once(t: Tables):
    """All logs appended in three batches, each of them tried twice, and read back: offsets go on from batch to batch."""
    path = f"{shared_folder(t.spark).rstrip('/')}/appended-{uuid.uuid4().hex}"
    for batch in range(3):
        some = t.all_logs().filter(F.col("offset") % 3 == batch)
        for _ in range(2):
            appending.append_once(some, path, "query", batch)
    return appending.read_appended(t.spark, path).select("topic", "partition", "offset", "key", "value")


@query("publish_counts", "logs", """SELECT topic, error, count(*) AS records FROM (SELECT topic, CASE
    WHEN value IS NULL THEN 'empty' WHEN octet_length(encode(value)) > 150 THEN 'too large' END AS error FROM logs) GROUP BY ALL""")
def publish_counts(t: Tables):
    """Sent and failed records by topic and error; a producer that takes up to 150 bytes and no empty values."""
    error = F.when(F.col("value").isNull(), "empty").when(F.octet_length("value") > 150, "too large")
    return sinks.publish_counts(t.all_logs(), error)


@query("dedup_publish", "logs", """SELECT topic, key, p AS "partition", o AS "offset", value FROM (
  SELECT *, row_number() OVER (PARTITION BY topic, key ORDER BY ts, p, o) AS nth FROM logs) WHERE nth = 1 OR key IS NULL""")
def dedup_publish(t: Tables):
    """The key stands for the correlation id: retried sends leave their first record, and records without
    an id all stay."""
    return sinks.deduplicated(t.all_logs(), F.col("key")).select("topic", "key", "partition", "offset", "value")


# ---- lag --------------------------------------------------------------------------------------

_LAGS = "SELECT grp, topic, p, day, greatest(end_offset - committed, 0) AS lag FROM offsets"


def _lags(t: Tables):
    offsets = t.offsets()
    ends = offsets.select("topic", "partition", "ts", "end_offset").distinct()
    return lag.consumer_lag(offsets.drop("end_offset"), ends, ("topic", "partition", "ts"))


@query("consumer_lag", "offsets", f"""SELECT grp AS "group", topic, p AS "partition", epoch_us(day) // 1000 AS ts_ms, lag
  FROM ({_LAGS})""")
def consumer_lag(t: Tables):
    return _lags(t).select("group", "topic", "partition", F.unix_millis("ts").alias("ts_ms"), "lag")


_LATEST = f"""SELECT * FROM ({_LAGS}) QUALIFY row_number() OVER (PARTITION BY grp, topic, p ORDER BY day DESC) = 1"""
_LAG_SUMS = """count(*) AS partitions, CAST(sum(lag) AS BIGINT) AS total_lag, max(lag) AS max_lag,
  CAST(sum(lag) // count(*) AS BIGINT) AS average_lag, count(*) FILTER (lag > 5) AS above_warning,
  count(*) FILTER (lag > 20) AS above_critical"""


@query("lag_summary", "offsets", f"""SELECT grp AS "group", false AS overall, {_LAG_SUMS} FROM ({_LATEST}) GROUP BY grp
  UNION ALL SELECT NULL, true, {_LAG_SUMS} FROM ({_LATEST})""")
def lag_summary(t: Tables):
    """Of the last snapshot; bounds of 5 and 20 fit the small lags of the tables."""
    return lag.lag_summary(lag.snapshot_lag(lag.latest(t.offsets())), 5, 20)


@query("lag_alerts", "offsets", f"""SELECT grp AS "group", p AS "partition", epoch_us(day) // 1000 AS ts_ms, lag,
  CASE WHEN lag > 20 THEN 'CRITICAL' ELSE 'WARNING' END AS level FROM ({_LAGS}) WHERE lag > 5""")
def lag_alerts(t: Tables):
    alerts = lag.lag_alerts(lag.snapshot_lag(t.offsets()), 5, 20)
    return alerts.select("group", "partition", F.unix_millis("ts").alias("ts_ms"), "lag", "level")


@query("lag_trend", "offsets", f"""SELECT grp AS "group", p AS "partition", epoch_us(day) // 1000 AS ts_ms,
  CASE WHEN before IS NULL THEN 'NEW' WHEN lag > before THEN 'INCREASING' WHEN lag < before THEN 'DECREASING'
    ELSE 'STABLE' END AS trend
  FROM (SELECT *, lag(lag) OVER (PARTITION BY grp, topic, p ORDER BY day) AS before FROM ({_LAGS}))""")
def lag_trend(t: Tables):
    return lag.lag_trend(lag.snapshot_lag(t.offsets())).select(
        "group", "partition", F.unix_millis("ts").alias("ts_ms"), "trend")


# ---- balance and membership -----------------------------------------------------------------

@query("skew", "logs", """WITH c AS (SELECT topic, p, count(*) AS n FROM (SELECT topic, o % 5 AS p FROM logs
    UNION ALL SELECT topic, 0 FROM logs WHERE o % 3 = 0) GROUP BY ALL)
  SELECT topic, false AS overall, round(max(n) / (sum(n) / count(*)), 9) AS skew, count(*) AS partitions,
    CAST(sum(n) AS BIGINT) AS records FROM c GROUP BY topic
  UNION ALL SELECT NULL, true, round(max(n) / (sum(n) / count(*)), 9), count(*), CAST(sum(n) AS BIGINT) FROM c"""
       .replace("WITH c AS", ", c AS", 1))
def skew(t: Tables):
    """Five partitions by offset, the first one fuller than the rest."""
    log = t.all_logs().select("topic", (F.col("offset") % 5).alias("partition"), "offset")
    more = log.filter("offset % 3 = 0").withColumn("partition", F.lit(0).cast("bigint"))
    return monitor.partition_skew(log.unionByName(more)).withColumn("skew", F.round("skew", 9))


@query("hot_partitions", "logs", """SELECT topic, p AS "partition", epoch_us(date_trunc('second', ts)) // 1000 AS second_ms,
  count(*) AS records FROM logs GROUP BY ALL HAVING count(*) > 4""")
def hot_partitions(t: Tables):
    """More than four records a second: the logs of the tables are thin."""
    return monitor.hot_partitions(t.all_logs(), 4).select(
        "topic", "partition", F.unix_millis("second").alias("second_ms"), "records")


_REBALANCES = """SELECT grp, day, count(*) AS members_changed FROM (
    SELECT grp, day, consumer_id FROM (
      SELECT m.grp, m.day, m.consumer_id FROM members m JOIN s ON s.grp = m.grp AND s.day = m.day WHERE s.prev IS NOT NULL
      UNION ALL SELECT m.grp, s.day, m.consumer_id FROM members m JOIN s ON s.grp = m.grp AND s.prev = m.day)
    GROUP BY ALL HAVING count(*) = 1) GROUP BY ALL"""
_SNAPS = ", s AS (SELECT grp, day, lag(day) OVER (PARTITION BY grp ORDER BY day) AS prev FROM (SELECT DISTINCT grp, day FROM members))"


@query("rebalance_events", "members", f"""{_SNAPS} SELECT grp AS "group", epoch_us(day) // 1000 AS ts_ms, members_changed
  FROM ({_REBALANCES})""")
def rebalance_events(t: Tables):
    return monitor.rebalance_events(t.members()).select(
        "group", F.unix_millis("ts").alias("ts_ms"), "members_changed")


_WATCH_AT = "2024-01-30 00:03:00"


@query("rebalance_frequency", "members", f"""{_SNAPS} SELECT count(*) AS rebalanced_groups,
  least(1.0, count(*) FILTER (last > TIMESTAMP '{_WATCH_AT}' - INTERVAL 1 HOUR) / 10) AS frequency,
  count(*) FILTER (last > TIMESTAMP '{_WATCH_AT}' - INTERVAL 5 MINUTE) > 3 AS too_often
  FROM (SELECT grp, max(day) AS last FROM ({_REBALANCES}) GROUP BY grp)""")
def rebalance_frequency(t: Tables):
    return monitor.rebalance_frequency(monitor.rebalance_events(t.members()), _WATCH_AT)


def _stats_sql(by_group: bool) -> str:
    group = "grp," if by_group else ""
    total = "CAST(coalesce(sum(rebalances), 0) AS BIGINT)" if by_group else "count(last)"
    return f"""SELECT *, utilization * 0.7::DOUBLE + (1.0::DOUBLE - frequency) * 0.3::DOUBLE AS efficiency
  FROM (SELECT *, greatest(0.0::DOUBLE, 1.0::DOUBLE - (skew - 1.0::DOUBLE)) AS utilization
   FROM (SELECT {group} max(partitions) / (sum(partitions) / count(partitions)) AS skew,
    count(consumer_id) AS active_consumers, CAST(sum(partitions) AS BIGINT) AS monitored_partitions,
    {total} AS total_rebalances,
    least(1.0::DOUBLE, count(*) FILTER (last > TIMESTAMP '{_WATCH_AT}' - INTERVAL 1 HOUR) / 10) AS frequency
   FROM (SELECT grp, consumer_id, partitions, NULL AS last, NULL AS rebalances FROM members
          WHERE (grp, day) IN (SELECT grp, max(day) FROM members GROUP BY grp)
     UNION ALL SELECT grp, NULL, NULL, max(day), count(*) FROM ({_REBALANCES}) GROUP BY grp)
   {'GROUP BY grp' if by_group else ''}))"""


def _stats(t: Tables, by_group: bool = True):
    members = t.members()
    return monitor.monitor_stats(members, monitor.rebalance_events(members), _WATCH_AT, by_group)


@query("monitor_stats", "members", f"""{_SNAPS} SELECT round(skew, 9) AS skew, round(utilization, 9) AS utilization,
  round(efficiency, 9) AS efficiency, active_consumers, monitored_partitions, total_rebalances FROM ({_stats_sql(False)})""")
def monitor_stats(t: Tables):
    return _rounded(_stats(t, False)).drop("rebalance_frequency")


def _rounded(df):
    for c in ("skew", "utilization", "efficiency"):
        df = df.withColumn(c, F.round(c, 9))
    return df


@query("utilization", "members",
       f"""{_SNAPS} SELECT grp AS "group", round(skew, 9) AS skew, round(utilization, 9) AS utilization FROM ({_stats_sql(True)})""")
def utilization(t: Tables):
    return _rounded(_stats(t)).select("group", "skew", "utilization")


@query("efficiency", "members",
       f"""{_SNAPS} SELECT grp AS "group", frequency AS rebalance_frequency, round(efficiency, 9) AS efficiency
  FROM ({_stats_sql(True)})""")
def efficiency(t: Tables):
    return _rounded(_stats(t)).select("group", "rebalance_frequency", "efficiency")


@query("partition_health", "members", f"""{_SNAPS} SELECT grp AS "group",
  CASE WHEN skew > 3 OR utilization < 0.4 OR efficiency < 0.5 THEN 'UNHEALTHY'
    WHEN skew > 2 OR utilization < 0.6 OR efficiency < 0.7 THEN 'DEGRADED' ELSE 'HEALTHY' END AS health,
  CASE WHEN skew <= 2 THEN 'HEALTHY' ELSE 'UNHEALTHY' END AS distribution,
  CASE WHEN utilization > 0.6 THEN 'HEALTHY' ELSE 'DEGRADED' END AS utilization_state,
  CASE WHEN efficiency > 0.7 THEN 'HEALTHY' ELSE 'DEGRADED' END AS efficiency_state FROM ({_stats_sql(True)})""")
def partition_health(t: Tables):
    return monitor.partition_health(_stats(t)).select(
        "group", "health", "distribution", "utilization_state", "efficiency_state")


@query("partition_recommendations", "members", f"""{_SNAPS} SELECT "group", a.kind AS type, a.severity, a.title,
    a.description, a.recommendation, a.goal, a.wanted, round(a.now, 9) AS current FROM (
  SELECT grp AS "group", unnest(list_filter([
    CASE WHEN skew > 2 THEN {{'kind': 'PARTITION_DISTRIBUTION', 'severity': 'HIGH', 'title': 'High Partition Skew Detected',
      'description': 'Partition distribution is uneven across consumers',
      'recommendation': 'Consider using LOAD_BALANCED assignment strategy or rebalancing consumer group',
      'goal': 'idealSkew', 'wanted': '< 1.5', 'now': CAST(skew AS DOUBLE)}} END,
    CASE WHEN utilization < 0.6 THEN {{'kind': 'CONSUMER_UTILIZATION', 'severity': 'MEDIUM',
      'title': 'Low Consumer Utilization', 'description': 'Consumers are not effectively utilizing available resources',
      'recommendation': 'Optimize partition assignment or consider reducing consumer count',
      'goal': 'targetUtilization', 'wanted': '> 0.8', 'now': CAST(utilization AS DOUBLE)}} END,
    CASE WHEN efficiency < 0.7 THEN {{'kind': 'ASSIGNMENT_EFFICIENCY', 'severity': 'MEDIUM',
      'title': 'Suboptimal Assignment Efficiency',
      'description': 'Partition assignment strategy is not optimal for current workload',
      'recommendation': 'Consider switching to WORKLOAD_AWARE or AFFINITY_BASED assignment strategy',
      'goal': 'targetEfficiency', 'wanted': '> 0.8', 'now': CAST(efficiency AS DOUBLE)}} END,
    CASE WHEN total_rebalances > 10 THEN {{'kind': 'REBALANCING_FREQUENCY', 'severity': 'HIGH',
      'title': 'Frequent Rebalancing Detected', 'description': 'Consumer group is rebalancing too frequently',
      'recommendation': 'Increase session timeout, enable sticky assignment, or investigate consumer stability',
      'goal': 'recommendedFrequency', 'wanted': '< 5 per hour', 'now': CAST(total_rebalances AS DOUBLE)}} END],
    lambda x: x IS NOT NULL)) AS a FROM ({_stats_sql(True)}))""")
def partition_recommendations(t: Tables):
    """The metrics map as two columns: the goal with its text, and the present value."""
    names = F.map_keys("metrics")
    return monitor.partition_recommendations(_stats(t)).select(
        "group", "type", "severity", "title", "description", "recommendation", F.get(names, F.lit(1)).alias("goal"),
        F.element_at("metrics", F.get(names, F.lit(1))).alias("wanted"),
        F.round(F.element_at("metrics", F.get(names, F.lit(0))).cast("double"), 9).alias("current"))


@query("optimization_plan", "members", f"""{_SNAPS} SELECT "group", a.action, a.goal, round(a.now, 9) AS current FROM (
  SELECT grp AS "group", unnest(list_filter([
    CASE WHEN skew > 2 THEN {{'action': 'REBALANCE_PARTITIONS', 'goal': '1.5', 'now': skew}} END,
    CASE WHEN utilization < 0.6 THEN {{'action': 'OPTIMIZE_CONSUMER_ASSIGNMENT', 'goal': '0.8', 'now': utilization}} END,
    CASE WHEN efficiency < 0.7 THEN {{'action': 'CHANGE_ASSIGNMENT_STRATEGY', 'goal': 'WORKLOAD_AWARE', 'now': efficiency}} END],
    lambda x: x IS NOT NULL)) AS a FROM ({_stats_sql(True)}))""")
def optimization_plan(t: Tables):
    return monitor.optimization_plan(_stats(t)).select("group", "action", "goal", F.round("current", 9).alias("current"))


@query("partition_detail", "members", f"""{_SNAPS} SELECT grp AS "group",
  CASE WHEN skew > 2 THEN 'WARNING' ELSE 'OK' END AS skew_status,
  CASE WHEN utilization > 0.8 THEN 'GOOD' ELSE 'NEEDS_IMPROVEMENT' END AS utilization_status,
  CASE WHEN efficiency > 0.8 THEN 'EXCELLENT' WHEN efficiency > 0.6 THEN 'GOOD' ELSE 'NEEDS_IMPROVEMENT' END AS efficiency_status,
  round(monitored_partitions / active_consumers, 9) AS partitions_per_consumer FROM ({_stats_sql(True)})""")
def partition_detail(t: Tables):
    return monitor.partition_detail(_stats(t)).select(
        "group", "skew_status", "utilization_status", "efficiency_status",
        F.round("partitions_per_consumer", 9).alias("partitions_per_consumer"))


@query("capacity_plan", "logs", """SELECT topic, rate, mean_size,
  CAST(greatest(16384, mean_size * least(100, greatest(10, 1000 // rate))) AS BIGINT) AS batch_size,
  greatest(67108864, rate * mean_size * 2) AS buffer_memory, greatest(1024, least(1048576, rate * 50)) AS fetch_min_bytes,
  greatest(1, least(12, rate // 1000)) AS concurrency, least(48, greatest(greatest(1, rate // 10000), 3)) AS partitions
  FROM (SELECT topic, count(*) * 100000 * 1000 // (epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000) AS rate,
    CAST(sum(coalesce(strlen(key), 0) + coalesce(strlen(value), 0) + 30 + CASE WHEN topic = 'notifications-topic' THEN 0
      WHEN k % 11 = 0 THEN 36 ELSE 17 END) // count(*) AS BIGINT) AS mean_size FROM logs GROUP BY topic)""")
def capacity_plan(t: Tables):
    """For a hundred thousand times the present rate."""
    plan = monitor.capacity_plan(t.all_logs(), growth=100_000)
    return plan.select("topic", "rate", "mean_size", "batch_size", "buffer_memory", "fetch_min_bytes",
                       "concurrency", "partitions")


# ---- metric series ---------------------------------------------------------------------------

_BLOCKS = """SELECT stage, r // 10 AS block, min_by(value, r) AS first_value, max_by(value, r) AS last_value,
    (max_by(value, r) - min_by(value, r)) / nullif(min_by(value, r), 0) AS trend
  FROM (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY ts, seq) - 1 AS r FROM metrics)
  GROUP BY ALL HAVING count(*) = 10"""


@query("metric_trend", "metrics", f"""SELECT stage, block, round(trend, 9) AS trend,
  coalesce(trend > 0.05, false) AS leak_warning FROM ({_BLOCKS})""")
def metric_trend(t: Tables):
    return series.metric_trend(t.metrics(), "stage").select(
        "stage", "block", F.round("trend", 9).alias("trend"), "leak_warning")


@query("metric_severity", "metrics", f"""SELECT stage, block,
  CASE WHEN last_value > 0.85 THEN 1.0::DOUBLE WHEN last_value > 0.7 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS pressure,
  CASE WHEN last_value > 0.85 OR coalesce(trend > 0.05, false) THEN 'CRITICAL' WHEN last_value > 0.7 THEN 'WARNING'
    ELSE 'OK' END AS severity, last_value > 0.85 OR coalesce(trend > 0.05, false) AS requires_action FROM ({_BLOCKS})""")
def metric_severity(t: Tables):
    rows = series.metric_severity(series.metric_trend(t.metrics(), "stage"))
    return rows.select("stage", "block", "pressure", "severity", "requires_action")


def _sql_list(lines: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in lines) + "]"


@query("metric_recommendations", "metrics", f"""SELECT stage, recommendation, count(*) AS blocks FROM (
  SELECT stage, unnest(list_concat(list_concat(
    CASE WHEN last_value > 0.85 THEN {_sql_list(series.CRITICAL_ADVICE)} WHEN last_value > 0.7
      THEN {_sql_list(series.WARNING_ADVICE)} ELSE [] END,
    CASE WHEN trend > 0.03 THEN {_sql_list(series.TREND_ADVICE)} ELSE [] END),
    CASE WHEN last_value > 0.85 THEN {_sql_list(series.PRESSURE_ADVICE)} ELSE [] END)) AS recommendation
  FROM ({_BLOCKS})) GROUP BY ALL""")
def metric_recommendations(t: Tables):
    rows = series.metric_recommendations(series.metric_trend(t.metrics(), "stage"))
    return rows.groupBy("stage", "recommendation").agg(F.count(F.lit(1)).alias("blocks"))


@query("throughput_series", "notifications_log", """SELECT topic, 'tumbling' AS kind,
    epoch_us(date_trunc('minute', ts)) // 1000 AS start_ms, count(*) AS records FROM notifications_log GROUP BY ALL
  UNION ALL SELECT topic, 'sliding', epoch_us(m - to_minutes(back)) // 1000, count(*) FROM (
    SELECT topic, date_trunc('minute', ts) AS m, unnest(range(0, 5)) AS back FROM notifications_log) GROUP BY ALL""")
def throughput_series(t: Tables):
    log = t.notifications_log()
    out = lambda df, kind: df.select(
        "topic", F.lit(kind).alias("kind"), F.unix_millis("start").alias("start_ms"), "records")
    return out(series.throughput_series(log, "topic"), "tumbling").unionByName(
        out(series.sliding_throughput(log, "topic"), "sliding"))


def _runs(breach: str, source: str, seconds: int) -> str:
    return f"""SELECT stage, epoch_us(min(step)) // 1000 AS since_ms, epoch_us(max(step)) // 1000 AS until_ms, count(*) AS steps
    FROM (SELECT *, sum(ch) OVER (PARTITION BY stage ORDER BY step) AS run FROM (SELECT *,
        CASE WHEN bad = lag(bad) OVER (PARTITION BY stage ORDER BY step)
          AND step - lag(step) OVER (PARTITION BY stage ORDER BY step) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS ch
      FROM (SELECT stage, step, coalesce({breach}, false) AS bad FROM ({source})))) WHERE bad
    GROUP BY stage, run HAVING epoch_us(max(step)) - epoch_us(min(step)) >= CAST({seconds} AS BIGINT) * 1000000"""


_STEPS = """SELECT stage, date_trunc('hour', ts) AS step, count(*) AS n, sum(CAST(value * 50 AS DECIMAL(18,2))) AS total
  FROM metrics GROUP BY ALL"""


# every hour between the first and the last of a stage
_ALL_STEPS = f"""SELECT stage, step, coalesce(n, 0) AS n, total FROM (
  SELECT stage, unnest(generate_series(min(step), max(step), INTERVAL 1 HOUR)) AS step FROM ({_STEPS}) GROUP BY stage)
  LEFT JOIN ({_STEPS}) USING (stage, step)"""


@query("alert_for", "metrics", f"""SELECT 'high_mean' AS rule, * FROM ({_runs('total / n > 25', _STEPS, 7200)})
  UNION ALL SELECT 'high_rate', * FROM ({_runs('r > 12', f'''SELECT *, sum(n) OVER (PARTITION BY stage ORDER BY step
    RANGE BETWEEN INTERVAL 4 HOUR PRECEDING AND CURRENT ROW) AS r FROM ({_ALL_STEPS})''', 7200)})
  UNION ALL SELECT 'rising', * FROM ({_runs('total / n - f > 10', f'''SELECT *, first(total / n) OVER (PARTITION BY stage ORDER BY step
    RANGE BETWEEN INTERVAL 5 HOUR PRECEDING AND CURRENT ROW) AS f FROM ({_STEPS})''', 3600)})""")
def alert_for(t: Tables):
    """Three kinds of rule at hourly steps: mean above 25, more than 12 events in five
    hours (which has a value at hours without events too), mean more than 10 above that of five hours
    before."""
    exact = (F.col("value") * 50).cast("decimal(18,2)")
    steps = series.steps(t.metrics().withColumn("value", exact), "stage", "1 hour").withColumn(
        "total", F.col("total").cast("double"))
    rated = series.rate_over(series.with_all_steps(steps, "stage", "1 hour"), "stage", 5 * 3600, 3600)
    rising = series.rise_over(steps, "stage", 5 * 3600)
    found = [
        ("high_mean", series.alert_for(steps, "stage", F.col("total") / F.col("n") > 25, "2 hours", "1 hour")),
        ("high_rate", series.alert_for(rated, "stage", F.round(F.col("rate") * (5 * 3600)) > 12, "2 hours", "1 hour")),
        ("rising", series.alert_for(rising, "stage", F.col("rise") > 10, "1 hour", "1 hour")),
    ]
    rows = [df.select(F.lit(rule).alias("rule"), "stage", F.unix_millis("since").alias("since_ms"),
                      F.unix_millis("until").alias("until_ms"), "steps") for rule, df in found]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


# The documented bounds for dead letters and for failed against sent. The data are thin, so a
# step is a day here and the span of the first three days.
DEAD_LETTERS, FAILED_SHARE = 1000, 0.05

_DAYS = """SELECT stage, date_trunc('day', ts) AS step, count(*) AS n FROM metrics GROUP BY ALL"""
_EVERY_DAY = f"""SELECT stage, step, coalesce(n, 0) AS n FROM (
  SELECT stage, unnest(generate_series(min(step), max(step), INTERVAL 1 DAY)) AS step FROM ({_DAYS}) GROUP BY stage)
  LEFT JOIN ({_DAYS}) USING (stage, step)"""


@query("alert_rules", "metrics", f"""SELECT 'failed_share' AS rule, 'all' AS series, epoch_us(step) // 1000 AS at_ms,
    e * 1.0 / n AS value FROM (SELECT date_trunc('day', ts) AS step, count(*) AS n, count(*) FILTER (stage = 'error') AS e
    FROM metrics GROUP BY ALL) WHERE e * 1.0 / n > 0.05
  UNION ALL SELECT 'increase', stage, epoch_us(step) // 1000, r FROM (SELECT *, sum(n) OVER (PARTITION BY stage ORDER BY step
    RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND CURRENT ROW) AS r FROM ({_EVERY_DAY})) WHERE r > 1000""")
def alert_rules(t: Tables):
    """The share of errors among all events of a day above 0.05, and more than 1000 events of a kind within
    three days; each step that breaks a rule, with its value."""
    metrics = t.metrics()
    steps = series.steps(metrics, "stage", "1 day")
    whole = series.steps(metrics.withColumn("stage", F.lit("all")), "stage", "1 day")
    errors = steps.filter("stage = 'error'").withColumn("stage", F.lit("all"))
    failed = series.ratio_of(errors, whole, "stage").filter(F.col("ratio") > FAILED_SHARE).select(
        F.lit("failed_share").alias("rule"), F.col("stage").alias("series"), F.unix_millis("step").alias("at_ms"),
        F.col("ratio").alias("value"))
    every = series.with_all_steps(steps, "stage", "1 day")
    grown = series.increase_over(every, "stage", 3 * 86_400, 86_400).filter(F.col("increase") > DEAD_LETTERS).select(
        F.lit("increase").alias("rule"), F.col("stage").alias("series"), F.unix_millis("step").alias("at_ms"),
        F.col("increase").cast("double").alias("value"))
    return failed.unionByName(grown)


def _islands(bad: str, hold: str, step: str) -> str:
    return f"""SELECT rule, series, epoch_us(min(step)) // 1000 AS since_ms, epoch_us(max(step)) // 1000 AS until_ms, count(*) AS steps
      FROM (SELECT *, step - INTERVAL 1 {step} * row_number() OVER (PARTITION BY rule, series ORDER BY step) AS run FROM ({bad}))
      GROUP BY rule, series, run HAVING max(step) - min(step) >= INTERVAL {hold}"""


_HOURS = """SELECT topic AS series, date_trunc('hour', ts) AS step, count(*) FILTER (size > 125) / count(*) AS share, avg(size) AS mean
  FROM (SELECT topic, ts, coalesce(octet_length(encode(value)), 0) AS size FROM logs) GROUP BY ALL"""


@query("alert_holds", "logs offsets", f"""{_islands(f"SELECT 'oversized_share' AS rule, * FROM ({_HOURS}) WHERE share > 0.1", "3 HOUR", "HOUR")}
  UNION ALL {_islands(f"SELECT 'mean_size' AS rule, * FROM ({_HOURS}) WHERE mean > 80", "2 HOUR", "HOUR")}
  UNION ALL {_islands(f"SELECT 'lag' AS rule, * FROM (SELECT grp AS series, day AS step, max(lag) AS worst FROM ({_LAGS}) GROUP BY ALL) WHERE worst > 5",
                      "2 DAY", "DAY")}""")
def alert_holds(t: Tables):
    """Documented alerts that hold for a time, with bounds and holds that fit the small records and lags of the tables."""
    sized = t.all_logs().select("topic", "timestamp", F.coalesce(F.octet_length("value"), F.lit(0)).alias("size"))
    steps = series.size_steps(sized, "topic", "timestamp", "size", "1 hour", 125)
    found = series.size_alerts(steps, "topic", "1 hour", 0.1, "3 hours", 80, "2 hours").unionByName(
        series.lag_alerts_for(lag.snapshot_lag(t.offsets()), "1 day", 5, "2 days"))
    return found.select("rule", "series", F.unix_millis("since").alias("since_ms"), F.unix_millis("until").alias("until_ms"), "steps")
