"""Queries of the record -> partition family, over six target partitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.operators import partitioners as parts
from tidelog.plans.registry import query
from tidelog.sources.derive import Tables

N = 6
GEO_N = 10  # two partitions for each of the four regions, two left over
LOADS = [5, 0, 3, 1200, 2, 0]
_ID = 'p AS "partition", o AS "offset"'
_COLUMNS = ["partition", "offset", parts.TARGET]
_ARRIVAL = "ORDER BY ts, topic, p, o"


def signed_hash(text: str) -> str:
    """SQL of the 31-multiplier string hash as a signed 32-bit value (BMP text)."""
    units = f"list_transform(string_split({text}, ''), lambda c: CAST(ord(c) AS UBIGINT))"
    folded = (f"list_reduce(list_prepend(CAST(0 AS UBIGINT), {units}), "
              "lambda a, u: (a * 31 + u) % 4294967296)")
    signed = f"CAST(({folded} + 2147483648) % 4294967296 AS BIGINT) - 2147483648"
    return f"(CASE WHEN {text} IS NOT NULL THEN {signed} END)"


def murmur(text: str) -> str:
    """SQL of murmur2 & 0x7fffffff over the UTF-8 bytes."""
    h, w, m = f"hex(encode({text}))", "4294967296", "1540483477"

    def byte(at: str) -> str:
        return f"CAST('0x' || substr({h}, CAST(({at}) * 2 + 1 AS BIGINT), 2) AS UBIGINT)"

    n = f"strlen({text})"
    words = (f"list_transform(range(0, {n} // 4), lambda i: {byte('i * 4')} + 256 * "
             f"{byte('i * 4 + 1')} + 65536 * {byte('i * 4 + 2')} + 16777216 * {byte('i * 4 + 3')})")
    mixed = f"list_transform({words}, lambda k: (k * {m}) % {w})"
    mixed = f"list_transform({mixed}, lambda k: (xor(k, k >> 24) * {m}) % {w})"
    seed = f"xor(CAST(2538058380 AS UBIGINT), CAST({n} AS UBIGINT))"
    body = f"list_reduce(list_prepend({seed}, {mixed}), lambda a, k: xor((a * {m}) % {w}, k))"
    tail = " + ".join(
        f"(CASE WHEN {n} % 4 > {j} THEN {byte(f'{n} - {n} % 4 + {j}')} * {256**j} ELSE 0 END)"
        for j in range(3))
    end = (f"(SELECT xor(y, y >> 15) & 2147483647 FROM (SELECT (xor(x, x >> 13) * {m}) % {w} AS y "
           f"FROM (SELECT CASE WHEN {n} % 4 > 0 THEN (xor({body}, CAST({tail} AS UBIGINT)) * {m}) % {w} "
           f"ELSE {body} END AS x)))")
    return end


def _with_fallback(direct: str, source: str = "orders_log", n: int = N) -> str:
    return f"""SELECT {_ID}, CAST(coalesce(direct, {murmur('key')} % {n},
      turn % {n}) AS INTEGER) AS target_partition
      FROM (SELECT *, row_number() OVER (PARTITION BY direct IS NULL AND key IS NULL {_ARRIVAL}) - 1
              AS turn
            FROM (SELECT *, {direct} AS direct FROM {source}))"""


@query("part_round_robin", "orders_log", f"""SELECT {_ID},
  CAST((row_number() OVER ({_ARRIVAL}) - 1) % {N} AS INTEGER) AS target_partition FROM orders_log""")
def part_round_robin(t: Tables):
    return parts.part_round_robin(t.orders_log(), N).select(_COLUMNS)


@query("part_hash", "orders_log", _with_fallback("CAST(NULL AS BIGINT)"))
def part_hash(t: Tables):
    return parts.part_hash(t.orders_log(), N).select(_COLUMNS)


@query("part_sticky", "orders_log", f"""SELECT {_ID}, CAST(newcomer % 2 AS INTEGER) AS target_partition
  FROM orders_log l JOIN (SELECT producer, row_number() OVER (ORDER BY first) - 1 AS newcomer
    FROM (SELECT coalesce(key, 'none') AS producer, min((ts, p, o)) AS first
          FROM orders_log GROUP BY ALL)) n ON coalesce(l.key, 'none') = n.producer""")
def part_sticky(t: Tables):
    producer = F.coalesce("key", F.lit("none"))
    return parts.part_sticky(t.orders_log(), N, producer, sticky=2).select(_COLUMNS)


_CUSTOMER = """CASE WHEN starts_with(key, 'customer-') OR starts_with(key, 'CUSTOMER-') THEN key
  WHEN starts_with(trim(value), '{') THEN json_extract_string(value, '$.customerId') END"""


@query("part_customer", "orders_log", _with_fallback(
    f"abs(xor({signed_hash('customer')}, CAST(12345 AS BIGINT))) % {N}",
    f"(SELECT *, {_CUSTOMER} AS customer FROM orders_log)"))
def part_customer(t: Tables):
    return parts.part_customer(t.orders_log(), N).select(_COLUMNS)


_HASH = f"abs(coalesce({signed_hash('key')}, 0))"


@query("part_geo", "orders_region_log", _with_fallback(
    f"""CASE WHEN starts_with(trim(value), '{{') AND list_contains(['us-east','us-west','eu','asia'], reg)
      THEN least((list_position(['us-east','us-west','eu','asia'], reg) - 1) * 2 + {_HASH} % 2, {GEO_N - 1}) END""",
    "orders_region_log", GEO_N))
def part_geo(t: Tables):
    return parts.part_geo(t.orders_log(region=True), GEO_N).select(_COLUMNS)


@query("part_priority", "orders_log", _with_fallback(
    f"""CASE WHEN contains(coalesce(value, ''), '"priority":"HIGH"')
      OR contains(coalesce(value, ''), '"priority":"CRITICAL"') THEN {_HASH} % 3
      ELSE 3 + {_HASH} % 3 END"""))
def part_priority(t: Tables):
    return parts.part_priority(t.orders_log(), N, ratio=0.5).select(_COLUMNS)


@query("part_time", "logs", f"""SELECT topic, {_ID},
  CAST(((epoch_us(ts) // 1000) // 60000) % {N} AS INTEGER) AS target_partition FROM logs""")
def part_time(t: Tables):
    return parts.part_time(t.all_logs(), N).select("topic", *_COLUMNS)


# orders have LOADS, payments the same in reverse order, notifications none
_TOPIC_LOADS = f"""(SELECT unnest(['orders-topic', 'payments-topic', 'notifications-topic']) AS topic,
  unnest([{LOADS}, list_reverse({LOADS}), [0 FOR x IN {LOADS}]]) AS loads)"""
_SLOTS = f"""(SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY level, q) - 1 AS slot, q FROM (
  SELECT topic, q, unnest(range(load, 1001)) AS level
  FROM (SELECT topic, unnest(range(0, {N})) AS q, unnest(loads) AS load FROM {_TOPIC_LOADS})))"""


@query("part_load_aware", "logs", f"""SELECT topic, {_ID}, CAST(coalesce(q, (i - filled) % {N}) AS INTEGER) AS target_partition
  FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY ts, p, o) - 1 AS i FROM logs)
  JOIN (SELECT topic, count(*) AS filled FROM {_SLOTS} GROUP BY topic) USING (topic)
  LEFT JOIN (SELECT topic, slot AS i, q FROM {_SLOTS}) USING (topic, i)""")
def part_load_aware(t: Tables):
    log = t.all_logs()
    loads = [("orders-topic", p, x) for p, x in enumerate(LOADS)] + [
        ("payments-topic", p, x) for p, x in enumerate(reversed(LOADS))]
    given = log.sparkSession.createDataFrame(loads, "topic string, partition int, load int")
    return parts.part_load_aware(log, N, given).select("topic", *_COLUMNS)


@query("part_distribution", "logs", """SELECT topic, p AS "partition", count(*) AS records,
  CAST(sum(count(*)) OVER (PARTITION BY topic) AS BIGINT) AS total_records,
  count(*) OVER (PARTITION BY topic) AS partitions_used FROM logs GROUP BY topic, p""")
def part_distribution(t: Tables):
    return parts.part_distribution(t.all_logs(), "partition")
