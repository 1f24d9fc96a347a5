"""Operators on literal rows: known sizes, hashes, outcomes and the odd rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidelog import schema
from tidelog.functions.hashing import murmur2, string_hash
from tidelog.functions.headers import header_map, last_header
from tidelog.functions.text import trim_low, utf16_length, utf16_prefix
from tidelog.operators import (allocate, deadletter, enrich, errors, filters, lag, monitor, partitioners, process,
                               replay, series, sizes, tracking)

NOW = dt.datetime(2024, 1, 31)


def log(spark, *rows):
    """Rows of (topic, key, value[, headers])."""
    full = [(r[0], 0, i, r[1], r[2], [(k, v.encode()) for k, v in (r[3] if len(r) > 3 else [])], NOW)
            for i, r in enumerate(rows)]
    return spark.createDataFrame(full, schema.LOG)


def column(df, expr):
    return [r[0] for r in df.orderBy("offset").select(expr).collect()]


def test_sizes(spark):
    df = log(spark, ("t", "test-key", "test-value"), ("t", None, "test-value"), ("t", "test-key", None),
             ("t", "test-key", "test-value", [("header1", "value1"), ("header2", "value2")]),
             ("t", None, "é"), ("t", None, "A" * 1048576))
    assert column(df, sizes.record_size()) == [48, 40, 38, 48 + 2 * 21, 32, 1048576 + 30]
    batch = sizes.batch_sizes(log(spark, ("t", None, "Hello"), ("t", None, "World"), ("t", None, "Kafka")))
    assert batch.first().batch_bytes == 15 + 90 + 50
    empty = sizes.size_summary(log(spark).limit(0)).first()
    assert (empty.messages, empty.average_size, empty.min_size, empty.average_batch_size) == (0, 0.0, 0, 0.0)


def test_format_size(spark):
    df = spark.createDataFrame([(500,), (1536,), (2097152,), (1073741824,)], "offset long")
    assert column(df, sizes.format_size(F.col("offset"))) == ["500 B", "1.5 KB", "2.0 MB", "1.0 GB"]


def test_large_values(spark):
    df = log(spark, ("t", None, "x" * 50), ("t", None, "x" * 5000), ("t", None, "x" * 200000), ("t", None, "x" * 1500000))
    size = sizes.record_size()
    assert column(df, sizes.size_category(size)) == ["SMALL", "MEDIUM", "LARGE", "OVERSIZED"]
    assert column(df, F.size(sizes.suggestions(size))) == [1, 0, 2, 3]
    chunks = sizes.split_chunks(df, F.col("offset"))
    assert chunks.filter("message_id = 3").count() == 23
    whole = chunks.filter("message_id = 2").orderBy("chunk").collect()
    assert b"".join(bytes(r.data) for r in whole) == b"x" * 200000
    advice = [r.recommendation for r in sizes.size_recommendations(sizes.size_summary(df)).collect()]
    assert advice == [sizes.MANY_OVERSIZED, sizes.LARGE_AVERAGE]


def test_generated_message_has_its_size(spark):
    rows = sizes.generate_messages(spark, 200, 30, "t").collect()
    assert {len(r.value) for r in rows} == {200} and rows[7].key == "test-key-7"
    assert sizes.generate_messages(spark, 1, 1, "t").first().value == '{"id":0,"timestamp":0,"data":""}'


def test_hashes(spark):
    keys = ["21", "foobar", "abc", "a-little-bit-long-string", "", None]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "offset long, key string")
    assert column(df, murmur2("key")) == [-973932308, -790332482, 479470107, -985981536, 275646681, None]

    def plain(text):
        units = text.encode("utf-16-be")
        h = 0
        for i in range(0, len(units), 2):
            h = (h * 31 + int.from_bytes(units[i:i + 2], "big")) % 2**32
        return h - 2**32 if h >= 2**31 else h

    texts = ["customer-123", "", "é", "日本語", "a😀b", "polygenelubricants"]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(texts)], "offset long, key string")
    assert column(df, string_hash(F.col("key"))) == [plain(x) for x in texts]
    assert plain("customer-123") == 899126211 and plain("polygenelubricants") == -2**31


def test_smallest_hash_gives_a_real_partition(spark):
    df = log(spark, ("t", "polygenelubricants", '{"priority":"HIGH"}'), ("t", "polygenelubricants", '{"region":"EU"}'))
    got = partitioners.part_priority(df, 7, 0.5).collect() + partitioners.part_geo(df, 12).collect()
    assert all(0 <= r.target_partition < 12 for r in got)


def test_text(spark):
    df = log(spark, ("t", None, "\t a b\n\x01"), ("t", None, "a😀b"))
    assert column(df, trim_low(F.col("value"))) == ["a b", "a😀b"]
    assert column(df, utf16_length(F.col("value"))) == [7, 4]


def test_headers_last_wins(spark):
    df = log(spark, ("t", None, "v", [("a", "1"), ("b", "2"), ("a", "3")]), ("t", None, "v"))
    assert column(df, last_header(F.col("headers"), "a")) == ["3", None]
    assert column(df, header_map(F.col("headers"))) == [{"a": "3", "b": "2"}, {}]


def test_filters(spark):
    df = log(spark, ("t", "k", '{"n":"LATEST"}'), ("t", "test-1", "{}"), ("t", None, None), ("t", "k", " \t"),
             ("t", "k", "{"), ("t", "k", " [1] "), ("payments-topic", "k", '{"amount":0.99}'),
             ("payments-topic", "k", '{"amount":0.00}'), ("orders-topic", "k", "x" * 1048577))
    assert column(df, filters.composite_reason(NOW)) == [
        "TEST", "TEST", "INVALID", "INVALID", "INVALID", None, "BUSINESS", "BUSINESS", "INVALID"]
    assert column(df, filters.business_reason(NOW, strict=True))[6:8] == [None, "ZERO_PAYMENT"]
    assert column(df, filters.invalid_reason())[2:5] == ["NULL_VALUE", "BLANK", "NOT_JSON"]
    assert column(df, filters.invalid_reason())[8] == "TOO_LARGE"
    assert filters.keep(df, filters.composite_reason(NOW)).count() == 1


def test_recoverable_filter_also_matches_its_opposite(spark):
    df = log(spark, ("d", None, "v", [("dlt.exception-class", "NonRecoverableException")]),
             ("d", None, "v", [("dlt.exception-class", "RecoverableException")]), ("d", None, "v"),
             ("d", None, "v", [("dlt.enhanced.timestamp", "no time")]))
    assert column(df, filters.dead_letter_match("recoverable")) == [True, True, False, False]
    assert column(df, filters.dead_letter_match("recoverable", strict=True)) == [False, True, False, False]
    assert column(df, filters.dead_letter_match("recent", NOW)) == [False] * 4
    assert column(df, filters.dead_letter_match(None)) == [True] * 4


def test_outcomes(spark):
    df = log(spark, ("orders-topic", None, "valid-order-message"), ("payments-topic", None, "valid-payment-message"),
             ("orders-topic", None, None), ("payments-topic", None, "   "), ("notifications-topic", None, ""),
             ("orders-topic", None, "RETRY_ERROR"), ("orders-topic", None, "x" * 10001))
    rows = process.outcome(df).orderBy("offset").collect()
    assert [(r.outcome, r.acked, r.failed) for r in rows] == [
        ("PROCESSED", True, False), ("PROCESSED", True, False), ("NON_RETRYABLE", True, False),
        ("NON_RETRYABLE", True, False), ("PROCESSED", True, False), ("RETRYABLE", False, True),
        ("NON_RETRYABLE", True, False)]


def test_processors_can_be_registered(spark):
    df = log(spark, ("orders-topic", None, "a"), ("x", None, "b"), ("mine", None, "c"), ("mine", None, " "))
    mine = {**process.PROCESSORS, "mine": process.Processor(F.upper, "MY_RULE", "nothing")}
    rows = process.process_by_topic(df, mine).orderBy("offset").collect()
    assert [r.result for r in rows] == ["PROCESSED_ORDER_a", "PROCESSED_b", "C", None]
    assert rows[3].error_rule == "MY_RULE"


def test_partition_strategies(spark):
    keys = log(spark, *[("t", f"key-{i}", "{}") for i in range(100)])
    spread = partitioners.part_by("ROUND_ROBIN", keys, 6).groupBy("target_partition").count().collect()
    assert sorted(r["count"] for r in spread) == [16, 16, 17, 17, 17, 17]
    same = log(spark, ("t", "consistent-key", "{}"), ("t", "consistent-key", "{}"), ("t", None, "{}"), ("t", None, "{}"))
    got = column(partitioners.part_by("no such strategy", same, 6), F.col("target_partition"))
    assert got[0] == got[1] and got[2:] == [0, 1]
    sticky = partitioners.part_sticky(keys, 6, F.lit("p"), sticky=2)
    assert sticky.select("target_partition").distinct().count() == 1
    customers = log(spark, ("t", None, '{"customerId":"CUSTOMER-123","amount":100.0}'),
                    ("t", None, '{"customerId":"CUSTOMER-123","amount":200.0}'))
    assert len(set(column(partitioners.part_customer(customers, 6), F.col("target_partition")))) == 1
    regions = log(spark, *[("t", "k", f'{{"region":"{r}"}}') for r in ("us-east", "US-EAST", "eu")])
    a, b, c = column(partitioners.part_geo(regions, 6), F.col("target_partition"))
    assert a == b != c
    both = log(spark, *[("t", f"key-{i}", f'{{"priority":"{p}"}}') for i in range(20) for p in ("HIGH", "NORMAL")])
    done = partitioners.part_priority(both, 6, 0.5).withColumn("high", F.col("value").contains("HIGH"))
    sides = {r.high: set(r.ps) for r in done.groupBy("high").agg(F.collect_set("target_partition").alias("ps")).collect()}
    assert not sides[True] & sides[False]
    with pytest.raises(ValueError):
        partitioners.part_hash(keys, 0)


def test_least_loaded_against_a_plain_loop(spark):
    loads, threshold = [3, 0, 9, 50, 2], 6
    df = log(spark, *[("t", None, "v")] * 60)
    now, turn, want = list(loads), 0, []
    for _ in range(60):
        best = min(range(5), key=lambda p: (now[p], p))
        if now[best] > threshold:
            best, turn = turn % 5, turn + 1
        now[best] += 1
        want.append(best)
    assert column(partitioners.part_load_aware(df, 5, loads, threshold), F.col("target_partition")) == want
    both = log(spark, *[("a", None, "v"), ("b", None, "v")] * 6)
    placed = partitioners.part_load_aware(both, 3).orderBy("topic", "offset").collect()
    assert [r.target_partition for r in placed] == [0, 1, 2, 0, 1, 2] * 2


def owners(spark, *rows):
    full = [("q", *r) for r in rows]
    return spark.createDataFrame(
        full, "queue string, owner string, rack string, priority string, capacity int, region string, "
        "capabilities array<string>, preferences array<string>")


def shares(allocation):
    return {r.owner: r["count"] for r in allocation.groupBy("owner").count().collect()}


def test_allocation(spark):
    units = spark.range(6).select(F.lit("q").alias("queue"), F.col("id").alias("unit"), F.lit("rack-1").alias("rack"),
                                  F.lit(None).cast("string").alias("previous_owner"))
    three = owners(spark, ("a", "rack-1", "HIGH", 3000, "us", [], []), ("b", "rack-2", "MEDIUM", 2000, "eu", [], []),
                   ("c", "rack-3", "LOW", 1000, "asia", [], []))
    assert shares(allocate.alloc_capacity(units, three)) == {"a": 3, "b": 2, "c": 1}
    assert shares(allocate.alloc_locality(units, three)) == {"a": 6}
    # a half of six, then 0.3 and 0.2 of what is left, at least one: one unit has no owner
    assert shares(allocate.alloc_priority(units, three)) == {"a": 3, "b": 1, "c": 1, None: 1}
    assert shares(allocate.alloc_region(units, three)) == {"a": 2, "b": 2, "c": 2}
    assert shares(allocate.alloc_sticky(units, three)) == {"a": 2, "b": 2, "c": 2}
    equal = owners(spark, *[(x, "r", "LOW", 100, "us", [], []) for x in "abcd"])
    got = shares(allocate.alloc_capacity(units, equal))
    assert sum(got.values()) == 6 and set(got) <= set("abcd")


def test_many_small_owners_and_a_big_one(spark):
    """Narrow buckets: the interval join against a plain loop."""
    units = spark.range(5000).select(F.lit("q").alias("queue"), F.col("id").alias("unit"))
    rows = [(f"o{i:03d}", "r", "LOW", 900 if i == 0 else 1 + i % 7, "us", [], []) for i in range(200)]
    got = {r.unit: r.owner for r in allocate.alloc_capacity(units, owners(spark, *rows)).collect()}
    order = sorted(rows, key=lambda r: (-r[3], r[0]))
    total, want = sum(r[3] for r in rows), {}
    for name, *_, capacity, _, _, _ in [(r[0], r[1], r[2], r[3], r[4], r[5], r[6]) for r in order]:
        for _ in range(min(int(capacity / total * 5000 + 0.5), 5000 - len(want))):
            want[len(want)] = name
    turn = 0
    while len(want) < 5000:
        want[len(want)] = order[turn % 200][0]
        turn += 1
    assert got == want


def test_original_topic_by_name_is_cut_too_early(spark):
    df = log(spark, ("orders-topic.validation.dlt", None, "v", [("dlt.original-topic", "orders-topic")]))
    assert column(df, deadletter.original_topic(by_name=True)) == ["orders-topic.validation"]
    assert column(df, deadletter.original_topic()) == ["orders-topic"]


def test_typed_samples(spark):
    text = ('{"order_id":"ORD-12345","customer_id":"CUST-67890","status":"PENDING","items":[{"product_id":"PROD-001",'
            '"product_name":"Sample Product","quantity":2,"unit_price":29.99,"total_price":59.98}],'
            '"total_amount":59.98,"order_timestamp":"2024-01-31T10:00:00.123","metadata":{"source":"web"}}')
    parsed = enrich.parse_order(log(spark, ("orders-topic", None, text))).select("order.*")
    row = enrich.order_items(parsed, "order_id").first()
    assert row.adds_up and row["item"].product_name == "Sample Product"
    assert parsed.select(process.order_violations()).first()[0] == []
    assert process.order_actions(parsed).first().action == "ORDER_PENDING"
    assert parsed.first().order_timestamp == dt.datetime(2024, 1, 31, 10, 0, 0, 123000)


def test_retry_delays(spark):
    df = spark.createDataFrame([(i,) for i in range(0, 9)], "offset int")
    assert column(df, errors.next_delay_ms(F.col("offset"))) == [0, 1000, 2000, 4000, 8000, 16000, 32000, 32000, 32000]
    rows = [("t", 0, 0, None, None, [], NOW, "RecoverableException", "m", None, None, None, None, None, 1, NOW),
            ("t", 0, 1, None, None, [], NOW, "ValidationException", "m", None, None, None, None, None, 1, NOW)]
    failures = spark.createDataFrame(rows, schema.FAILURES)
    plan = errors.retry_schedule(failures, "config").orderBy("retry").collect()
    assert [(r.retry, r.delay_ms) for r in plan] == [(1, 1000), (2, 2000), (3, 4000)]
    moved = errors.retry_schedule(failures, "fixed", jitter_key=F.col("offset")).collect()
    assert len(moved) == 3 and all(4500 <= r.delay_ms <= 5500 for r in moved)
    began, waits = int(NOW.replace(tzinfo=dt.timezone.utc).timestamp() * 1000), [r.delay_ms for r in sorted(moved, key=lambda r: r.retry)]
    assert [r.due_ms - began for r in sorted(moved, key=lambda r: r.retry)] == [sum(waits[:k]) for k in (1, 2, 3)]
    many = spark.createDataFrame([(f"t{k}", 5000) for k in range(12)], "topic string, messages long")
    assert deadletter.problem_topics(many).count() == 10 and deadletter.problem_topics(many, n=None).count() == 12
    assert failures.orderBy("offset").select(errors.log_map()).first()[0]["errorCode"] == "UNKNOWN"


def test_lag_is_never_negative(spark):
    rows = [("g", "t", 0, 10, 6010, NOW), ("g", "t", 1, 50, 40, NOW), ("g", "t", 2, 0, 1500, NOW), ("g", "t", 3, 5, None, NOW)]
    offsets = spark.createDataFrame(rows, "group string, topic string, partition int, committed long, end_offset long, ts timestamp")
    lags = lag.snapshot_lag(offsets)
    assert sorted(r.lag for r in lags.collect()) == [0, 1500, 6000]
    total = lag.lag_summary(lags).filter("overall").first()
    assert (total.total_lag, total.average_lag, total.above_warning, total.above_critical) == (7500, 2500, 2, 1)
    assert sorted(r.level for r in lag.lag_alerts(lags).collect()) == ["CRITICAL", "WARNING"]


def test_balance(spark):
    members = spark.createDataFrame(
        [("g", NOW, "a", 4), ("g", NOW, "b", 1), ("g", NOW, "c", 1)], "group string, ts timestamp, consumer_id string, partitions int")
    earlier = members.withColumn("ts", F.col("ts") - F.expr("INTERVAL 1 DAY"))
    events = monitor.rebalance_events(members.unionByName(earlier))
    assert events.count() == 0
    joined = monitor.rebalance_events(members.unionByName(earlier.filter("consumer_id <> 'c'"))).collect()
    assert [(r.group, r.members_changed) for r in joined] == [("g", 1)]
    row = monitor.monitor_stats(members, events, NOW).first()
    assert (row.skew, row.utilization, row.active_consumers, row.total_rebalances) == (2.0, 0.0, 3, 0)
    assert row.efficiency == pytest.approx(0.3)
    nobody = monitor.monitor_stats(members.limit(0), events, NOW).first()
    assert (nobody.skew, nobody.utilization, nobody.efficiency) == (0.0, 0.0, 1.0)
    advice = {r.type for r in monitor.partition_recommendations(monitor.monitor_stats(members, events, NOW)).collect()}
    assert advice == {"CONSUMER_UTILIZATION", "ASSIGNMENT_EFFICIENCY"}


def test_capacity_modes(spark):
    df = log(spark, *[("t", "k", "v" * 70)] * 3).withColumn(
        "timestamp", F.col("timestamp") + F.make_dt_interval(secs=F.col("offset")))
    fast = monitor.capacity_plan(df, growth=100, low_latency=True).first()
    assert (fast.rate, fast.batch_size, fast.max_poll_records, fast.acks) == (150, 1024, 6, "1")
    safe = monitor.capacity_plan(df, growth=100, durable=True).first()
    assert (safe.linger_ms, safe.replication, safe.acks, safe.max_poll_records) == (20, 3, "all", 3000)
    still = monitor.capacity_plan(df.limit(1), growth=0).first()
    assert still.rate == 0 and still.partitions is None


def test_health_forms(spark):
    rows = [(0, 0.04, 999), (1, 0.05, 10), (2, 0.0, 1000)]
    df = spark.createDataFrame(rows, "offset int, error_rate double, lag long")
    assert column(df, process.lag_health(F.col("error_rate"), F.col("lag"))) == [True, False, False]
    stats = process.stage_health(df, F.col("lag"), F.col("offset") == 2).orderBy("offset").collect()
    assert [(r.errors_ok, r.backlog_ok, r.breaker_ok, r.healthy) for r in stats] == [
        (True, False, True, False), (False, True, True, False), (True, False, False, False)]
    statuses = spark.createDataFrame([(0, s) for s in ["SUCCESS"] * 4 + ["ERROR", "REJECTED"]], "offset int, status string")
    row = process.processor_stats(statuses).first()
    assert (row.processed, row.errors, row.rejected, row.error_rate) == (4, 1, 1, 0.25)
    assert process.processor_stats(statuses.filter("status = 'ERROR'")).first().error_rate == 0.0


def test_batch_accepts_nine_of_ten(spark):
    def batch(topic, bad):
        return [(topic, None, "RETRY_ERROR PAYMENT_SERVICE_DOWN" if i < bad else "fine") for i in range(10)]

    rows = {}
    for name, topic, bad in [("one", "orders-topic", 1), ("two", "orders-topic", 2), ("pay", "payments-topic", 9)]:
        r = process.batch_outcome(process.outcome(log(spark, *batch(topic, bad)))).first()
        rows[name] = (r.processed, r.accepted, r.size_range)
    assert rows == {"one": (9, True, "small"), "two": (8, False, "small"), "pay": (10, True, "small")}


def test_alert_needs_its_time(spark):
    rows = [("s", NOW + dt.timedelta(minutes=i), 1, v) for i, v in enumerate([9.0, 9.0, 1.0, 9.0, 9.0, 9.0, 9.0])]
    steps = spark.createDataFrame(rows, "s string, step timestamp, n long, total double")
    found = series.alert_for(steps, "s", F.col("total") > 5, "3 minutes", "1 minute").collect()
    assert [(r.since, r.steps) for r in found] == [(NOW + dt.timedelta(minutes=3), 4)]


def test_alert_ends_where_samples_are_missing(spark):
    minutes = [0, 1, 60, 61, 62, 63]
    rows = [("s", NOW + dt.timedelta(minutes=m), 2, 9.0) for m in minutes]
    steps = spark.createDataFrame(rows, "s string, step timestamp, n long, total double")
    found = series.alert_for(steps, "s", F.col("total") > 5, "3 minutes", "1 minute").collect()
    assert [(r.since, r.steps) for r in found] == [(NOW + dt.timedelta(minutes=60), 4)]
    every = series.with_all_steps(steps, "s", "1 minute")
    assert [r.n for r in every.orderBy("step").collect()] == [2, 2, *[0] * 58, 2, 2, 2, 2]
    rates = {r.step: r.rate for r in series.rate_over(every, "s", 180, 60).collect()}
    assert rates[NOW + dt.timedelta(minutes=3)] == 2 / 180 and rates[NOW + dt.timedelta(minutes=30)] == 0
    grown = series.increase_over(every, "s", 120, 60).agg(F.max("increase")).first()[0]
    assert grown == 4
    ratio = series.ratio_of(steps.filter("minute(step) = 1"), every, "s").filter("ratio is not null")
    assert sorted(r.ratio for r in ratio.collect()) == [0, 0, 0, 0, 0.5, 1] or sorted(
        r.ratio for r in ratio.collect()) == [0, 0, 0, 0, 1, 1]


def test_replay_targets(spark):
    df = log(spark, *[("t", None, "stop" if i == 5 else "v") for i in range(10)]).withColumn(
        "timestamp", F.col("timestamp") + F.make_dt_interval(secs=F.col("offset")))
    trigger = F.col("value") == "stop"
    counts = {t: replay.replay_conditional(df, trigger, t, v).count() for t, v in [
        ("OFFSET", 8), ("RELATIVE", -2), ("BEGINNING", None), ("END", None), ("TIMESTAMP", NOW + dt.timedelta(seconds=4))]}
    assert counts == {"OFFSET": 2, "RELATIVE": 7, "BEGINNING": 10, "END": 0, "TIMESTAMP": 6}
    assert replay.replay_end(df).count() == 0
    assert replay.compact_latest(df.withColumn("key", F.lit("k"))).first().offset == 9


def test_limited_failures_are_not_tracked(spark):
    def failure(offset, attempt, service="Mail", at=0):
        when = NOW + dt.timedelta(seconds=at)
        return ("t", 0, offset, None, "v", [], NOW, "RecoverableException", "m", None, service, None, None, None, attempt, when)

    rows = [failure(0, a, at=a) for a in (1, 2, 3)] + [failure(1, a, None, at=10 + a) for a in (1, 2, 3)]
    failures = spark.createDataFrame(rows, schema.FAILURES)
    flags = {r.offset: (r.failure_count, r.poison, r.breaker_state, r.breaker_failures, r.attempt)
             for r in tracking.failure_flags(failures, breaker_threshold=3).collect()}
    assert flags == {0: (3, True, "OPEN", 3, 3), 1: (3, True, None, None, 3)}
    eight = spark.createDataFrame([failure(o, 1, at=o) for o in range(8)], schema.FAILURES)
    states = [(r.breaker_state, r.breaker_failures) for r in tracking.failure_flags(eight).orderBy("offset").collect()]
    assert states == [("CLOSED", n) for n in range(1, 5)] + [("OPEN", n) for n in range(5, 9)]
    limited = tracking.rate_limit(failures, 2)
    flags = {r.offset: (r.failure_count, r.poison, r.breaker_state, r.breaker_failures, r.attempt)
             for r in tracking.failure_flags(limited, breaker_threshold=3).collect()}
    assert flags == {0: (2, False, "CLOSED", 2, 3), 1: (0, False, None, None, 3)}


def test_text_is_cut_in_utf16_units(spark):
    """A character of two units is never cut in half, and what is short stays whole."""
    texts = ["a" * 300, "\U0001F600" * 150, "x" + "\U0001F600" * 150, "é" * 200, ""]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "offset int, t string")
    got = column(frame, utf16_prefix(F.col("t"), 200))
    assert got == ["a" * 200, "\U0001F600" * 100, "x" + "\U0001F600" * 99, "é" * 200, ""]
