"""The breaker against a plain fold, with chunks so small that every key is split."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators import carry
from tidelog.operators.breaker import INITIAL, STATE_NAMES, Breaker, circuit_breaker, gated_outcome


def fold(rule, events):
    state, out = INITIAL, []
    for at, ok in events:
        state, through = rule.step(state, at, ok)
        out.append((through, STATE_NAMES[state[0]]))
    return out


@pytest.mark.parametrize("seed", range(30))
def test_summary_equals_replay(seed):
    rng = random.Random(seed)
    rule = Breaker(rng.randint(1, 4), rng.randint(1, 6) * 1000, rng.randint(1, 4))
    times = sorted(rng.randint(0, 40) * 1_000_000 for _ in range(rng.randint(1, 60)))
    oks = [rng.random() < 0.6 for _ in times]
    exits, steps = rule.summary(times, oks)
    entries = [(0, i, 0) for i in range(rule.failures)] + [(1, i, 0) for i in range(rule.successes)]
    entries += [(2, rule.failures, t * 1_000_000) for t in range(-8, 1)]
    for entry in entries:
        state = entry
        for at, ok in zip(times, oks):
            state, _ = rule.step(state, at, ok)
        assert rule.after(entry, exits, steps) == state, entry


@pytest.mark.parametrize("chunk", [7, 100_000])
def test_chunks_change_nothing(spark, chunk):
    rule = Breaker(failures=3, reset_ms=60_000, successes=2)
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("key"),
        F.timestamp_seconds(F.col("id") * 7 + F.pmod(F.hash("id"), F.lit(5))).alias("ts"),
        F.col("id").alias("seq"), (F.pmod(F.xxhash64("id"), F.lit(10)) < 5).alias("ok"))
    got = {}
    for r in circuit_breaker(rows, rule, chunk=chunk).collect():
        got[r.seq] = (r.admitted, r.state)
    by_key = {}
    for r in rows.select("key", F.unix_micros("ts").alias("at"), "seq", "ok").collect():
        by_key.setdefault(r.key, []).append((r["at"], r.seq, r.ok))
    want = {}
    for events in by_key.values():
        events.sort()
        for (_, seq, _), result in zip(events, fold(rule, [(a, o) for a, _, o in events])):
            want[seq] = result
    assert got == want
    assert {s for _, s in got.values()} == {"CLOSED", "HALF_OPEN", "OPEN"}


def test_states_step_by_step():
    rule = Breaker(failures=2, reset_ms=1000, successes=2)
    events = [(0, False), (1, True), (2, False), (3, False), (500_000, True), (1_000_003, True),
              (1_000_004, True), (1_000_005, False)]
    assert fold(rule, events) == [
        (True, "CLOSED"), (True, "CLOSED"), (True, "CLOSED"), (True, "OPEN"), (False, "OPEN"),
        (True, "HALF_OPEN"), (True, "CLOSED"), (True, "CLOSED")]


def test_null_and_empty_keys_are_two(spark):
    rows = spark.createDataFrame([(None, 1, False), ("", 2, False), ("-", 3, False)], "key string, seq long, ok boolean")
    done = circuit_breaker(rows.withColumn("ts", F.timestamp_seconds("seq")), Breaker(failures=2))
    assert [r.state for r in done.collect()] == ["CLOSED"] * 3


def test_recoverable_errors_are_not_acknowledged(spark):
    rows = [(True, True, False), (True, False, False), (True, False, True), (False, False, True)]
    done = spark.createDataFrame(rows, "admitted boolean, ok boolean, recoverable boolean")
    assert [(r.status, r.acked) for r in gated_outcome(done).collect()] == [
        ("SUCCESS", True), ("ERROR", True), ("ERROR", False), ("REJECTED", True)]


def random_calls(rng, n, gap, fails):
    at, out = 0, []
    for k in range(n):
        at += rng.choice([0, 1, gap]) * 1_000_000
        out.append((at, k, rng.random() >= fails))
    return out


@pytest.mark.parametrize("fails, gap", [(1.0, 2), (1.0, 40), (0.9, 5), (0.5, 30), (0.2, 3)])
def test_composed_functions_give_the_entry_states(spark, fails, gap):
    """Chunks much shorter and much longer than the time a breaker rests, seven levels of them."""
    rule, rng = Breaker(failures=3, reset_ms=30_000, successes=2), random.Random(int(fails * 10) + gap)
    calls = random_calls(rng, 500, gap, fails)
    frame = spark.createDataFrame([("hot", *c) for c in calls] + [("two", *c) for c in calls[:9]],
                                  "key string, at bigint, seq bigint, ok boolean").withColumn("ts", F.timestamp_micros("at"))
    got = {(r.key, r.seq): (r.admitted, r.state) for r in circuit_breaker(frame, rule, chunk=4).collect()}
    for key, some in (("hot", calls), ("two", calls[:9])):
        want = fold(rule, [(at, ok) for at, _, ok in some])
        assert [got[key, k] for k in range(len(some))] == want


def test_a_failing_hot_key_is_never_in_one_task(spark, monkeypatch):
    """A million calls of one key that all fail: the fold's result, and no task has more rows of functions than
    a chunk has calls."""
    n, chunk, rule = 1_000_000, 100_000, Breaker(failures=10, reset_ms=300_000, successes=5)
    rows = spark.range(0, n, 1, 16).select(F.lit("hot").alias("key"), F.timestamp_micros(F.col("id") * 2000).alias("ts"),
                                           F.col("id").alias("seq"), F.lit(False).alias("ok"))
    laid, plain = [], carry.durable
    monkeypatch.setattr(carry, "durable", lambda df: laid.append(plain(df)) or laid[-1])
    spark.conf.set("spark.sql.shuffle.partitions", 32)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # small partitions would be merged
    try:
        done = circuit_breaker(rows, rule, chunk=chunk)
        got = done.groupBy("state", "admitted").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("s")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for df in laid for r in df.groupBy("__task").count().collect()]
    state, want = INITIAL, {}
    for k in range(n):
        state, through = rule.step(state, k * 2000, False)
        c, s = want.get((STATE_NAMES[state[0]], through), (0, 0))
        want[STATE_NAMES[state[0]], through] = (c + 1, s + k)
    assert {(r.state, r.admitted): (r.n, r.s) for r in got} == want
    assert sizes and max(sizes) <= chunk
