"""Stream forms give what the batch forms give, over files that arrive in time order."""

import os

import pytest
from pyspark.sql import functions as F

from tidelog import schema
from tidelog.operators import breaker, filters, lag, monitor, replay, series, tracking
from tidelog.plans.failing import SPARSE
from tidelog.sources.derive import AS_OF, Tables
from tidelog.streaming import aggregates, lagging, ordered, stateful
from tidelog.streaming.consume import consumer
from tidelog.streaming.reading import read_stream, run_available, write_files
from tidelog.sources.sinks import read_committed

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, FOLDER)


def arriving(df, folder, time, files=4):
    """The rows in time order, cut into files whose names and ages follow that order."""
    bounds = df.approxQuantile("__t", [i / files for i in range(1, files)], 0.0)
    for i in range(files):
        part = df
        if i:
            part = part.filter(F.col("__t") > bounds[i - 1])
        if i < files - 1:
            part = part.filter(F.col("__t") <= bounds[i])
        part.drop("__t").coalesce(1).write.mode("append").parquet(folder)
    return folder


def stream_of(spark, df, tmp_path, time, layout):
    timed = df.withColumn("__t", F.unix_micros(time).cast("double"))
    return read_stream(spark, arriving(timed, str(tmp_path / "in"), time), layout, files_per_trigger=1)


def collected(df, tmp_path, mode="append"):
    rows = []

    def keep(batch, _):
        if mode == "complete":
            rows.clear()
        rows.extend(tuple(r) for r in batch.collect())

    run_available(df, str(tmp_path / "check"), keep, mode)
    return rows


def test_filters_need_no_state(spark, tables, tmp_path):
    log = tables.orders_log()
    stream = stream_of(spark, log, tmp_path, "timestamp", schema.LOG)
    kept = filters.keep(stream, filters.composite_reason(AS_OF))
    write_files(kept, str(tmp_path / "out"), str(tmp_path / "check"))
    want = filters.keep(log, filters.composite_reason(AS_OF))
    got = spark.read.schema(schema.LOG).parquet(str(tmp_path / "out"))
    assert got.select("partition", "offset").exceptAll(want.select("partition", "offset")).count() == 0
    assert got.count() == want.count() > 0


def test_closed_windows_equal_the_batch(spark, tables, tmp_path):
    log = tables.notifications_log()
    stream = stream_of(spark, log, tmp_path, "timestamp", schema.LOG)
    got = collected(aggregates.windowed_counts(stream, "topic"), tmp_path)
    want = {(r.start, r.topic, r.records) for r in series.throughput_series(log, "topic").collect()}
    assert set(got) <= want and len(want) - len(got) < 10 and got


def test_reason_counts_in_complete_mode(spark, tables, tmp_path):
    log = tables.payments_log()
    stream = stream_of(spark, log, tmp_path, "timestamp", schema.LOG)
    got = collected(aggregates.reason_counts(stream, AS_OF, "1 day"), tmp_path, "complete")
    totals = {}
    for _, topic, reason, n in got:
        totals[(topic, reason)] = totals.get((topic, reason), 0) + n
    want = filters.reason_counts(log, filters.composite_reason(AS_OF), "topic").collect()
    assert totals == {(r.topic, r.reason): r.records for r in want}


def flushed(df, time, **values):
    """The rows and one far behind them, which closes all slots of the others."""
    late = df.limit(1).withColumn(time, F.col(time) + F.expr("interval 300 days"))
    for name, value in values.items():
        late = late.withColumn(name, F.lit(value))
    return df.unionByName(late)


def test_breaker(spark, tables, tmp_path):
    """One key holds half of the calls; the stream's rows are those of static data."""
    calls = tables.calls().withColumn("key", F.when(F.col("seq") % 2 == 0, "hot").otherwise(F.col("key")))
    stream = stream_of(spark, flushed(calls, "ts", key="flush"), tmp_path, "ts", "key string, ts timestamp, seq bigint, ok boolean")
    got = collected(stateful.circuit_breaker(stream, SPARSE, slot_ms=3_600_000), tmp_path)
    want = breaker.circuit_breaker(calls, SPARSE).collect()
    assert sorted(r[2:] for r in got) == sorted(tuple(r)[2:] for r in want)


def test_consuming_behind_a_breaker(spark, tables, tmp_path):
    calls = tables.calls().withColumn("recoverable", F.col("seq") % 3 == 0)
    layout = "key string, ts timestamp, seq bigint, ok boolean, recoverable boolean"
    stream = stream_of(spark, flushed(calls, "ts", key="flush"), tmp_path, "ts", layout)
    got = collected(stateful.consume_with_breaker(stream, SPARSE, slot_ms=3_600_000).select("seq", "status", "acked"), tmp_path)
    done = breaker.gated_outcome(breaker.circuit_breaker(calls, SPARSE)).select("seq", "status", "acked")
    assert sorted(got) == sorted(tuple(r) for r in done.collect()) and len({r[1:] for r in got}) > 2


def test_late_rows_of_a_slot_are_put_in_order(spark, tmp_path):
    """Files whose times overlap by less than the watermark give the order of times; quiet keys are forgotten."""
    rows = [("a", k, k, k % 4 == 0) for k in range(400)] + [("flush", 50_000, 1, True)]
    for part in ([r for r in rows if r[1] % 7 < 3], [r for r in rows if r[1] % 7 >= 3]):
        frame = spark.createDataFrame(part, "key string, at bigint, seq bigint, ok boolean")
        frame.select("key", F.timestamp_seconds(F.col("at") + 1).alias("ts"), "seq", "ok").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = read_stream(spark, str(tmp_path / "in"), "key string, ts timestamp, seq bigint, ok boolean", files_per_trigger=1)
    rule, out = breaker.Breaker(failures=2, reset_ms=20_000, successes=1), []
    done = stateful.circuit_breaker(stream, rule, watermark="1 hour", forget_ms=3_600_000)
    query = run_available(done, str(tmp_path / "check"), lambda batch, _: out.extend(batch.collect()))
    want, state = [], breaker.INITIAL
    for _, at, seq, ok in rows[:-1]:
        state, through = rule.step(state, (at + 1) * 1_000_000, ok)
        want.append((seq, through, breaker.STATE_NAMES[state[0]]))
    assert [(r.seq, r.admitted, r.state) for r in sorted(out, key=lambda r: r.seq)] == want
    # of the quiet key nothing is left: the other one has a part, its count and two timers' entries
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] < 8


def test_poison_pills(spark, tables, tmp_path):
    failures = tables.failures()
    stream = stream_of(spark, flushed(failures, "failed_at", topic="flush"), tmp_path, "failed_at", schema.FAILURES)
    got = collected(stateful.poison_pills(stream), tmp_path)
    final = {}
    for topic, partition, offset, _, count, poison in got:
        final[(topic, partition, offset)] = max(final.get((topic, partition, offset), (0, False)), (count, poison))
    want = tracking.poison_pills(failures, AS_OF).collect()
    assert final == {(r.topic, r.partition, r.offset): (r.failure_count, r.poison) for r in want}


def test_newest_per_key(spark, tables, tmp_path):
    log = tables.orders_log()
    stream = stream_of(spark, log, tmp_path, "timestamp", schema.LOG)
    got = collected(aggregates.compact_latest(stream), tmp_path, "complete")
    want = replay.compact_latest(log).filter("key is not null").collect()
    assert sorted((r[1], r[2]) for r in got) == sorted((r.partition, r.offset) for r in want)


def test_duplicates_within_the_watermark(spark, tables, tmp_path):
    log = tables.notifications_log()
    twice = log.unionByName(log)
    stream = stream_of(spark, twice, tmp_path, "timestamp", schema.LOG)
    got = collected(aggregates.deduplicated(stream, F.col("offset") * 3 + F.col("partition")), tmp_path)
    assert len(got) == log.count()


def test_consumer_writes_whole_batches(spark, tables, tmp_path):
    log = tables.orders_log()
    stream = stream_of(spark, log, tmp_path, "timestamp", schema.LOG)
    out = str(tmp_path / "out")
    run_available(stream, str(tmp_path / "check"), consumer(out))
    assert read_committed(spark, out).count() == log.count()


def test_limited_counts(spark, tables, tmp_path):
    failures = tables.failures()
    stream = stream_of(spark, failures, tmp_path, "failed_at", schema.FAILURES)
    got = collected(aggregates.limited_counts(stream, 1), tmp_path, "complete")
    want = tracking.limited_counts(failures, 1).agg(F.sum("limited")).first()[0]
    assert sum(r[-1] for r in got) == want > 0


def test_rate_limit(spark, tables, tmp_path):
    """A hot topic holds most failures of few minutes; its parts meet in the second step."""
    failures = tables.failures().filter("topic = 'orders-topic'").withColumn("topic", F.lit("hot")).withColumn(
        "failed_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.xxhash64("partition", "offset", "attempt"), F.lit(400))))
    stream = stream_of(spark, flushed(failures, "failed_at", topic="flush"), tmp_path, "failed_at", schema.FAILURES)
    got = collected(stateful.rate_limit(stream, 20), tmp_path)
    want = tracking.rate_limit(failures, 20).select("topic", "partition", "offset", "attempt", "limited").collect()
    assert sorted(got) == sorted(tuple(r) for r in want)
    assert len({r.limited for r in want}) == 2


def test_lag_from_two_streams(spark, tables, tmp_path):
    """Commits and ends come in files of their own, some ends not at all; closed windows equal static data."""
    offsets = tables.offsets()
    ends = offsets.select("topic", "partition", "ts", "end_offset").distinct().filter("not (partition = 1 and day(ts) % 5 = 0)")
    commits = offsets.drop("end_offset")
    end = commits.agg(F.max("ts")).first()[0]
    far = spark.createDataFrame([("flush", "flush", 0, end, 1, 1)], "group string, topic string, partition int, ts timestamp, committed bigint, end_offset bigint")
    far = far.withColumn("ts", F.col("ts") + F.expr("interval 300 days"))
    (tmp_path / "c").mkdir()
    (tmp_path / "e").mkdir()
    left = stream_of(spark, commits.unionByName(far.drop("end_offset")), tmp_path / "c", "ts",
                     "group string, topic string, partition int, committed bigint, ts timestamp")
    right = stream_of(spark, ends.unionByName(far.select(*ends.columns)), tmp_path / "e", "ts",
                      "topic string, partition int, ts timestamp, end_offset bigint")
    lags = lagging.consumer_lag(left, right, watermark="3 days")
    want = lag.consumer_lag(commits, ends, ("topic", "partition", "ts"))
    got = collected(lags.filter("topic <> 'flush'").select("group", "topic", "partition", "ts", "lag"), tmp_path)
    assert sorted(got) == sorted(tuple(r) for r in want.select("group", "topic", "partition", "ts", "lag").collect()) and got
    (tmp_path / "sum").mkdir()
    sums = collected(lagging.lag_summary(lags, "1 day", 5, 20).filter("group <> 'flush'"), tmp_path / "sum")
    per_day = want.groupBy(F.date_trunc("day", "ts").alias("start"), "group").agg(
        F.count(F.lit(1)), F.sum("lag"), F.max("lag"), F.expr("sum(lag) div count(1)"), F.expr("count_if(lag > 5)"), F.expr("count_if(lag > 20)"))
    want = {tuple(r) for r in per_day.collect()}
    assert set(sums) <= want and len(sums) == len(set(sums)) > len(want) / 2  # the newest windows are still open


def test_rebalances_of_snapshots_in_two_batches(spark, tables, tmp_path):
    members = tables.members().filter("day(ts) <= 12")
    folder = str(tmp_path / "in")
    late = members.limit(1).withColumn("ts", F.col("ts") + F.expr("interval 300 days")).withColumn("group", F.lit("flush"))
    half = F.pmod(F.xxhash64("consumer_id"), F.lit(2)) == 0
    for part in (members.filter(half), members.filter(~half).unionByName(late)):
        part.coalesce(1).write.mode("append").parquet(folder)
    stream = read_stream(spark, folder, "group string, ts timestamp, consumer_id string, partitions int", files_per_trigger=1)
    got = collected(ordered.rebalance_events(stream, "60 days", slot_ms=86_400_000), tmp_path)
    want = monitor.rebalance_events(members).select("group", F.unix_millis("ts"), "members_changed").collect()
    assert sorted(got) == sorted(tuple(r) for r in want) and got
