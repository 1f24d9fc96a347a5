"""Marks carried forward over the borders of tasks, against a plain walk."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidelog.operators import allocate, carry, partitioners
from tidelog.operators.carry import carried


@pytest.mark.parametrize("tasks", [1, 13])
def test_last_mark_before_each_row(spark, tasks):
    rng = random.Random(tasks)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None, ""]), k, rng.random() < 0.004, k * 10 if k % 7 else None, f"m{k}")
            for k in range(3000)]
    frame = spark.createDataFrame(rows, "g string, at bigint, is_mark boolean, v bigint, w string").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        got = {r["at"]: (r.last_v, r.last_w) for r in carried(frame, ["g"], ["at"], "is_mark", ["v", "w"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    last, want = {}, {}
    for g, at, is_mark, v, w in rows:
        if is_mark:
            last[g] = (v, w)
        want[at] = last.get(g, (None, None))
    assert got == want and any(x[1] for x in want.values())


def test_no_rows(spark):
    frame = spark.createDataFrame([], "g string, at bigint, is_mark boolean, v bigint")
    assert carried(frame, ["g"], ["at"], "is_mark", ["v"]).count() == 0


def test_one_heavy_and_many_light_owners(spark, monkeypatch):
    """Blocks of very unlike width: the same shares as a plain loop, and no task with over twice the median's rows."""
    units = spark.range(40_000).select(F.lit("q").alias("queue"), F.col("id").alias("unit"))
    rows = [("q", f"o{i:05d}", 20_000 if i == 0 else 2) for i in range(10_001)]
    frame = spark.createDataFrame(rows, "queue string, owner string, capacity int")
    laid, plain = [], carry.durable
    monkeypatch.setattr(carry, "durable", lambda df: laid.append(plain(df)) or laid[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        got = {r.unit: r.owner for r in allocate.alloc_capacity(units, frame).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    total, want = sum(r[2] for r in rows), {}
    for _, name, capacity in sorted(rows, key=lambda r: (-r[2], r[1])):
        for _ in range(min(int(capacity / total * 40_000 + 0.5), 40_000 - len(want))):
            want[len(want)] = name
    assert got == want
    sizes = sorted(r["count"] for df in laid for r in df.groupBy("__task").count().collect())
    assert len(sizes) > 4 and sizes[-1] <= 2 * statistics.median(sizes)


def test_a_high_threshold_costs_no_rows(spark):
    """Least-loaded partitions up to a level of a billion, per topic, against a plain loop."""
    from test_literals import log

    loads = {"a": [7, 0, 1_000_000, 3], "b": [0, 2, 2, 2_000_000_000]}
    df = log(spark, *[(t, None, "v") for _ in range(40) for t in ("a", "b", "c")])
    given = spark.createDataFrame([(t, p, n) for t, some in loads.items() for p, n in enumerate(some)] + [("a", 99, 5), ("a", -1, 5)],
                                  "topic string, partition int, load bigint")
    got = {}
    for r in partitioners.part_load_aware(df, 4, given, 10**9).orderBy("topic", "offset").collect():
        got.setdefault(r.topic, []).append(r.target_partition)
    for topic in "abc":
        now, want = list(loads.get(topic, [0] * 4)), []
        for _ in range(40):
            best = min(range(4), key=lambda p: (now[p], p))
            now[best] += 1
            want.append(best)
        assert got[topic] == want
