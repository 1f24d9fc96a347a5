"""Dense positions, with one group that holds most rows, against a plain sort."""

from pyspark.sql import functions as F

from tidelog.operators.indexing import arrival_index, rank_within


def test_hot_group_is_spread_and_exact(spark):
    rows = spark.range(20000).select(
        F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 < 9, F.concat(F.lit("g"), F.col("id") % 50))
        .alias("g"), F.pmod(F.hash("id"), F.lit(1000)).alias("t"), "id")
    ranked = rank_within(rows, ["t", "id"], group=["g"])
    got = {(r.g, r.id): r["rank"] for r in ranked.collect()}
    by_group = {}
    for r in rows.collect():
        by_group.setdefault(r.g, []).append((r.t, r.id))
    want = {(g, i): n for g, v in by_group.items() for n, (_, i) in enumerate(sorted(v))}
    assert got == want
    assert None in by_group  # rows without group are a group of their own


def test_arrival_is_dense(spark):
    log = spark.range(1000).select(
        F.lit("t").alias("topic"), (F.col("id") % 3).cast("int").alias("partition"), F.col("id").alias("offset"),
        F.timestamp_seconds(F.lit(1000)).alias("timestamp"))  # all at one time
    got = [(r.arrival, r.partition, r.offset) for r in arrival_index(log).orderBy("arrival").collect()]
    assert [g[0] for g in got] == list(range(1000))
    assert [g[1:] for g in got] == sorted(g[1:] for g in got)
