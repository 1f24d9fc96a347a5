"""Consumer lag: positions of groups against the ends of partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Alert bounds.
WARNING_LAG = 1000
CRITICAL_LAG = 5000


def consumer_lag(committed: DataFrame, ends: DataFrame, on: tuple[str, ...] = ("topic", "partition")) -> DataFrame:
    """Never negative; partitions whose end is not known are left out."""
    joined = committed.join(ends, list(on))
    lag = F.greatest(F.col("end_offset") - F.col("committed"), F.lit(0).cast("bigint"))
    return joined.withColumn("lag", lag)


def snapshot_lag(offsets: DataFrame) -> DataFrame:
    """The same for snapshots that already hold both offsets."""
    known = offsets.filter(F.col("end_offset").isNotNull())
    return known.withColumn("lag", F.greatest(F.col("end_offset") - F.col("committed"), F.lit(0).cast("bigint")))


def latest(offsets: DataFrame) -> DataFrame:
    place = ["group", "topic", "partition"]
    return offsets.groupBy(*place).agg(F.max_by(F.struct(*offsets.columns), "ts").alias("row")).select("row.*")


def lag_summary(lags: DataFrame, warning: int = WARNING_LAG, critical: int = CRITICAL_LAG) -> DataFrame:
    """Per group, and over all groups in the row with ``overall``. The average is cut to
    whole records."""
    return lags.rollup("group").agg(
        F.grouping("group").cast("boolean").alias("overall"),
        F.count(F.lit(1)).alias("partitions"), F.sum("lag").alias("total_lag"),
        F.max("lag").alias("max_lag"),
        F.expr("sum(lag) div count(1)").alias("average_lag"),
        F.count_if(F.col("lag") > warning).alias("above_warning"),
        F.count_if(F.col("lag") > critical).alias("above_critical"))


def alert_level(lag: Column, warning: int = WARNING_LAG, critical: int = CRITICAL_LAG) -> Column:
    return F.when(lag > critical, "CRITICAL").when(lag > warning, "WARNING")


def lag_alerts(lags: DataFrame, warning: int = WARNING_LAG, critical: int = CRITICAL_LAG) -> DataFrame:
    rows = lags.withColumn("level", alert_level(F.col("lag"), warning, critical))
    return rows.filter(F.col("level").isNotNull())


def lag_trend(lags: DataFrame) -> DataFrame:
    """Against the previous snapshot of the same group and partition. The window runs over
    the snapshots of one partition, a number that time bounds, not the size of the log."""
    series = Window.partitionBy("group", "topic", "partition").orderBy("ts")
    before = F.lag("lag").over(series)
    trend = (F.when(before.isNull(), "NEW").when(F.col("lag") > before, "INCREASING")
             .when(F.col("lag") < before, "DECREASING").otherwise("STABLE"))
    return lags.withColumn("trend", trend)
