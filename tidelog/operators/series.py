"""Rules over metric series: trends, severity, alerts that must hold, throughput."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidelog.operators.indexing import rank_within

# Bounds, levels and texts.
CRITICAL_LEVEL, WARNING_LEVEL = 0.85, 0.70
HIGH_PRESSURE, MEDIUM_PRESSURE = 1.0, 0.5
LEAK_TREND, SUSPECT_TREND = 0.05, 0.03
SAMPLES = 10
CRITICAL_ADVICE = ["CRITICAL: Increase heap size immediately (-Xmx)",
                   "Reduce buffer sizes in streaming processors",
                   "Implement more aggressive backpressure"]
WARNING_ADVICE = ["Consider increasing heap size", "Monitor buffer utilization in streaming processors"]
TREND_ADVICE = ["Investigate potential memory leak", "Enable memory profiling for detailed analysis"]
PRESSURE_ADVICE = ["Reduce concurrent processing threads", "Implement smaller batch sizes"]


def metric_trend(samples: DataFrame, series: str, order: tuple[str, ...] = ("ts", "seq"),
                 block: int = SAMPLES) -> DataFrame:
    """Relative change over each full block of ``block`` samples of a series."""
    ranked = rank_within(samples, list(order), group=[series], name="__rank")
    blocks = ranked.groupBy(series, F.expr(f"__rank div {block}").alias("block")).agg(
        F.count(F.lit(1)).alias("__n"), F.min_by("value", "__rank").alias("first_value"),
        F.max_by("value", "__rank").alias("last_value"))
    first = F.when(F.col("first_value") != 0, F.col("first_value"))
    trend = (F.col("last_value") - F.col("first_value")) / first
    return blocks.filter(F.col("__n") == block).drop("__n").withColumn("trend", trend).withColumn(
        "leak_warning", F.coalesce(F.col("trend") > LEAK_TREND, F.lit(False)))


def pressure(level: Column) -> Column:
    return (F.when(level > CRITICAL_LEVEL, HIGH_PRESSURE).when(level > WARNING_LEVEL, MEDIUM_PRESSURE)
            .otherwise(0.0))


def needs_action(level: Column, trend: Column) -> Column:
    return (level > CRITICAL_LEVEL) | (F.coalesce(trend, F.lit(0.0)) > LEAK_TREND)


def severity(level: Column, trend: Column) -> Column:
    return (F.when(needs_action(level, trend), "CRITICAL").when(level > WARNING_LEVEL, "WARNING")
            .otherwise("OK"))


def metric_severity(trends: DataFrame, level: str = "last_value") -> DataFrame:
    at, trend = F.col(level), F.col("trend")
    return (trends.withColumn("pressure", pressure(at)).withColumn("severity", severity(at, trend))
            .withColumn("requires_action", needs_action(at, trend)))


def metric_recommendations(trends: DataFrame, level: str = "last_value") -> DataFrame:
    at = F.col(level)

    def texts(lines: list[str]) -> Column:
        return F.array(*[F.lit(x) for x in lines])

    none = F.array().cast("array<string>")
    advice = F.concat(
        F.when(at > CRITICAL_LEVEL, texts(CRITICAL_ADVICE)).when(at > WARNING_LEVEL, texts(WARNING_ADVICE))
        .otherwise(none),
        F.when(F.coalesce(F.col("trend") > SUSPECT_TREND, F.lit(False)), texts(TREND_ADVICE)).otherwise(none),
        F.when(pressure(at) > MEDIUM_PRESSURE, texts(PRESSURE_ADVICE)).otherwise(none))
    return trends.withColumn("recommendation", F.explode(advice))


def steps(samples: DataFrame, series: str, step: str, value: str = "value") -> DataFrame:
    """Samples reduced to one row per series and evaluation step, before anything is ordered."""
    return samples.groupBy(series, F.window("ts", step)["start"].alias("step")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


# Documented alert rules that hold for a time: share of oversized records, mean size in bytes, lag.
OVERSIZED_SHARE, OVERSIZED_HOLD = 0.1, "5 minutes"
MEAN_SIZE, MEAN_HOLD = 102_400, "10 minutes"
LAG_BOUND, LAG_HOLD = 10_000, "5 minutes"


def size_alerts(steps: DataFrame, series: str, step: str, share: float = OVERSIZED_SHARE, share_hold: str = OVERSIZED_HOLD,
                mean: float = MEAN_SIZE, mean_hold: str = MEAN_HOLD) -> DataFrame:
    """(rule, series, since, until, steps): stretches with too many oversized records, or with too large ones on average."""
    found = [("oversized_share", F.col("share") > share, share_hold), ("mean_size", F.col("mean") > mean, mean_hold)]
    parts = [alert_for(steps, series, bad, hold, step).withColumn("rule", F.lit(rule)) for rule, bad, hold in found]
    return parts[0].unionByName(parts[1]).select("rule", F.col(series).alias("series"), "since", "until", "steps")


def lag_alerts_for(lags: DataFrame, step: str, bound: int = LAG_BOUND, hold: str = LAG_HOLD) -> DataFrame:
    """The same for groups whose largest lag of a snapshot stays above a bound; snapshots are a ``step`` apart."""
    worst = lags.groupBy("group", F.col("ts").alias("step")).agg(F.max("lag").alias("worst"))
    found = alert_for(worst, "group", F.col("worst") > bound, hold, step)
    return found.select(F.lit("lag").alias("rule"), F.col("group").alias("series"), "since", "until", "steps")


def with_all_steps(evaluated: DataFrame, series: str, step: str) -> DataFrame:
    """Adds the steps without samples between the first and the last of a series, with n = 0 and no total."""
    gap = F.expr(f"INTERVAL {step}")
    after = F.lead("step").over(Window.partitionBy(series).orderBy("step"))
    until = F.coalesce(F.col("__next") - gap, F.col("step"))
    every = evaluated.withColumn("__next", after).withColumn("__at", F.explode(F.sequence(F.col("step"), until, gap)))
    real = F.col("__at") == F.col("step")
    kept = [F.col(c) for c in evaluated.columns if c not in ("step", "n", "total")]
    return every.select(*kept, F.col("__at").alias("step"), F.when(real, F.col("n")).otherwise(0).alias("n"),
                        F.when(real, F.col("total")).alias("total")).select(*evaluated.columns)


def alert_for(evaluated: DataFrame, series: str, breached: Column, hold: str, step: str) -> DataFrame:
    """Stretches of successive steps in which a condition holds for at least ``hold``.

    A step without a row has no value, so the condition does not hold there: it ends a stretch. The windows run
    over the steps of one series, whose number time bounds.
    """
    over = Window.partitionBy(series).orderBy("step")
    marked = evaluated.select(series, "step", F.coalesce(breached, F.lit(False)).alias("__bad"))
    follows = F.col("step") - F.lag("step").over(over) <= F.expr(f"INTERVAL {step}")
    goes_on = follows & (F.col("__bad") == F.lag("__bad").over(over))
    runs = marked.withColumn("__change", F.when(goes_on, 0).otherwise(1)).withColumn(
        "__run", F.sum("__change").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.filter("__bad").groupBy(series, "__run").agg(
        F.min("step").alias("since"), F.max("step").alias("until"), F.count(F.lit(1)).alias("steps"))
    held = F.unix_micros("until") - F.unix_micros("since") >= F.unix_micros(
        F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {hold}"))
    return spans.filter(held).drop("__run")


def size_steps(sized: DataFrame, series: str, time: str, size: str, step: str, oversized: int) -> DataFrame:
    """Per series and step: ``n`` records, the ``share`` of them above ``oversized`` bytes, and their ``mean`` size."""
    return sized.groupBy(series, F.window(time, step).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), (F.count_if(F.col(size) > oversized) / F.count(F.lit(1))).alias("share"),
        F.avg(size).alias("mean")).select(series, F.col("w.start").alias("step"), "n", "share", "mean")


def ratio_of(part: DataFrame, whole: DataFrame, series: str) -> DataFrame:
    """Adds ``ratio`` to the steps of ``whole``: the count of ``part`` in the same step over its own."""
    counted = part.select(series, "step", F.col("n").alias("__part"))
    return whole.join(counted, [series, "step"], "left").withColumn(
        "ratio", F.coalesce(F.col("__part"), F.lit(0)) / F.when(F.col("n") > 0, F.col("n"))).drop("__part")


def increase_over(evaluated: DataFrame, series: str, span_seconds: int, step_seconds: int) -> DataFrame:
    """Adds ``increase``: how much a counter (``n`` events a step) grew over the last ``span_seconds``."""
    over = Window.partitionBy(series).orderBy(F.unix_seconds("step")).rangeBetween(-(span_seconds - step_seconds), 0)
    return evaluated.withColumn("increase", F.sum("n").over(over))


def rate_over(evaluated: DataFrame, series: str, span_seconds: int, step_seconds: int) -> DataFrame:
    """Adds ``rate``: events per second over the last ``span_seconds``, from step counts."""
    at = F.unix_seconds("step")
    over = Window.partitionBy(series).orderBy(at).rangeBetween(-(span_seconds - step_seconds), 0)
    return evaluated.withColumn("rate", F.sum("n").over(over) / float(span_seconds))


def rise_over(evaluated: DataFrame, series: str, span_seconds: int) -> DataFrame:
    """Adds ``rise``: change of the mean against the earliest step within the span."""
    over = Window.partitionBy(series).orderBy(F.unix_seconds("step")).rangeBetween(-span_seconds, 0)
    mean = F.col("total") / F.col("n")
    return evaluated.withColumn("__mean", mean).withColumn(
        "rise", F.col("__mean") - F.first("__mean").over(over)).drop("__mean")


def throughput_series(df: DataFrame, *by: str, window: str = "1 minute") -> DataFrame:
    return df.groupBy(*by, F.window("timestamp", window).alias("w")).agg(
        F.count(F.lit(1)).alias("records")).select(*by, F.col("w.start").alias("start"), "records")


def sliding_throughput(df: DataFrame, *by: str, length: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Sliding counts from the tumbling ones: each record is counted once and only the much
    fewer step rows are copied into the windows they fall in."""
    base = throughput_series(df, *by, window=slide)
    return base.groupBy(*by, F.window("start", length, slide).alias("w")).agg(
        F.sum("records").alias("records")).select(*by, F.col("w.start").alias("start"), "records")
