"""Rules over the failures of a record, a service or a topic minute.

Positions within a group come from ``rank_within``: a topic or a service may hold a third of
all failures and must not end up in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidelog.operators.indexing import rank_within, running_total
from tidelog.session import measured

# Thresholds of the rules.
POISON_FAILURES = 3
POISON_COOLDOWN = "5 minutes"
BREAKER_FAILURES = 5
MAX_ERRORS_PER_MINUTE = 100
RECORD = ["topic", "partition", "offset"]
ATTEMPT = [*RECORD, "attempt"]
QUARANTINE_SUFFIX = ".poison-pill.quarantine"


def rate_limit(failures: DataFrame, limit: int = MAX_ERRORS_PER_MINUTE) -> DataFrame:
    """``limited``: the failure came after ``limit`` others of its topic in the same minute."""
    timed = failures.withColumn("__minute", F.date_trunc("minute", "failed_at"))
    order = ["failed_at", "partition", "offset", "attempt"]
    ranked = rank_within(timed, order, group=["topic", "__minute"], name="__rank", identity=ATTEMPT)
    return ranked.withColumn("limited", F.col("__rank") >= limit).drop("__rank", "__minute")


def limited_counts(failures: DataFrame, limit: int = MAX_ERRORS_PER_MINUTE) -> DataFrame:
    """How many failures of each topic the limit held back: counting needs no order."""
    minutes = failures.groupBy("topic", F.date_trunc("minute", "failed_at").alias("minute")).agg(
        F.count(F.lit(1)).alias("n"))
    return minutes.filter(F.col("n") > limit).groupBy("topic").agg(F.sum(F.col("n") - limit).alias("limited"))


def service_breaker(failures: DataFrame, threshold: int = BREAKER_FAILURES) -> DataFrame:
    """Failures with a service, with its running count and breaker state. Only failures are
    reported to this breaker, so once open it stays open; it opens once."""
    named = failures.filter(F.col("service_name").isNotNull())
    order = ["failed_at", *RECORD, "attempt"]
    ranked = rank_within(named, order, group=["service_name"], name="__rank", identity=ATTEMPT)
    count = F.col("__rank") + 1
    return (
        ranked.withColumn("breaker_failures", count)
        .withColumn("breaker_state", F.when(count >= threshold, "OPEN").otherwise("CLOSED"))
        .withColumn("opens", count == threshold).drop("__rank")
    )


def service_states(failures: DataFrame, threshold: int = BREAKER_FAILURES) -> DataFrame:
    """Present state per service: a plain count, no order needed."""
    return failures.filter(F.col("service_name").isNotNull()).groupBy("service_name").agg(
        F.count(F.lit(1)).alias("failures"), F.max("failed_at").alias("last_failure"),
    ).withColumn("state", F.when(F.col("failures") >= threshold, "OPEN").otherwise("CLOSED"))


def poison_pills(failures: DataFrame, as_of=None, threshold: int = POISON_FAILURES,
                 cooldown: str = POISON_COOLDOWN) -> DataFrame:
    """Per record: failures, first and last time, whether it was ever found to be poison
    (enough failures when one came in) and whether it still is within the cooldown."""
    now = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    return failures.groupBy(*RECORD).agg(
        F.count(F.lit(1)).alias("failure_count"), F.min("failed_at").alias("first_failure"),
        F.max("failed_at").alias("last_failure"),
    ).withColumn("poison", F.col("failure_count") >= threshold).withColumn(
        "active", F.col("poison") & (F.col("last_failure") > now - F.expr(f"INTERVAL {cooldown}")))


def handler_status(failures: DataFrame, limit: int = MAX_ERRORS_PER_MINUTE, threshold: int = POISON_FAILURES,
                   breaker_threshold: int = BREAKER_FAILURES) -> DataFrame:
    """Error handling in one row. Each count is aggregated on its own and the partial results
    are added up, so nothing has to be joined."""
    one = F.lit(1).cast("bigint")
    records = failures.groupBy(*RECORD).agg(F.count(F.lit(1)).alias("n")).select(
        one.alias("tracked_messages"), (F.col("n") >= threshold).cast("bigint").alias("poison_pills"))
    services = service_states(failures, breaker_threshold).select(
        one.alias("active_breakers"), (F.col("state") == "OPEN").cast("bigint").alias("breaker_opens"))
    held = limited_counts(failures, limit).select(F.col("limited").alias("rate_limited"))
    parts = records.unionByName(services, allowMissingColumns=True).unionByName(held, allowMissingColumns=True)
    names = ["poison_pills", "breaker_opens", "rate_limited", "active_breakers", "tracked_messages"]
    return parts.agg(*[F.coalesce(F.sum(n), F.lit(0).cast("bigint")).alias(n) for n in names])


def running_breaker(failures: DataFrame, threshold: int = BREAKER_FAILURES) -> DataFrame:
    """(attempt, breaker_state, breaker_failures) of failures with a service: its breaker as it was when the
    failure was handled. Failures marked ``limited`` ask for the state, but do not count."""
    named = failures.filter(F.col("service_name").isNotNull())
    counts = ~F.col("limited") if "limited" in failures.columns else F.lit(True)
    narrow = named.select(*ATTEMPT, "service_name", "failed_at", counts.cast("bigint").alias("__counts"))
    order = ["failed_at", *ATTEMPT]
    ranked = rank_within(narrow, order, group=["service_name"], name="__rank")
    counted = running_total(ranked, "__counts", "__rank", ["service_name"], "breaker_failures")
    return counted.select(*ATTEMPT, "breaker_failures", F.when(
        F.col("breaker_failures") >= threshold, "OPEN").otherwise("CLOSED").alias("breaker_state"))


def failure_flags(failures: DataFrame, threshold: int = POISON_FAILURES,
                  breaker_threshold: int = BREAKER_FAILURES) -> DataFrame:
    """The last failure of each record with the flags that routing and headers read; the breaker's are those
    at the time of that failure.

    Failures that ``rate_limit`` marked as ``limited`` (where it ran before) are published
    too, but count neither towards poison nor towards the breaker. Only places are aggregated, not
    values.
    """
    tracked = ~F.col("limited") if "limited" in failures.columns else F.lit(True)
    last = measured(failures.groupBy(*RECORD).agg(
        F.count_if(tracked).alias("failure_count"), F.max(F.struct("failed_at", "attempt")).alias("__last")).select(
        *RECORD, F.col("__last.attempt").alias("attempt"), "failure_count"))
    states = running_breaker(failures, breaker_threshold)
    rows = failures.join(last, ATTEMPT).select(
        *failures.columns, "failure_count", (F.col("failure_count") >= threshold).alias("poison"))
    return rows.join(states, ATTEMPT, "left").select(*rows.columns, "breaker_state", "breaker_failures")


def quarantine(failures: DataFrame, host: str = "unknown", environment: str = "unknown",
               threshold: int = POISON_FAILURES) -> DataFrame:
    """Poison records as records of the quarantine log of their topic, with an analysis."""
    flagged = failures.groupBy(*RECORD).agg(
        F.count(F.lit(1)).alias("failureCount"), F.min("failed_at").alias("firstFailureTime"),
        F.max("failed_at").alias("lastFailureTime"),
        F.max_by(F.struct("key", "exception_class", "exception_message"), F.struct("failed_at", "attempt"))
        .alias("last")).filter(F.col("failureCount") >= threshold)
    analysis = F.to_json(F.struct(
        F.col("topic").alias("originalTopic"), F.col("partition").alias("originalPartition"),
        F.col("offset").alias("originalOffset"), "failureCount",
        F.unix_millis("firstFailureTime").alias("firstFailureTime"),
        F.unix_millis("lastFailureTime").alias("lastFailureTime"),
        F.col("last.exception_class").alias("exceptionType"),
        F.col("last.exception_message").alias("exceptionMessage"),
        F.lit(host).alias("hostname"), F.lit(environment).alias("environment")))
    return flagged.select(
        F.concat("topic", F.lit(QUARANTINE_SUFFIX)).alias("topic"), F.col("last.key").alias("key"),
        analysis.alias("value"), F.col("lastFailureTime").alias("timestamp"))
