"""Record filters. Each is a Column that names why a record is dropped (null = keep)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidelog.functions.headers import last_header
from tidelog.functions.text import is_blank, json_shaped, longer_than

# Markers, limits and ages the rules compare with.
TEST_MARKERS = ["TEST", "DEVELOPMENT", "DEBUG"]
TEST_KEY_PREFIX = "test-"
MAX_MESSAGE_UNITS = 1048576
MAX_RECORD_AGE = "24 hours"
MAX_FAILED_PAYMENT_AGE = "1 hour"
RECENT_FAILURE_AGE = "1 hour"
MAX_CONSUMED_UNITS = 10000


def _as_of(as_of) -> Column:
    return F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")


def _text() -> Column:
    return F.coalesce(F.col("value"), F.lit(""))


def older_than(timestamp: Column, age: str, as_of=None) -> Column:
    return timestamp < _as_of(as_of) - F.expr(f"INTERVAL {age}")


def test_record() -> Column:
    marks = [_text().contains(m) for m in TEST_MARKERS]
    by_key = F.coalesce(F.col("key").startswith(TEST_KEY_PREFIX), F.lit(False))
    return reduce(lambda a, b: a | b, [*marks, by_key])


def invalid_reason() -> Column:
    value = F.col("value")
    return (
        F.when(value.isNull(), "NULL_VALUE")
        .when(is_blank(value), "BLANK")
        .when(longer_than(value, MAX_MESSAGE_UNITS), "TOO_LARGE")
        .when(~json_shaped(value), "NOT_JSON")
    )


def business_reason(as_of=None, strict: bool = False) -> Column:
    """``strict`` reads the amount as a number; the default looks for its text only, so that
    0.99 is dropped along with 0."""
    topic, value = F.col("topic"), _text()
    if strict:
        amount = F.get_json_object(value, "$.amount").try_cast("decimal(38,10)")
        zero = F.coalesce(amount == 0, F.lit(False))
    else:
        zero = value.contains('"amount":0') | value.contains('"amount":"0"')
    return (
        F.when(topic.contains("orders") & value.contains('"status":"CANCELLED"'), "CANCELLED_ORDER")
        .when(topic.contains("payments") & zero, "ZERO_PAYMENT")
        .when(older_than(F.col("timestamp"), MAX_RECORD_AGE, as_of), "TOO_OLD")
    )


def composite_reason(as_of=None, strict: bool = False) -> Column:
    """First of test, invalid, business that applies."""
    return (
        F.when(test_record(), "TEST")
        .when(invalid_reason().isNotNull(), "INVALID")
        .when(business_reason(as_of, strict).isNotNull(), "BUSINESS")
    )


def order_reason() -> Column:
    value = _text()
    return F.when(value.contains('"status":"DRAFT"'), "DRAFT_ORDER").when(
        ~value.contains("customerId") | value.contains('"customerId":null'), "NO_CUSTOMER"
    )


def payment_reason(as_of=None) -> Column:
    stale = older_than(F.col("timestamp"), MAX_FAILED_PAYMENT_AGE, as_of)
    return F.when(_text().contains('"status":"FAILED"') & stale, "STALE_FAILED_PAYMENT")


def notification_reason() -> Column:
    value = _text()
    return F.when(
        ~value.contains("recipient") | value.contains('"recipient":null'), "NO_RECIPIENT"
    )


def topic_reason(as_of=None) -> Column:
    topic = F.col("topic")
    return (
        F.when(topic.contains("orders"), order_reason())
        .when(topic.contains("payments"), payment_reason(as_of))
        .when(topic.contains("notifications"), notification_reason())
    )


def keep(df: DataFrame, reason: Column) -> DataFrame:
    return df.filter(reason.isNull())


def with_reason(df: DataFrame, reason: Column, name: str = "reason") -> DataFrame:
    return df.withColumn(name, reason)


def reason_counts(df: DataFrame, reason: Column, *by: str) -> DataFrame:
    return df.groupBy(*by, F.coalesce(reason, F.lit("KEEP")).alias("reason")).agg(
        F.count(F.lit(1)).alias("records")
    )


def filter_stats(df: DataFrame, as_of=None, *by: str) -> DataFrame:
    """Dropped records in total and by family."""
    reasons = df.select(*by, composite_reason(as_of).alias("reason"))
    agg = (
        F.count("reason").alias("total_filtered"),
        F.count_if(F.col("reason") == "TEST").alias("test_filtered"),
        F.count_if(F.col("reason") == "INVALID").alias("invalid_filtered"),
        F.count_if(F.col("reason") == "BUSINESS").alias("business_filtered"),
    )
    return reasons.groupBy(*by).agg(*agg)


def dead_letter_match(kind: str | None, as_of=None, strict: bool = False) -> Column:
    """Predicate on the headers of a dead-letter record; unknown kinds match everything.

    ``recoverable`` is a substring test and so also matches non-recoverable failures;
    ``strict`` excludes those.
    """
    headers = F.col("headers")
    error_class = last_header(headers, "dlt.exception-class")
    name = (kind or "").lower()
    if name == "validation":
        hit = error_class.contains("ValidationException")
    elif name == "recoverable":
        hit = error_class.contains("RecoverableException")
        if strict:
            hit = hit & ~error_class.contains("NonRecoverableException")
    elif name == "poison-pill":
        hit = last_header(headers, "dlt.enhanced.poison.pill") == "true"
    elif name == "circuit-breaker":
        hit = last_header(headers, "dlt.enhanced.circuit.breaker.service").isNotNull()
    elif name == "recent":
        stamped = F.try_to_timestamp(last_header(headers, "dlt.enhanced.timestamp"))
        hit = stamped > _as_of(as_of) - F.expr(f"INTERVAL {RECENT_FAILURE_AGE}")
    else:
        return F.lit(True)
    return F.coalesce(hit, F.lit(False))


def message_error(value: Column, kind: str | Column) -> Column:
    """Why a consumed message is refused, as text (null = fine)."""
    label = F.lit(kind) if isinstance(kind, str) else kind
    return F.when(is_blank(value), F.concat(label, F.lit(" message cannot be null or empty"))).when(
        longer_than(value, MAX_CONSUMED_UNITS),
        F.concat(label, F.lit(" message exceeds maximum size limit")),
    )


def request_error(identifier: Column, label: str) -> Column:
    return F.when(is_blank(identifier), F.lit(f"{label} ID is required"))
