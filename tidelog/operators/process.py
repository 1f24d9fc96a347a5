"""Validation of typed events, processing by topic, outcomes and their statistics."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidelog import schema
from tidelog.functions.text import is_blank
from tidelog.operators.filters import message_error
from tidelog.operators.sizes import POLL_SIZE, micro_batches

# Limits, marker texts, rules and prefixes of the processing rules.
LEAST_PRICE = "0.01"
ORDER_LIMIT = 10000
RETRY_MARKERS = [("orders", "RETRY_ERROR", "Simulated recoverable error for testing"),
                 ("payments", "PAYMENT_SERVICE_DOWN", "Payment service temporarily unavailable")]
BATCH_MIN_SUCCESS = 0.9
RATE_EPSILON = 0.001
MAX_ERROR_RATE = 0.05
BACKLOG_SHARE = 0.9
BACKLOG_CAPACITY = 1000
MAX_HEALTHY_LAG = 1000


# ---- constraints of typed events ---------------------------------------------------

def _violations(*rules: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), name) for bad, name in rules]))


def _below(c: Column, least: str) -> Column:
    return c < F.lit(least).cast("decimal(18,2)")


def order_violations() -> Column:
    """Names of the broken constraints of a typed order and its items."""
    c = F.col
    any_item = lambda test: F.exists("items", test)
    return _violations(
        (is_blank(c("order_id")), "order_id is blank"),
        (is_blank(c("customer_id")), "customer_id is blank"),
        (c("status").isNull(), "status is null"),
        (c("items").isNull(), "items is null"),
        (F.size("items") == 0, "items is empty"),
        (c("total_amount").isNull(), "total_amount is null"),
        (_below(c("total_amount"), LEAST_PRICE), "total_amount is not positive"),
        (c("order_timestamp").isNull(), "order_timestamp is null"),
        (any_item(lambda i: is_blank(i["product_id"])), "item product_id is blank"),
        (any_item(lambda i: is_blank(i["product_name"])), "item product_name is blank"),
        (any_item(lambda i: i["quantity"].isNull()), "item quantity is null"),
        (any_item(lambda i: i["quantity"] < 1), "item quantity is below 1"),
        (any_item(lambda i: i["unit_price"].isNull()), "item unit_price is null"),
        (any_item(lambda i: _below(i["unit_price"], LEAST_PRICE)), "item unit_price is not positive"),
        (any_item(lambda i: i["total_price"].isNull()), "item total_price is null"),
        (any_item(lambda i: _below(i["total_price"], LEAST_PRICE)), "item total_price is not positive"),
    )


def payment_violations() -> Column:
    c = F.col
    return _violations(
        (is_blank(c("payment_id")), "payment_id is blank"),
        (is_blank(c("order_id")), "order_id is blank"),
        (is_blank(c("customer_id")), "customer_id is blank"),
        (c("status").isNull(), "status is null"),
        (c("amount").isNull(), "amount is null"),
        (_below(c("amount"), LEAST_PRICE), "amount is not positive"),
        (is_blank(c("currency")), "currency is blank"),
        (c("payment_method").isNull(), "payment_method is null"),
        (c("payment_method").isNotNull() & c("payment_method.type").isNull(), "payment type is null"),
        (c("payment_timestamp").isNull(), "payment_timestamp is null"),
    )


# ---- actions by status ---------------------------------------------------------------

def _by_status(kind: str, known: list[str], without_action: list[str]) -> tuple[Column, Column]:
    status = F.col("status")
    handled = [s for s in known if s not in without_action]
    action = F.when(status.isin(handled), F.concat(F.lit(f"{kind.upper()}_"), status))
    error = F.when(status.isNull(), f"Unexpected error processing {kind}: status is null").when(
        ~status.isin(handled), F.concat(F.lit(f"Unknown {kind} status: "), status))
    return action, error


def order_actions(orders: DataFrame) -> DataFrame:
    """``action`` by status, or ``error``: unknown status, or a pending order above the limit."""
    action, error = _by_status("order", schema.ORDER_STATUSES, [])
    over = (F.col("status") == "PENDING") & (F.col("total_amount") > ORDER_LIMIT)
    error = F.when(over, F.concat(F.lit("Order amount exceeds limit: "), F.col("total_amount"))).otherwise(error)
    return orders.withColumn("error", error).withColumn("action", F.when(F.col("error").isNull(), action))


def payment_actions(payments: DataFrame) -> DataFrame:
    """As for orders; a partial refund is a known status that nothing handles."""
    action, error = _by_status("payment", schema.PAYMENT_STATUSES, ["PARTIALLY_REFUNDED"])
    return payments.withColumn("error", error).withColumn("action", F.when(F.col("error").isNull(), action))


# ---- processing by topic ---------------------------------------------------------------

@dataclass(frozen=True)
class Processor:
    """What a topic does with its messages: a Column function (a pandas UDF will do as
    well) and the rule that a blank message breaks."""

    run: Callable[[Column], Column]
    rule: str
    blank_text: str


def prefixing(prefix: str) -> Callable[[Column], Column]:
    return lambda value: F.concat(F.lit(prefix), value)


PROCESSORS: Mapping[str, Processor] = {
    "orders-topic": Processor(prefixing("PROCESSED_ORDER_"), "NON_EMPTY_ORDER", "Empty order message"),
    "payments-topic": Processor(prefixing("PROCESSED_PAYMENT_"), "NON_EMPTY_PAYMENT", "Empty payment message"),
    "*": Processor(prefixing("PROCESSED_"), "NON_EMPTY_MESSAGE", "Empty message"),
}


def process_by_topic(df: DataFrame, processors: Mapping[str, Processor] = PROCESSORS) -> DataFrame:
    """Adds ``result``, or ``error_message`` and ``error_rule`` where the message is blank."""
    value, default = F.col("value"), processors["*"]

    def pick(of: Callable[[Processor], Column]) -> Column:
        chosen = of(default)
        for topic, processor in processors.items():
            if topic != "*":
                chosen = F.when(F.col("topic") == topic, of(processor)).otherwise(chosen)
        return chosen

    blank = is_blank(value)
    return (
        df.withColumn("error_rule", F.when(blank, pick(lambda p: F.lit(p.rule))))
        .withColumn("error_message", F.when(blank, pick(lambda p: F.lit(p.blank_text))))
        .withColumn("result", F.when(~blank, pick(lambda p: p.run(value))))
    )


# ---- outcomes ----------------------------------------------------------------------------

def outcome(df: DataFrame) -> DataFrame:
    """What consuming each record leads to: ``outcome``, ``acked``, ``failed``, ``error_message``.

    Refused orders and payments are acknowledged and do not count as failed; temporary
    failures are neither acknowledged nor done. Notifications always go through.
    """
    topic, value = F.col("topic"), F.coalesce(F.col("value"), F.lit(""))
    refusal, trouble = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, marker, message in reversed(RETRY_MARKERS):
        mine = topic.contains(word)
        refusal = F.when(mine, message_error(F.col("value"), word[:-1])).otherwise(refusal)
        trouble = F.when(mine, F.when(value.contains(marker), message)).otherwise(trouble)
    result = F.when(F.col("__refusal").isNotNull(), "NON_RETRYABLE").when(
        F.col("__trouble").isNotNull(), "RETRYABLE").otherwise("PROCESSED")
    return (
        df.withColumn("__refusal", refusal).withColumn("__trouble", trouble)
        .withColumn("outcome", result)
        .withColumn("acked", F.col("outcome") != "RETRYABLE")
        .withColumn("failed", F.col("outcome") == "RETRYABLE")
        .withColumn("error_message", F.coalesce("__refusal", "__trouble"))
        .drop("__refusal", "__trouble")
    )


def consumer_health(outcomes: DataFrame, *by: str) -> DataFrame:
    result = F.col("outcome")
    return outcomes.groupBy(*by).agg(
        F.count_if(result == "PROCESSED").alias("processed"),
        F.count_if(F.col("failed")).alias("failed"),
        F.count_if(result == "RETRYABLE").alias("retryable_errors"),
        F.count_if(result == "NON_RETRYABLE").alias("non_retryable_errors"),
    )


def success_rate(good: Column, bad: Column) -> Column:
    return good / (good + bad + F.lit(RATE_EPSILON))


def producer_health(sends: DataFrame, ok: Column, *by: str, duration_ms: Column | None = None) -> DataFrame:
    """Sent, failed, success rate, and mean time where durations are known."""
    duration = F.lit(None).cast("double") if duration_ms is None else duration_ms
    return sends.groupBy(*by).agg(
        F.count_if(ok).alias("sent"), F.count_if(~ok).alias("failed"),
        success_rate(F.count_if(ok), F.count_if(~ok)).alias("success_rate"),
        F.avg(duration).alias("mean_ms"))


def topic_metrics(df: DataFrame, *tags: str) -> DataFrame:
    """Counts by all tags, and the grand total in the row whose tags are all null."""
    return (
        df.rollup(F.struct(*tags).alias("tags")).agg(F.count(F.lit(1)).alias("records"))
        .select(*[F.col(f"tags.{t}").alias(t) for t in tags],
                F.col("tags").isNull().alias("is_total"), "records")
    )


# ---- batches -------------------------------------------------------------------------------

def batch_size_range(size: Column) -> Column:
    return (F.when(size <= 10, "small").when(size <= 100, "medium")
            .when(size <= 500, "large").otherwise("extra-large"))


def batch_outcome(outcomes: DataFrame, poll_size: int = POLL_SIZE) -> DataFrame:
    """Accept an order batch with at least 90 % processed; a payment batch as a whole (its
    messages are not looked at); notification batches always."""
    batches = micro_batches(outcomes, poll_size).groupBy("topic", "partition", "batch").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("outcome") == "PROCESSED").alias("good"))
    order = F.col("topic").contains("orders")
    processed = F.when(order, F.col("good")).otherwise(F.col("total"))
    return batches.select(
        "topic", "partition", "batch", "total", processed.alias("processed"),
        (F.col("total") - processed).alias("failed"),
        (processed / F.col("total") >= BATCH_MIN_SUCCESS).alias("accepted"),
        batch_size_range(F.col("total")).alias("size_range"))


def batch_health(batches: DataFrame, *by: str) -> DataFrame:
    """A failed batch counts once."""
    good, bad = F.count_if(F.col("accepted")), F.count_if(~F.col("accepted"))
    return batches.groupBy(*by).agg(
        good.alias("batches_processed"), bad.alias("batches_failed"),
        F.sum("processed").alias("messages"), success_rate(good, bad).alias("batch_success_rate"))


# ---- processor statistics ------------------------------------------------------------------

def processor_stats(statuses: DataFrame, *by: str) -> DataFrame:
    """Counts by status; the error rate divides by the successes only, 0 if there are none."""
    good = F.count_if(F.col("status") == "SUCCESS")
    bad = F.count_if(F.col("status") == "ERROR")
    return statuses.groupBy(*by).agg(
        good.alias("processed"), bad.alias("errors"),
        F.count_if(F.col("status") == "REJECTED").alias("rejected"),
        F.when(good > 0, bad / good).otherwise(F.lit(0.0)).alias("error_rate"))


def stage_health(stats: DataFrame, backlog: Column, breaker_open: Column,
                 capacity: int = BACKLOG_CAPACITY) -> DataFrame:
    """Healthy: few errors, backlog below nine tenths of what fits, breaker not open."""
    return (
        stats.withColumn("errors_ok", F.col("error_rate") < MAX_ERROR_RATE)
        .withColumn("backlog_ok", backlog < capacity * BACKLOG_SHARE)
        .withColumn("breaker_ok", ~breaker_open)
        .withColumn("healthy", F.col("errors_ok") & F.col("backlog_ok") & F.col("breaker_ok"))
    )


def lag_health(error_rate: Column, max_lag: Column) -> Column:
    return (error_rate < MAX_ERROR_RATE) & (max_lag < MAX_HEALTHY_LAG)
