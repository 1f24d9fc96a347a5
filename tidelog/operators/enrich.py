"""Header enrichment, message building and parsing of records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidelog import schema
from tidelog.functions.headers import add_headers, has_header, header, header_if, header_map, no_headers
from tidelog.functions.text import instant_text
from tidelog.operators.indexing import arrival_index

# Header names and texts, and what each kind of topic adds. First match wins.
SCHEMA_VERSION = "1.0"
TOPIC_HEADERS = [
    ("orders", [("x-message-type", "order"), ("x-business-domain", "commerce")]),
    ("payments", [("x-message-type", "payment"), ("x-business-domain", "finance"),
                  ("x-requires-encryption", "true")]),
    ("notifications", [("x-message-type", "notification"),
                       ("x-business-domain", "communication"), ("x-priority", "normal")]),
]
EVENT_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS"
CORRUPT = "_corrupt_record"


def enrich_headers(df: DataFrame, application: str = "event-log", version: str = "1.0.0",
                   environment: str = "unknown", as_of=None, sequence: Column | None = None) -> DataFrame:
    """Tracing and routing headers. Timestamp and correlation id are only added where they
    are missing. ``sequence`` is the message number; by default the arrival order from 1."""
    at = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    if sequence is None:
        df = arrival_index(df, "__sequence")
        sequence = F.col("__sequence") + 1
    number = sequence.cast("string")
    correlation = F.concat_ws("-", F.lit(application), F.unix_millis(at).cast("string"), number)
    topic, headers = F.col("topic"), F.col("headers")
    constant = lambda pairs: F.array(*[header(n, F.lit(t)) for n, t in pairs])
    by_topic = no_headers()
    for word, extra in reversed(TOPIC_HEADERS):
        by_topic = F.when(topic.contains(word), constant(extra)).otherwise(by_topic)
    # all but the first three arrays fold to constants at planning time
    enriched = F.concat(
        add_headers(
            headers,
            header_if(~has_header(headers, "x-timestamp"), "x-timestamp", instant_text(at)),
            header_if(~has_header(headers, "x-correlation-id"), "x-correlation-id", correlation)),
        constant([("x-application", application), ("x-version", version), ("x-environment", environment)]),
        F.array(header("x-message-sequence", number)),
        by_topic,
        constant([("x-schema-version", SCHEMA_VERSION)]),
    )
    return df.withColumn("headers", enriched).drop("__sequence")


def with_header_map(df: DataFrame, name: str = "header_map") -> DataFrame:
    return df.withColumn(name, header_map(F.col("headers")))


def _quoted(fields: Sequence[tuple[str, Column, bool]]) -> Column:
    parts = []
    for i, (name, value, text) in enumerate(fields):
        mark = '"' if text else ""
        parts.append(F.lit(("{" if i == 0 else ",") + f'"{name}":{mark}'))
        parts.append(F.coalesce(value, F.lit("null")))
        parts.append(F.lit(mark))
    return F.concat(*parts, F.lit("}"))


def money_text(amount: Column) -> Column:
    return F.format_string("%.2f", amount.cast("double"))


def order_message(order_id: Column, customer_id: Column, amount: Column, status: Column,
                  at: Column) -> Column:
    return _quoted([("orderId", order_id, True), ("customerId", customer_id, True),
                    ("amount", money_text(amount), False), ("status", status, True),
                    ("timestamp", at, True)])


def payment_message(payment_id: Column, order_id: Column, amount: Column, method: Column,
                    status: Column, at: Column) -> Column:
    return _quoted([("paymentId", payment_id, True), ("orderId", order_id, True),
                    ("amount", money_text(amount), False), ("method", method, True),
                    ("status", status, True), ("timestamp", at, True)])


def notification_message(kind: Column, recipient: Column, subject: Column, content: Column,
                         at: Column) -> Column:
    return _quoted([("type", kind, True), ("recipient", recipient, True),
                    ("subject", subject, True), ("content", content, True),
                    ("timestamp", at, True)])


def _parsed(value: Column, layout: str) -> Column:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT,
               "timestampNTZFormat": EVENT_TIME_FORMAT}
    return F.from_json(value, f"{layout}, {CORRUPT} string", options)


def parse_order(df: DataFrame, name: str = "order") -> DataFrame:
    """Typed order; text that does not parse is kept in ``_corrupt_record``."""
    return df.withColumn(name, _parsed(F.col("value"), schema.ORDER_EVENT))


def parse_payment(df: DataFrame, name: str = "payment") -> DataFrame:
    return df.withColumn(name, _parsed(F.col("value"), schema.PAYMENT_EVENT))


def parse_flat(df: DataFrame, kind: str, name: str = "message") -> DataFrame:
    """The flat messages that ``order_message`` and its like build: kind order, payment or
    notification."""
    layouts = {"order": schema.FLAT_ORDER, "payment": schema.FLAT_PAYMENT, "notification": schema.NOTIFICATION}
    return df.withColumn(name, _parsed(F.col("value"), layouts[kind]))


def parse_generic(df: DataFrame, name: str = "message") -> DataFrame:
    """Message with free-form data and metadata, kept as variants."""
    whole = F.try_parse_json(F.col("value"))
    part = lambda path, kind: F.try_variant_get(whole, path, kind)
    return df.withColumn(name, F.struct(
        part("$.type", "string").alias("type"), part("$.data", "variant").alias("data"),
        part("$.metadata", "variant").alias("metadata"),
        part("$.schema_version", "string").alias("schema_version")))


def order_items(orders: DataFrame, *keep: str) -> DataFrame:
    """One row per item (orders without items keep one row), with whether the item totals
    add up to the order total."""
    money = F.lit(0).cast("decimal(28,2)")
    items_total = F.aggregate(
        "items", money, lambda acc, i: (acc + F.coalesce(i["total_price"], F.lit(0))).cast("decimal(28,2)"))
    return orders.select(
        *keep, "total_amount", items_total.alias("items_total"),
        (items_total == F.col("total_amount")).alias("adds_up"),
        F.posexplode_outer("items").alias("position", "item"))
