"""Queries of the filter family."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.operators import filters
from tidelog.plans.registry import query
from tidelog.sources.derive import AS_OF, Tables

_ID = ["topic", "partition", "offset"]
_SQL_ID = 'topic, p AS "partition", o AS "offset"'

_TEXT = "coalesce(value, '')"
_TEST = f"""(contains({_TEXT}, 'TEST') OR contains({_TEXT}, 'DEVELOPMENT')
  OR contains({_TEXT}, 'DEBUG') OR coalesce(starts_with(key, 'test-'), false))"""
_TRIMMED = "trim(value)"
_INVALID = f"""CASE WHEN value IS NULL THEN 'NULL_VALUE' WHEN {_TRIMMED} = '' THEN 'BLANK'
  WHEN length(value) > 1048576 THEN 'TOO_LARGE'
  WHEN NOT ((starts_with({_TRIMMED}, '{{') AND ends_with({_TRIMMED}, '}}'))
         OR (starts_with({_TRIMMED}, '[') AND ends_with({_TRIMMED}, ']'))) THEN 'NOT_JSON' END"""
_AS_OF_SQL = f"TIMESTAMP '{AS_OF}'"
_BUSINESS = f"""CASE
  WHEN contains(topic, 'orders') AND contains({_TEXT}, '"status":"CANCELLED"') THEN 'CANCELLED_ORDER'
  WHEN contains(topic, 'payments') AND (contains({_TEXT}, '"amount":0')
    OR contains({_TEXT}, '"amount":"0"')) THEN 'ZERO_PAYMENT'
  WHEN {_AS_OF_SQL} - ts > INTERVAL 24 HOUR THEN 'TOO_OLD' END"""
COMPOSITE = f"""CASE WHEN {_TEST} THEN 'TEST' WHEN ({_INVALID}) IS NOT NULL THEN 'INVALID'
  WHEN ({_BUSINESS}) IS NOT NULL THEN 'BUSINESS' END"""


@query("filter_test", "logs", f"SELECT {_SQL_ID}, {_TEST} AS dropped FROM logs")
def filter_test(t: Tables):
    return t.all_logs().select(*_ID, filters.test_record().alias("dropped"))


@query("filter_invalid", "logs", f"SELECT {_SQL_ID}, {_INVALID} AS reason FROM logs")
def filter_invalid(t: Tables):
    return t.all_logs().select(*_ID, filters.invalid_reason().alias("reason"))


@query("filter_business", "logs", f"SELECT {_SQL_ID}, {_BUSINESS} AS reason FROM logs")
def filter_business(t: Tables):
    return t.all_logs().select(*_ID, filters.business_reason(AS_OF).alias("reason"))


@query("filter_composite", "logs", f"""SELECT topic, coalesce({COMPOSITE}, 'KEEP') AS reason,
  count(*) AS records FROM logs GROUP BY ALL""")
def filter_composite(t: Tables):
    return filters.reason_counts(t.all_logs(), filters.composite_reason(AS_OF), "topic")


@query("filter_stats", "logs", f"""SELECT count(reason) AS total_filtered,
  count(*) FILTER (reason = 'TEST') AS test_filtered,
  count(*) FILTER (reason = 'INVALID') AS invalid_filtered,
  count(*) FILTER (reason = 'BUSINESS') AS business_filtered
  FROM (SELECT {COMPOSITE} AS reason FROM logs)""")
def filter_stats(t: Tables):
    return filters.filter_stats(t.all_logs(), AS_OF)


@query("filter_topic_specific", "logs", f"""SELECT {_SQL_ID}, CASE
  WHEN contains(topic, 'orders') THEN CASE
    WHEN contains({_TEXT}, '"status":"DRAFT"') THEN 'DRAFT_ORDER'
    WHEN NOT contains({_TEXT}, 'customerId') OR contains({_TEXT}, '"customerId":null')
      THEN 'NO_CUSTOMER' END
  WHEN contains(topic, 'payments') THEN CASE
    WHEN contains({_TEXT}, '"status":"FAILED"') AND {_AS_OF_SQL} - ts > INTERVAL 1 HOUR
      THEN 'STALE_FAILED_PAYMENT' END
  WHEN contains(topic, 'notifications') THEN CASE
    WHEN NOT contains({_TEXT}, 'recipient') OR contains({_TEXT}, '"recipient":null')
      THEN 'NO_RECIPIENT' END END AS reason FROM logs""")
def filter_topic_specific(t: Tables):
    return t.all_logs().select(*_ID, filters.topic_reason(AS_OF).alias("reason"))


@query("validate_message", "logs payloads", f"""SELECT topic, o AS "offset",
  CASE WHEN value IS NULL OR regexp_full_match(value, '[\\x00-\\x20]*')
    THEN 'order message cannot be null or empty'
  WHEN length(value) > 10000 THEN 'order message exceeds maximum size limit' END AS error
  FROM (SELECT topic, o, value FROM logs WHERE topic = 'orders-topic'
        UNION ALL SELECT topic, o, value FROM payloads)""")
def validate_message(t: Tables):
    rows = t.orders_log().unionByName(t.payloads())
    return rows.select("topic", "offset", filters.message_error(F.col("value"), "order").alias("error"))


@query("validate_request", "orders_log", """SELECT p AS "partition", o AS "offset",
  CASE WHEN key IS NULL OR trim(key) = '' THEN 'Order ID is required' END AS error
  FROM orders_log""")
def validate_request(t: Tables):
    return t.orders_log().select(
        "partition", "offset", filters.request_error(F.col("key"), "Order").alias("error"))
