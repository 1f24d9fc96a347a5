"""Queries of enrichment, validation, processing and their statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.functions.headers import add_headers, header_if
from tidelog.functions.text import instant_text
from tidelog.operators import enrich, process
from tidelog.plans.registry import query
from tidelog.sources.derive import AS_OF, Tables

_ID = ["topic", "partition", "offset"]
_SQL_ID = 'topic, p AS "partition", o AS "offset"'
_AS_OF_MS = "1706659200000"


@query("enrich_headers", "logs", f"""SELECT {_SQL_ID}, seq AS sequence,
  CASE WHEN key IS NULL THEN 'given' ELSE 'event-log-{_AS_OF_MS}-' || seq END AS correlation,
  '2024-01-31T00:00:00.000Z' AS stamped,
  CASE WHEN topic = 'orders-topic' THEN 'order' WHEN topic = 'payments-topic' THEN 'payment'
    ELSE 'notification' END AS message_type,
  CASE WHEN topic = 'payments-topic' THEN 'true' END AS encryption,
  CASE WHEN topic = 'notifications-topic' THEN 'normal' END AS priority,
  CAST(7 + CASE WHEN topic = 'orders-topic' THEN 2 ELSE 3 END
    + CASE WHEN topic = 'notifications-topic' THEN 0 WHEN k % 11 = 0 THEN 2 ELSE 1 END
    AS INTEGER) AS header_count
  FROM (SELECT *, row_number() OVER (ORDER BY ts, topic, p, o) AS seq FROM logs)""")
def enrich_headers(t: Tables):
    given = header_if(F.col("key").isNull(), "x-correlation-id", F.lit("given"))
    rows = t.all_logs().drop("value").withColumn("headers", add_headers(F.col("headers"), given))
    done = enrich.with_header_map(enrich.enrich_headers(rows, as_of=AS_OF), "map")
    text = lambda name: F.try_element_at("map", F.lit(name))
    return done.select(
        *_ID, text("x-message-sequence").cast("bigint").alias("sequence"),
        text("x-correlation-id").alias("correlation"), text("x-timestamp").alias("stamped"),
        text("x-message-type").alias("message_type"), text("x-requires-encryption").alias("encryption"),
        text("x-priority").alias("priority"), F.size("headers").alias("header_count"))


@query("header_map", "orders_log payments_log payloads", f"""SELECT topic, p AS "partition", o AS "offset", name, text FROM (
    SELECT topic, p, o, 'source' AS name, CASE WHEN k % 11 = 0 THEN 'batch' ELSE 'web' END AS text
    FROM (SELECT topic, p, o, k FROM orders_log UNION ALL SELECT topic, p, o, k FROM payments_log)
  UNION ALL SELECT 'documents-topic', CAST(doc_id % 3 AS INTEGER), doc_id // 3, 'lang', lang FROM documents
  UNION ALL SELECT 'documents-topic', CAST(doc_id % 3 AS INTEGER), doc_id // 3, 'source', source FROM documents)""")
def header_map(t: Tables):
    rows = t.orders_log().unionByName(t.payments_log()).unionByName(t.payloads())
    return enrich.with_header_map(rows).select(*_ID, F.explode("header_map").alias("name", "text"))


_BLANK = "(value IS NULL OR trim(value) = '')"
_LOGS3 = "CASE WHEN topic = 'orders-topic' THEN '{}' WHEN topic = 'payments-topic' THEN '{}' ELSE '{}' END"


@query("process_by_topic", "logs", f"""SELECT {_SQL_ID},
  CASE WHEN {_BLANK} THEN {_LOGS3.format('NON_EMPTY_ORDER', 'NON_EMPTY_PAYMENT', 'NON_EMPTY_MESSAGE')} END AS error_rule,
  CASE WHEN {_BLANK} THEN {_LOGS3.format('Empty order message', 'Empty payment message', 'Empty message')} END AS error_message,
  CASE WHEN NOT {_BLANK} THEN {_LOGS3.format('PROCESSED_ORDER_', 'PROCESSED_PAYMENT_', 'PROCESSED_')} || value END AS result
  FROM logs""")
def process_by_topic(t: Tables):
    return process.process_by_topic(t.all_logs()).select(*_ID, "error_rule", "error_message", "result")


@query("validate_order", "order_events items", """SELECT e.k, concat_ws('; ',
    CASE WHEN trim(order_id) = '' THEN 'order_id is blank' END,
    CASE WHEN status IS NULL THEN 'status is null' END,
    CASE WHEN i.k IS NULL THEN 'items is empty' END,
    CASE WHEN total_amount < 0.01 THEN 'total_amount is not positive' END,
    CASE WHEN low_quantity THEN 'item quantity is below 1' END,
    CASE WHEN low_unit THEN 'item unit_price is not positive' END,
    CASE WHEN low_total THEN 'item total_price is not positive' END) AS violations
  FROM order_events e LEFT JOIN (SELECT k, bool_or(quantity < 1) AS low_quantity,
    bool_or(unit_price < 0.01) AS low_unit, bool_or(total_price < 0.01) AS low_total
    FROM items GROUP BY k) i ON e.k = i.k""")
def validate_order(t: Tables):
    return t.order_events().select(
        "k", F.array_join(process.order_violations(), "; ").alias("violations"))


@query("validate_payment", "", """SELECT o_orderkey AS k, concat_ws('; ',
    CASE WHEN o_orderkey % 47 = 0 THEN 'order_id is blank' END,
    CASE WHEN o_orderkey % 30 = 0 OR CAST(o_totalprice AS DECIMAL(18,2)) < 0.01
      THEN 'amount is not positive' END,
    CASE WHEN o_orderkey % 61 = 0 THEN 'currency is blank' END,
    CASE WHEN o_orderkey % 59 = 0 THEN 'payment_method is null' END,
    CASE WHEN o_orderkey % 59 <> 0 AND o_orderkey % 31 = 0 THEN 'payment type is null' END)
    AS violations FROM orders""")
def validate_payment(t: Tables):
    return t.payment_events().select(
        "k", F.array_join(process.payment_violations(), "; ").alias("violations"))


@query("order_actions", "order_events", """SELECT k,
  CASE WHEN status = 'PENDING' AND total_amount > 10000 THEN 'Order amount exceeds limit: ' || total_amount
    WHEN status IS NULL THEN 'Unexpected error processing order: status is null'
    WHEN status = 'LOST' THEN 'Unknown order status: LOST' END AS error,
  CASE WHEN status = 'PENDING' AND total_amount > 10000 OR status = 'LOST' THEN NULL
    ELSE 'ORDER_' || status END AS action FROM order_events""")
def order_actions(t: Tables):
    return process.order_actions(t.order_events()).select("k", "error", "action")


@query("payment_actions", "", """SELECT k,
  CASE WHEN status = 'PARTIALLY_REFUNDED' THEN 'Unknown payment status: ' || status END AS error,
  CASE WHEN status <> 'PARTIALLY_REFUNDED' THEN 'PAYMENT_' || status END AS action
  FROM (SELECT o_orderkey AS k, ['PENDING','PROCESSING','COMPLETED','FAILED','CANCELLED','REFUNDED',
    'PARTIALLY_REFUNDED'][o_orderkey % 7 + 1] AS status FROM orders)""")
def payment_actions(t: Tables):
    return process.payment_actions(t.payment_events()).select("k", "error", "action")


_REFUSED = """(topic <> 'notifications-topic' AND (value IS NULL OR trim(value) = '' OR length(value) > 10000))"""
_TROUBLE = """((topic = 'orders-topic' AND contains(coalesce(value, ''), 'RETRY_ERROR'))
  OR (topic = 'payments-topic' AND contains(coalesce(value, ''), 'PAYMENT_SERVICE_DOWN')))"""
_OUTCOME = f"CASE WHEN {_REFUSED} THEN 'NON_RETRYABLE' WHEN {_TROUBLE} THEN 'RETRYABLE' ELSE 'PROCESSED' END"


@query("outcome", "logs", f"""SELECT {_SQL_ID}, outcome, outcome <> 'RETRYABLE' AS acked,
  outcome = 'RETRYABLE' AS failed,
  CASE WHEN outcome = 'NON_RETRYABLE' THEN CASE topic WHEN 'orders-topic' THEN 'order' ELSE 'payment' END
      || ' message cannot be null or empty'
    WHEN outcome = 'RETRYABLE' AND topic = 'orders-topic' THEN 'Simulated recoverable error for testing'
    WHEN outcome = 'RETRYABLE' THEN 'Payment service temporarily unavailable' END AS error_message
  FROM (SELECT *, {_OUTCOME} AS outcome FROM logs)""")
def outcome(t: Tables):
    return process.outcome(t.all_logs()).select(*_ID, "outcome", "acked", "failed", "error_message")


@query("parse_order", "order_events items", """SELECT e.k, k % 29 = 0 AS corrupt,
  CASE WHEN k % 29 <> 0 THEN order_id END AS order_id, CASE WHEN k % 29 <> 0 THEN status END AS status,
  CASE WHEN k % 29 <> 0 THEN total_amount END AS total_amount,
  CASE WHEN k % 29 <> 0 THEN (epoch_us(o_orderdate) // 1000) ELSE -1 END AS placed_ms,
  CASE WHEN k % 29 <> 0 THEN CAST((SELECT count(*) FROM items i WHERE i.k = e.k) AS INTEGER) ELSE -1 END AS item_count
  FROM order_events e""")
def parse_order(t: Tables):
    """Typed orders written as JSON, every 29th cut off, then parsed."""
    text = F.to_json(
        F.struct("order_id", "customer_id", "status", "items", "total_amount", "order_timestamp"),
        {"timestampNTZFormat": enrich.EVENT_TIME_FORMAT})
    broken = F.when(F.col("k") % 29 == 0, F.expr("left(value, 20)")).otherwise(F.col("value"))
    rows = t.order_events().select("k", text.alias("value")).select("k", broken.alias("value"))
    corrupt = F.col(f"order.{enrich.CORRUPT}").isNotNull()
    good = lambda c: F.when(~corrupt, c)
    return enrich.parse_order(rows).select(
        "k", corrupt.alias("corrupt"), good(F.col("order.order_id")).alias("order_id"),
        good(F.col("order.status")).alias("status"), good(F.col("order.total_amount")).alias("total_amount"),
        F.coalesce(good(F.unix_millis(F.col("order.order_timestamp").cast("timestamp"))), F.lit(-1)).alias("placed_ms"),
        F.coalesce(good(F.size("order.items")), F.lit(-1)).alias("item_count"))


@query("parse_payment", "", """SELECT o_orderkey AS k,
  CASE WHEN o_orderkey % 47 = 0 THEN '' ELSE 'ORD-' || o_orderkey END AS order_id,
  CAST(CASE WHEN o_orderkey % 30 = 0 THEN 0 ELSE o_totalprice END AS DECIMAL(18,2)) AS amount,
  CASE WHEN o_orderkey % 59 <> 0 AND o_orderkey % 31 <> 0 THEN 'CREDIT_CARD' END AS type,
  (epoch_us(o_orderdate) // 1000) AS paid_ms FROM orders""")
def parse_payment(t: Tables):
    text = F.to_json(
        F.struct("payment_id", "order_id", "customer_id", "status", "amount", "currency",
                 "payment_method", "payment_timestamp"), {"timestampNTZFormat": enrich.EVENT_TIME_FORMAT})
    parsed = enrich.parse_payment(t.payment_events().select("k", text.alias("value")))
    return parsed.select(
        "k", "payment.order_id", "payment.amount", F.col("payment.payment_method.type").alias("type"),
        F.unix_millis(F.col("payment.payment_timestamp").cast("timestamp")).alias("paid_ms"))


@query("parse_flat", "", """SELECT o_orderkey AS k, 'ORD-' || o_orderkey AS order_id, 'CUST-' || o_custkey AS customer_id,
  CAST(o_totalprice AS DECIMAL(18,2)) AS amount, o_orderstatus AS status FROM orders""")
def parse_flat(t: Tables):
    text = enrich.order_message(F.concat(F.lit("ORD-"), "o_orderkey"), F.concat(F.lit("CUST-"), "o_custkey"),
                                F.col("o_totalprice"), F.col("o_orderstatus"), F.lit("2024-01-31T00:00:00.000Z"))
    rows = enrich.parse_flat(t.table("orders").select(F.col("o_orderkey").alias("k"), text.alias("value")), "order")
    return rows.select("k", F.col("message.orderId").alias("order_id"), F.col("message.customerId").alias("customer_id"),
                       F.col("message.amount").cast("decimal(18,2)").alias("amount"), "message.status")


@query("parse_generic", "", """SELECT event_id AS k, CASE WHEN event_id % 31 <> 0 THEN event_type END AS type,
  CASE WHEN event_id % 31 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) ELSE -1 END AS data_k,
  CASE WHEN event_id % 31 <> 0 THEN '1.0' END AS schema_version FROM events""")
def parse_generic(t: Tables):
    text = F.concat(F.lit('{"type":"'), "event_type", F.lit('","data":'), "props",
                    F.lit(',"metadata":{},"schema_version":"1.0"}'))
    rows = t.table("events").select("event_id", "event_type", "props").select(
        F.col("event_id").alias("k"),
        F.when(F.col("event_id") % 31 == 0, "{broken").otherwise(text).alias("value"))
    return enrich.parse_generic(rows).select(
        "k", "message.type", F.coalesce(F.try_variant_get("message.data", "$.k", "bigint"), F.lit(-1)).alias("data_k"),
        "message.schema_version")


@query("order_items", "order_events items", """SELECT e.k, e.total_amount,
  CAST(coalesce(s.total, 0) AS DECIMAL(18,2)) AS items_total,
  coalesce(s.total, 0) = e.total_amount AS adds_up, coalesce(i.pos, -1) AS "position", i.product_id,
  coalesce(i.quantity, -1) AS quantity, i.total_price FROM order_events e LEFT JOIN (SELECT k, sum(total_price) AS total FROM items GROUP BY k) s ON s.k = e.k
  LEFT JOIN items i ON i.k = e.k""")
def order_items(t: Tables):
    rows = enrich.order_items(t.order_events(), "k")
    return rows.select("k", "total_amount", F.col("items_total").cast("decimal(18,2)").alias("items_total"),
                       "adds_up", F.coalesce("position", F.lit(-1)).alias("position"), "item.product_id",
                       F.coalesce("item.quantity", F.lit(-1)).alias("quantity"), "item.total_price")


_NOW_TEXT = "2024-01-31T00:00:00.000Z"


@query("build_messages", "", f"""SELECT 'order' AS kind, o_orderkey AS k,
    '{{"orderId":"ORD-' || o_orderkey || '","customerId":"CUST-' || o_custkey || '","amount":'
    || CAST(o_totalprice AS DECIMAL(18,2)) || ',"status":"' || o_orderstatus || '","timestamp":"{_NOW_TEXT}"}}' AS message
  FROM orders
  UNION ALL SELECT 'payment', o_orderkey, '{{"paymentId":"PAY-' || o_orderkey || '","orderId":"ORD-' || o_orderkey
    || '","amount":' || CAST(o_totalprice AS DECIMAL(18,2)) || ',"method":"CARD","status":"' || o_orderstatus
    || '","timestamp":"{_NOW_TEXT}"}}' FROM orders
  UNION ALL SELECT 'notification', event_id, '{{"type":"' || event_type || '","recipient":"user-' || user_id
    || '","subject":"event ' || event_id || '","content":"notice","timestamp":"{_NOW_TEXT}"}}' FROM events""")
def build_messages(t: Tables):
    at = instant_text(F.lit(AS_OF).cast("timestamp"))
    oid, orders = F.concat(F.lit("ORD-"), "o_orderkey"), t.table("orders")
    k = F.col("o_orderkey").alias("k")
    placed = orders.select(F.lit("order").alias("kind"), k, enrich.order_message(
        oid, F.concat(F.lit("CUST-"), "o_custkey"), F.col("o_totalprice"), F.col("o_orderstatus"), at).alias("message"))
    paid = orders.select(F.lit("payment").alias("kind"), k, enrich.payment_message(
        F.concat(F.lit("PAY-"), "o_orderkey"), oid, F.col("o_totalprice"), F.lit("CARD"),
        F.col("o_orderstatus"), at).alias("message"))
    told = t.table("events").select(F.lit("notification").alias("kind"), F.col("event_id").alias("k"),
                                    enrich.notification_message(
        F.col("event_type"), F.concat(F.lit("user-"), "user_id"), F.concat(F.lit("event "), "event_id"),
        F.lit("notice"), at).alias("message"))
    return placed.unionByName(paid).unionByName(told)


@query("consumer_health", "logs", f"""SELECT topic, count(*) FILTER (outcome = 'PROCESSED') AS processed,
  count(*) FILTER (outcome = 'RETRYABLE') AS failed, count(*) FILTER (outcome = 'RETRYABLE') AS retryable_errors,
  count(*) FILTER (outcome = 'NON_RETRYABLE') AS non_retryable_errors
  FROM (SELECT topic, {_OUTCOME} AS outcome FROM logs) GROUP BY topic""")
def consumer_health(t: Tables):
    return process.consumer_health(process.outcome(t.all_logs()), "topic")


@query("producer_health", "logs", """SELECT topic, sent, failed,
  round(sent / (sent + failed + CAST(0.001 AS DOUBLE)), 9) AS success_rate,
  round(total / n, 6) AS mean_ms FROM (SELECT topic, count(*) FILTER (value IS NOT NULL) AS sent,
    count(*) FILTER (value IS NULL) AS failed, CAST(sum(o % 50) AS DOUBLE) AS total, count(*) AS n
  FROM logs GROUP BY topic)""")
def producer_health(t: Tables):
    """Records without a value stand for failed sends; offset % 50 for the time taken."""
    health = process.producer_health(t.all_logs(), F.col("value").isNotNull(), "topic",
                                     duration_ms=F.col("offset") % 50)
    return health.withColumn("success_rate", F.round("success_rate", 9)).withColumn(
        "mean_ms", F.round("mean_ms", 6))


@query("topic_metrics", "logs", f"""SELECT topic, outcome, error_message, false AS is_total, count(*) AS records
  FROM (SELECT topic, {_OUTCOME} AS outcome, CASE WHEN {_REFUSED} THEN CASE topic WHEN 'orders-topic' THEN 'order'
      ELSE 'payment' END || ' message cannot be null or empty' WHEN {_TROUBLE} AND topic = 'orders-topic'
      THEN 'Simulated recoverable error for testing' WHEN {_TROUBLE}
      THEN 'Payment service temporarily unavailable' END AS error_message FROM logs) GROUP BY ALL
  UNION ALL SELECT NULL, NULL, NULL, true, count(*) FROM logs""")
def topic_metrics(t: Tables):
    return process.topic_metrics(process.outcome(t.all_logs()), "topic", "outcome", "error_message")


_BATCHES = f"""SELECT topic, p AS "partition", batch, total,
    CASE WHEN topic = 'orders-topic' THEN good ELSE total END AS processed,
    total - CASE WHEN topic = 'orders-topic' THEN good ELSE total END AS failed,
    CASE WHEN topic = 'orders-topic' THEN good / total >= 0.9 ELSE true END AS accepted,
    CASE WHEN total <= 10 THEN 'small' WHEN total <= 100 THEN 'medium' WHEN total <= 500 THEN 'large'
      ELSE 'extra-large' END AS size_range
  FROM (SELECT topic, p, o // 500 AS batch, count(*) AS total, count(*) FILTER ({_OUTCOME} = 'PROCESSED') AS good
    FROM logs GROUP BY ALL)"""


@query("batch_outcome", "logs", _BATCHES)
def batch_outcome(t: Tables):
    return process.batch_outcome(process.outcome(t.all_logs()))


@query("batch_size_range", "logs",
       f"SELECT size_range, count(*) AS batches FROM ({_BATCHES}) GROUP BY size_range")
def batch_size_range(t: Tables):
    batches = process.batch_outcome(process.outcome(t.all_logs()))
    return batches.groupBy("size_range").agg(F.count(F.lit(1)).alias("batches"))


@query("batch_health", "logs", f"""SELECT topic, count(*) FILTER (accepted) AS batches_processed,
  count(*) FILTER (NOT accepted) AS batches_failed, CAST(sum(processed) AS BIGINT) AS messages,
  round(count(*) FILTER (accepted) / (count(*) + CAST(0.001 AS DOUBLE)), 9) AS batch_success_rate
  FROM ({_BATCHES}) GROUP BY topic""")
def batch_health(t: Tables):
    health = process.batch_health(process.batch_outcome(process.outcome(t.all_logs())), "topic")
    return health.withColumn("batch_success_rate", F.round("batch_success_rate", 9))


_STATUS = f"CASE {_OUTCOME} WHEN 'PROCESSED' THEN 'SUCCESS' WHEN 'RETRYABLE' THEN 'ERROR' ELSE 'REJECTED' END"
_STATS = f"""SELECT topic, good AS processed, bad AS errors, rejected,
  CASE WHEN good > 0 THEN bad / good ELSE 0.0 END AS error_rate
  FROM (SELECT topic, count(*) FILTER (s = 'SUCCESS') AS good, count(*) FILTER (s = 'ERROR') AS bad,
    count(*) FILTER (s = 'REJECTED') AS rejected FROM (SELECT topic, {_STATUS} AS s FROM logs) GROUP BY topic)"""


def _statuses(t: Tables):
    status = F.when(F.col("outcome") == "PROCESSED", "SUCCESS").when(
        F.col("outcome") == "RETRYABLE", "ERROR").otherwise("REJECTED")
    return process.outcome(t.all_logs()).withColumn("status", status)


@query("processor_stats", "logs",
       f"SELECT topic, processed, errors, rejected, round(error_rate, 9) AS error_rate FROM ({_STATS})")
def processor_stats(t: Tables):
    return process.processor_stats(_statuses(t), "topic").withColumn("error_rate", F.round("error_rate", 9))


@query("stage_health", "logs", f"""SELECT topic, error_rate < 0.05 AS errors_ok, rejected < 900 AS backlog_ok,
  errors <= 200 AS breaker_ok, error_rate < 0.05 AND rejected < 900 AND errors <= 200 AS healthy FROM ({_STATS})""")
def stage_health(t: Tables):
    """Rejected records stand for the backlog, more than 200 errors for an open breaker."""
    stats = process.processor_stats(_statuses(t), "topic")
    health = process.stage_health(stats, F.col("rejected"), F.col("errors") > 200)
    return health.select("topic", "errors_ok", "backlog_ok", "breaker_ok", "healthy")
