"""SQL statements of the derived logs, for the counterpart of each query.

Each entry says in plain SQL what the same-named method of ``Tables`` computes. Columns
``p`` and ``o`` are partition and offset.
"""

from __future__ import annotations

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"

_ORDER_KEY = """CASE WHEN o_orderkey % 40 = 7 THEN NULL
      WHEN o_orderkey % 50 = 3 THEN 'test-' || o_custkey ELSE 'customer-' || o_custkey END"""
_CUSTOMER = "CASE WHEN o_orderkey % 97 = 5 THEN 'null' ELSE '\"CUST-' || o_custkey || '\"' END"
_ORDER_TS = f"{AS_OF} - to_hours(o_orderkey % 36) - to_seconds(o_orderkey % 3600)"


def _damaged(value: str) -> str:
    return f"""CASE o_orderkey % 60 WHEN 11 THEN NULL WHEN 12 THEN '   ' WHEN 13 THEN 'not json'
      ELSE {value} END"""


def _order_value(region: str) -> str:
    return _damaged(f"""'{{"orderId":"ORD-' || o_orderkey || '","customerId":' || {_CUSTOMER}
      || ',"amount":' || CAST(o_totalprice AS DECIMAL(18,2)) || ',"status":"'
      || CASE WHEN o_orderkey % 25 = 0 THEN 'CANCELLED' WHEN o_orderkey % 25 = 1 THEN 'DRAFT'
              WHEN o_orderstatus = 'P' THEN 'PENDING' WHEN o_orderstatus = 'O' THEN 'CONFIRMED'
              ELSE 'DELIVERED' END
      || '","note":"' || CASE o_orderkey % 60 WHEN 14 THEN 'TEST' WHEN 15 THEN 'RETRY_ERROR'
              ELSE 'ok' END || '"'
      || CASE o_orderpriority WHEN '1-URGENT' THEN ',"priority":"CRITICAL"'
              WHEN '2-HIGH' THEN ',"priority":"HIGH"' WHEN '3-MEDIUM' THEN ',"priority":"NORMAL"'
              WHEN '5-LOW' THEN ',"priority":"LOW"' ELSE '' END || {region} || '}}'""")


_PAYMENT_STATES = """['PENDING','PROCESSING','COMPLETED','FAILED','CANCELLED','REFUNDED',
      'PARTIALLY_REFUNDED'][o_orderkey % 7 + 1]"""

_PLACED = 'CAST(o_orderkey % 3 AS INTEGER) AS p, o_orderkey // 3 AS o'

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "orders_log": ((), f"""SELECT 'orders-topic' AS topic, {_PLACED}, {_ORDER_KEY} AS key,
      {_order_value("''")} AS value, o_orderkey AS k, {_ORDER_TS} AS ts FROM orders"""),
    "orders_region_log": ((), f"""SELECT 'orders-topic' AS topic, {_PLACED}, {_ORDER_KEY} AS key,
      {_order_value("',\"region\":\"' || reg || '\"'")} AS value, o_orderkey AS k,
      {_ORDER_TS} AS ts, reg
      FROM (SELECT o.*, coalesce(CASE WHEN r_name = 'AMERICA' THEN
              CASE WHEN n_nationkey % 2 = 0 THEN 'us-east' ELSE 'us-west' END
              ELSE lower(r_name) END, 'none') AS reg
            FROM orders o LEFT JOIN customer ON o_custkey = c_custkey
            LEFT JOIN nation ON c_nationkey = n_nationkey
            LEFT JOIN region ON n_regionkey = r_regionkey)"""),
    "payments_log": ((), f"""SELECT 'payments-topic' AS topic, {_PLACED}, {_ORDER_KEY} AS key,
      {_damaged(f'''('{{"paymentId":"PAY-' || o_orderkey || '","orderId":"ORD-' || o_orderkey
        || '","customerId":' || {_CUSTOMER} || ',"amount":'
        || CASE o_orderkey % 30 WHEN 0 THEN '0.00' WHEN 1 THEN '0.50'
           ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END
        || ',"status":"' || {_PAYMENT_STATES} || '","note":"'
        || CASE WHEN o_orderkey % 70 = 9 THEN 'PAYMENT_SERVICE_DOWN' ELSE 'ok' END || '"}}')''')}
      AS value, o_orderkey AS k, {_ORDER_TS} AS ts FROM orders"""),
    "notifications_log": ((), """SELECT 'notifications-topic' AS topic,
      CAST(event_id % 3 AS INTEGER) AS p, event_id // 3 AS o, 'user-' || user_id AS key,
      '{"type":"' || event_type || '"' || CASE event_id % 20 WHEN 0 THEN ',"recipient":null'
        WHEN 1 THEN '' ELSE ',"recipient":"user-' || user_id || '"' END
        || ',"subject":"event ' || event_id || '","content":"notice"}' AS value,
      event_id AS k, ts FROM events"""),
    "logs": (("orders_log", "payments_log", "notifications_log"), """SELECT * FROM orders_log
      UNION ALL SELECT * FROM payments_log UNION ALL SELECT * FROM notifications_log"""),
    "payloads": ((), f"""SELECT 'documents-topic' AS topic, CAST(doc_id % 3 AS INTEGER) AS p,
        doc_id // 3 AS o, CAST(doc_id AS VARCHAR) AS key, text AS value,
        strlen('lang') + strlen(lang) + 8 + strlen('source') + strlen(source) + 8 AS header_bytes,
        {AS_OF} - to_seconds(doc_id % 86400) AS ts FROM documents
      UNION ALL SELECT 'pages-topic', CAST(page_id % 3 AS INTEGER), page_id // 3, url, html, 0,
        {AS_OF} FROM pages
      UNION ALL SELECT 'conversations-topic', CAST(conv_id % 3 AS INTEGER), conv_id * 1000 + turn,
        CAST(conv_id AS VARCHAR), text, 0, {AS_OF} FROM conversations"""),
    "sized": (("payloads",), """SELECT *, coalesce(strlen(key), 0) + coalesce(strlen(value), 0)
        + header_bytes + 30 AS size FROM payloads"""),
    "order_events": ((), """SELECT *, CAST(CASE WHEN k % 4 = 0 THEN price ELSE
        CASE WHEN k % 43 = 0 THEN 0 ELSE price * quantity END
        + CASE WHEN k % 3 = 0 THEN freight ELSE 0 END END AS DECIMAL(18,2)) AS total_amount
      FROM (SELECT o_orderkey AS k, CAST(o_totalprice AS DECIMAL(18,2)) AS price, o_orderdate,
        CAST(CASE WHEN o_orderkey % 41 = 0 THEN 0 ELSE o_orderkey % 5 + 1 END AS INTEGER) AS quantity,
        CAST(o_orderkey % 7 AS DECIMAL(18,2)) AS freight,
        CASE WHEN o_orderkey % 47 = 0 THEN ' ' ELSE 'ORD-' || o_orderkey END AS order_id,
        CASE WHEN o_orderkey % 25 = 1 THEN NULL WHEN o_orderstatus = 'P' THEN 'PENDING'
             WHEN o_orderstatus = 'O' THEN 'CONFIRMED' WHEN o_orderkey % 53 = 2 THEN 'LOST'
             ELSE 'DELIVERED' END AS status FROM orders)"""),
    "items": (("order_events",), """SELECT k, CAST(0 AS INTEGER) AS pos, 'P' || (k % 2000) AS product_id,
        quantity, price AS unit_price, CAST(price * quantity AS DECIMAL(18,2)) AS total_price
      FROM order_events WHERE k % 43 <> 0
      UNION ALL SELECT k, CAST(CASE WHEN k % 43 = 0 THEN 0 ELSE 1 END AS INTEGER), 'FREIGHT', 1, freight, freight
      FROM order_events WHERE k % 3 = 0"""),
    "failed": ((), """SELECT event_id AS k,
      ['orders-topic','payments-topic','notifications-topic'][event_id % 3 + 1] AS topic,
      CAST((event_id // 3) % 3 AS INTEGER) AS p, event_id // 9 AS o, 'user-' || user_id AS key,
      props AS value, ts,
      ['ValidationException','ValidationException','NonRecoverableException',
       'RecoverableException','DeserializationException','IllegalStateException'][event_id % 6 + 1]
        AS exception_class,
      'failure of ' || event_id AS exception_message,
      CASE WHEN event_id % 6 = 2 THEN
        ['AUTH_FAILED','ACCESS_DENIED','CONFIG_ERROR','UNKNOWN'][event_id % 4 + 1] END AS error_code,
      CASE WHEN event_id % 6 = 3 THEN
        ['Inventory','payment-gateway','mail',NULL][user_id % 4 + 1] END AS service_name,
      CASE WHEN event_id % 6 = 0 THEN 'Amount' END AS field_name,
      CASE WHEN event_id % 6 = 0 THEN 'NON_EMPTY_ORDER' END AS validation_rule,
      CASE WHEN event_id % 8 <> 0 THEN 'corr-' || event_id END AS correlation_id,
      CAST(event_id % 5 + 1 AS INTEGER) AS attempts
      FROM events"""),
    "failures": (("failed",), """SELECT *, ts + to_seconds((attempt - 1) * 30) AS failed_at
      FROM (SELECT *, CAST(unnest(range(1, attempts + 1)) AS INTEGER) AS attempt FROM failed)"""),
    "exhausted": (("failed",), """SELECT *, attempts AS attempt,
      ts + to_seconds((attempts - 1) * 30) AS failed_at FROM failed"""),
    "offsets": ((), """SELECT s.grp, s.topic, s.p,
      CASE WHEN s.grp = 'group-0' THEN committed + 500 ELSE committed END AS committed,
      e.end_offset, s.day
      FROM (SELECT 'group-' || (user_id % 50) AS grp, 'notifications-topic' AS topic,
              CAST(event_id % 3 AS INTEGER) AS p, date_trunc('day', ts) AS day,
              max(event_id // 3) + 1 AS committed FROM events GROUP BY ALL) s
      JOIN (SELECT CAST(event_id % 3 AS INTEGER) AS p, date_trunc('day', ts) AS day,
              max(event_id // 3) + 1 AS end_offset FROM events GROUP BY ALL) e
        ON s.p = e.p AND s.day = e.day"""),
    "members": ((), """SELECT event_type AS grp, date_trunc('day', ts) AS day,
      'user-' || user_id AS consumer_id, CAST(count(*) AS INTEGER) AS partitions
      FROM events GROUP BY ALL"""),
    "metrics": ((), """SELECT event_type AS stage, ts, event_id AS seq, value / 50 AS value
      FROM events"""),
    "owners": ((), """SELECT unnest(['batch-parts','stream-parts','bulk-parts']) AS queue,
      'S' || lpad(CAST(s_suppkey AS VARCHAR), 12, '0') AS owner, 'rack-' || (s_nationkey % 5) AS rack,
      ['HIGH','MEDIUM','LOW'][s_suppkey % 3 + 1] AS priority,
      CAST(s_suppkey % 97 + 1 AS INTEGER) AS capacity, coalesce(r_name, 'none') AS region,
      s_suppkey AS sk
      FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
      LEFT JOIN region ON n_regionkey = r_regionkey"""),
    "units": ((), """SELECT ['batch-parts','stream-parts','bulk-parts'][p_size % 3 + 1] AS queue,
      p_partkey AS unit, 'rack-' || (p_partkey % 7) AS rack,
      CASE WHEN p_partkey % 4 <> 0 THEN
        'S' || lpad(CAST((p_partkey * 7) % 1000 AS VARCHAR), 12, '0') END AS previous_owner
      FROM part"""),
}


def with_ctes(names: str, body: str) -> str:
    """``WITH`` clause of the named statements and what they build on, then ``body``."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in CTES[name][0]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    lead = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in ordered)
    return f"WITH {lead}\n{body}"
