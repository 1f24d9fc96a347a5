"""Queries of failures, retries, dead letters and breakers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.functions.headers import header_map as map_of, last_header
from tidelog.operators import breaker, deadletter, errors, filters, process, tracking
from tidelog.plans.ctes import CTES
from tidelog.plans.registry import query
from tidelog.sources.derive import AS_OF, Tables

_ID = ["topic", "partition", "offset"]
_SQL_ID = 'topic, p AS "partition", o AS "offset"'
_CLS = "exception_class"
_CODE = "coalesce(error_code, 'UNKNOWN')"

_BASIC = f"""topic || CASE {_CLS} WHEN 'ValidationException' THEN '.validation'
  WHEN 'NonRecoverableException' THEN '.non-recoverable.' || lower({_CODE})
  WHEN 'RecoverableException' THEN '.recoverable' ELSE '' END || '.dlt'"""
_CONFIG = f"""topic || CASE {_CLS} WHEN 'ValidationException' THEN '.validation'
  WHEN 'DeserializationException' THEN '.deserialization'
  WHEN 'NonRecoverableException' THEN '.business' ELSE '' END || '.dlt'"""


def _enhanced(poison: str, is_open: str) -> str:
    return f"""topic || CASE WHEN {poison} THEN '.poison-pill'
    WHEN {_CLS} = 'RecoverableException' AND service_name IS NOT NULL AND {is_open}
      THEN '.circuit-breaker.' || lower(service_name)
    WHEN {_CLS} = 'ValidationException' THEN '.validation' || coalesce('.' || lower(field_name), '')
    WHEN {_CLS} = 'NonRecoverableException' THEN CASE {_CODE} WHEN 'AUTH_FAILED' THEN '.auth.'
      WHEN 'ACCESS_DENIED' THEN '.authz.' WHEN 'CONFIG_ERROR' THEN '.config.' ELSE '.non-recoverable.' END
      || lower({_CODE})
    WHEN {_CLS} = 'RecoverableException' THEN '.recoverable' || coalesce('.' || lower(service_name), '')
    ELSE '.error.' || lower({_CLS}) END || '.dlt'"""


_MS_TEXT = "strftime(date_trunc('millisecond', failed_at), '%Y-%m-%dT%H:%M:%S.%gZ')"

# The dead-letter log of the queries: the last attempt of each failed record. Records that
# could not be read are handled by the config policy and so lack the enhanced headers.
CTES["dlt"] = (("exhausted",), f"""SELECT CASE WHEN {_CLS} = 'DeserializationException' THEN {_CONFIG}
      ELSE {_enhanced('attempt >= 3', 'false')} END AS topic, topic AS origin, p, o, key, value,
    {_CLS}, service_name, attempt, failed_at, exception_message, correlation_id,
    validation_rule, field_name, {_CLS} <> 'DeserializationException' AS enhanced,
    {_CLS} <> 'DeserializationException' AND attempt >= 3 AS poison, error_code FROM exhausted""")


def dlt_log(t: Tables):
    rows = errors.with_flags(t.exhausted()).withColumn("poison", F.col("attempt") >= 3)
    rows = rows.withColumn("breaker_state", F.when(F.col("service_name").isNotNull(), "CLOSED"))
    rows = rows.withColumn("breaker_failures", F.when(F.col("service_name").isNotNull(), F.lit(1)))
    unreadable = errors.is_class(errors.DESERIALIZATION)
    return errors.dead_letters(rows.filter(~unreadable)).unionByName(
        errors.dead_letters(rows.filter(unreadable), "config"))


@query("route_basic", "failures", f"SELECT {_SQL_ID}, attempt, {_BASIC} AS dlt_topic FROM failures")
def route_basic(t: Tables):
    return t.failures().select(*_ID, "attempt", errors.route_basic().alias("dlt_topic"))


@query("route_config", "failures", f"SELECT {_SQL_ID}, attempt, {_CONFIG} AS dlt_topic FROM failures")
def route_config(t: Tables):
    return t.failures().select(*_ID, "attempt", errors.route_config().alias("dlt_topic"))


@query("route_enhanced", "failures", f"""SELECT {_SQL_ID}, n AS failure_count, breaker_state,
  {_enhanced('n >= 3', "breaker_state = 'OPEN'")} AS dlt_topic
  FROM (SELECT f.*, n, breaker_state FROM failures f
    JOIN (SELECT topic, p, o, count(*) AS n, max(attempt) AS attempt FROM failures GROUP BY ALL)
      USING (topic, p, o, attempt)
    LEFT JOIN (SELECT topic, p, o, attempt, CASE WHEN row_number() OVER (PARTITION BY service_name
        ORDER BY failed_at, topic, p, o, attempt) >= 500 THEN 'OPEN' ELSE 'CLOSED' END AS breaker_state
      FROM failures WHERE service_name IS NOT NULL) USING (topic, p, o, attempt))""")
def route_enhanced(t: Tables):
    """With a breaker threshold of 500 failures; the breaker is asked when a record fails for the last time."""
    rows = tracking.failure_flags(t.failures(), breaker_threshold=500)
    is_open = F.coalesce(F.col("breaker_state") == "OPEN", F.lit(False))
    return rows.select(*_ID, "failure_count", "breaker_state",
                       errors.route_enhanced(F.col("poison"), is_open).alias("dlt_topic"))


@query("dlt_pipeline", "failures", f"""SELECT {_enhanced('n >= 3', 'coalesce(is_open, false)')} AS dlt_topic, count(*) AS records,
    CAST(sum(n) AS BIGINT) AS failures FROM (SELECT f.*, n, is_open FROM failures f
    JOIN (SELECT topic, p, o, count(*) FILTER (NOT limited) AS n, max(attempt) AS attempt FROM (SELECT *, row_number() OVER (
        PARTITION BY topic, date_trunc('minute', failed_at) ORDER BY failed_at, p, o, attempt) > 2 AS limited FROM failures)
      GROUP BY ALL) USING (topic, p, o, attempt)
    LEFT JOIN (SELECT topic, p, o, attempt, sum(CASE WHEN limited THEN 0 ELSE 1 END) OVER (PARTITION BY service_name
        ORDER BY failed_at, topic, p, o, attempt) >= 500 AS is_open FROM (SELECT *, row_number() OVER (
        PARTITION BY topic, date_trunc('minute', failed_at) ORDER BY failed_at, p, o, attempt) > 2 AS limited FROM failures)
      WHERE service_name IS NOT NULL) USING (topic, p, o, attempt)) GROUP BY dlt_topic""")
def dlt_pipeline(t: Tables):
    """Failures through the whole handler: rate limit, counts, breaker and poison flags, routing, dead letters."""
    flagged = tracking.failure_flags(tracking.rate_limit(t.failures(), 2), breaker_threshold=500)
    letters = errors.dead_letters(flagged)
    routed = flagged.select("failure_count", errors.route_enhanced(
        F.col("poison"), F.coalesce(F.col("breaker_state") == "OPEN", F.lit(False))).alias("dlt_topic"))
    counts = routed.groupBy("dlt_topic").agg(F.sum("failure_count").alias("failures"))
    published = letters.groupBy(F.col("topic").alias("dlt_topic")).agg(F.count(F.lit(1)).alias("records"))
    return published.join(counts, "dlt_topic").select("dlt_topic", "records", "failures")


@query("dlt_headers", "dlt", f"""SELECT topic, p AS "partition", o AS "offset", h.name, h.text FROM (
  SELECT topic, p, o, unnest(list_filter(CASE WHEN enhanced THEN [
    {{'name': 'dlt.original-topic', 'text': origin}}, {{'name': 'dlt.original-partition', 'text': CAST(p AS VARCHAR)}},
    {{'name': 'dlt.original-offset', 'text': CAST(o AS VARCHAR)}}, {{'name': 'dlt.exception-class', 'text': {_CLS}}},
    {{'name': 'dlt.exception-message', 'text': exception_message}},
    {{'name': 'dlt.exception-timestamp', 'text': {_MS_TEXT}}},
    {{'name': 'dlt.validation-rule', 'text': validation_rule}}, {{'name': 'dlt.field-name', 'text': field_name}},
    {{'name': 'dlt.original-message-content', 'text': CASE WHEN {_CLS} = 'ValidationException' THEN value END}},
    {{'name': 'dlt.error-code', 'text': CASE WHEN {_CLS} = 'NonRecoverableException' THEN {_CODE} END}},
    {{'name': 'dlt.retry-attempts', 'text': CASE WHEN {_CLS} = 'RecoverableException' THEN CAST(attempt AS VARCHAR) END}},
    {{'name': 'dlt.correlation-id', 'text': CASE WHEN {_CLS} LIKE '%ecoverableException' THEN correlation_id END}},
    {{'name': 'dlt.service-name', 'text': service_name}},
    {{'name': 'dlt.enhanced.version', 'text': '2.0'}}, {{'name': 'dlt.enhanced.timestamp', 'text': {_MS_TEXT}}},
    {{'name': 'dlt.enhanced.hostname', 'text': 'unknown'}}, {{'name': 'dlt.enhanced.application', 'text': 'event-log'}},
    {{'name': 'dlt.enhanced.environment', 'text': 'unknown'}},
    {{'name': 'dlt.enhanced.message.key', 'text': origin || ':' || p || ':' || o}},
    {{'name': 'dlt.enhanced.failure.count', 'text': CAST(attempt AS VARCHAR)}},
    {{'name': 'dlt.enhanced.circuit.breaker.service', 'text': service_name}},
    {{'name': 'dlt.enhanced.circuit.breaker.state', 'text': CASE WHEN service_name IS NOT NULL THEN 'CLOSED' END}},
    {{'name': 'dlt.enhanced.circuit.breaker.failure.count', 'text': CASE WHEN service_name IS NOT NULL THEN '1' END}},
    {{'name': 'dlt.enhanced.correlation.id', 'text': correlation_id}},
    {{'name': 'dlt.enhanced.poison.pill', 'text': CASE WHEN poison THEN 'true' END}},
    {{'name': 'dlt.enhanced.poison.pill.detected.at', 'text': CASE WHEN poison THEN {_MS_TEXT} END}}]
  ELSE [{{'name': 'dlt-exception-message', 'text': exception_message}}, {{'name': 'dlt-exception-class', 'text': {_CLS}}},
    {{'name': 'dlt-original-topic', 'text': origin}}, {{'name': 'dlt-original-partition', 'text': CAST(p AS VARCHAR)}},
    {{'name': 'dlt-original-offset', 'text': CAST(o AS VARCHAR)}},
    {{'name': 'dlt-timestamp', 'text': CAST((epoch_us(failed_at) // 1000) AS VARCHAR)}}] END,
  lambda h: h.text IS NOT NULL)) AS h FROM dlt)""")
def dlt_headers(t: Tables):
    return dlt_log(t).select(*_ID, F.explode(map_of(F.col("headers"))).alias("name", "text"))


@query("error_context", "failures", f"""SELECT {_SQL_ID}, attempt, '{{attempt=' || attempt || ', code=' || error_code || '}}' AS text
  FROM (SELECT * REPLACE (coalesce(error_code, 'none') AS error_code) FROM failures) WHERE {_CLS} = 'NonRecoverableException'""")
def error_context(t: Tables):
    """The context header of failures that are not recoverable, as it is in their dead letters."""
    context = F.create_map(F.lit("code"), F.coalesce("error_code", F.lit("none")), F.lit("attempt"), F.col("attempt").cast("string"))
    letters = errors.dead_letters(t.failures().withColumn("context", context), "basic")
    text = last_header(F.col("headers"), "dlt.error-context")
    number = F.element_at(F.str_to_map(F.regexp_replace(text, "[{}]", ""), F.lit(", "), F.lit("=")), "attempt").cast("int")
    place = [last_header(F.col("headers"), f"dlt.original-{c}") for c in ("topic", "partition", "offset")]
    return letters.filter(text.isNotNull()).select(
        place[0].alias("topic"), place[1].cast("int").alias("partition"), place[2].cast("bigint").alias("offset"),
        number.alias("attempt"), text.alias("text"))


@query("failure_log", "failures", f"""SELECT {_SQL_ID}, attempt, e.name AS name, e.text AS text FROM (
  SELECT *, unnest([{{'name': 'message', 'text': exception_message}}, {{'name': 'errorCode', 'text': {_CODE}}},
    {{'name': 'timestamp', 'text': CAST(epoch_us(failed_at) // 1000 AS VARCHAR)}},
    {{'name': 'correlationId', 'text': correlation_id}}]) AS e FROM failures) WHERE e.text IS NOT NULL""")
def failure_log(t: Tables):
    """What a structured log says of each failure, a row per name."""
    return t.failures().select(*_ID, "attempt", F.explode(errors.log_map()).alias("name", "text"))


@query("error_counters", "failures", f"""SELECT topic,
  count(*) FILTER ({_CLS} = 'ValidationException') AS validation_errors,
  count(*) FILTER ({_CLS} = 'NonRecoverableException') AS non_recoverable_errors,
  count(*) FILTER ({_CLS} = 'RecoverableException') AS recoverable_errors, count(*) AS failures,
  count(*) FILTER (attempt > 1) AS retries FROM failures GROUP BY topic""")
def error_counters(t: Tables):
    return errors.error_counters(t.failures(), "topic")


@query("error_class", "failures", f"""SELECT {_SQL_ID}, attempt,
  CASE WHEN {_CLS} = 'NonRecoverableException' THEN CASE {_CODE} WHEN 'AUTH_FAILED' THEN 'AUTH'
    WHEN 'ACCESS_DENIED' THEN 'AUTHZ' WHEN 'CONFIG_ERROR' THEN 'CONFIG' ELSE 'OTHER' END END AS error_kind,
  exception_message || CASE {_CLS}
    WHEN 'ValidationException' THEN coalesce(' [Rule: ' || validation_rule || ']', '')
      || coalesce(' [Field: ' || field_name || ']', '') || coalesce(' [Content: ' || value || ']', '')
    WHEN 'NonRecoverableException' THEN CASE WHEN {_CODE} <> 'UNKNOWN' THEN ' [ErrorCode: ' || error_code || ']'
      ELSE '' END || coalesce(' [CorrelationId: ' || correlation_id || ']', '')
      || ' [Timestamp: ' || (epoch_us(failed_at) // 1000) || ']'
    WHEN 'RecoverableException' THEN coalesce(' [CorrelationId: ' || correlation_id || ']', '')
      || ' [Attempt: ' || attempt || ']' || ' [NextRetryIn: '
      || CAST(least(1000 * pow(2, attempt - 1), 32000) AS BIGINT) || 'ms]'
      || coalesce(' [Service: ' || service_name || ']', '') ELSE '' END AS detail FROM failures""")
def error_class(t: Tables):
    return t.failures().select(*_ID, "attempt", errors.error_class().alias("error_kind"),
                               errors.detail_text().alias("detail"))


@query("retryable", "failures", f"""SELECT {_CLS}, CASE WHEN {_CLS} IN ('ValidationException', 'NonRecoverableException')
    THEN 'NOT_RETRYABLE' WHEN {_CLS} = 'RecoverableException' THEN 'RETRYABLE' ELSE 'DEFAULT' END AS enhanced,
  CASE WHEN {_CLS} IN ('ValidationException', 'NonRecoverableException', 'DeserializationException')
    THEN 'NOT_RETRYABLE' WHEN {_CLS} = 'RecoverableException' THEN 'RETRYABLE' ELSE 'DEFAULT' END AS config,
  count(*) AS failures FROM failures GROUP BY ALL""")
def retryable(t: Tables):
    return t.failures().groupBy(
        "exception_class", errors.retry_list("enhanced").alias("enhanced"),
        errors.retry_list("config").alias("config")).agg(F.count(F.lit(1)).alias("failures"))


@query("retry_schedule", "exhausted", f"""SELECT {_SQL_ID}, CAST(retry AS INTEGER) AS retry,
  least(1000 * CAST(pow(2, retry - 1) AS BIGINT), 32000) AS delay_ms,
  (epoch_us(failed_at) // 1000) + CAST(list_sum(list_transform(range(1, retry + 1),
    lambda i: least(1000 * CAST(pow(2, i - 1) AS BIGINT), 32000))) AS BIGINT) AS due_ms
  FROM (SELECT *, unnest(range(1, 11)) AS retry FROM exhausted
    WHERE {_CLS} NOT IN ('ValidationException', 'NonRecoverableException'))""")
def retry_schedule(t: Tables):
    return errors.retry_schedule(t.exhausted()).select(*_ID, "retry", "delay_ms", "due_ms")


@query("rate_limit", "failures", f"""SELECT {_SQL_ID}, attempt,
  row_number() OVER (PARTITION BY topic, date_trunc('minute', failed_at)
    ORDER BY failed_at, p, o, attempt) > 2 AS limited FROM failures""")
def rate_limit(t: Tables):
    """Two failures a minute, since the failures of the tables are sparse."""
    return tracking.rate_limit(t.failures(), limit=2).select(*_ID, "attempt", "limited")


@query("service_breaker", "failures", f"""SELECT {_SQL_ID}, attempt, service_name, n AS breaker_failures,
  CASE WHEN n >= 5 THEN 'OPEN' ELSE 'CLOSED' END AS breaker_state, n = 5 AS opens
  FROM (SELECT *, row_number() OVER (PARTITION BY service_name ORDER BY failed_at, topic, p, o, attempt) AS n
    FROM failures WHERE service_name IS NOT NULL)""")
def service_breaker(t: Tables):
    return tracking.service_breaker(t.failures()).select(
        *_ID, "attempt", "service_name", "breaker_failures", "breaker_state", "opens")


@query("poison_pill", "failures", f"""SELECT {_SQL_ID}, count(*) AS failure_count,
  (epoch_us(min(failed_at)) // 1000) AS first_ms, (epoch_us(max(failed_at)) // 1000) AS last_ms, count(*) >= 3 AS poison,
  count(*) >= 3 AND max(failed_at) > TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 5 MINUTE AS active
  FROM failures GROUP BY topic, p, o""")
def poison_pill(t: Tables):
    pills = tracking.poison_pills(t.failures(), as_of="2024-01-15 12:00:00")
    return pills.select(*_ID, "failure_count", F.unix_millis("first_failure").alias("first_ms"),
                        F.unix_millis("last_failure").alias("last_ms"), "poison", "active")


@query("poison_quarantine", "failures", """SELECT topic || '.poison-pill.quarantine' AS topic, key,
  (epoch_us(last) // 1000) AS timestamp_ms, '{"originalTopic":"' || topic || '","originalPartition":' || p
  || ',"originalOffset":' || o || ',"failureCount":' || n || ',"firstFailureTime":' || (epoch_us(first) // 1000)
  || ',"lastFailureTime":' || (epoch_us(last) // 1000) || ',"exceptionType":"' || exception_class
  || '","exceptionMessage":"' || exception_message || '","hostname":"unknown","environment":"unknown"}' AS value
  FROM (SELECT topic, p, o, key, exception_class, exception_message, count(*) AS n, min(failed_at) AS first,
    max(failed_at) AS last FROM failures GROUP BY ALL HAVING count(*) >= 3)""")
def poison_quarantine(t: Tables):
    return tracking.quarantine(t.failures()).select(
        "topic", "key", F.unix_millis("timestamp").alias("timestamp_ms"), "value")


@query("publish_dlt", "dlt", """SELECT topic, p AS "partition", count(*) AS records,
  min(o) AS first_offset, max(o) AS last_offset, (epoch_us(max(failed_at)) // 1000) AS newest_ms FROM dlt GROUP BY ALL""")
def publish_dlt(t: Tables):
    return dlt_log(t).groupBy("topic", "partition").agg(
        F.count(F.lit(1)).alias("records"), F.min("offset").alias("first_offset"),
        F.max("offset").alias("last_offset"), F.unix_millis(F.max("timestamp")).alias("newest_ms"))


_RECENT = "TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 1 HOUR"


@query("dlt_filter", "dlt", f"""SELECT {_SQL_ID}, enhanced AND {_CLS} = 'ValidationException' AS validation,
  enhanced AND contains({_CLS}, 'RecoverableException') AS recoverable,
  enhanced AND {_CLS} = 'RecoverableException' AS recoverable_strict, poison AS poison_pill,
  enhanced AND service_name IS NOT NULL AS circuit_breaker,
  enhanced AND date_trunc('millisecond', failed_at) > {_RECENT} AS recent, true AS anything FROM dlt""")
def dlt_filter(t: Tables):
    match = filters.dead_letter_match
    return dlt_log(t).select(
        *_ID, match("validation").alias("validation"), match("recoverable").alias("recoverable"),
        match("recoverable", strict=True).alias("recoverable_strict"),
        match("poison-pill").alias("poison_pill"), match("circuit-breaker").alias("circuit_breaker"),
        match("recent", as_of="2024-01-15 12:00:00").alias("recent"), match("other").alias("anything"))


@query("dlt_topics", "dlt logs", """SELECT DISTINCT topic FROM (SELECT topic FROM dlt
  UNION ALL SELECT topic FROM logs) WHERE contains(topic, '.dlt') OR contains(topic, '.poison-pill')""")
def dlt_topics(t: Tables):
    return deadletter.dlt_topics(dlt_log(t).select("topic").unionByName(t.all_logs().select("topic")))


@query("dlt_browse", "dlt", f"""SELECT p AS "partition", o AS "offset", key, value, exception_message AS message
  FROM dlt WHERE topic = 'orders-topic.poison-pill.dlt' AND {_CLS} = 'ValidationException'
  ORDER BY p, o LIMIT 50""")
def dlt_browse(t: Tables):
    page = deadletter.dlt_browse(dlt_log(t), "orders-topic.poison-pill.dlt", 50,
                                 filters.dead_letter_match("validation"))
    return page.select("partition", "offset", "key", "value",
                       F.try_element_at("headers", F.lit("dlt.exception-message")).alias("message"))


_REPROCESS = """CASE WHEN NOT (enhanced AND contains(exception_class, 'RecoverableException')) AND enhanced
  THEN 'SKIPPED_FILTER' WHEN NOT enhanced THEN 'SKIPPED_INVALID' ELSE 'REPROCESSED' END"""


def _classified(t: Tables, limit: int = 0, topic: str | None = None):
    dlt = dlt_log(t) if topic is None else dlt_log(t).filter(F.col("topic") == topic)
    unreadable = F.col("topic").contains(".deserialization.")
    return deadletter.classify(dlt, filters.dead_letter_match("recoverable") | unreadable, limit)


@query("dlt_reprocess", "dlt", f"""SELECT topic, count(*) FILTER (status = 'REPROCESSED') AS processed,
  count(*) FILTER (starts_with(status, 'SKIPPED')) AS skipped FROM (SELECT topic, {_REPROCESS} AS status FROM dlt)
  GROUP BY topic""")
def dlt_reprocess(t: Tables):
    return deadletter.reprocess_summary(_classified(t), "topic")


@query("dlt_reprocess_records", "dlt", f"""SELECT origin AS topic, p AS source_partition, o AS source_offset,
  key, value, topic AS came_from FROM dlt WHERE {_REPROCESS} = 'REPROCESSED'""")
def dlt_reprocess_records(t: Tables):
    rows = deadletter.reprocessed(_classified(t), as_of=AS_OF)
    return rows.select("topic", "source_partition", "source_offset", "key", "value", F.try_element_at(
        map_of(F.col("headers")), F.lit("dlt.original.topic")).alias("came_from"))


@query("dlt_reprocess_limited", "dlt", f"""SELECT p AS "partition", o AS "offset",
  CASE WHEN (SELECT count(*) FROM d e WHERE e.status = 'REPROCESSED' AND (e.p, e.o) < (d.p, d.o)) >= 20
    THEN 'NOT_REACHED' ELSE status END AS status
  FROM (SELECT p, o, {_REPROCESS} AS status FROM dlt WHERE topic = 'orders-topic.poison-pill.dlt') d
  """.replace("FROM d e", f"FROM (SELECT p, o, {_REPROCESS} AS status FROM dlt WHERE topic = 'orders-topic.poison-pill.dlt') e"))
def dlt_reprocess_limited(t: Tables):
    """Stop after twenty reprocessed records of one topic."""
    return _classified(t, 20, "orders-topic.poison-pill.dlt").select("partition", "offset", "status")


@query("dlt_retention", "dlt", f"""SELECT topic,
  count(*) FILTER (failed_at < TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) AS deleted,
  count(*) FILTER (failed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) AS kept FROM dlt GROUP BY topic""")
def dlt_retention(t: Tables):
    return deadletter.retention_report(dlt_log(t), AS_OF)


def _bytes(name: str, text: str) -> str:
    return f"coalesce({len(name) + 8} + strlen({text}), 0)"


_SIZE = " + ".join([
    "30 + strlen(key) + strlen(value)", "CASE WHEN enhanced THEN " + " + ".join([
        _bytes("dlt.original-topic", "origin"), _bytes("dlt.original-partition", "CAST(p AS VARCHAR)"),
        _bytes("dlt.original-offset", "CAST(o AS VARCHAR)"), _bytes("dlt.exception-class", _CLS),
        _bytes("dlt.exception-message", "exception_message"), _bytes("dlt.exception-timestamp", _MS_TEXT),
        _bytes("dlt.validation-rule", "validation_rule"), _bytes("dlt.field-name", "field_name"),
        _bytes("dlt.original-message-content", f"CASE WHEN {_CLS} = 'ValidationException' THEN value END"),
        _bytes("dlt.error-code", f"CASE WHEN {_CLS} = 'NonRecoverableException' THEN {_CODE} END"),
        _bytes("dlt.retry-attempts", f"CASE WHEN {_CLS} = 'RecoverableException' THEN CAST(attempt AS VARCHAR) END"),
        _bytes("dlt.correlation-id", f"CASE WHEN {_CLS} LIKE '%ecoverableException' THEN correlation_id END"),
        _bytes("dlt.service-name", "service_name"), _bytes("dlt.enhanced.version", "'2.0'"),
        _bytes("dlt.enhanced.timestamp", _MS_TEXT), _bytes("dlt.enhanced.hostname", "'unknown'"),
        _bytes("dlt.enhanced.application", "'event-log'"), _bytes("dlt.enhanced.environment", "'unknown'"),
        _bytes("dlt.enhanced.message.key", "origin || ':' || p || ':' || o"),
        _bytes("dlt.enhanced.failure.count", "CAST(attempt AS VARCHAR)"),
        _bytes("dlt.enhanced.circuit.breaker.service", "service_name"),
        _bytes("dlt.enhanced.circuit.breaker.state", "CASE WHEN service_name IS NOT NULL THEN 'CLOSED' END"),
        _bytes("dlt.enhanced.circuit.breaker.failure.count", "CASE WHEN service_name IS NOT NULL THEN '1' END"),
        _bytes("dlt.enhanced.correlation.id", "correlation_id"),
        _bytes("dlt.enhanced.poison.pill", "CASE WHEN poison THEN 'true' END"),
        _bytes("dlt.enhanced.poison.pill.detected.at", f"CASE WHEN poison THEN {_MS_TEXT} END")]) + " ELSE " + " + ".join([
            _bytes("dlt-exception-message", "exception_message"), _bytes("dlt-exception-class", _CLS),
            _bytes("dlt-original-topic", "origin"), _bytes("dlt-original-partition", "CAST(p AS VARCHAR)"),
            _bytes("dlt-original-offset", "CAST(o AS VARCHAR)"),
            _bytes("dlt-timestamp", "CAST((epoch_us(failed_at) // 1000) AS VARCHAR)")]) + " END"])

_STATS = f"""SELECT topic, count(*) AS messages, CAST(sum({_SIZE}) AS BIGINT) AS size_bytes,
  max(failed_at) AS last FROM dlt GROUP BY topic"""


@query("dlt_analytics", "dlt", f"""SELECT count(*) AS topics, CAST(sum(messages) AS BIGINT) AS messages,
  CAST(sum(size_bytes) AS BIGINT) AS size_bytes, count(*) FILTER (messages > 100) AS critical_topics,
  CAST(sum(messages) // count(*) AS BIGINT) AS average_messages, (epoch_us(min(last)) // 1000) AS oldest_ms,
  (epoch_us(max(last)) // 1000) AS newest_ms FROM ({_STATS})""")
def dlt_analytics(t: Tables):
    row = deadletter.overview(deadletter.topic_stats(dlt_log(t)), critical=100)
    return row.select("topics", "messages", "size_bytes", "critical_topics", "average_messages",
                      F.unix_millis("oldest_activity").alias("oldest_ms"),
                      F.unix_millis("newest_activity").alias("newest_ms"))


@query("dlt_top_topics", "dlt", f"""SELECT topic, messages, size_bytes, (epoch_us(last) // 1000) AS last_ms
  FROM ({_STATS}) ORDER BY messages DESC, topic LIMIT 10""")
def dlt_top_topics(t: Tables):
    top = deadletter.top_topics(deadletter.topic_stats(dlt_log(t)))
    return top.select("topic", "messages", "size_bytes", F.unix_millis("last_activity").alias("last_ms"))


@query("dlt_top_errors", "dlt",
       f"SELECT {_CLS} AS error_type, count(*) AS errors FROM dlt GROUP BY ALL ORDER BY errors DESC, error_type LIMIT 10")
def dlt_top_errors(t: Tables):
    return deadletter.top_errors(deadletter.error_types(dlt_log(t)))


@query("problem_topics", "dlt", f"""SELECT topic, messages FROM (SELECT topic, count(*) AS messages FROM dlt
  GROUP BY topic ORDER BY messages DESC, topic LIMIT 10) WHERE messages >= 100""")
def problem_topics(t: Tables):
    return deadletter.problem_topics(deadletter.topic_stats(dlt_log(t))).select("topic", "messages")


@query("dlt_stale_state", "dlt", f"""SELECT topic, messages FROM (SELECT topic, count(*) AS messages FROM dlt GROUP BY topic)
  WHERE topic IN (SELECT topic FROM dlt WHERE failed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 2 DAY)""")
def dlt_stale_state(t: Tables):
    """Topics without a record in the last two days count as gone."""
    dlt = dlt_log(t)
    stats = deadletter.topic_stats(dlt).select("topic", "messages")
    return deadletter.active_stats(stats, deadletter.retained(dlt, AS_OF, days=2))


@query("error_patterns", "failures dlt", f"""SELECT 'error_type' AS kind, {_CLS} AS name, count(*) AS n FROM dlt GROUP BY ALL
  UNION ALL SELECT 'breaker_opens', service_name, 1 FROM failures WHERE service_name IS NOT NULL
    GROUP BY service_name HAVING count(*) >= 5
  UNION ALL SELECT 'poison_pills', topic, count(*) FROM (SELECT topic FROM failures GROUP BY topic, p, o
    HAVING count(*) >= 3) GROUP BY topic
  UNION ALL SELECT 'rate_limited', topic, CAST(sum(n - 2) AS BIGINT) FROM (SELECT topic, count(*) AS n FROM failures
    GROUP BY topic, date_trunc('minute', failed_at) HAVING count(*) > 2) GROUP BY topic""")
def error_patterns(t: Tables):
    failures = t.failures()
    one = F.lit(1).cast("bigint")
    types = deadletter.error_types(dlt_log(t)).select(
        F.lit("error_type").alias("kind"), F.col("error_type").alias("name"), F.col("errors").alias("n"))
    opens = tracking.service_states(failures).filter("state = 'OPEN'").select(
        F.lit("breaker_opens").alias("kind"), F.col("service_name").alias("name"), one.alias("n"))
    pills = tracking.poison_pills(failures, AS_OF).filter("poison").groupBy("topic").agg(
        F.count(F.lit(1)).alias("n")).select(F.lit("poison_pills").alias("kind"), F.col("topic").alias("name"), "n")
    limited = tracking.limited_counts(failures, 2).select(
        F.lit("rate_limited").alias("kind"), F.col("topic").alias("name"), F.col("limited").alias("n"))
    return types.unionByName(opens).unionByName(pills).unionByName(limited)


@query("error_handler_status", "failures", """SELECT
  (SELECT count(*) FROM (SELECT 1 FROM failures GROUP BY topic, p, o HAVING count(*) >= 3)) AS poison_pills,
  (SELECT count(*) FROM (SELECT 1 FROM failures WHERE service_name IS NOT NULL GROUP BY service_name
    HAVING count(*) >= 5)) AS breaker_opens,
  (SELECT CAST(sum(n - 2) AS BIGINT) FROM (SELECT count(*) AS n FROM failures
    GROUP BY topic, date_trunc('minute', failed_at) HAVING count(*) > 2)) AS rate_limited,
  (SELECT count(DISTINCT service_name) FROM failures) AS active_breakers,
  (SELECT count(DISTINCT (topic, p, o)) FROM failures) AS tracked_messages""")
def error_handler_status(t: Tables):
    return tracking.handler_status(t.failures(), limit=2)


# ---- breakers: the SQL walks each key call by call, which is what Spark must not do -----------

def _walk(calls: str, rule: breaker.Breaker) -> str:
    """SQL of the breaker over ``calls`` (key, tick in microseconds, ok, n from 1 within key)."""
    first = "SELECT *, 0 AS kind, 0 AS count, CAST(0 AS BIGINT) AS opened FROM calls WHERE n = 1"
    following = "SELECT c.*, s.kind, s.count, s.opened FROM s JOIN calls c ON c.key = s.key AND c.n = s.n + 1"

    def step(source: str) -> str:
        return f"""SELECT * EXCLUDE (kind, count, opened, k, c, blocked), NOT blocked AS admitted,
      CASE WHEN blocked THEN 2 WHEN k = 1 AND NOT ok THEN 2 WHEN k = 1 AND c + 1 < {rule.successes} THEN 1
        WHEN k = 0 AND NOT ok AND c + 1 >= {rule.failures} THEN 2 ELSE 0 END AS kind,
      CASE WHEN blocked THEN count WHEN k = 1 AND NOT ok THEN {rule.failures}
        WHEN k = 1 AND c + 1 < {rule.successes} THEN c + 1 WHEN k = 0 AND NOT ok THEN c + 1 ELSE 0 END AS count,
      CASE WHEN blocked THEN opened WHEN k = 1 AND NOT ok THEN tick
        WHEN k = 0 AND NOT ok AND c + 1 >= {rule.failures} THEN tick ELSE 0 END AS opened
    FROM (SELECT *, kind = 2 AND tick - opened < {rule.reset} AS blocked,
        CASE WHEN kind = 2 THEN 1 ELSE kind END AS k, CASE WHEN kind = 2 THEN 0 ELSE count END AS c
      FROM ({source}))"""

    return f""", calls AS ({calls}), s AS ({step(first)} UNION ALL {step(following)})"""


_STATE = "['CLOSED','HALF_OPEN','OPEN'][kind + 1]"
SPARSE = breaker.Breaker(failures=3, reset_ms=12 * 3600 * 1000, successes=2)


@query("circuit_breaker", "metrics", _walk("""SELECT 'user-' || user_id AS key, event_id AS seq,
    event_type <> 'error' AS ok, epoch_us(ts) AS tick,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events""", SPARSE) + f"""
  SELECT key, tick // 1000 AS ts_ms, seq, ok, admitted, {_STATE} AS state FROM s""", recursive=True)
def circuit_breaker(t: Tables):
    """Three errors open, twelve hours rest, two successes close: the calls are sparse."""
    done = breaker.circuit_breaker(t.calls(), SPARSE)
    return done.select("key", F.unix_millis("ts").alias("ts_ms"), "seq", "ok", "admitted", "state")


_SHARDED = breaker.Breaker(failures=2, reset_ms=600_000, successes=2)


@query("consume_with_breaker", "orders_log payments_log", _walk("""SELECT *,
    row_number() OVER (PARTITION BY key ORDER BY tick, o, p) AS n FROM (SELECT topic, p, o, epoch_us(ts) AS tick,
    topic || ':' || (o % 50) AS key, NOT (value IS NULL OR trim(value) = '' OR down) AS ok FROM (
      SELECT *, coalesce(value LIKE '%PAYMENT_SERVICE_DOWN%' OR value LIKE '%RETRY_ERROR%', false) AS down
      FROM (SELECT * FROM orders_log UNION ALL SELECT * FROM payments_log)))""", _SHARDED) + f"""
  SELECT topic, p AS "partition", o AS "offset", CASE WHEN NOT admitted THEN 'REJECTED' WHEN ok THEN 'SUCCESS'
    ELSE 'ERROR' END AS status, NOT (admitted AND w.down) AS acked, {_STATE} AS state FROM s JOIN (
    SELECT topic, p, o, coalesce(value LIKE '%PAYMENT_SERVICE_DOWN%' OR value LIKE '%RETRY_ERROR%', false) AS down
    FROM (SELECT * FROM orders_log UNION ALL SELECT * FROM payments_log)) w USING (topic, p, o)""", recursive=True)
def consume_with_breaker(t: Tables):
    """Orders and payments, each through fifty workers with a breaker of their own. A service that is down is
    an error from which the record recovers, so it is not acknowledged."""
    rows = process.process_by_topic(t.orders_log().unionByName(t.payments_log()))
    down = F.coalesce(F.contains("value", F.lit("PAYMENT_SERVICE_DOWN")) | F.contains("value", F.lit("RETRY_ERROR")), F.lit(False))
    calls = rows.select(
        *_ID, "timestamp", F.concat_ws(":", "topic", F.col("offset") % 50).alias("key"),
        (F.col("error_rule").isNull() & ~down).alias("ok"), down.alias("recoverable"))
    done = breaker.circuit_breaker(calls, _SHARDED, time="timestamp", order=("timestamp", "offset", "partition"))
    return breaker.gated_outcome(done).select(*_ID, "status", "acked", "state")
