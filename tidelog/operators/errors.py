"""Failure classes, retry plans, dead-letter routing and error headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidelog.functions.headers import add_headers, header, header_if
from tidelog.functions.text import instant_text, utf16_length, utf16_prefix

VALIDATION = "ValidationException"
NON_RECOVERABLE = "NonRecoverableException"
RECOVERABLE = "RecoverableException"
DESERIALIZATION = "DeserializationException"

# Error codes by class, exception lists and back-off of each policy.
AUTH_CODES = ["AUTH_FAILED", "INVALID_CREDENTIALS", "TOKEN_EXPIRED"]
AUTHZ_CODES = ["ACCESS_DENIED", "INSUFFICIENT_PERMISSIONS", "FORBIDDEN"]
CONFIG_CODES = ["CONFIG_ERROR", "INVALID_CONFIG", "MISSING_CONFIG"]
UNKNOWN_CODE = "UNKNOWN"
NOT_RETRYABLE = {
    "basic": ["ValidationException", "NonRecoverableException", "IllegalArgumentException",
              "SecurityException", "UnsupportedOperationException"],
    "enhanced": ["ValidationException", "NonRecoverableException", "IllegalArgumentException",
                 "SecurityException", "UnsupportedOperationException"],
    "config": ["ValidationException", "NonRecoverableException", "DeserializationException",
               "MessageConversionException", "IllegalArgumentException", "NullPointerException"],
    "fixed": ["ValidationException", "DeserializationException"],
}
RETRYABLE = {
    "basic": ["RecoverableException", "ConnectException", "SocketTimeoutException", "KafkaException"],
    "enhanced": ["RecoverableException", "ConnectException", "SocketTimeoutException", "KafkaException"],
    "config": ["RecoverableException", "TransientDataAccessException", "ResourceAccessException",
               "SocketTimeoutException", "TimeoutException"],
    "fixed": ["RecoverableException", "SocketTimeoutException"],
}
# retries, first delay ms, factor, longest delay ms
BACKOFF = {
    "basic": (10, 1000, 2, 32000),
    "enhanced": (10, 1000, 2, 32000),
    "config": (3, 1000, 2, 10000),
    "fixed": (3, 5000, 1, 5000),
}
JITTER = 0.1
CONTENT_SHOWN = 200
MAX_ERRORS_PER_MINUTE = 100


def is_class(name: str) -> Column:
    return F.col("exception_class") == name


def error_code() -> Column:
    return F.coalesce(F.col("error_code"), F.lit(UNKNOWN_CODE))


def error_class() -> Column:
    """AUTH, AUTHZ, CONFIG or OTHER for permanent failures; null for the rest."""
    code = error_code()
    kind = (F.when(code.isin(AUTH_CODES), "AUTH").when(code.isin(AUTHZ_CODES), "AUTHZ")
            .when(code.isin(CONFIG_CODES), "CONFIG").otherwise("OTHER"))
    return F.when(is_class(NON_RECOVERABLE), kind)


def retryable(policy: str = "enhanced") -> Column:
    """Whether the policy tries again; classes on neither list are tried again."""
    return ~F.col("exception_class").isin(NOT_RETRYABLE[policy])


def retry_list(policy: str = "enhanced") -> Column:
    name = F.col("exception_class")
    return (F.when(name.isin(NOT_RETRYABLE[policy]), "NOT_RETRYABLE")
            .when(name.isin(RETRYABLE[policy]), "RETRYABLE").otherwise("DEFAULT"))


def next_delay_ms(attempt: Column) -> Column:
    """Planned wait after an attempt, without jitter; 0 for no attempt."""
    doubled = F.lit(1000.0) * F.pow(F.lit(2.0), (F.least(attempt, F.lit(40)) - 1).cast("double"))
    return F.when(attempt <= 0, 0).otherwise(F.least(doubled, F.lit(32000.0))).cast("bigint")


def retry_schedule(failures: DataFrame, policy: str = "enhanced", jitter_key: Column | None = None) -> DataFrame:
    """One row per planned retry of each retryable failure: number, wait, due time.

    The waits of a policy are a short fixed list. With ``jitter_key`` each wait moves by up
    to a tenth, seeded by the key and the retry number, so that a rerun plans the same.
    """
    retries, first, factor, longest = BACKOFF[policy]
    plan, after = [], F.lit(0).cast("bigint")
    for n in range(1, retries + 1):
        wait = F.lit(min(first * factor ** (n - 1), longest)).cast("bigint")
        if jitter_key is not None:
            share = F.pmod(F.xxhash64(jitter_key, F.lit(n)), F.lit(1 << 30)) / float(1 << 30)
            wait = (wait * (1.0 - JITTER + 2 * JITTER * share)).cast("bigint")
        after = after + wait
        plan.append(F.struct(F.lit(n).alias("retry"), wait.alias("delay_ms"), after.alias("__after")))
    planned = failures.filter(retryable(policy)).withColumn("__plan", F.explode(F.array(*plan)))
    return planned.select(*failures.columns, "__plan.retry", "__plan.delay_ms",
                          (F.unix_millis("failed_at") + F.col("__plan.__after")).alias("due_ms"))


def _tag(label: str, text: Column, when: Column) -> Column:
    return F.when(when, F.concat(F.lit(f" [{label}: "), text.cast("string"), F.lit("]"))).otherwise("")


def detail_text() -> Column:
    """Message with what is known about the failure, by class."""
    c = F.col
    base = F.coalesce(c("exception_message"), F.lit(""))
    corr = _tag("CorrelationId", c("correlation_id"), c("correlation_id").isNotNull())
    shown = F.when(utf16_length(c("value")) <= CONTENT_SHOWN, c("value")).otherwise(
        F.concat(utf16_prefix(c("value"), CONTENT_SHOWN), F.lit("...")))
    validation = F.concat(
        base, _tag("Rule", c("validation_rule"), c("validation_rule").isNotNull()),
        _tag("Field", c("field_name"), c("field_name").isNotNull()),
        _tag("Content", shown, c("value").isNotNull()))
    permanent = F.concat(
        base, _tag("ErrorCode", error_code(), error_code() != UNKNOWN_CODE), corr,
        _tag("Timestamp", F.unix_millis("failed_at"), F.lit(True)))
    delay = next_delay_ms(c("attempt"))
    temporary = F.concat(
        base, corr, _tag("Attempt", c("attempt"), c("attempt") > 0),
        _tag("NextRetryIn", F.concat(delay.cast("string"), F.lit("ms")), delay > 0),
        _tag("Service", c("service_name"), c("service_name").isNotNull()))
    return (F.when(is_class(VALIDATION), validation).when(is_class(NON_RECOVERABLE), permanent)
            .when(is_class(RECOVERABLE), temporary).otherwise(base))


def log_map() -> Column:
    """Failure as name -> text, without the names that have no value."""
    pairs = F.create_map(
        F.lit("message"), F.col("exception_message"), F.lit("errorCode"), error_code(),
        F.lit("timestamp"), F.unix_millis("failed_at").cast("string"),
        F.lit("correlationId"), F.col("correlation_id"))
    return F.map_filter(pairs, lambda _, v: v.isNotNull())


# ---- routing ---------------------------------------------------------------------------------

def _topic(*parts) -> Column:
    return F.concat(F.col("topic"), *[p if isinstance(p, Column) else F.lit(p) for p in parts], F.lit(".dlt"))


def route_basic() -> Column:
    return (
        F.when(is_class(VALIDATION), _topic(".validation"))
        .when(is_class(NON_RECOVERABLE), _topic(".non-recoverable.", F.lower(error_code())))
        .when(is_class(RECOVERABLE), _topic(".recoverable")).otherwise(_topic())
    )


def route_enhanced(poison: Column, breaker_open: Column) -> Column:
    """Poison records first, then open breakers, then by class and detail."""
    code, service = F.lower(error_code()), F.lower(F.col("service_name"))
    temporary = is_class(RECOVERABLE)
    kind = error_class()
    return (
        F.when(poison, _topic(".poison-pill"))
        .when(temporary & service.isNotNull() & breaker_open, _topic(".circuit-breaker.", service))
        .when(is_class(VALIDATION) & F.col("field_name").isNotNull(),
              _topic(".validation.", F.lower(F.col("field_name"))))
        .when(is_class(VALIDATION), _topic(".validation"))
        .when(kind == "AUTH", _topic(".auth.", code))
        .when(kind == "AUTHZ", _topic(".authz.", code))
        .when(kind == "CONFIG", _topic(".config.", code))
        .when(kind == "OTHER", _topic(".non-recoverable.", code))
        .when(temporary & service.isNotNull(), _topic(".recoverable.", service))
        .when(temporary, _topic(".recoverable"))
        .otherwise(_topic(".error.", F.lower(F.col("exception_class"))))
    )


def route_config() -> Column:
    return (
        F.when(is_class(VALIDATION), _topic(".validation"))
        .when(is_class(DESERIALIZATION), _topic(".deserialization"))
        .when(is_class(NON_RECOVERABLE), _topic(".business")).otherwise(_topic())
    )


# ---- headers of dead-letter records ------------------------------------------------------------

def context_text(context: Column) -> Column:
    """A failure's context as text, by name: {a=1, b=2}."""
    pairs = F.transform(F.array_sort(F.map_entries(context)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null"))))
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))


def basic_headers() -> list[Column]:
    """Needs ``context``, a map that may be null."""
    c = F.col
    validation, permanent, temporary = (is_class(VALIDATION), is_class(NON_RECOVERABLE), is_class(RECOVERABLE))
    return [
        header("dlt.original-topic", c("topic")),
        header("dlt.original-partition", c("partition").cast("string")),
        header("dlt.original-offset", c("offset").cast("string")),
        header("dlt.exception-class", c("exception_class")),
        header("dlt.exception-message", F.coalesce(c("exception_message"), F.lit(""))),
        header("dlt.exception-timestamp", instant_text(c("failed_at"))),
        header_if(validation & c("validation_rule").isNotNull(), "dlt.validation-rule", c("validation_rule")),
        header_if(validation & c("field_name").isNotNull(), "dlt.field-name", c("field_name")),
        header_if(validation & c("value").isNotNull(), "dlt.original-message-content", c("value")),
        header_if(permanent, "dlt.error-code", error_code()),
        header_if(permanent & (F.size("context") > 0), "dlt.error-context", context_text(c("context"))),
        header_if(temporary, "dlt.retry-attempts", c("attempt").cast("string")),
        header_if((permanent | temporary) & c("correlation_id").isNotNull(), "dlt.correlation-id",
                  c("correlation_id")),
        header_if(temporary & c("service_name").isNotNull(), "dlt.service-name", c("service_name")),
    ]


def enhanced_headers(host: str = "unknown", application: str = "event-log",
                     environment: str = "unknown") -> list[Column]:
    """Needs ``failure_count``, ``poison``, ``breaker_state`` and ``breaker_failures``."""
    c = F.col
    known = c("service_name").isNotNull() & c("breaker_state").isNotNull()
    at = instant_text(c("failed_at"))
    return [
        header("dlt.enhanced.version", F.lit("2.0")),
        header("dlt.enhanced.timestamp", at),
        header("dlt.enhanced.hostname", F.lit(host)),
        header("dlt.enhanced.application", F.lit(application)),
        header("dlt.enhanced.environment", F.lit(environment)),
        header("dlt.enhanced.message.key", F.concat_ws(":", "topic", "partition", "offset")),
        header("dlt.enhanced.failure.count", c("failure_count").cast("string")),
        header_if(known, "dlt.enhanced.circuit.breaker.service", c("service_name")),
        header_if(known, "dlt.enhanced.circuit.breaker.state", c("breaker_state")),
        header_if(known, "dlt.enhanced.circuit.breaker.failure.count", c("breaker_failures").cast("string")),
        header_if(c("correlation_id").isNotNull(), "dlt.enhanced.correlation.id", c("correlation_id")),
        header_if(c("poison"), "dlt.enhanced.poison.pill", F.lit("true")),
        header_if(c("poison"), "dlt.enhanced.poison.pill.detected.at", at),
    ]


def config_headers() -> list[Column]:
    c = F.col
    return [
        header("dlt-exception-message", F.coalesce(c("exception_message"), F.lit(""))),
        header("dlt-exception-class", c("exception_class")),
        header("dlt-original-topic", c("topic")),
        header("dlt-original-partition", c("partition").cast("string")),
        header("dlt-original-offset", c("offset").cast("string")),
        header("dlt-timestamp", F.unix_millis("failed_at").cast("string")),
    ]


def with_flags(failures: DataFrame) -> DataFrame:
    """Neutral values for the columns that the enhanced headers read, where absent."""
    defaults = {"context": F.lit(None).cast("map<string,string>"), "failure_count": F.col("attempt"), "poison": F.lit(False),
                "breaker_state": F.lit(None).cast("string"), "breaker_failures": F.lit(None).cast("bigint")}
    for name, value in defaults.items():
        if name not in failures.columns:
            failures = failures.withColumn(name, value)
    return failures


def dead_letters(failures: DataFrame, policy: str = "enhanced", **names) -> DataFrame:
    """Failed records as dead-letter log records: routed topic, error headers added.

    The enhanced policy writes the basic headers too, since both the filters and the
    reprocessing of dead letters read headers of both sets.
    """
    rows = with_flags(failures)
    if policy == "config":
        topic, new = route_config(), config_headers()
    elif policy == "basic":
        topic, new = route_basic(), basic_headers()
    else:
        topic = route_enhanced(F.col("poison"), F.coalesce(F.col("breaker_state") == "OPEN", F.lit(False)))
        new = basic_headers() + enhanced_headers(**names)
    return rows.select(
        topic.alias("topic"), "partition", "offset", "key", "value",
        add_headers(F.col("headers"), *new).alias("headers"), F.col("failed_at").alias("timestamp"))


def error_counters(failures: DataFrame, *by: str) -> DataFrame:
    """Failures by class; the last attempt of a record is the one that was published."""
    return failures.groupBy(*by).agg(
        F.count_if(is_class(VALIDATION)).alias("validation_errors"),
        F.count_if(is_class(NON_RECOVERABLE)).alias("non_recoverable_errors"),
        F.count_if(is_class(RECOVERABLE)).alias("recoverable_errors"),
        F.count(F.lit(1)).alias("failures"), F.count_if(F.col("attempt") > 1).alias("retries"))
