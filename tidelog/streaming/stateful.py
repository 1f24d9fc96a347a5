"""Rules that remember a key across micro-batches.

A key's rows are applied in the order of their times, whatever micro-batch brings them: they wait in keyed state until
the watermark has passed their slot of time (see ``ordered``). The newest slots are therefore still open when a stream ends.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidelog.operators.breaker import INITIAL, STATE_NAMES, Breaker, gated_outcome
from tidelog.operators.tracking import MAX_ERRORS_PER_MINUTE, POISON_FAILURES, RECORD
from tidelog.streaming.ordered import SLOT_MS, in_order
from tidelog.streaming.reading import WATERMARK

COOLDOWN_MS = 5 * 60 * 1000
MINUTE_MS = 60_000
#: Parts of a topic's minute that are counted on their own before they meet.
PARTS = 16


def _layout(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def circuit_breaker(calls: DataFrame, rule: Breaker = Breaker(), key: str = "key", time: str = "ts",
                    order: Sequence[str] = ("ts", "seq"), ok: str = "ok", watermark: str = WATERMARK,
                    slot_ms: int = SLOT_MS, forget_ms: int | None = None) -> DataFrame:
    """Stream form of the breaker: same columns and rules as on static data. A key without calls for ``forget_ms``
    is forgotten; by default none is. Of a hot key, a task holds the calls of one slot."""
    columns = list(calls.columns)

    def run(_: tuple, state: tuple | None, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        now, admitted, names = state or INITIAL, [], []
        for at, good in zip(rows["__us"].tolist(), rows["__good"].tolist(), strict=True):
            now, through = rule.step(now, at, bool(good))
            admitted.append(through)
            names.append(STATE_NAMES[now[0]])
        return now, rows[columns].assign(admitted=admitted, state=names)

    placed = calls.withColumn("__us", F.unix_micros(F.col(time))).withColumn("__good", F.coalesce(F.col(ok), F.lit(False)))
    return in_order(placed, [key], time, watermark, run, "kind int, count int, opened bigint",
                    f"{_layout(calls)}, admitted boolean, state string", order, slot_ms, forget_ms)


def consume_with_breaker(calls: DataFrame, rule: Breaker = Breaker(), **how) -> DataFrame:
    """Records behind a breaker per key, with ``status`` and ``acked`` as on static data."""
    return gated_outcome(circuit_breaker(calls, rule, **how))


def poison_pills(failures: DataFrame, threshold: int = POISON_FAILURES, cooldown_ms: int = COOLDOWN_MS,
                 watermark: str = WATERMARK, slot_ms: int = SLOT_MS) -> DataFrame:
    """Each failure with the running count of its record and whether that makes it poison.

    A record without a failure for the cooldown is forgotten. That goes by event time: a
    replay decides the same, and a stream over what is available now comes to an end.
    """

    def run(key: tuple, state: tuple | None, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        count = state[0] if state else 0
        counts = range(count + 1, count + len(rows) + 1)
        return (count + len(rows),), pd.DataFrame({
            "topic": key[0], "partition": key[1], "offset": key[2], "attempt": rows["attempt"].to_numpy(),
            "failure_count": list(counts), "poison": [c >= threshold for c in counts]})

    return in_order(failures.select(*RECORD, "attempt", "failed_at"), RECORD, "failed_at", watermark, run, "count bigint",
                    "topic string, partition int, offset bigint, attempt int, failure_count bigint, poison boolean",
                    ["__at", "attempt"], slot_ms, cooldown_ms)


def rate_limit(failures: DataFrame, limit: int = MAX_ERRORS_PER_MINUTE, watermark: str = WATERMARK, parts: int = PARTS) -> DataFrame:
    """Each failure with whether its topic minute was already full.

    A topic may hold a third of all failures, so each part of its minute first picks its own earliest ``limit``
    ones. What is behind those is limited whatever the other parts hold, and only the picked ones meet, at most
    ``parts`` times ``limit`` of them. All parts come out in the batch whose watermark ends the minute, and state goes then.
    """
    place = ["__ms", "partition", "offset", "attempt"]

    def pick(key: tuple, _: tuple | None, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        ranks = list(range(len(rows)))
        return (len(rows),), pd.DataFrame({
            "topic": key[0], "minute": key[1], "lane": [0 if k < limit else 1 + key[2] for k in ranks],
            "partition": rows["partition"].to_numpy(), "offset": rows["offset"].to_numpy(), "attempt": rows["attempt"].to_numpy(),
            "__ms": rows["__ms"].to_numpy(),
            # later than the watermark of the batch before, so that the second step does not take it for late
            "closes_at": pd.to_datetime([(key[1] + 1) * MINUTE_MS] * len(rows), unit="ms")})

    def meet(key: tuple, _: tuple | None, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        ranks = list(range(len(rows)))
        return (len(rows),), pd.DataFrame({
            "topic": key[0], "partition": rows["partition"].to_numpy(), "offset": rows["offset"].to_numpy(),
            "attempt": rows["attempt"].to_numpy(), "limited": [key[2] > 0 or k >= limit for k in ranks]})

    slim = failures.select(
        *RECORD, "attempt", "failed_at", F.unix_millis("failed_at").alias("__ms"),
        F.expr(f"unix_millis(failed_at) div {MINUTE_MS}").alias("minute"),
        F.pmod(F.xxhash64("partition", "offset", "attempt"), F.lit(parts)).cast("int").alias("part"))
    picked = in_order(slim, ["topic", "minute", "part"], "failed_at", watermark, pick, "seen bigint",
                      "topic string, minute bigint, lane int, partition int, offset bigint, attempt int, `__ms` bigint, closes_at timestamp",
                      place, MINUTE_MS, MINUTE_MS, event_time="closes_at")
    return in_order(picked, ["topic", "minute", "lane"], "closes_at", "", meet, "seen bigint",
                    "topic string, partition int, offset bigint, attempt int, limited boolean", place, 1, MINUTE_MS)


def service_breaker(failures: DataFrame, threshold: int) -> DataFrame:
    """Failures per service and whether that opens its breaker: for update or complete mode."""
    counted = failures.filter(F.col("service_name").isNotNull()).groupBy("service_name").agg(
        F.count(F.lit(1)).alias("failures"))
    return counted.withColumn("state", F.when(F.col("failures") >= threshold, "OPEN").otherwise("CLOSED"))
