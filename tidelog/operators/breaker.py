"""Circuit breaker per key over an ordered series of call outcomes.

The breaker is a small state machine, so a key cannot simply be split. But what a stretch of
calls does to the breaker can be written down for every state it might be entered in:

1. keys of more than ``chunk`` calls are numbered and cut into chunks of so many;
2. each chunk becomes a function, kept as rows: an exit for each closed and half-open entry state, and steps of
   time for entries that are open (until when opened, which exit);
3. functions of neighbours are composed pair by pair until a key has one, in as many rounds as the logarithm of
   its chunks. An exit that is open meets the next function's steps by a merge over the borders of tasks (see
   ``carry``), so a function's rows never have to be together;
4. going back down, the state in which a pair is entered gives those of its two halves, by one look-up each;
5. each chunk is replayed from its entry state.

So no task holds more of a key than a chunk's calls, however hot the key is and whatever its calls do.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidelog.operators.carry import carried
from tidelog.operators.indexing import rank_within
from tidelog.session import measured

CLOSED, HALF_OPEN, OPEN = 0, 1, 2
STATE_NAMES = ["CLOSED", "HALF_OPEN", "OPEN"]
INITIAL = (CLOSED, 0, 0)
CHUNK = 50_000

ENTRY = [("__kind", "int"), ("__count", "int"), ("__opened", "bigint")]


@dataclass(frozen=True)
class Breaker:
    """Opens after ``failures`` in a row, tries again ``reset_ms`` later, closes after
    ``successes`` in a row. Times inside are microseconds."""

    failures: int = 10
    reset_ms: int = 300_000
    successes: int = 5

    @property
    def reset(self) -> int:
        return self.reset_ms * 1000

    def step(self, state: tuple, at: int, ok: bool) -> tuple[tuple, bool]:
        """State after one call, and whether the call was let through. A state is (kind,
        failures or successes so far, time of opening)."""
        kind, count, opened = state
        if kind == OPEN:
            if at - opened < self.reset:
                return state, False
            kind, count = HALF_OPEN, 0
        if kind == HALF_OPEN:
            if not ok:
                return (OPEN, self.failures, at), True
            return ((HALF_OPEN, count + 1, 0) if count + 1 < self.successes else INITIAL), True
        if ok:
            return INITIAL, True
        return ((CLOSED, count + 1, 0) if count + 1 < self.failures else (OPEN, count + 1, at)), True

    def summary(self, times: Sequence[int], oks: Sequence[bool]) -> tuple[list, list]:
        """Exit states by entry state: closed 0.., half-open 0.., then steps (last time,
        exit) for an entry that is open until some time within the stretch."""
        n = len(times)
        closed = [(CLOSED, i, 0) for i in range(self.failures)]
        half = [(HALF_OPEN, i, 0) for i in range(self.successes)]
        from_half = [half[0]] * (n + 1)  # exit when the trial phase begins at call i
        steps: list[tuple[int, tuple]] = []
        for i in range(n - 1, -1, -1):
            if oks[i]:
                closed, half = [closed[0]] * self.failures, half[1:] + [closed[0]]
            else:
                again = max(i + 1, bisect_left(times, times[i] + self.reset))
                opened = from_half[again] if again < n else (OPEN, self.failures, times[i])
                closed, half = closed[1:] + [opened], [opened] * self.successes
            from_half[i] = half[0]
            if not steps or steps[-1][1] != half[0]:
                steps.append((times[i], half[0]))
        return closed + half, steps[::-1]

    def after(self, state: tuple, exits: Sequence[tuple], steps: Sequence[tuple]) -> tuple:
        """Exit state of a summarised stretch entered in ``state``."""
        kind, count, opened = state
        if kind == CLOSED:
            return exits[count]
        if kind == HALF_OPEN:
            return exits[self.failures + count]
        at = bisect_left([t for t, _ in steps], opened + self.reset)
        return steps[at][1] if at < len(steps) else state


def _runs(batch: pa.RecordBatch, *columns: str):
    return zip(*[batch.column(c).to_pylist() for c in columns])


#: A function as rows: entries of ``kind`` with the count ``at``, or open ones that wait until a time in (since, at],
#: leave as ``exit_*``; the stretch lasts from ``first`` to ``last``.
FUNCTION = ("key string, group bigint, kind int, at bigint, since bigint, exit_kind int, exit_count bigint, "
            "exit_opened bigint, first bigint, last bigint")
_NUMBERS = ["group", "kind", "at", "since", "exit_kind", "exit_count", "exit_opened", "first", "last"]
_SCHEMA = pa.schema([("key", pa.string())] + [(c, pa.int32() if c in ("kind", "exit_kind") else pa.int64()) for c in _NUMBERS])
_EXIT = ["exit_kind", "exit_count", "exit_opened"]
_NEVER = -(1 << 62)
_ROWS = 10_000


def _function_rows(rule: Breaker, times: Sequence[int], oks: Sequence[bool]) -> list[tuple]:
    """(kind, at, since, exit) of a chunk. Calls before it opened the breaker at its first call at the latest, so
    steps that no such entry can wait for are left out."""
    exits, steps = rule.summary(times, oks)
    rows = [(CLOSED, i, 0, exits[i]) for i in range(rule.failures)]
    rows += [(HALF_OPEN, i, 0, exits[rule.failures + i]) for i in range(rule.successes)]
    since = _NEVER
    for upto, out in steps:
        if since >= times[0] + rule.reset:
            break
        rows.append((OPEN, upto, since, out))
        since = upto
    return rows


def _summarise(rule: Breaker):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, times, oks = None, [], []

        def finished() -> Iterator[pa.RecordBatch]:
            rows = _function_rows(rule, times, oks)
            for start in range(0, len(rows), _ROWS):
                some = rows[start:start + _ROWS]
                columns = [[place[0]] * len(some), [place[1]] * len(some), *zip(*[r[:3] for r in some], strict=True),
                           *zip(*[r[3] for r in some], strict=True), [times[0]] * len(some), [times[-1]] * len(some)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)

        for batch in batches:
            for key, chunk, at, ok in _runs(batch, "__key", "__chunk", "__at", "__ok"):
                if (key, chunk) != place:
                    if place is not None:
                        yield from finished()
                    place, times, oks = (key, chunk), [], []
                times.append(at)
                oks.append(ok)
        if place is not None:
            yield from finished()

    return run


def _composed(functions: DataFrame, rule: Breaker) -> DataFrame:
    """Functions of the groups 2 k and 2 k + 1 one after the other, as group k; one without a second stays."""
    paired = functions.withColumn("pair", F.expr("group div 2"))
    first, second = paired.filter("group % 2 = 0"), paired.filter("group % 2 = 1")
    spans = measured(paired.groupBy("key", "pair").agg(
        F.min("first").alias("begin"), F.max("last").alias("end"),
        F.max(F.when(F.col("group") % 2 == 0, F.col("last"))).alias("border")))
    # an exit that is open waits for the second's first step at or behind its time: times go downwards
    steps = second.filter(F.col("kind") == OPEN).select(
        "key", "pair", (-F.col("at")).alias("place"), F.lit(0).alias("late"), F.lit(True).alias("step"), *_EXIT)
    waiting = first.filter(F.col("exit_kind") == OPEN).select(
        "key", "pair", (-(F.col("exit_opened") + rule.reset)).alias("place"), F.lit(1).alias("late"), F.lit(False).alias("step"),
        *_EXIT, "kind", "at", "since")
    met = carried(steps.unionByName(waiting, allowMissingColumns=True), ["key", "pair"], ["place", "late"], "step", _EXIT)
    open_ = met.filter("not step").select("key", "pair", "kind", "at", "since", *[
        F.when(F.col("last_exit_kind").isNull(), F.col(c)).otherwise(F.col(f"last_{c}")).alias(c) for c in _EXIT])
    small = second.filter(F.col("kind") != OPEN).select(
        F.col("key").alias("k"), F.col("pair").alias("p"), F.col("kind").alias("in_kind"), F.col("at").alias("in_count"),
        *[F.col(c).alias(f"to_{c}") for c in _EXIT])
    match = (F.col("key") == F.col("k")) & (F.col("pair") == F.col("p")) & (
        F.col("exit_kind") == F.col("in_kind")) & (F.col("exit_count") == F.col("in_count"))
    counted = first.filter(F.col("exit_kind") != OPEN).join(small, match, "left").select("key", "pair", "kind", "at", "since", *[
        F.when(F.col("k").isNull(), F.col(c)).otherwise(F.col(f"to_{c}")).alias(c) for c in _EXIT])
    # entries that wait for longer than the first lasts pass on to the second as they are
    beyond = second.filter(F.col("kind") == OPEN).join(spans, ["key", "pair"]).filter(
        (F.col("at") > F.col("border")) & (F.greatest("since", "border") < F.col("begin") + rule.reset)).select(
        "key", "pair", "kind", "at", F.greatest("since", "border").alias("since"), *_EXIT)
    return measured(open_.unionByName(counted).unionByName(beyond).join(spans, ["key", "pair"]).select(
        "key", F.col("pair").alias("group"), "kind", "at", "since", *_EXIT, F.col("begin").alias("first"), F.col("end").alias("last")))


_STATE = ["in_kind", "in_count", "in_opened"]


def _halves(parents: DataFrame, functions: DataFrame, rule: Breaker) -> DataFrame:
    """(key, group, in_*): states in which the two halves of each pair are entered."""
    first = parents.withColumn("group", F.col("group") * 2)
    wanted = ((F.col("kind") == F.col("in_kind")) & (
        ((F.col("kind") != OPEN) & (F.col("at") == F.col("in_count")))
        | ((F.col("kind") == OPEN) & (F.col("at") >= F.col("in_opened") + rule.reset)
           & (F.col("since") < F.col("in_opened") + rule.reset))))
    left = functions.filter("group % 2 = 0").join(first, ["key", "group"]).filter(wanted).select("key", "group", *_EXIT)
    out = first.join(left, ["key", "group"], "left").select("key", (F.col("group") + 1).alias("group"), *[
        F.when(F.col("exit_kind").isNull(), F.col(i)).otherwise(F.col(o)).alias(i) for i, o in zip(_STATE, _EXIT, strict=True)])
    return measured(first.select("key", "group", *_STATE).unionByName(out))


def entry_states(functions: DataFrame, rule: Breaker) -> DataFrame:
    """(key, group, in_*): the state in which each group of a key is entered, given the functions of all, numbered from 0."""
    levels = [measured(functions)]
    while (levels[-1].agg(F.max("group")).first()[0] or 0) > 0:
        levels.append(_composed(levels[-1], rule))
    kind, count, opened = INITIAL
    states = measured(levels[-1].select("key").distinct().select(
        "key", F.lit(0).cast("bigint").alias("group"), F.lit(kind).alias("in_kind"), F.lit(count).cast("bigint").alias("in_count"),
        F.lit(opened).cast("bigint").alias("in_opened")))
    for functions in reversed(levels[:-1]):
        states = _halves(states, functions, rule)
    return states


def _replay(rule: Breaker, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, state = None, INITIAL
        for batch in batches:
            admitted, states = [], []
            for i, (key, chunk, at, ok) in enumerate(_runs(batch, "__key", "__chunk", "__at", "__ok")):
                if (key, chunk) != place:
                    place = (key, chunk)
                    entry = tuple(batch.column(name)[i].as_py() for name, _ in ENTRY)
                    state = INITIAL if entry[0] is None else entry
                state, let_through = rule.step(state, at, ok)
                admitted.append(let_through)
                states.append(STATE_NAMES[state[0]])
            columns = [batch.column(i) for i in range(width)]  # passed through untouched
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(admitted, pa.bool_()), pa.array(states, pa.string())],
                names=[*batch.schema.names[:width], "admitted", "state"])

    return run


def circuit_breaker(calls: DataFrame, rule: Breaker = Breaker(), key: str = "key", time: str = "ts",
                    order: Sequence[str] = ("ts", "seq"), ok: str = "ok", chunk: int = CHUNK) -> DataFrame:
    """Adds ``admitted`` (let through) and ``state`` (of the breaker after the call)."""
    named = calls.withColumn("__key", F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("-")))
    columns = [*calls.columns, "__key", F.unix_micros(F.col(time)).alias("__at"), F.coalesce(F.col(ok), F.lit(False)).alias("__ok")]
    entry = [F.lit(None).cast(kind).alias(name) for name, kind in ENTRY]
    layout = f"{_ddl(calls)}, admitted boolean, state string"
    hot = measured(named.groupBy("__key").agg(F.count(F.lit(1)).alias("__calls")).filter(F.col("__calls") > chunk).select("__key"))
    whole = named if hot.isEmpty() else named.join(hot, "__key", "left_anti")
    cold = whole.select(*columns, F.lit(0).cast("bigint").alias("__chunk"), *entry).repartition("__key").sortWithinPartitions(
        "__key", *order).mapInArrow(_replay(rule, len(calls.columns)), layout)
    if hot.isEmpty():
        return cold
    ranked = rank_within(named.join(hot, "__key", "left_semi"), list(order), group=["__key"], name="__rank")
    placed = ranked.select(*columns, "__rank", F.expr(f"__rank div {chunk}").alias("__chunk"))
    functions = placed.select("__key", "__chunk", "__rank", "__at", "__ok").repartition("__key", "__chunk").sortWithinPartitions(
        "__key", "__chunk", "__rank").mapInArrow(_summarise(rule), FUNCTION)
    states = entry_states(functions, rule).select(
        F.col("key").alias("__key"), F.col("group").alias("__chunk"),
        *[F.col(c).cast(kind).alias(name) for c, (name, kind) in zip(_STATE, ENTRY, strict=True)])
    warm = placed.join(states, ["__key", "__chunk"]).select(
        *calls.columns, "__key", "__at", "__ok", "__chunk", *[name for name, _ in ENTRY], "__rank").repartition(
        "__key", "__chunk").sortWithinPartitions("__key", "__chunk", "__rank").mapInArrow(_replay(rule, len(calls.columns)), layout)
    return cold.unionByName(warm)


def gated_outcome(done: DataFrame) -> DataFrame:
    """``status`` and ``acked`` of processing behind a breaker. A rejected record is reported
    as REJECTED; a broken rule is an error that is acknowledged all the same. A ``recoverable`` error
    (where there is such a column) is not, so that it comes again."""
    status = F.when(~F.col("admitted"), "REJECTED").when(F.col("ok"), "SUCCESS").otherwise("ERROR")
    again = F.coalesce(F.col("recoverable"), F.lit(False)) if "recoverable" in done.columns else F.lit(False)
    return done.withColumn("status", status).withColumn("acked", ~((F.col("status") == "ERROR") & again))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
