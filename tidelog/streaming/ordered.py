"""Rules on streams that see a key's rows in the order of their times, whatever order they arrive in.

Rows wait in a map state by slot of event time. A timer fires when the watermark has passed a slot; only then, and only
that slot's rows of the key, are read, sorted and given to the rule. So a key's rows are never gathered: a task
holds those of one slot, and what a micro-batch brings is put away as it comes. Rules keep a small value state, which a
second timer lets go after a pause. State lives in RocksDB, off the heap, and only changes are written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SLOT_MS = 60_000

#: (key, state or None, sorted rows) -> (new state, rows of the result)
Rule = Callable[[tuple, tuple | None, pd.DataFrame], tuple[tuple, pd.DataFrame]]


def use_rocksdb(spark: SparkSession) -> None:
    """State stores of queries that start from now on; the heap holds none of their state."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _packed(rows: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(packed: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(packed).read_pandas()


class InOrder(StatefulProcessor):
    """Gives each key's rows to ``rule`` a slot at a time, sorted by ``order``. ``__at`` holds milliseconds."""

    def __init__(self, rule: Rule, state: str, names: Sequence[str], order: Sequence[str], slot_ms: int, forget_ms: int | None):
        self.rule, self.layout, self.names, self.order = rule, state, list(names), list(order)
        self.slot_ms, self.forget_ms = slot_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "slot bigint, part int", "rows binary")
        self.counts = handle.getMapState("counts", "slot bigint", "parts int")
        self.state = handle.getValueState("state", self.layout)
        self.quiet = handle.getValueState("quiet", "at bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for frame in rows:
            frame.columns = self.names  # Spark hands out other names for those that begin with an underscore
            for slot, piece in frame.groupby(frame["__at"] // self.slot_ms):
                slot = int(slot)
                known = self.counts.getValue((slot,))
                part = known[0] if known else 0
                self.parts.updateValue((slot, part), (_packed(piece),))
                self.counts.updateValue((slot,), (part + 1,))
                if not part:
                    # of a slot that is over already, it goes off in this batch: timers come behind rows
                    self.handle.registerTimer((slot + 1) * self.slot_ms)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        for slot in sorted(s[0] for s in self.counts.keys()):
            if (slot + 1) * self.slot_ms > now:
                break
            yield self._close(tuple(key), slot)
        if self.forget_ms is not None and self.quiet.exists() and self.quiet.get()[0] <= now and not any(True for _ in self.counts.keys()):
            self.forget()
            self.quiet.clear()

    def forget(self) -> None:
        """Let go of what the rule remembers of the key."""
        self.state.clear()

    def apply(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        state, out = self.rule(key, tuple(self.state.get()) if self.state.exists() else None, rows)
        self.state.update(state)
        return out

    def _close(self, key: tuple, slot: int) -> pd.DataFrame:
        pieces = []
        for part in range(self.counts.getValue((slot,))[0]):
            pieces.append(_unpacked(self.parts.getValue((slot, part))[0]))
            self.parts.removeKey((slot, part))
        self.counts.removeKey((slot,))
        rows = pd.concat(pieces).sort_values(self.order, kind="stable")
        last = self.quiet.get()[0] if self.quiet.exists() else None
        if last is not None and int(rows["__at"].iloc[0]) >= last:
            self.forget()
        out = self.apply(key, rows)
        if self.forget_ms is not None:
            quiet = int(rows["__at"].iloc[-1]) + self.forget_ms
            if last is not None:
                self.handle.deleteTimer(last)
            self.quiet.update((quiet,))
            self.handle.registerTimer(quiet)
        return out

    def close(self) -> None:
        pass


class Membership(InOrder):
    """Keeps the members of a group's last snapshot in a map state and tells how each snapshot differs from the one
    before. Members that stay are neither written nor sent anywhere."""

    def __init__(self, names: Sequence[str], slot_ms: int, forget_ms: int | None):
        super().__init__(lambda *_: None, "snapshots bigint", names, ["__at"], slot_ms, forget_ms)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.members = handle.getMapState("members", "consumer_id string", "since bigint")

    def forget(self) -> None:
        super().forget()
        self.members.clear()

    def apply(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out, seen = [], self.state.get()[0] if self.state.exists() else 0
        for at, present in rows.groupby("__at", sort=True):
            now = set(present["consumer_id"])
            gone = [m[0] for m in self.members.keys() if m[0] not in now]
            new = [m for m in now if not self.members.containsKey((m,))]
            for member in gone:
                self.members.removeKey((member,))
            for member in new:
                self.members.updateValue((member,), (int(at),))
            if seen and gone + new:
                out.append((key[0], int(at), len(gone) + len(new)))
            seen += 1
        self.state.update((seen,))
        return pd.DataFrame(out, columns=["group", "ts_ms", "members_changed"])


def in_order(rows: DataFrame, key: Sequence[str], time: str, watermark: str, rule: Rule, state: str, result: str,
             order: Sequence[str], slot_ms: int = SLOT_MS, forget_ms: int | None = None, event_time: str = "") -> DataFrame:
    """Rows of a stream through ``rule``, key by key in time order, in append mode. A key whose rows have paused for
    ``forget_ms`` starts anew. Rows behind the watermark are dropped by Spark. ``event_time`` names the column of the
    result that carries the time for a further stateful step."""
    timed = _timed(rows, time, watermark)
    processor = InOrder(rule, state, timed.columns, order, slot_ms, forget_ms)
    return timed.groupBy(*key).transformWithStateInPandas(processor, result, "Append", "EventTime", eventTimeColumnName=event_time)


def _timed(rows: DataFrame, time: str, watermark: str) -> DataFrame:
    use_rocksdb(rows.sparkSession)
    timed = rows.withWatermark(time, watermark) if watermark else rows
    return timed.withColumn("__at", F.unix_millis(time))


def rebalance_events(members: DataFrame, watermark: str, slot_ms: int = SLOT_MS, forget_ms: int | None = None) -> DataFrame:
    """(group, ts_ms, members_changed): snapshots whose members differ from the group's snapshot before, as on static
    data. A snapshot may come in several micro-batches: it is looked at when the watermark has passed it."""
    timed = _timed(members.select("group", "ts", "consumer_id"), "ts", watermark)
    return timed.groupBy("group").transformWithStateInPandas(
        Membership(timed.columns, slot_ms, forget_ms), "group string, ts_ms bigint, members_changed bigint", "Append", "EventTime")
