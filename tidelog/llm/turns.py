"""Repair of the structure of conversations: the cheapest edits, by a Viterbi search whose survivors coalesce."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidelog.llm.common import arrays, nonempty, written
from tidelog.llm.scan import before
from tidelog.operators.indexing import rank_within

#: Rows of a conversation that one task takes at a time; longer conversations are cut into chunks of so many.
CHUNK = 20_000
#: A repaired conversation is an optional system row, then user and assistant in turn, or nothing. States: nothing
#: yet, a system row, last a user row, last an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
NEEDED = ("u", "u", "a", "u")
ROLES = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
#: Inserts that lead from each state to an end of the conversation.
TO_END = (0, 2, 1, 0)
#: What it costs at most to go on from the first state as from the second: a survivor that is dearer by more
#: than that cannot be part of a cheapest repair.
INSTEAD = ((0, 0, 5, 0), (10, 0, 5, 10), (7, 5, 0, 5), (2, 0, 5, 0))
INFINITE = 1 << 40
FAULTS = ("blank", "duplicate", "truncated")
_WHITE = " \t\n\x0b\x0c\r"


def moves(state: int, initial: str, must_go: bool, cut: bool) -> Iterator[tuple[int, int, str]]:
    """(next state, cost, letters) of a row: inserts before it, then it is kept, given another role or deleted."""
    for inserts in range(4):
        cost, letters = INSERT * inserts, "I" * inserts
        yield state, cost + DELETE, letters + "D"
        if not must_go:
            cost += CUT_OFF if cut else 0
            yield NEXT[state], cost + REROLE, letters + "R"
            if initial == NEEDED[state]:
                yield NEXT[state], cost, letters + "K"
            if initial == "s" and state == START:
                yield SYSTEM, cost, letters + "K"
        state = NEXT[state]


class Node:
    """An edit of a survivor: what was done at one row. ``kids`` are the references to it."""

    __slots__ = ("parent", "letters", "row", "kids")

    def __init__(self, parent: Node | None, letters: str, row: tuple):
        self.parent, self.letters, self.row, self.kids = parent, letters, row, set()


class Survivors:
    """The cheapest edits that lead to each state, as a tree of back pointers.

    A node that no survivor refers to is let go; as soon as all survivors share an ancestor, the edits up to
    it are handed to ``emit`` and let go too. So what is held is what is not yet decided. Of equal cost the
    letters that come first in ASCII win: the rank of a survivor stands for all letters since the shared ancestor.
    """

    def __init__(self, emit: Callable[[str, tuple], None], entry: int = START):
        self.emit, self.root = emit, Node(None, "", ())
        self.alive: dict[int, tuple[int, int, Node]] = {entry: (0, 0, self.root)}

    def step(self, row: tuple, initial: str, must_go: bool, cut: bool) -> None:
        best: dict[int, tuple[int, int, str]] = {}
        nodes = {}
        for state, (cost, rank, node) in self.alive.items():
            nodes[rank] = node
            for to, more, letters in moves(state, initial, must_go, cut):
                offer = (cost + more, rank, letters)
                if to not in best or offer < best[to]:
                    best[to] = offer
        kept = {q: b for q, b in best.items() if not any(c[0] + INSTEAD[p][q] < b[0] for p, c in best.items())}
        alive = {}
        for at, q in enumerate(sorted(kept, key=lambda q: kept[q][1:])):
            cost, rank, letters = kept[q]
            node = Node(nodes[rank], letters, row)
            node.parent.kids.add(node)
            alive[q] = (cost, at, node)
        for node in nodes.values():
            self._release(node)
        self.alive = alive
        while len(self.root.kids) == 1:
            self._advance(next(iter(self.root.kids)))

    def _advance(self, node: Node) -> None:
        self.emit(node.letters, node.row)
        node.parent, self.root = None, node

    @staticmethod
    def _release(node: Node) -> None:
        while not node.kids and node.parent is not None:
            parent = node.parent
            parent.kids.discard(node)
            node = parent

    def cheapest(self, beyond: list[int]) -> int:
        """The state of the best survivor, given what it costs to go on from each state."""
        return min(self.alive, key=lambda q: (self.alive[q][0] + beyond[q], self.alive[q][1]))

    def finish(self, state: int) -> None:
        """Hand out the edits of the survivor that is in this state."""
        path, node = [], self.alive[state][2]
        while node is not self.root:
            path.append(node)
            node = node.parent
        for node in reversed(path):
            self._advance(node)


def fault_of(text: str, seen: bool) -> str | None:
    """The first of a row's faults: no visible character, a row that was there before, an end without a mark."""
    visible = text.rstrip(_WHITE)
    if not visible:
        return "blank"
    return "duplicate" if seen else None if visible[-1] in ".!?" else "truncated"


def damaged(conversations: DataFrame) -> DataFrame:
    """(key, conv_id, turn, role, text): rows with faults put in by the checksum of ``conv_id:turn``, of which 20
    remainders are told: 0 drops the row, 1 empties its text, 2 takes out ``.!?``, 3 has it twice, 4 makes it a user's.
    A null is read as one space."""
    rows = conversations.selectExpr("cast(conv_id as bigint) as conv_id", "cast(turn as bigint) as turn",
                                    "coalesce(cast(role as string), ' ') as role", "coalesce(cast(text as string), ' ') as text")
    key, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    hurt = rows.withColumn("key", key).withColumn("hurt", F.crc32(F.concat(key, F.lit(":"), turn).cast("binary")) % 20)
    text = F.when(F.col("hurt") == 1, "").when(F.col("hurt") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("hurt") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.when(F.col("hurt") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return hurt.filter("hurt <> 0").select("key", "conv_id", "turn", role.alias("role"), text.alias("text"), twice.alias("copy")).drop("copy")


EDITS = ("key string, conv_id bigint, chunk bigint, place bigint, edit string, turn bigint, role string, text string, "
         "had string, fault string")
_EDITS = pa.schema([("key", pa.string()), ("conv_id", pa.int64()), ("chunk", pa.int64()), ("place", pa.int64()),
                    ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()),
                    ("had", pa.string()), ("fault", pa.string())])


class Out:
    """Edits in order, as rows of EDITS."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.bytes = 0

    def begin(self, key: str, conv_id: int | None, chunk: int, state: int) -> None:
        self.head, self.place, self.state = (key, conv_id, chunk), 0, state

    def __call__(self, letters: str, row: tuple) -> None:
        for letter in letters:
            turn, role, text, initial, fault = row if letter != "I" else (None, None, "", None, None)
            if letter == "D":
                role = text = None
            else:
                kept = letter == "K" and initial == "s" and self.state == START
                self.state = SYSTEM if kept else NEXT[self.state]
                role = role if letter == "K" else ROLES[self.state]
            self.rows.append((*self.head, self.place, letter, turn, role, text, initial, fault))
            self.place += 1
            self.bytes += len(text or "")

    def batches(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least or self.bytes > 4 << 20:
            yield arrays(_EDITS, dict(zip(_EDITS.names, zip(*self.rows, strict=True), strict=True)))
            self.rows, self.bytes = [], 0


def _columns(batch: pa.RecordBatch, *names: str):
    return zip(*(batch.column(c).to_pylist() for c in names), strict=True)


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of whole conversations that come one after the other, sorted by turn."""
    out, current, search, seen = Out(), None, None, set()

    def close():
        if search is not None:
            end = search.cheapest([INSERT * n for n in TO_END])
            search.finish(end)
            out("I" * TO_END[end], ())

    for batch in nonempty(batches):
        for key, conv_id, turn, role, text in _columns(batch, "key", "conv_id", "turn", "role", "text"):
            if key != current:
                close()
                current, search, seen = key, Survivors(out), set()
                out.begin(key, conv_id, 0, START)
            mark = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
            fault = fault_of(text, mark in seen)
            seen.add(mark)
            search.step((turn, role, text, role[:1], fault), role[:1], fault in FAULTS[:2], fault == "truncated")
            yield from out.batches(1000)
    close()
    if out.rows:
        yield from out.batches()


def _cost_matrices() -> dict[tuple, np.ndarray]:
    made = {}
    for initial in ("s", "u", "a", ""):
        for fault in (None, *FAULTS):
            costs = np.full((4, 4), INFINITE, np.int64)
            for state in range(4):
                for to, cost, _ in moves(state, initial, fault in FAULTS[:2], fault == "truncated"):
                    costs[state, to] = min(costs[state, to], cost)
            made[initial, fault] = costs
    return made


MATRICES = _cost_matrices()


def _of(initial: str, fault: str | None) -> np.ndarray:
    return MATRICES[initial if initial in ("s", "u", "a") else "", fault]


def _then(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Costs of one stretch after the other, from each state to each: the (min, +) product."""
    a, b = first.reshape(4, 4), second.reshape(4, 4)
    return np.minimum((a[:, :, None] + b[None]).min(axis=1), INFINITE).ravel()


def _before(second: np.ndarray, first: np.ndarray) -> np.ndarray:
    return _then(first, second)


_NOTHING = np.where(np.eye(4, dtype=bool), 0, INFINITE).ravel().tolist()


def _by_chunk(rows: DataFrame, *more: str) -> DataFrame:
    """Rows of a chunk after one another, in their order."""
    return rows.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "rank").select(
        "key", "chunk", "initial", "fault", *more)


def _chunks(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """(key, chunk), first row of it or not, and the columns, of every row."""
    place = None
    for batch in nonempty(batches):
        for key, chunk, *rest in _columns(batch, "key", "chunk", *columns):
            yield (key, chunk), (key, chunk) != place, rest
            place = (key, chunk)


def _chunk_costs(rows: DataFrame) -> DataFrame:
    """(key, chunk, value): what each chunk costs from each state to each."""
    schema = pa.schema([("key", pa.string()), ("chunk", pa.int64()), ("value", pa.list_(pa.int64()))])

    def run(batches):
        place, total = None, None
        for own, new, (initial, fault) in _chunks(batches, "initial", "fault"):
            if new:
                if place is not None:
                    yield pa.RecordBatch.from_pylist([{"key": place[0], "chunk": place[1], "value": total}], schema=schema)
                place, total = own, np.array(_NOTHING, np.int64)
            total = _then(total, _of(initial, fault).ravel())
        if place is not None:
            yield pa.RecordBatch.from_pylist([{"key": place[0], "chunk": place[1], "value": total}], schema=schema)

    return _by_chunk(rows).mapInArrow(run, "key string, chunk bigint, value array<bigint>")


def _exits(rows: DataFrame) -> DataFrame:
    """(key, chunk, value): for each state in which a chunk may be entered, the one in which the best repair leaves it.
    ``beyond`` is what it costs to go on behind the chunk."""
    schema = pa.schema([("key", pa.string()), ("chunk", pa.int64()), ("value", pa.list_(pa.int64()))])

    def run(batches):
        place, searches, beyond = None, [], []

        def found():
            return pa.RecordBatch.from_pylist([{"key": place[0], "chunk": place[1],
                                                "value": [s.cheapest(beyond) for s in searches]}], schema=schema)

        for own, new, (initial, fault, costs) in _chunks(batches, "initial", "fault", "beyond"):
            if new:
                if place is not None:
                    yield found()
                place, beyond = own, costs
                searches = [Survivors(lambda letters, row: None, q) for q in range(4)]
            for search in searches:
                search.step((), initial, fault in FAULTS[:2], fault == "truncated")
        if place is not None:
            yield found()

    return _by_chunk(rows, "beyond").mapInArrow(run, "key string, chunk bigint, value array<bigint>")


def _replayed(rows: DataFrame) -> DataFrame:
    """Edits of chunks of which the first and last state are known."""

    def run(batches):
        out, search, final = Out(), None, None
        columns = ("initial", "fault", "conv_id", "turn", "role", "text", "entry", "exit", "last")

        def close():
            if search is not None:
                search.finish(final[0])
                if final[1]:
                    out("I" * TO_END[final[0]], ())

        for (key, chunk), new, (initial, fault, conv_id, turn, role, text, entry, end, last) in _chunks(batches, *columns):
            if new:
                close()
                search, final = Survivors(out, entry), (end, last)
                out.begin(key, conv_id, chunk, entry)
            search.step((turn, role, text, initial, fault), initial, fault in FAULTS[:2], fault == "truncated")
            yield from out.batches(1000)
        close()
        if out.rows:
            yield from out.batches()

    return _by_chunk(rows, "conv_id", "turn", "role", "text", "entry", "exit", "last").mapInArrow(run, EDITS)


def _long(rows: DataFrame, chunk: int) -> DataFrame:
    """Edits of conversations of any length, a chunk to a task at a time.

    Costs of chunks are (min, +) matrices; their products from the end give what it costs to go on behind each
    chunk, with which every chunk tells its best exit from each entry; the products of these from the
    beginning give the state in which each chunk is entered.
    """
    ranked = rank_within(rows.withColumn("copy", F.monotonically_increasing_id()), ["turn", "role", "text", "copy"], ["key"])
    hashes = [F.xxhash64("role", "text"), F.xxhash64(F.lit(1), "role", "text")]
    numbered = written(ranked.select("key", "conv_id", "turn", "role", "text", "rank", F.expr(f"rank div {chunk}").alias("chunk"),
                                     F.substring("role", 1, 1).alias("initial"), hashes[0].alias("h1"), hashes[1].alias("h2")))
    first = numbered.groupBy("key", "h1", "h2").agg(F.min("rank").alias("first"))
    visible = F.regexp_replace("text", "[ \\t\\n\\x0B\\f\\r]+\\z", "")
    fault = F.when(visible == "", "blank").when(F.col("rank") > F.col("first"), "duplicate").when(
        ~F.substring(visible, -1, 1).isin(".", "!", "?"), "truncated")
    told = written(numbered.join(first, ["key", "h1", "h2"]).withColumn("fault", fault).drop("h1", "h2", "first"))
    ends = written(told.groupBy("key").agg(F.max("chunk").alias("end")))
    costs = written(_chunk_costs(told).join(ends, "key"))
    back = F.col("end") - F.col("chunk")
    behind = before(costs.select("key", back.alias("number"), "value"), _before, _NOTHING)
    final = [INSERT * n for n in TO_END]
    beyond = [F.least(*[F.col("value")[4 * q + r] + final[r] for r in range(4)]) for q in range(4)]
    going_on = written(behind.join(ends, "key").select(
        "key", (F.col("end") - F.col("number")).alias("chunk"), F.array(*beyond).alias("beyond")))
    exits = written(_exits(told.join(going_on, ["key", "chunk"])))
    entered = before(exits.withColumnRenamed("chunk", "number"), lambda a, b: b[a], [0, 1, 2, 3])
    states = written(entered.select("key", F.col("number").alias("chunk"), F.col("value")[START].cast("int").alias("entry")).join(
        exits, ["key", "chunk"]).join(ends, "key").select(
        "key", "chunk", "entry", F.expr("cast(value[entry] as int)").alias("exit"), (F.col("chunk") == F.col("end")).alias("last")))
    return _replayed(told.join(states, ["key", "chunk"]))


def edits(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The cheapest edits that bring conversations, (key, conv_id, turn, role, text) without null texts or roles, into shape.

    One row per edit, in the order of (key, chunk, place): Keep (K), another role (R), Delete (D) or Insert (I), with the role
    and text that the repaired conversation has there (null if deleted), the initial of the role that was there and
    the row's fault. Rows of a conversation count by turn, null first, then by role and text; equal rows follow one another.

    Conversations of up to ``chunk`` rows go through one search each; longer ones, of which a group may hold a
    third of all rows, are cut into chunks that are searched at once. Both give the same edits. What a search
    holds is what is not yet decided, and 16 bytes per row to tell duplicates.
    """
    long = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > chunk).select("key"))
    order = ["key", "turn", "role", "text"]
    some = rows.join(long, "key", "left_anti").repartition("key").sortWithinPartitions(*order)
    short = some.select("key", "conv_id", "turn", "role", "text").mapInArrow(_short, EDITS)
    if long.isEmpty():
        return short
    done = written(_long(rows.join(long, "key", "left_semi"), chunk))
    return short.union(done.repartition("key").sortWithinPartitions("key", "chunk", "place"))


def report(edited: DataFrame) -> DataFrame:
    """(key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): what was wrong with each
    conversation and what was done. Edits of a conversation come in order and stream through: only the audit,
    a letter per edit, grows with it."""
    types = [("key", pa.string())] + [(c, pa.int64()) for c in ("gaps", *FAULTS, "illegal", "cost")] + [
        ("audit", pa.string()), ("repaired_sha256", pa.string())]
    schema = pa.schema(types)

    def run(batches):
        current, out = None, []

        def close():
            seen = [] if first is None else [last - first + 1 - turns]
            gaps = seen[0] if seen else 0
            out.append((current, gaps, *(counts[f] for f in FAULTS), illegal, cost, "".join(audit), digest.hexdigest()))

        for batch in nonempty(batches):
            for key, edit, turn, role, text, had, fault in _columns(batch, "key", "edit", "turn", "role", "text", "had", "fault"):
                if key != current:
                    if current is not None:
                        close()
                    current, counts, illegal, cost, audit = key, dict.fromkeys(FAULTS, 0), 0, 0, []
                    first = last = before_ = None
                    turns, digest, begun = 0, hashlib.sha256(), False
                audit.append(edit)
                cost += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit]
                if edit != "D":
                    digest.update(f"{chr(10) if begun else ''}{role}:{text}".encode())
                    begun = True
                    cost += CUT_OFF if fault == "truncated" else 0
                if edit == "I":
                    continue
                if fault:
                    counts[fault] += 1
                illegal += before_ is not None and before_ + had not in ("su", "ua", "au")
                before_ = had
                if turn is not None:
                    turns += turn != last
                    first, last = turn if first is None else first, turn
            if len(out) >= 1000:
                yield arrays(schema, dict(zip(schema.names, zip(*out, strict=True), strict=True)))
                out = []
        if current is not None:
            close()
        if out:
            yield arrays(schema, dict(zip(schema.names, zip(*out, strict=True), strict=True)))

    kinds = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'bigint'}" for f in schema)
    return edited.mapInArrow(run, kinds)


def audited(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per conversation of the damaged table: gaps, faults, the cost of the repair, its edits and a digest of its result.

    A null conv_id is a conversation like others. One of which no row is left has zeros, an empty audit and the digest of
    nothing. Null roles and texts are one space, so such texts are blank and such roles legal nowhere; an empty role
    has no initial. Turns may be null or repeated; equal rows count as often as they are there. An empty table gives
    no rows; other columns are not read.
    """
    found = report(edits(damaged(conversations), chunk))
    ids = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    named = ids.withColumn("own", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    zeros = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", *FAULTS, "illegal", "cost")]
    return named.join(found, F.col("own") == F.col("key"), "left").select(
        "conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
