"""Cost-balanced packing of documents into sequences of a fixed token capacity."""

from __future__ import annotations

import heapq
import json
import os
import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from tidelog.llm.bpe import PATTERN, byte_values
from tidelog.llm.common import arrays, nonempty, strings

VOCABULARY = "byte_bpe_50k.json"
#: Tokens of rests that are packed together. Bounds a task's memory; at most one sequence of
#: each such lot is not full.
LOT_TOKENS = 1_500_000

SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                    ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()),
                    ("offset", pa.int64()), ("cost", pa.float64())])
COLUMNS = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
           "sequence_id bigint, `offset` bigint, cost double")


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Callable[[str], bytes]:
    """Function from a text to its ids as little-endian unsigned 32-bit numbers.

    The vocabulary is that of the ``tokenizers`` file. ``tiktoken`` applies it four times as fast and
    gives the same ids; runs of white space too long for its pattern go to ``tokenizers``.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core already
    path = public_tokenizers.path(vocabulary)
    whole, of = Tokenizer.from_file(path), byte_values()
    with open(path, encoding="utf-8") as file:
        read = json.load(file)
    added = {t["content"]: t["id"] for t in read["added_tokens"]}
    ranks = {bytes(map(of.__getitem__, t)): i for t, i in read["model"]["vocab"].items() if t not in added}
    fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def ids(text: str) -> bytes:
        try:
            return fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()
        except ValueError:
            return np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    return ids


def cost(length, linear: float, quadratic: float):
    """Work that a piece causes: its tokens, and attention among them."""
    return linear * length + quadratic * length * length


def balance(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pack rests of documents: (index, start in the rest, length, sequence, offset) per piece.

    As many sequences as the tokens need. The longest piece left goes to the sequence of lowest
    cost that has room for it; if none has, the roomiest sequence takes what it can hold and the
    remainder waits its turn by its own length. So all sequences but the room of one are full.
    """
    total = sum(lengths)
    n = -(-total // capacity)
    room, load = np.full(n, capacity, np.int64), np.zeros(n)
    room[-1] -= n * capacity - total  # what is left over stays in one place: the last sequence
    offset = np.zeros(n, np.int64)
    heap = [(-size, k, 0) for k, size in enumerate(lengths)]
    heapq.heapify(heap)
    pieces = []
    while heap:
        size, k, start = heapq.heappop(heap)
        size = -size
        at = int(np.argmin(np.where(room >= size, load, np.inf)))
        take = size
        if room[at] < size:
            at = int(np.argmax(room))
            take = int(room[at])
            heapq.heappush(heap, (take - size, k, start + take))
        pieces.append((k, start, take, at, int(offset[at])))
        room[at] -= take
        offset[at] += take
        load[at] += cost(take, linear, quadratic)
    return pieces


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 0, linear: float = 1.0,
         quadratic: float = 1 / 1024, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces of all documents, each in its place in a sequence of at most ``capacity`` tokens.

    A document is its token ids and ``end_id``. Its full stretches of ``capacity`` ids make
    sequences of their own; the rests of the documents of a task are packed together by
    ``balance``, a lot of LOT_TOKENS at a time, so at most one sequence of a lot is not full. There
    is no shuffle, and a very long document leaves only its rest in memory. Sequence numbers hold
    the number of the task, so they are unique; a repeated task packs its rows in the same way.

    A null text counts as empty: its one piece is ``end_id``. Null ids stay null and equal rows
    are packed once each. An empty table gives no rows. Other columns are not read. ``ids_crc32``
    is over the ids as little-endian unsigned 32-bit numbers, ``cost`` is that of the piece.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode, task, made = encoder(vocabulary), TaskContext.get().partitionId() << 40, 0
        rest, waiting = [], 0

        def rows(found):
            names = SCHEMA.names[:-1]
            columns = dict(zip(names, zip(*found, strict=True), strict=True))
            return arrays(SCHEMA, columns | {"cost": [cost(n, linear, quadratic) for n in columns["length"]]})

        def flush():
            nonlocal made, rest, waiting
            packed = balance([len(r[2]) // 4 for r in rest], capacity, linear, quadratic)
            out = []
            for k, start, length, at, offset in packed:
                doc, before, ids, total = rest[k]
                out.append((doc, before + start, length, zlib.crc32(ids[4 * start:4 * (start + length)]),
                            total, task + made + at, offset))
            made += max(p[3] for p in packed) + 1
            rest, waiting = [], 0
            return rows(out)

        for batch in nonempty(batches):
            full = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), strings(batch, "text"), strict=True):
                ids = encode(text or "") + end
                total = len(ids) // 4
                whole = total // capacity * capacity
                for start in range(0, whole, capacity):
                    full.append((doc, start, capacity, zlib.crc32(ids[4 * start:4 * (start + capacity)]), total,
                                 task + made, 0))
                    made += 1
                if whole < total:
                    rest.append((doc, whole, ids[4 * whole:], total))
                    waiting += total - whole
            if full:
                yield rows(full)
            if waiting >= LOT_TOKENS:
                yield flush()
        if rest:
            yield flush()

    rows = docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text")
    return rows.mapInArrow(run, COLUMNS)
