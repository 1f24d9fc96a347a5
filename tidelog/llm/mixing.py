"""Language-model scores by logistic context mixing on the bits of words."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from tidelog.llm.common import arrays, held_out, let_go, letting_go, nonempty, written

#: Hashed-context predictors look back 1 to 4 bytes, as far as the blank before the word; each has
#: 2^19 slots, whatever the corpus. A fifth one has the whole word so far as its context.
ORDERS, SLOT_BITS = 4, 19
GATES, BUCKETS, INPUTS = 16, 24, ORDERS + 2
RATE, PRIOR, STEP = 0.2, 0.25, 8192
#: Bytes of text that are scored against one list of word scores; words whose tree is built at once.
BLOCK_BYTES, TREE_WORDS, TREE_BYTES = 24 << 20, 20_000, 1 << 19
#: Words (repeats included) that a task holds before it hands their counts on.
HELD = 3_000_000
#: Words (repeats included) of a block that are looked up at once among those with a score.
PLACED = 2_000_000
#: Words by class whose slots are summed in a task.
SUMMED = 200_000
#: What stands for the end of a text: no word can hold it.
END = b"\n"
#: Classes of documents are told by their use of the most frequent words. LOT documents are grouped at once, into
#: FINE groups; GATHERED tasks group the groups of all others.
CLASS_WORDS, CLASSES, ALIKE, RARE, LOT, FINE, GATHERED = 256, 8, 0.8, 1 << 14, 2000, 32, 16

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


# ---- trees of words -------------------------------------------------------------------------

class Tree:
    """Distinct sorted words, each with its class before and a blank behind it, as edges of a tree.

    All that is predicted about a byte depends on the bytes before it in the word and on the class, so
    each edge is worked out once for all words that run through it. The class itself is given.
    """

    def __init__(self, words: list[bytes], counts: np.ndarray):
        sizes = np.array([len(w) + 1 for w in words])
        self.starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        flat = np.frombuffer(b" ".join(words) + b" ", np.uint8).astype(np.int64)
        word = np.repeat(np.arange(len(words)), sizes)
        depth = np.arange(len(flat)) - self.starts[word]
        # a place is a new edge unless the word before has the same bytes up to it
        before = np.maximum(word - 1, 0)
        there = (word > 0) & (depth < sizes[before])
        same = there & (flat[np.where(there, self.starts[before] + depth, 0)] == flat)
        first = np.minimum.reduceat(np.where(same, 1 << 40, depth), self.starts)
        new = depth >= first[word]
        by_depth = np.argsort(depth, kind="stable")
        number = np.where(new, np.cumsum(new) - 1, -1)
        # within a depth, a place that is not new has the edge of the last new one
        block = number[by_depth]
        last = np.maximum.accumulate(np.where(block >= 0, np.arange(len(block)), 0))
        self.edge = np.empty(len(flat), np.int64)
        self.edge[by_depth] = block[last]
        places = np.flatnonzero(new)
        parent = np.where(depth[places] > 0, self.edge[places - 1], -1)
        # edges of one parent lie together, by their bytes
        order = np.argsort((parent + 1) << 8 | flat[places], kind="stable")
        places, self.parent = places[order], parent[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.edge = rank[self.edge]
        self.symbol, self.depth = flat[places], depth[places]
        self.weight = np.bincount(self.edge, counts[word], len(places))
        self.given = self.depth == 0
        self.context = np.zeros(len(places), np.uint64)
        for k in range(ORDERS, 0, -1):
            byte = np.where(self.depth >= k, flat[places - k], np.where(self.depth == k - 1, 32, 0))
            self.context = self.context << np.uint64(8) | byte.astype(np.uint64)

    def sum_by_word(self, of_edge: np.ndarray) -> np.ndarray:
        return np.add.reduceat(of_edge[self.edge], self.starts)

    def slots(self, order: int, bit: int) -> np.ndarray:
        """Slots of the hashed context of an order together with the bits of the byte so far."""
        context = self.context & np.uint64((1 << 8 * order) - 1)
        so_far = (1 << bit | self.symbol >> (8 - bit)).astype(np.uint64)
        key = (context << np.uint64(9) | so_far) * _MULTIPLIER + np.uint64(order)
        return (((key ^ key >> np.uint64(29)) * _MULTIPLIER) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def prefix_counts(self, bit: int) -> tuple[np.ndarray, np.ndarray]:
        """How often the words so far went on with 0 and with 1 at this bit."""
        key = self.parent << 8 | self.symbol >> (8 - bit)
        begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(begins, append=len(key))
        ones = np.add.reduceat(self.weight * (self.symbol >> (7 - bit) & 1), begins)
        return np.repeat(np.add.reduceat(self.weight, begins) - ones, sizes), np.repeat(ones, sizes)


def trees(batches: Iterator[pa.RecordBatch], whole_prefix: int = ORDERS) -> Iterator[tuple[pa.RecordBatch, Tree]]:
    """Trees of the sorted words of a task. Words with the same first bytes come into one tree, so
    that its counts are whole, up to three times TREE_WORDS of them."""
    words: list[bytes] = []
    counts: list[int] = []
    wholes: list[int] = []

    def cut():
        table = pa.RecordBatch.from_pydict({"word": pa.array(words, pa.binary()), "all": pa.array(wholes, pa.int64())})
        tree = Tree(words, np.array(counts, float))
        for held in (words, counts, wholes):
            held.clear()
        return table, tree

    size = 0
    for batch in nonempty(batches):
        some, c = batch.column("word").to_pylist(), batch.column("c").to_pylist()
        every = batch.column("all").to_pylist() if "all" in batch.schema.names else c
        more = sum(map(len, some)) + len(some)
        if len(words) + len(some) <= TREE_WORDS and size + more < TREE_BYTES:
            # no tree is full before the end of the batch
            size += more
            words += some
            counts += c
            wholes += every
            continue
        for now, n, whole in zip(some, c, every, strict=True):
            size += len(now) + 1
            full = len(words) >= TREE_WORDS or size >= TREE_BYTES
            if words and full and (now[:whole_prefix] != words[-1][:whole_prefix] or len(words) >= 3 * TREE_WORDS):
                yield cut()
                size = len(now) + 1
            words.append(now)
            counts.append(n)
            wholes.append(whole)
    if words:
        yield cut()


# ---- the mixer --------------------------------------------------------------------------------

def _low_gate(known: np.ndarray) -> np.ndarray:
    """The gate by what the longest hashed context knows, where the whole word was not met."""
    return np.minimum(5, np.log2(known + 1).astype(int) // 2)


class Mixer:
    """Weights by gate, and the last refinement: what bits were by gate, place in the byte and mixed
    prediction."""

    def __init__(self, tables: np.ndarray):
        self.tables = tables  # order, slot, bit
        self.weights = np.full((GATES, INPUTS), 0.3)
        self.weights[:, -1] = 0
        self.seen = np.zeros((GATES, 8, BUCKETS, 2))
        #: sums of the weights over all that was learned, and how much that was
        self.passed = np.zeros((GATES, INPUTS + 1))

    def inputs(self, tree: Tree, bit: int, leave_out: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Predictions in the logistic domain (a row for each), the gate, and the true bit. ``leave_out`` takes one
        occurrence of the word itself out of all counts, as if it were met for the first time."""
        truth = tree.symbol >> (7 - bit) & 1
        own = np.minimum(tree.weight, 1).astype(np.float32) if leave_out else np.zeros(len(truth), np.float32)
        own_one = truth.astype(np.float32) * own
        own_zero = own - own_one
        x = np.empty((INPUTS, len(truth)), np.float32)
        for order in range(1, ORDERS + 1):
            slots = tree.slots(order, bit)
            if not leave_out:
                x[order - 1] = self.logits[order - 1].take(slots)
                continue
            # both numbers of a slot are fetched at once
            n = self.pairs[order - 1].take(slots).view(np.float32).reshape(-1, 2)
            zeros, ones = np.maximum(n[:, 0] - own_zero, 0), np.maximum(n[:, 1] - own_one, 0)
            x[order - 1] = np.log((ones + PRIOR) / (zeros + PRIOR))
        known = _low_gate(zeros + ones) if leave_out else self.low_gates.take(slots)
        zeros, ones = (v.astype(np.float32) for v in tree.prefix_counts(bit))
        zeros, ones = np.maximum(zeros - own_zero, 0), np.maximum(ones - own_one, 0)
        # words that begin alike are together from ORDERS bytes on; before, order 4 has the whole word
        zeros[tree.depth < ORDERS] = ones[tree.depth < ORDERS] = 0
        x[ORDERS] = np.log((ones + PRIOR / 4) / (zeros + PRIOR / 4))
        x[-1] = 0.3
        met = zeros + ones
        gate = np.where(met > 0, 6 + np.minimum(9, np.log2(met + 1).astype(int)), known)
        return x, gate, truth

    @cached_property
    def pairs(self) -> np.ndarray:
        """Both numbers of each slot as one item of eight bytes."""
        return np.ascontiguousarray(self.tables, np.float32).view(np.uint64)[..., 0]

    @cached_property
    def logits(self) -> np.ndarray:
        """What each slot predicts, worked out once where nothing is left out of its counts."""
        return np.log((self.tables[..., 1] + PRIOR) / (self.tables[..., 0] + PRIOR))

    @cached_property
    def low_gates(self) -> np.ndarray:
        return _low_gate(self.tables[-1, :, 0] + self.tables[-1, :, 1])

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        logit = np.zeros(len(gate))
        for k in range(INPUTS):
            logit += x[k] * self.weights[:, k].take(gate)
        return np.clip(logit, -12, 12, out=logit)

    def bucket(self, logit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.clip((logit + 12) / 24 * (BUCKETS - 1), 0, BUCKETS - 1.001)
        return at.astype(int), at - at.astype(int)

    def learn(self, tree: Tree) -> None:
        """Online: predict STEP edges, see their bits, move the weights of the gates they came through, and
        go on. Edges are taken in a mixed order, since neighbours are alike."""
        mixed = np.argsort(np.arange(len(tree.symbol), dtype=np.uint64) * _MULTIPLIER, kind="stable")
        for bit in range(8):
            x, gate, truth = (v.take(mixed, axis=-1) for v in self.inputs(tree, bit, leave_out=True))
            part = np.where(tree.given, 0, tree.weight)[mixed]
            mixed_to = np.empty(len(truth), np.float32)
            for at in range(0, len(truth), STEP):
                now = slice(at, at + STEP)
                logit = self.mixed(x[:, now], gate[now])
                error = (truth[now] - 1 / (1 + np.exp(-logit))) * part[now]
                n = np.bincount(gate[now], part[now], GATES) + 50
                moved = [np.bincount(gate[now], x[k, now] * error, GATES) for k in range(INPUTS)]
                self.weights += RATE * np.stack(moved, 1) / n[:, None]
                self.passed += (n - 50)[:, None] * np.concatenate([self.weights, np.ones((GATES, 1))], 1)
                mixed_to[now] = logit
            place, up = self.bucket(mixed_to)
            for k, share in ((place, 1 - up), (place + 1, up)):
                self.seen[:, bit] += np.bincount((gate * BUCKETS + k) * 2 + truth, share * part,
                                                 GATES * BUCKETS * 2).reshape(GATES, BUCKETS, 2)

    def code_lengths(self, tree: Tree) -> np.ndarray:
        """Bits that each word and its end cost."""
        cost = np.zeros(len(tree.symbol))
        shift = np.linspace(-12, 12, BUCKETS)
        sure = 1 / (1 + np.exp(-shift))
        n = self.seen + 20 * np.stack([1 - sure, sure], -1)
        refined = n[..., 1] / n.sum(-1)
        for bit in range(8):
            x, gate, truth = self.inputs(tree, bit, leave_out=False)
            logit = self.mixed(x, gate)
            at, up = self.bucket(logit)
            second = refined[gate, bit, at] * (1 - up) + refined[gate, bit, at + 1] * up
            p = np.clip((1 / (1 + np.exp(-logit)) + second) / 2, 1e-7, 1 - 1e-7)
            cost -= np.log2(np.where(truth == 1, p, 1 - p))
        return tree.sum_by_word(np.where(tree.given, 0, cost))


def slot_sums(counts: DataFrame, n_words: int) -> DataFrame:
    """(slot, zeros, ones): bits seen in the slots of the hashed contexts, summed within tasks. A task takes about
    SUMMED of the ``n_words`` words, so that the rows grow with the words and not with the number of partitions."""
    schema = pa.schema([("slot", pa.int32()), ("zeros", pa.int64()), ("ones", pa.int64())])

    def run(batches):
        sums = None
        for _, tree in trees(batches, 0):
            if sums is None:
                sums = np.zeros((ORDERS, 2 << SLOT_BITS))
            for order in range(1, ORDERS + 1):
                for bit in range(8):
                    slot, truth = tree.slots(order, bit), tree.symbol >> (7 - bit) & 1
                    np.add.at(sums[order - 1], truth << SLOT_BITS | slot, tree.weight)
        if sums is not None:
            sums = sums.reshape(ORDERS, 2, -1)
            for order in range(ORDERS):
                slot = np.flatnonzero(sums[order].any(0))
                for lot in np.array_split(slot, max(1, len(slot) // 100_000)):
                    yield arrays(schema, {"slot": order << SLOT_BITS | lot, "zeros": sums[order, 0, lot].astype(np.int64),
                                          "ones": sums[order, 1, lot].astype(np.int64)})

    few = counts.filter("c > 0").coalesce(max(1, -(-n_words // SUMMED)))
    return few.mapInArrow(letting_go(run), "slot int, zeros bigint, ones bigint")


def context_tables(counts: DataFrame, n_words: int) -> np.ndarray:
    """Bits seen in every slot of the hashed contexts, over all ``n_words`` training words: summed by Spark; the
    result has at most ORDERS x 2^19 rows, however large the corpus."""
    found = slot_sums(counts, n_words).groupBy("slot").agg(
        F.sum("zeros").cast("float").alias("zeros"), F.sum("ones").cast("float").alias("ones")).toArrow()
    tables = np.zeros((ORDERS << SLOT_BITS, 2), np.float32)
    for k, name in enumerate(("zeros", "ones")):
        tables[found.column("slot").to_numpy(), k] = found.column(name).to_numpy()
    return tables.reshape(ORDERS, -1, 2)


def train(counts: DataFrame, n_words: int) -> Mixer:
    """Learn from ``n_words`` (word, c) rows, sorted within partitions and with equal beginnings together.

    Counts are summed over all words first. Then every task learns weights online, from tree to tree, and the
    mean over all steps of all tasks (by how much went through a gate) is kept, so that what comes last does
    not decide; the refinement's counts are added up.
    """
    mixer = Mixer(context_tables(counts, n_words))
    shared = counts.sparkSession.sparkContext.broadcast(mixer)
    schema = pa.schema([("place", pa.int32()), ("part", pa.float64()), ("value", pa.float64())])
    size = GATES * INPUTS

    def run(batches):
        own = Mixer(shared.value.tables)
        for _, tree in trees(batches):
            own.learn(tree)
        weight, seen = np.repeat(own.passed[:, -1], INPUTS), own.seen.ravel()
        yield arrays(schema, {"place": np.arange(size + len(seen)), "part": np.concatenate([weight, np.ones(len(seen))]),
                              "value": np.concatenate([own.passed[:, :-1].ravel(), seen])})

    sums = counts.filter("c > 0").mapInArrow(letting_go(run), "place int, part double, value double").groupBy("place").agg(
        F.sum("part").alias("part"), F.sum("value").alias("value")).toArrow()
    value, part = np.zeros(size + mixer.seen.size), np.zeros(size + mixer.seen.size)
    place = sums.column("place").to_numpy()
    value[place], part[place] = sums.column("value").to_numpy(), sums.column("part").to_numpy()
    learned = part[:size] > 0
    mixer.weights = np.where(learned, value[:size] / np.where(learned, part[:size], 1), mixer.weights.ravel()).reshape(
        GATES, INPUTS)
    mixer.seen = value[size:].reshape(mixer.seen.shape)
    return mixer


def word_scores(counts: DataFrame, mixer: Mixer) -> DataFrame:
    """(word, c, bits) of (word, c, all): what the frozen model takes for each word, and ``all`` as c."""
    shared = counts.sparkSession.sparkContext.broadcast(mixer)
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64()), ("bits", pa.float32())])

    def run(batches):
        for table, tree in trees(batches):
            yield arrays(schema, {"word": table.column("word"), "c": table.column("all"),
                                  "bits": shared.value.code_lengths(tree).astype(np.float32)})

    return counts.mapInArrow(letting_go(run), "word binary, c bigint, bits float")


# ---- documents --------------------------------------------------------------------------------

def fold(doc_id: Column) -> Column:
    """Documents that are not learned from: crc32 of the id modulo 7 is 2."""
    return held_out(doc_id, 7, 2)


def _groups(use: np.ndarray, most: int) -> np.ndarray:
    """Sums of the rows of ``use`` (how often each class word occurs) by group: nearest of ``most`` centres, which
    begin far from each other and move to their means; in both a row counts as often as it has words."""
    size = use.sum(1)
    use, size = use[size > 0], size[size > 0]
    if not len(use):
        return use
    unit = np.sqrt(use / size[:, None])
    centres = [unit[size.argmax()]]
    far = 1 - unit @ centres[0]
    while len(centres) < min(most, len(unit)):
        centres.append(unit[(far * size).argmax()])
        far = np.minimum(far, 1 - unit @ centres[-1])
    of = None
    for _ in range(10):
        before, of = of, (unit @ np.array(centres).T).argmax(1)
        if before is not None and (before == of).all():
            break
        own = (of == np.arange(len(centres))[:, None]) * size
        centres = [c / np.linalg.norm(c) for c in (own @ unit)[own.any(1)]]
    of = (unit @ np.array(centres).T).argmax(1)
    return np.array([use[of == k].sum(0) for k in np.unique(of)])


def _unlike(groups: np.ndarray) -> np.ndarray:
    """The groups without those whose use of words is much like that of one before, which take them in."""
    unit = np.sqrt(groups / groups.sum(1, keepdims=True))
    root = list(range(len(groups)))
    for k in range(len(groups)):
        for j in range(k):
            if unit[j] @ unit[k] >= ALIKE:
                root[k] = root[j]
                break
    return np.array([groups[np.array(root) == k].sum(0) for k in sorted(set(root))]).reshape(-1, groups.shape[1])


class Words:
    """The words of some texts, one after the other, and which text (``of``) each belongs to."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string())))
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        flat = lists.flatten()
        real = pc.not_equal(pc.binary_length(flat), 0)
        self.n_texts = len(lists)
        self.flat = flat.filter(real).cast(pa.binary())
        sizes = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)
        self.of = np.repeat(np.arange(self.n_texts, dtype=np.int32), sizes)[real.to_numpy(zero_copy_only=False)]

    def sums(self, of_word: np.ndarray) -> np.ndarray:
        """Per text the sum over its words."""
        return np.bincount(self.of, of_word, self.n_texts)

    def by_group(self, group: np.ndarray) -> Iterator[tuple[int, np.ndarray, pa.Array, np.ndarray]]:
        """For every group of texts: its number, its texts, their words, and which of all words these are."""
        of_word = group[self.of]
        order, texts = np.argsort(of_word, kind="stable"), np.argsort(group, kind="stable")
        sorted_, sorted_texts = of_word[order], group[texts]
        words = self.flat.take(pa.array(order))
        for k in np.unique(group):
            low, high = np.searchsorted(sorted_, (k, k + 1))
            first, last = np.searchsorted(sorted_texts, (k, k + 1))
            yield int(k), texts[first:last], words.slice(low, high - low), order[low:high]


class Classes:
    """Classes of documents: which frequent words each uses how often. A document's class is named
    before its words, and costs as much as any of the classes."""

    def __init__(self, words: list[bytes], groups: np.ndarray | list):
        self.words = pa.array(words, pa.binary())
        use = np.array(groups).reshape(len(groups), len(words)) + 0.5
        # whole numbers, so that a text has the same class in every pass
        self.log = np.rint(np.log(use / use.sum(1, keepdims=True)) * (1 << 20)).astype(np.int64)
        self.letters = [bytes([65 + k]) for k in range(max(1, len(groups)))]

    def use(self, words: Words) -> np.ndarray:
        """How often each text uses each of the frequent words."""
        place = pc.index_in(words.flat, value_set=self.words)
        met = place.is_valid().to_numpy(zero_copy_only=False)
        at = words.of[met] * len(self.words) + place.drop_null().to_numpy()
        return np.bincount(at, minlength=words.n_texts * len(self.words)).reshape(words.n_texts, len(self.words))

    def of(self, words: Words) -> np.ndarray:
        """Per text the number of the class under which its words are most likely; the first one, if none tells."""
        if len(self.letters) == 1:
            return np.zeros(words.n_texts, np.int64)
        return (self.use(words) @ self.log.T).argmax(1)


def class_words(rows: DataFrame) -> list[bytes]:
    """The most frequent words of all these texts, at most CLASS_WORDS, the first ones first.

    A lot of a task hands on the words that are at least one in RARE of its own, so a word's count lacks less
    than that share of all words: more frequent ones are never lost.
    """

    def frequent(some):
        found = pc.value_counts(some)
        n = found.field("counts")
        often = pc.greater_equal(n, len(some) / RARE)
        return _batch(found.field("values").filter(often), n=n.filter(often))

    def run(batches):
        for held in _lots(batches, lambda batch: [(None, Words(batch.column("text")).flat, 0)]):
            yield frequent(held.pop(None)[0])

    found = rows.select("text").mapInArrow(letting_go(run), "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return [bytes(r.word) for r in found.orderBy(F.desc("n"), "word").limit(CLASS_WORDS).collect()]


def classes(rows: DataFrame) -> Classes:
    """Fit classes on all of these rows and their whole texts: every task groups its documents, LOT at a time
    together with the groups so far, the tasks' groups are grouped again in GATHERED tasks, and those here, into CLASSES.
    A group is the sum of its documents' counts, so each document counts in the class that takes it in."""
    words = class_words(rows)
    schema = pa.schema([("use", pa.list_(pa.int64()))])

    def counts(batch):
        return Classes(words, []).use(Words(batch.column("text")))

    def given(batch):
        return np.array(batch.column("use").to_pylist(), float)

    def grouped(read):
        def run(batches):
            held = np.zeros((0, len(words)))
            for batch in nonempty(batches):
                held = np.concatenate([held, read(batch)])
                if len(held) >= LOT:
                    held = _groups(held, FINE)
            if len(held):
                yield arrays(schema, {"use": list(_groups(held, FINE).astype(np.int64))})

        return letting_go(run)

    if not words:
        return Classes([], [])
    by_task = rows.select("text").mapInArrow(grouped(counts), "use array<bigint>")
    found = sorted(r.use for r in by_task.repartition(GATHERED).mapInArrow(grouped(given), "use array<bigint>").collect())
    return Classes(words, _unlike(_groups(np.array(found, float).reshape(len(found), len(words)), CLASSES)))


def _batch(word: pa.Array | pa.ChunkedArray, **others) -> pa.RecordBatch:
    """Words and other columns; a single value stands for all rows."""
    columns = {"word": word.combine_chunks() if isinstance(word, pa.ChunkedArray) else word}
    for k, v in others.items():
        kind = pa.int32() if k == "class" else pa.int64()
        columns[k] = v if isinstance(v, pa.Array) else pa.repeat(pa.scalar(v, kind), len(word))
    return pa.RecordBatch.from_pydict(columns)


def _lots(batches: Iterator[pa.RecordBatch], read) -> Iterator[dict]:
    """key -> (words, number of texts), of so many batches that they have about HELD words. ``read`` gives
    (key, words, number of texts) for a batch. Who takes a lot takes the words of its keys out of it, so that they are
    gone before the next lot is read."""
    held: dict[tuple, tuple[list, int]] = {}
    size = 0

    def given():
        return {k: (pa.chunked_array(v, pa.binary()), n) for k, (v, n) in held.items()}

    for batch in nonempty(batches):
        for key, words, n in read(batch):
            some, before = held.get(key, ([], 0))
            held[key] = [*some, words], before + n
            size += len(words)
        if size >= HELD:
            lot, held, size = given(), {}, 0
            del words
            yield lot
            let_go()
    if held:
        lot, held = given(), {}
        yield lot


def _counted(rows: DataFrame, told: Broadcast) -> DataFrame:
    """(word, class, n) for rows (learned, text): word counts of a task by number of the class, HELD words at a time.
    Documents that are not learned from name their words with n = 0."""

    def read(batch):
        words = Words(batch.column("text"))
        learned = batch.column("learned").to_numpy(zero_copy_only=False).astype(np.int64)
        for k, texts, some, _ in words.by_group(2 * told.value.of(words) + learned):
            yield k, some, len(texts)

    def counted(k, some, n_texts):
        name, learned = k // 2, k % 2
        found = pc.value_counts(some)
        del some
        yield _batch(found.field("values"), **{"class": name, "n": found.field("counts") if learned else 0})
        yield _batch(pa.array([END], pa.binary()), **{"class": name, "n": n_texts * learned})

    def run(batches):
        for held in _lots(batches, read):
            for k in list(held):
                yield from counted(k, *held.pop(k))

    return rows.mapInArrow(letting_go(run), "word binary, class int, n bigint")


def _places(known: pa.Array, asked: list[pa.Array]) -> list[np.ndarray]:
    """For each of some arrays of words their places in ``known``, which has all of them and may repeat some; words are
    hashed once for all arrays."""
    codes = pa.concat_arrays([known, *asked]).dictionary_encode().indices.to_numpy()
    own = codes[:len(known)]
    place = np.empty(own.max() + 1, np.int32)
    place[own] = np.arange(len(known))
    return np.split(place[codes[len(known):]], np.cumsum([len(a) for a in asked])[:-1])


def _asked(rows: DataFrame, told: Broadcast) -> DataFrame:
    """(word, block) for rows with block and text: the words of a block's documents, with their class before them."""

    def read(batch):
        words = Words(batch.column("text"))
        own = told.value.of(words)
        names, block = np.unique(batch.column("block").to_numpy(), return_inverse=True)
        size = len(told.value.letters)
        for k, _, some, _ in words.by_group(block * size + own):
            yield (int(names[k // size]), k % size), some, 0

    def named(some, letter, block):
        return _batch(pc.binary_join_element_wise(pa.scalar(letter, pa.binary()), some, pa.scalar(b"", pa.binary())), block=block)

    def run(batches):
        for held in _lots(batches, read):
            for block, k in list(held):
                letter = told.value.letters[k]
                yield named(pc.unique(held.pop((block, k))[0]), letter, block)
                yield named(pa.array([END], pa.binary()), letter, block)

    return rows.mapInArrow(letting_go(run), "word binary, block bigint")


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) per row.

    Tokens are the words of the whole text, A-Z in lower case, and one end. The model learns from the
    documents outside the fold: documents are told apart by class (such as their language), word counts by
    class are summed by Spark, spread into the hashed contexts, the mixer is trained over all of
    them, and every word of the corpus gets its cost in its class once. Documents are dealt into blocks of
    about BLOCK_BYTES; each block asks for the costs of its own words only, so neither the
    vocabulary nor a group of documents is ever in one place.

    ``base_score`` is the add-one unigram score. A null or empty text has the end alone. A null id is held out
    and stays null; equal rows come out once each; an empty table gives no rows; only doc_id and text are read.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       fold(F.col("doc_id")).alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    found = classes(rows.filter(~F.col("held_out")))
    told, letters = docs.sparkSession.sparkContext.broadcast(found), [x.decode() for x in found.letters]
    of = [F.when(F.col("class") == k, F.col("n")) for k in range(len(letters))]
    words = written(_counted(rows.select("text", (~F.col("held_out")).alias("learned")), told).groupBy("word").agg(
        F.sum("n").alias("c"), F.array(*map(F.sum, of)).alias("own")))
    total, distinct, n_words = words.agg(
        F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0),
        F.coalesce(F.sum(F.size(F.filter("own", lambda n: n > 0))), F.lit(0))).first()
    counts = words.select("word", F.col("c").alias("all"), F.posexplode("own").alias("at", "c")).filter(
        "c is not null").select(F.concat(F.encode(F.get(F.array(*map(F.lit, letters)), "at"), "utf-8"), "word").alias("word"),
                                "c", "all")
    together = counts.repartition(F.substring("word", 1, ORDERS)).sortWithinPartitions("word")
    costs = written(word_scores(together, train(together.select("word", "c"), n_words)))

    dealt = rows.withColumn("block", F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))),
                                            F.lit(blocks).cast("bigint"))).repartition("block")
    # the same columns as below, so that documents are dealt out once for both
    lists = _asked(dealt, told).join(costs, "word").select("block", "word", "c", "bits")
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
                        ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()),
                        ("score", pa.float64()), ("bits_per_byte", pa.float64())])
    scale = np.log10(total + distinct + 1)

    def of_parts(parts: list[tuple[pa.RecordBatch, Words]], of_class: list[tuple]) -> list[pa.RecordBatch]:
        """The rows of some batches, which are taken out of the list."""
        # (class, place of the words among those of the class) per part: a class's words are hashed once for all parts
        asked: dict[int, list] = defaultdict(list)
        sizes = []
        for part, (_, words) in enumerate(parts):
            for k, some, own, which in words.by_group(told.value.of(words)):
                asked[k].append((part, some, own, which.astype(np.int32)))
            sizes.append(words.sums(pc.binary_length(words.flat).to_numpy()))
            words.flat = None  # from here on they are held by class
        found: list[list] = [[] for _ in parts]
        for k, of_part in asked.items():
            places = _places(of_class[k][0], [own for _, _, own, _ in of_part])
            for (part, some, _, which), at in zip(of_part, places, strict=True):
                found[part].append((k, some, which, at))
            of_part.clear()
        out = []
        for (batch, words), size, of_part in zip(parts, sizes, found, strict=True):
            # of each word: bits, base score, known
            values, ends = np.zeros((3, len(words.of))), np.zeros((3, words.n_texts))
            for k, some, which, at in of_part:
                _, costs, end = of_class[k]
                for place, cost in enumerate(costs):
                    values[place, which] = cost[at]
                    ends[place, some] = cost[end]
            cost, base, known = (words.sums(v) + e for v, e in zip(values, ends, strict=True))
            cost += np.log2(len(told.value.letters))
            out.append(arrays(schema, {
                "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
                "n_tokens": np.bincount(words.of, minlength=words.n_texts) + 1, "n_known": np.rint(known).astype(np.int64),
                "train_tokens": np.full(words.n_texts, total), "base_score": base, "score": -cost * np.log10(2),
                "bits_per_byte": cost / np.maximum(1, size)}))
        parts.clear()
        return out

    def run(texts: pa.Table, lists: pa.Table) -> pa.Table:
        out = scored(texts, lists)
        let_go()
        return out

    def scored(texts: pa.Table, lists: pa.Table) -> pa.Table:
        named = lists.column("word").combine_chunks()
        first, rest = pc.binary_slice(named, 0, 1), pc.binary_slice(named, 1, 1 << 30)
        c, bits = (lists.column(n).to_numpy() for n in ("c", "bits"))
        # per class its words, their costs, their base scores and whether they are known; the end is among them
        of_class = []
        for letter in told.value.letters:
            own = pc.equal(first, pa.scalar(letter, named.type))
            at = pc.indices_nonzero(own).to_numpy()
            known, some = c[at] > 0, rest.filter(own)
            of_class.append((some, (bits[at].astype(float), np.log10(c[at] + 1.0) - scale, known.astype(float)),
                             pc.index(some, pa.scalar(END, some.type)).as_py()))
        del named, first, rest, own, some
        out, parts, size = [], [], 0
        for batch in texts.to_batches(max_chunksize=2000):
            parts.append((batch, Words(batch.column("text"))))
            size += len(parts[-1][1].of)
            if size >= PLACED:
                out += of_parts(parts, of_class)
                size = 0
        out += of_parts(parts, of_class)
        return pa.Table.from_batches(out, schema)

    return dealt.groupBy("block").cogroup(
        lists.groupBy("block")).applyInArrow(
        run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
             "base_score double, score double, bits_per_byte double")
