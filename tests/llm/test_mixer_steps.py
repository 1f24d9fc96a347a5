"""Steps of the mixing model against plain ones: places of words, trees of a task, and weights by gate."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tidelog.llm import mixing


def test_places_of_words():
    rng = random.Random(3)
    known = [b"\n", *(b"w%d" % k for k in range(50)), b"w3", b"w3", b"\n"]
    asked = [[rng.choice(known) for _ in range(n)] for n in (7, 0, 40, 0)]
    found = mixing._places(pa.array(known, pa.binary()), [pa.array(a, pa.binary()) for a in asked])
    assert [[known[k] for k in some] for some in found] == asked
    with pytest.raises(IndexError):
        mixing._places(pa.array(known, pa.binary()), [pa.array([b"w1", b"unknown"], pa.binary())])


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_trees_do_not_depend_on_batches(monkeypatch, size):
    monkeypatch.setattr(mixing, "TREE_WORDS", 20)
    monkeypatch.setattr(mixing, "TREE_BYTES", 150)
    rng = random.Random(8)
    words = sorted({bytes(rng.choices(b"abc", k=rng.randint(1, 9))) + b"x" * (rng.random() < 0.1) * 60 for _ in range(400)})
    rows = [(w, k % 5, k % 7) for k, w in enumerate(words)]
    want, held, n_bytes = [], [], 0
    for row in rows:
        n_bytes += len(row[0]) + 1
        full = len(held) >= 20 or n_bytes >= 150
        if held and full and (row[0][:4] != held[-1][0][:4] or len(held) >= 60):
            want.append(held)
            held, n_bytes = [], len(row[0]) + 1
        held.append(row)
    batches = [pa.RecordBatch.from_pydict({n: pa.array(v) for n, v in zip(("word", "c", "all"), zip(*rows[k:k + size]), strict=True)})
               for k in range(0, len(rows), size)]
    found = [(t.column("word").to_pylist(), t.column("all").to_pylist(), tree.sum_by_word(tree.weight).tolist())
             for t, tree in mixing.trees(iter(batches))]
    trees = [mixing.Tree([w for w, _, _ in some], np.array([c for _, c, _ in some], float)) for some in [*want, held]]
    assert found == [([w for w, _, _ in some], [a for _, _, a in some], tree.sum_by_word(tree.weight).tolist())
                     for some, tree in zip([*want, held], trees, strict=True)] and len(found) > 5


def test_weights_move_by_gate():
    """One step of learning, gate by gate and edge by edge."""
    words = sorted({b"A" + bytes(random.Random(k).choices(b"abcd", k=4)) for k in range(60)})
    tree = mixing.Tree(words, np.arange(1.0, len(words) + 1))
    tables = np.zeros((mixing.ORDERS, 1 << mixing.SLOT_BITS, 2), np.float32)
    for order in range(1, mixing.ORDERS + 1):
        for bit in range(8):
            np.add.at(tables[order - 1], (tree.slots(order, bit), tree.symbol >> (7 - bit) & 1), tree.weight)
    mixer, weights = mixing.Mixer(tables), np.full((mixing.GATES, mixing.INPUTS), 0.3)
    weights[:, -1] = 0
    for bit in range(8):
        x, gate, truth = mixer.inputs(tree, bit, leave_out=True)
        part = np.where(tree.given, 0, tree.weight)
        moved, n = np.zeros_like(weights), np.full(mixing.GATES, 50.0)
        for k, g in enumerate(gate):
            logit = np.clip(x[:, k].astype(float) @ weights[g], -12, 12)
            moved[g] += x[:, k] * (truth[k] - 1 / (1 + np.exp(-logit))) * part[k]
            n[g] += part[k]
        weights += mixing.RATE * moved / n[:, None]
    mixer.learn(tree)
    assert np.allclose(mixer.weights, weights, rtol=1e-6, atol=1e-9)
