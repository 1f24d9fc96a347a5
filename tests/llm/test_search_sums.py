"""The search for test items sums by place in an array where that is small, by sorted keys where it is not."""

import random

import numpy as np
import pytest

from tidelog.llm import decontaminate


@pytest.mark.parametrize("dense", [True, False])
def test_sums_by_place_and_by_sorting(monkeypatch, dense):
    monkeypatch.setattr(decontaminate, "_dense", lambda n, size: dense)
    rng = np.random.default_rng(5)
    keys, numbers = rng.integers(0, 500, 300), rng.random(300)
    want = {}
    for k, x in zip(keys.tolist(), numbers.tolist(), strict=True):
        want[k] = want.get(k, 0) + x
    some, sums = decontaminate._sums(keys, numbers, 500)
    assert some.tolist() == sorted(want) and sums.tolist() == [want[k] for k in sorted(want)]
    assert decontaminate._distinct(keys, 500).tolist() == sorted(want)
    wanted = np.array(sorted(want)[::3])
    assert decontaminate._among(keys, wanted, 500).tolist() == [k in set(wanted.tolist()) for k in keys.tolist()]


def test_both_ways_find_the_same(monkeypatch, documents):
    rng = random.Random(11)
    items = [(k, " ".join(rng.choice(documents)[1].split()[:rng.randint(3, 200)])) for k in range(60)]
    texts = [t for _, t in documents[:40]] + [None, "", " ".join(t for _, t in items[:20])]
    found = []
    for dense in (True, False):
        monkeypatch.setattr(decontaminate, "_dense", lambda n, size, dense=dense: dense)
        found.append(decontaminate.leaks(decontaminate.indexes(items), texts, 0.8, 0.8))
    assert found[0] == found[1] and len(found[0]) > 20


def test_common_words_are_not_counted_twice(documents):
    """Scores of what is found hold each late term of a passage once, whatever it repeats."""
    items = [(k, f"the old town of place{k} has the bridge and the mill of builder{k} by the river") for k in range(40)]
    index, = decontaminate.indexes(items)
    assert index.late.any()
    text = " ".join(["the of and"] * 20 + [items[7][1], items[7][1]])
    (d, start, item, score), = [f for f in index.search([decontaminate.words(text)]) if f[2] == 7][:1]
    assert (d, item) == (0, 7) and abs(score - 1) < 1e-9
