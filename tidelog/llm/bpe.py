"""Byte-pair tokens by units: stretches of text whose tokens do not depend on their surroundings.

The pre-token pattern never lets a token run from a non-space character into the white space
after it, and looks ahead only from inside white space. So a text may be cut before every space
that follows a non-space character, and each unit has the same tokens alone as in its text. Units
repeat far more often than texts do, so their tokens are worked out once and kept.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import numpy as np
import regex

#: Units a worker keeps, and the longest unit it keeps; both bound memory only, not results.
KEPT_UNITS, KEPT_LENGTH = 600_000, 48

# Fixed value: the pre-token pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_SPACED = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")


def units(text: str) -> list[str]:
    """The text in order, cut where tokens always end."""
    if _SPACED.search(text) is None:
        first, *rest = text.split(" ")
        return [first] * bool(first) + [" " + part for part in rest]
    return [part for part in _CUT.split(text) if part]


def byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible ones stand for
    themselves, the code points from 256 on for the other bytes in order."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = sorted(set(range(256)) - set(visible))
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Kept:
    """Values of units, worked out in batches by ``make``: list of units -> list of values."""

    def __init__(self, make: Callable[[list[str]], list]):
        self.make, self.kept = make, {}

    def of(self, unit_lists: list[list[str]]) -> dict:
        """A mapping that has every unit of these lists."""
        if len(self.kept) > KEPT_UNITS:
            self.kept = {}
        new = list({u for some in unit_lists for u in some if u not in self.kept})
        found = dict(zip(new, self.make(new), strict=True))
        short = {u: v for u, v in found.items() if len(u) <= KEPT_LENGTH}
        self.kept.update(short)
        if len(short) == len(found):
            return self.kept
        return self.kept | {u: v for u, v in found.items() if len(u) > KEPT_LENGTH}


class Merges:
    """The merge list of a byte-level vocabulary, for rank-synchronous merging."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        vocab = whole["model"]["vocab"]
        self.special = sorted((t["content"] for t in whole["added_tokens"]), key=len, reverse=True)
        self.special_pattern = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.pattern = regex.compile(PATTERN)
        self.byte_ids = np.zeros(256, np.int64)
        for character, byte in byte_values().items():
            self.byte_ids[byte] = vocab[character]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in whole["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]

    def counts(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols left of each pre-token when no pair can be merged.

        All pre-tokens lie behind each other in one array. Each round looks up every pair's rank,
        finds the lowest of each pre-token, and merges all its places at once, from the left
        where they overlap. A merge only makes pairs of higher rank, so this equals merging one
        pair after the other.
        """
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        out = sizes.copy()
        open_ = np.flatnonzero(sizes > 1)
        if not len(open_):
            return out
        symbols = self.byte_ids[np.frombuffer(b"".join(tokens[i] for i in open_), np.uint8)]
        sizes, none = sizes[open_], np.int64(1 << 40)
        while len(open_):
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            owner = np.repeat(np.arange(len(sizes)), sizes)
            keys = symbols << 32
            keys[:-1] |= symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            rank = np.where(self.keys[at] == keys, self.ranks[at], none)
            rank[starts + sizes - 1] = none
            lowest = np.minimum.reduceat(rank, starts)
            picked = np.flatnonzero((rank == lowest[owner]) & (rank < none))
            if len(picked):
                first = np.concatenate(([True], np.diff(picked) != 1))
                run = np.arange(len(picked))
                run -= np.maximum.accumulate(np.where(first, run, 0))
                picked = picked[run % 2 == 0]
                symbols[picked] = self.made[at[picked]]
            keep = np.ones(len(symbols), bool)
            keep[picked + 1] = False
            sizes = sizes - np.bincount(owner[picked], minlength=len(sizes))
            done = lowest == none
            out[open_[done]] = sizes[done]
            keep &= ~done[owner]
            symbols, open_, sizes = symbols[keep], open_[~done], sizes[~done]
        return out

    def unit_counts(self, some: list[str]) -> list[int]:
        """Tokens of each unit; strings of added tokens inside count as one token each."""
        distinct: dict[str, int] = {}
        flat, owner, fixed = [], [], np.zeros(len(some), np.int64)
        for k, unit in enumerate(some):
            parts = [unit]
            if self.special_pattern is not None and self.special_pattern.search(unit):
                fixed[k] = len(self.special_pattern.findall(unit))
                parts = self.special_pattern.split(unit)
            for part in parts:
                found = self.pattern.findall(part)
                flat += [distinct.setdefault(t, len(distinct)) for t in found]
                owner += [k] * len(found)
        if flat:
            counts = self.counts([t.encode() for t in distinct])
            fixed += np.bincount(owner, weights=counts[flat], minlength=len(some)).astype(np.int64)
        return fixed.tolist()
