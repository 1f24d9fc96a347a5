"""Plain versions of the operators, one row after the other."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import public_tokenizers
import xxhash
from tokenizers import Tokenizer

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def fingerprint(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k:k + size]) for k in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_components(rows, size=3, radius=2):
    """doc_id -> (fingerprint, component) by comparing all pairs."""
    prints = {i: fingerprint(t, size) for i, t in rows}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    names = sorted(prints)
    for a in names:
        for b in names:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (f"{prints[i]:016x}", find(i)) for i in names}


def removed_lines(rows):
    """doc_id -> numbers of the lines that match an earlier line."""
    seen, removed = [], defaultdict(set)
    for i, text in sorted(rows):
        for k, line in enumerate((text or "").split("\n")):
            words = set(re.split("[ \t\r\x0b\x0c]+", line.lower())) - {""}
            if not words:
                continue
            if any(9 * len(words & w) >= 4 * (len(words) + len(w)) for w in seen):
                removed[i].add(k)
            seen.append(words)
    return removed


def without_lines(rows):
    removed = removed_lines(rows)
    return [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in removed[i])) for i, t in rows]


def leaks(rows, items, least=0.8):
    def shingles(text):
        w = re.findall(r"\w+", (text or "").lower())
        return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())

    def has(words, s):
        return any(tuple(words[k:k + len(s)]) == s for k in range(len(words) - len(s) + 1))

    out = set()
    for item, text in items:
        wanted = shingles(text)
        for i, t in rows:
            words = re.findall(r"\w+", (t or "").lower())
            if wanted and sum(has(words, s) for s in wanted) / len(wanted) >= least:
                out.add((i, item))
    return out


def best_inner_products(rows, k=5, every=50):
    import math

    ints = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    out = []
    for q in sorted(i for i in ints if i % every == 0):
        scores = sorted((-sum(a * b for a, b in zip(ints[q], ints[c], strict=True)), c) for c in ints if c != q)
        out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scores[:k])]
    return out


def word_counts(texts):
    c = Counter()
    for t in texts:
        c.update((t or "").encode().lower().split())
        c["end"] += 1
    return c
