"""Token counts and packing against the tokenizers library."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

import brute
from tidelog.llm import bpe, packing, token_counts

PIECES = [" ", "  ", "\n", "\t", "\r\n", "a", "the", "'s", "'S", "don't", "ñ", "ß", "中文", "🙂", "1", "23", "...", "!",
          "<|endoftext|>", " ", "　", "\x1c", "\x85", "aaaaaaa", "==", "ing", " Aa", "​", "é", "٣"]


def test_units_and_merges_equal_the_library():
    rng, merges = random.Random(3), bpe.Merges(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.encoder("byte_bpe_50k.json")
    for _ in range(4000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14)))
        some, want = bpe.units(text), brute.ids(text)
        assert "".join(some) == text
        assert sum(merges.unit_counts(some)) == len(want), repr(text)
        assert np.frombuffer(encode(text), "<u4").tolist() == want, repr(text)


@pytest.mark.parametrize("text", [" " * 300_000, "a" * 100_000, "\n" * 50_000 + "x", "ab" * 60_000])
def test_extreme_texts(text):
    merges = bpe.Merges(public_tokenizers.path("byte_bpe_50k.json"))
    want = brute.ids(text)
    assert sum(merges.unit_counts(bpe.units(text))) == len(want)
    assert np.frombuffer(packing.encoder("byte_bpe_50k.json")(text), "<u4").tolist() == want


def test_counts(spark, messy, documents, folder):
    for frame in (messy, spark.read.parquet(f"{folder}/documents.parquet")):
        texts = sorted(((r.doc_id, r.text) for r in frame.collect()), key=str)
        want = sorted(((i, len((t or "").encode()), len(brute.ids(t)), len(brute.ids(t)) > 1024) for i, t in texts), key=str)
        assert sorted(map(tuple, token_counts.token_counts(frame).collect()), key=str) == want
    assert token_counts.token_counts(messy.limit(0)).count() == 0


def check_packing(rows, texts):
    """Every id in one piece, sequences gapless and at most 1024 long; gives the padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == {i for i, _ in texts}
    for i, text in texts:
        want, at = [*brute.ids(text), 0], 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            part = np.array(want[r.start:r.start + r.length], "<u4").tobytes()
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(want), zlib.crc32(part))
            at += r.length
        assert at == len(want)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 1024
    return len(by_sequence) * 1024 - sum(r.length for r in rows)


def test_packing(spark, documents, folder):
    frame = spark.read.parquet(f"{folder}/documents.parquet").coalesce(1)
    rows = packing.pack(frame).collect()
    assert check_packing(rows, documents) < 1024


def test_packing_of_messy_rows(messy):
    unique = messy.filter("doc_id is not null").dropDuplicates(["doc_id"])
    check_packing(packing.pack(unique).collect(), [(r.doc_id, r.text) for r in unique.collect()])
    every = packing.pack(messy).collect()
    assert sum(r.doc_tokens for r in every if r.start == 0) == sum(len(brute.ids(r.text)) + 1 for r in messy.collect())
    assert packing.pack(messy.limit(0)).count() == 0


def test_costs_are_balanced():
    rng = random.Random(5)
    lengths = [rng.randint(1, 1023) for _ in range(600)]
    pieces = packing.balance(lengths, 1024, 1.0, 1 / 1024)
    load = defaultdict(float)
    got = defaultdict(int)
    for k, start, length, at, _ in pieces:
        assert start == got[k]
        got[k] += length
        load[at] += packing.cost(length, 1.0, 1 / 1024)
    assert [got[k] for k in range(600)] == lengths and len(load) == -(-sum(lengths) // 1024)
    assert packing.balance([5, 5], 1024, 1.0, 1.0) == [(0, 0, 5, 0, 0), (1, 0, 5, 0, 5)]
