import os
import sys

import pytest

from tidelog.llm import line_dedup

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SMALL = "/root/testdata/sf0.001"

#: Names that operators use inside, as further columns of the input.
CLASHES = ["score", "block", "word", "d", "h1", "fp", "fingerprint", "component_id", "kept", "words", "class", "n",
           "lang_pred", "held_out", "id", "at", "__text"]


@pytest.fixture(autouse=True)
def small_tables(monkeypatch):
    """Tables of fixed size are small here, which changes no result."""
    monkeypatch.setattr(line_dedup, "BUCKET_BITS", 14)
    monkeypatch.setattr(line_dedup, "FLAG_BITS", 12)


@pytest.fixture(scope="session")
def folder():
    if not os.path.isdir(SMALL):
        pytest.skip("no tables")
    return SMALL


@pytest.fixture(scope="session")
def documents(spark, folder):
    """(doc_id, text) of the smallest table."""
    return sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect())


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with null, empty, repeated and very long values, and columns of clashing names."""
    long_word, many = "x" * 150_000, " ".join(f"w{k % 977} the of" for k in range(20_000))
    rows = [(1, "The cat sat on the mat.\nA second line of this text here.", "en"), (2, None, "en"), (3, "", None),
            (4, " \t\n \n", "fr"), (None, "the lost one has no number at all", "en"), (None, None, None),
            (7, long_word, "en"), (8, many, "en"), (9, "the same text twice over", "en"), (9, "the same text twice over", "en"),
            (10, "the same text twice over", "en"), (11, "12345 67890 --- ...", "de"), (12, "der die das und ist nicht ein", "de"),
            (13, "İstanbul ſtraße ǅ 中文 🙂 é́", "tr"), (14, "<|endoftext|> inside <|endoftext|>", "en"),
            (15, "a", "en"), (16, "b", "en"), (0, "zero is an id like others", "en"), (-5, "a negative id", "en")]
    frame = spark.createDataFrame([(*r, "s", 1) for r in rows],
                                  "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name in CLASHES:
        frame = frame.selectExpr("*", f"'x' as `{name}`")
    return frame.repartition(3)
