"""Characters that are nearly letters, and many values in one text."""

import time

from tidelog.llm import language, pii
from tidelog.llm.common import has_letter

MOVES = pii.Feistel(b"a key of the tests")


def test_month_names_with_odd_letters_are_left_alone(spark):
    texts = ["on 1 Auguſt 1790", "ſep 5, 2020", "10 aprıl 2020", "10 APRİL 2020"]
    for text in texts:
        assert pii.pseudonymize(text, MOVES) == (text, [])
    assert pii.pseudonymize("10 April 2020", MOVES)[1] == ["date"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert [r.n_private for r in pii.pseudonyms(rows, b"k").collect()] == [0] * 4


def test_many_values_in_one_text():
    text = " ".join(f"user{k}@mail.example.org" for k in range(20_000))
    began = time.perf_counter()
    done, kinds = pii.pseudonymize(text, MOVES)
    assert len(kinds) == 20_000 and time.perf_counter() - began < 15
    assert pii.pseudonymize(done, MOVES, back=True)[0] == text


def test_numbers_are_no_letters(spark):
    assert not any(map(has_letter, ["½ ²", "① Ⅷ", "12 34", "", None, "_ -"])) and all(map(has_letter, ["a", "½ é", "中", "ʰ"]))
    rows = [(k, f"the cat sat on the mat {k}", "en") for k in range(30)] + [(100, "½ ²", "en"), (101, "① Ⅷ", None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language.identify(frame).collect()}
    assert got[100] == got[101] == "und" and got[5] == "en"
