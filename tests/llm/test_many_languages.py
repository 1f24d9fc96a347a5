"""More labels than one model of languages holds."""

from pyspark.sql import functions as F

from tidelog.llm import language


def test_every_label_can_be_predicted(spark):
    rows = []
    for k in range(language_count := 207):
        own = [chr(0x4E00 + 7 * k + j) for j in range(7)]
        rows += [(10 * k + j, " ".join(own[j % 7] + own[(j + i) % 7] for i in range(7)), f"l{k:03}") for j in range(9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    model = language.train(docs.filter(~language.training_fold(F.col("doc_id"))))
    assert len(model.languages) == language_count
    of = {i: lang for i, _, lang in rows}
    got = language.identify(docs).collect()
    assert {r.lang_pred for r in got} == set(of.values())
    assert sum(of[r.doc_id] == r.lang_pred for r in got) > 0.95 * len(got)


def test_lots_change_no_result(spark, folder, monkeypatch):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    whole = sorted(map(tuple, language.identify(docs).collect()))
    monkeypatch.setattr(language, "LANGUAGES_AT_ONCE", 1)
    for a, b in zip(whole, sorted(map(tuple, language.identify(docs).collect())), strict=True):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-9
