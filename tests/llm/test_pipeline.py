"""The pipeline against plain versions of its stages, and its stages on messy rows."""

import corpus_pipeline
from pyspark.sql import functions as F

import brute
from test_tokens import check_packing
from tidelog.llm import language


def test_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    told = {r.doc_id for r in language.identify(docs).filter("lang_pred <> 'und' and score >= 0.3").collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in told)
    rows = brute.without_lines(rows)
    found = brute.simhash_components(rows, size=5)
    rows = [(i, t) for i, t in rows if found[i][1] == i]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    dirty = {i for i, _ in brute.leaks(rows, items)}
    rows = [(i, t) for i, t in rows if i not in dirty]
    result = corpus_pipeline.run(spark, folder)
    check_packing(result.collect(), rows)
    assert len(rows) < docs.count()


def test_stages_on_messy_rows(spark, messy, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, messy, folder)
        if name != "packing":
            assert done.columns == messy.columns, name
        assert 0 < done.count(), name
        assert stage(spark, messy.limit(0), folder).count() == 0, name
    labelled = messy.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.STAGES[0][1](spark, labelled, folder).count() == 0
