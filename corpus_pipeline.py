"""From raw documents to packed training sequences, a stage at a time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import decontaminate, language, line_dedup, near_copies, packing
from tidelog.llm.common import small_batches, table
from tidelog.session import shared_folder


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay; those without letters, or that no learned language
    fits better than others, go."""
    small_batches(spark)
    return language.keep_identified(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line are taken out of the texts; all documents stay."""
    return line_dedup.without_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id. Near copies are texts whose
    SimHash fingerprints, over three-word shingles (those of ``op4``) or over five-word ones, differ in at most 2 bits,
    or whose five-word shingles have a Jaccard similarity of at least 0.8. Documents whose lines have all gone are alike, so one of them stays too."""
    small_batches(spark)
    return near_copies.keep_one(docs, size=5, radius=2, prints_of=(3, 5))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item or its question go."""
    small_batches(spark)
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"), least_question=decontaminate.LEAST_QUESTION)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents that are left, in sequences of at most 1024 tokens."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup_stage), ("near_dedup", near_dedup),
          ("decontamination", decontamination), ("packing", pack)]

#: SQL can neither tokenize nor train, so the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
