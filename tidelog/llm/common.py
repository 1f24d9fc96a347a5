"""Helpers that the text operators share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidelog.session import durable

#: Rows that Spark hands to a Python worker at once. Whole texts travel, so the default of
#: 10,000 rows would let a batch of long documents outgrow a worker.
ROWS_PER_BATCH = 1000

#: Words of the text operators: everything between ASCII white space.
WORD_SPLIT = "[ \\t\\n\\x0B\\f\\r]+"


def written(df: DataFrame) -> DataFrame:
    """``durable(df)``, after which the shuffle files of the steps behind it are let go.

    Spark deletes them when the driver collects its garbage, which may not happen for long; until then
    all steps of an operator would lie on the executors' disks together.
    """
    out = durable(df)
    del df
    gc.collect()
    out.sparkSession.sparkContext._jvm.System.gc()
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to ROWS_PER_BATCH, never raise it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > ROWS_PER_BATCH:
        spark.conf.set(key, str(ROWS_PER_BATCH))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: A-Z in lower case, split at ASCII white space; of a null text, none."""
    return text.encode().lower().split() if text else []


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether a document belongs to the fold that is never learned from. A null id does."""
    at = F.crc32(doc_id.cast("string").cast("binary")) % modulus
    return F.coalesce(at == remainder, F.lit(True))


def strings(batch: pa.RecordBatch, name: str) -> list[str | None]:
    return batch.column(name).to_pylist()


def arrays(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def plain_names(df: DataFrame, *wanted: str) -> tuple[DataFrame, list[str]]:
    """``df`` with its columns named c0, c1 and so on, which no name used inside can meet, and what the wanted
    ones are called in it. ``toDF(*df.columns)`` gives the names back."""
    low = [c.lower() for c in df.columns]
    return df.toDF(*(f"c{k}" for k in range(len(low)))), [f"c{low.index(w)}" for w in wanted]


def let_go() -> None:
    """Give back the memory that arrays have left. Arrow keeps it for the next ones, and an executor's idle
    workers would keep what their largest step took."""
    pa.default_memory_pool().release_unused()


def letting_go(run: Callable) -> Callable:
    """``run``, a function of batches for ``mapInArrow``, after which a worker gives memory back."""

    def then_let_go(batches):
        yield from run(batches)
        let_go()

    return then_let_go


def nonempty(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b for b in batches if b.num_rows)


def has_letter(text: str | None) -> bool:
    """Whether a text has a character of a letter category; numbers such as a half or a Roman eight are none."""
    return bool(text) and any(map(str.isalpha, text))
