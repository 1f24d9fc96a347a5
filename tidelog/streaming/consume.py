"""Consuming a log as a stream: outcomes, dead letters and results per micro-batch.

Every micro-batch is one transaction named after its batch id. Spark repeats a batch under
the same id after a failure, and the transaction then replaces what was there before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from tidelog.operators import errors, process
from tidelog.sources.sinks import publish_atomic

# What stands in for the failure of a refused or postponed record.
FAILURE_CLASSES = {"NON_RETRYABLE": errors.VALIDATION, "RETRYABLE": errors.RECOVERABLE}


def as_failures(outcomes: DataFrame, at: str = "timestamp") -> DataFrame:
    """Records that did not go through, in the layout that routing reads."""
    none = F.lit(None).cast("string")
    name = F.lit(None).cast("string")
    for result, failure in FAILURE_CLASSES.items():
        name = F.when(F.col("outcome") == result, failure).otherwise(name)
    return outcomes.filter(F.col("outcome") != "PROCESSED").select(
        "topic", "partition", "offset", "key", "value", "headers", "timestamp",
        name.alias("exception_class"), F.col("error_message").alias("exception_message"),
        none.alias("error_code"), none.alias("service_name"), none.alias("field_name"),
        none.alias("validation_rule"), none.alias("correlation_id"), F.lit(1).alias("attempt"),
        F.col(at).alias("failed_at"))


def consume_batch(batch: DataFrame, path: str, batch_id: int, policy: str = "enhanced") -> None:
    """Processed records and dead letters of one micro-batch, written together."""
    outcomes = process.outcome(batch)
    processed = outcomes.filter(F.col("outcome") == "PROCESSED").select(*batch.columns)
    publish_atomic([processed, errors.dead_letters(as_failures(outcomes), policy)], path, f"batch-{batch_id}")


def consumer(path: str, policy: str = "enhanced") -> Callable[[DataFrame, int], None]:
    """Handler for ``foreachBatch``."""
    return lambda batch, batch_id: consume_batch(batch, path, batch_id, policy)
