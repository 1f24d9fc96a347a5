"""Token counts by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame

from tidelog.llm.bpe import Kept, Merges, units
from tidelog.llm.common import arrays, nonempty, strings

VOCABULARY = "byte_bpe_50k.json"


@lru_cache(maxsize=2)
def _kept(vocabulary: str) -> Kept:
    return Kept(Merges(public_tokenizers.path(vocabulary)).unit_counts)


def token_counts(docs: DataFrame, limit: int = 1024, vocabulary: str = VOCABULARY,
                 id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: bytes, tokens, and whether it has more than ``limit`` tokens.

    One pass without a shuffle: each task counts its own rows. Null and empty texts have no bytes
    and no tokens; a null id stays null; equal rows come out once each; other columns of the
    input are not read. Texts are counted whole, however long. ``vocabulary`` names a byte-level
    vocabulary file that every executor has.
    """
    schema = pa.schema([(id_column, pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()),
                        ("over_limit", pa.bool_())])

    def count(batches):
        kept = _kept(vocabulary)
        for batch in nonempty(batches):
            texts = [t or "" for t in strings(batch, "text")]
            cut = [units(t) for t in texts]
            of = kept.of(cut)
            tokens = [sum(map(of.__getitem__, some)) for some in cut]
            yield arrays(schema, {id_column: batch.column("id"), "n_bytes": [len(t.encode()) for t in texts],
                                  "n_tokens": tokens, "over_limit": [n > limit for n in tokens]})

    rows = docs.selectExpr(f"cast(`{id_column}` as bigint) as id", f"cast(`{text_column}` as string) as text")
    return rows.mapInArrow(count, f"`{id_column}` bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
