"""Exact top-k inner products by Fagin's threshold algorithm."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidelog.session import durable

#: Vectors of a candidate block and queries of a query block; both bound what a task holds.
CANDIDATES, QUERIES = 8192, 1024
FIRST_DEPTH = 64


def valid(vector: Column) -> Column:
    """Vectors that take part: not null or empty, every component there and finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False))


def integers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def _all(parts: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint")))


def threshold_search(query: np.ndarray, own, ids: np.ndarray, vectors: np.ndarray, order: np.ndarray,
                     k: int) -> list[tuple[int, int]]:
    """The k best (score, id) of a block, best first, ties to the smaller id.

    ``order`` has, per dimension, the rows in ascending order of that component. Each list is
    read from the end that adds most to this query's score, all lists down to the same depth. A row that
    turns up for the first time is scored in full. No row deeper in every list can score more than
    the sum of the lists' values at the present depth; once that is below the k-th best, the search stops.
    """
    used = np.flatnonzero(query)
    down = query[used] > 0
    n, depth, step = len(ids), 0, FIRST_DEPTH
    seen = ids == own
    best_score, best_id = np.zeros(0, np.int64), np.zeros(0, np.int64)
    while depth < n:
        until = min(n, depth + step)
        at = np.arange(depth, until)[:, None]
        rows = order[np.where(down, n - 1 - at, at), used].ravel() if len(used) else np.arange(n)
        met = np.zeros(n, bool)
        met[rows] = True
        new = np.flatnonzero(met & ~seen)
        seen |= met
        score = np.concatenate([best_score, vectors[new] @ query])
        names = np.concatenate([best_id, ids[new]])
        keep = np.lexsort((names, -score))[:k]
        best_score, best_id = score[keep], names[keep]
        if not len(used):
            break
        last = order[np.where(down, n - until, until - 1), used]
        bound = int((vectors[last, used] * query[used]).sum())
        if len(best_score) == k and bound < best_score[-1]:
            break
        depth, step = until, step * 2
    return list(zip(best_score.tolist(), best_id.tolist(), strict=True))


def search(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, candidates: int = CANDIDATES,
           queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest integer inner product of each query.

    Queries are the rows whose ``vec_id`` is divisible by ``every``, candidates all rows but those of
    the query's own id. Components become floor(scale * x). Rows are dealt by a hash of their id into
    blocks of bounded size; each pair of a query block and a candidate block is searched by the
    threshold algorithm on its own, and the k best of all blocks are merged. So work and moved
    rows grow with queries x candidates, as an exact search of this query set must, and no task grows.

    Vectors that are null, empty, or hold null or non-finite components take no part, nor do rows
    with a null id; only vectors of as many components as the query are compared. Equal rows count once.
    Fewer than k candidates give fewer rows; an empty table gives none. Only ``vec_id`` and
    ``embedding`` are read. Scores must fit 64 bits.
    """
    rows = durable(vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").alias("e"))
                   .filter(F.col("vec_id").isNotNull() & valid(F.col("e")))
                   .select("vec_id", integers(F.col("e"), scale).alias("v")).distinct())
    asked = F.col("vec_id") % every == 0
    total, asking = rows.agg(F.count(F.lit(1)), F.count_if(asked)).first()
    blocks, lots = max(1, -(-total // candidates)), max(1, -(-asking // queries))
    dims, mixed = F.size("v").alias("dims"), F.xxhash64("vec_id")
    there = rows.select(F.lit(False).alias("asks"), "vec_id", "v", dims, F.pmod(mixed, F.lit(blocks).cast("bigint")).alias("block"),
                        _all(lots).alias("lot"))
    here = rows.filter(asked).select(
        F.lit(True).alias("asks"), "vec_id", "v", dims,
        _all(blocks).alias("block"),
        F.pmod(mixed, F.lit(lots).cast("bigint")).alias("lot"))

    def run(table: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        ids = table.column("vec_id").to_numpy()
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        flat = pa.chunked_array(table.column("v")).combine_chunks()
        whole = flat.flatten().to_numpy().reshape(len(ids), -1)
        by_id = np.argsort(ids, kind="stable")
        mine, theirs = by_id[~asks[by_id]], by_id[asks[by_id]]
        held, names = whole[mine], ids[mine]
        order = np.argsort(held, axis=0, kind="stable")
        for q in theirs:
            for score, vec_id in threshold_search(whole[q], ids[q], names, held, order, k):
                out["query_id"].append(ids[q])
                out["vec_id"].append(vec_id)
                out["score"].append(score)
        return pa.table({n: pa.array(c, pa.int64()) for n, c in out.items()})

    found = there.union(here).groupBy("block", "lot", "dims").applyInArrow(
        run, "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
