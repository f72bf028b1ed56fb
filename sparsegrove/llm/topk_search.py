"""Exact top-k inner-product search by block-at-a-time pruning.

The candidate vectors lie in shards, the shards in blocks of neighbouring vectors. A block keeps the largest and the
smallest value of each component (its term maxima, for either sign of a query's weight) and its vectors as a dense
forward index. For each query the blocks of a shard are taken in the order of their summed term maxima and scored
through the forward index, until the next bound is below the query's k-th score. The shards' winners are then ranked
once more. Queries and candidates meet in a grid of (query chunk, shard) cells, each a task of bounded size; the grid
has as many cells as the work asks for, and no cell grows with the input.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import splitmix, table

BLOCK = 64
SCORED = "query_id long, vec_id long, score long"


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """_id, _v: floor(scale * x) for every component x, as double; vectors that are null, empty or hold null or
    non-finite components are left out."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)).select(F.col(id_col).cast("long").alias("_id"), v.alias("_v")).where(whole).select("_id", F.transform("_v", lambda x: F.floor(x * scale).cast("long")).alias("_v"))


def locality(vectors: np.ndarray, bits: int = 16) -> np.ndarray:
    """Signs of fixed projections, as a number: vectors with like signs lie together, which tightens block bounds."""
    dims = vectors.shape[1]
    planes = (splitmix(dims * bits, 11).reshape(dims, bits) >> np.uint64(63)).astype(np.float64) * 2 - 1
    return ((vectors @ planes) > 0) @ (1 << np.arange(bits)[::-1])


class Blocks:
    """The forward index of a shard in blocks, with the bounds of each."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((ids, locality(vectors)))
        self.ids, self.vectors = ids[order], vectors[order]
        self.starts = np.arange(0, len(ids), BLOCK)
        self.high = np.maximum.reduceat(self.vectors, self.starts, axis=0)
        self.low = np.minimum.reduceat(self.vectors, self.starts, axis=0)

    def search(self, query: np.ndarray, own: int, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best, without the query's own row; ties go to the smaller id."""
        order = np.argsort(-bounds, kind="stable")
        ids, scores, kth, step = np.zeros(0, np.int64), np.zeros(0), -math.inf, max(1, k // BLOCK + 1)
        at = 0
        while at < len(order) and bounds[order[at]] >= kth:
            take = order[at : at + step]
            at += step
            rows = np.concatenate([np.arange(s, min(s + BLOCK, len(self.ids))) for s in self.starts[take]])
            rows = rows[self.ids[rows] != own]
            ids, scores = np.concatenate([ids, self.ids[rows]]), np.concatenate([scores, self.vectors[rows] @ query])
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
            kth = scores[-1] if len(scores) == k else -math.inf
            step = min(2 * step, 64)
        return ids, scores


def matrix(vectors: pd.Series, dims: int) -> np.ndarray:
    """Rows of one width; shorter vectors end in zeros, so the inner product is that of the common components."""
    out = np.zeros((len(vectors), dims))
    lengths = vectors.map(len).to_numpy()
    if len(lengths) and (lengths == dims).all():
        return np.array(vectors.tolist(), dtype=np.float64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def check_range(queries: np.ndarray, vectors: np.ndarray) -> None:
    if np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * queries.shape[1] >= 2.0**53:
        raise ValueError("scores may reach 2**53: use a smaller scale")


def exact_top_k(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0, shard_rows: int = 8192, chunk_rows: int = 2048) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row where is_query holds, the k other rows with the highest inner
    product of the integer vectors.

    Ties go to the smaller id; fewer rows than k come back when there are fewer. Defined cases: rows with a null id,
    null or empty vectors and vectors with null or non-finite components take no part; vectors of unlike lengths are
    multiplied over their common components; every row with the query's own id is left out of its candidates; a row
    given twice is a candidate twice, and a query given twice is asked once (by the smaller vector); an empty table
    gives an empty result; scores that might reach 2**53, from where doubles are not exact, are an error. Cells hold at most about shard_rows
    candidates and chunk_rows queries.
    """
    rows = df.select(id_col, vector_col, F.coalesce(is_query, F.lit(False)).alias("_query"))
    vectors = integer_vectors(rows, id_col, vector_col, scale)
    asked = integer_vectors(rows.where("_query"), id_col, vector_col, scale).groupBy("_id").agg(F.min("_v").alias("_v"))
    n = rows.agg(F.count(F.lit(1)), F.count_if("_query")).first()
    shards, chunks = max(1, math.ceil(n[0] / shard_rows)), max(1, math.ceil(n[1] / chunk_rows))
    cell = lambda own, other, n_own, n_other: (F.pmod(F.xxhash64("_id"), F.lit(n_own)).alias(own), F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other))
    left = asked.select("_id", "_v", *cell("_chunk", "_shard", chunks, shards)).select("_id", "_v", "_chunk", F.col("_shard").cast("long"))
    right = vectors.select("_id", "_v", *cell("_shard", "_chunk", shards, chunks)).select("_id", "_v", F.col("_chunk").cast("long"), "_shard")

    def search(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(d):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        dims = max(q["_v"].map(len).max(), d["_v"].map(len).max())
        queries, blocks = matrix(q["_v"], dims), Blocks(d["_id"].to_numpy(), matrix(d["_v"], dims))
        check_range(queries, blocks.vectors)
        bounds = np.maximum(queries, 0) @ blocks.high.T + np.minimum(queries, 0) @ blocks.low.T
        own = q["_id"].to_numpy()
        found = [blocks.search(queries[i], own[i], bounds[i], k) for i in range(len(q))]
        return pd.DataFrame({"query_id": np.repeat(own, [len(x[0]) for x in found]), "vec_id": np.concatenate([x[0] for x in found]), "score": np.concatenate([x[1] for x in found]).astype("int64")})

    best = left.groupBy("_chunk", "_shard").cogroup(right.groupBy("_chunk", "_shard")).applyInPandas(search, SCORED)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_exact_topk(spark, sf_dir):
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.v, d.v) AS BIGINT) AS score FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
