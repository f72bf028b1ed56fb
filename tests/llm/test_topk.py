import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsegrove.llm.topk_search import Blocks, exact_top_k


def brute(vectors, queries, k):
    out = {}
    for q in queries:
        scores = sorted((-(sum(math.floor(64 * a) * math.floor(64 * b) for a, b in zip(vectors[q], v))), i) for i, v in vectors.items() if i != q)
        out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def test_against_brute_force_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    vectors = {i: [float(np.float32(x)) for x in rng.integers(-3, 4, 6) / 64] for i in range(300)}  # many ties
    rows = [(i, v, 0) for i, v in vectors.items()]
    odd = [(1000, None, 0), (1001, [], 0), (1002, [1.0, float("nan")], 0), (1003, [1.0, None], 0), (1004, [float("inf")], 0), (None, [1.0] * 6, 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, score int")
    found = {}
    for r in exact_top_k(df, F.col("vec_id") % 20 == 0, shard_rows=90, chunk_rows=5).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert found == brute(vectors, range(0, 300, 20), 20)


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(20, [1.0]), (40, [2.0]), (41, [3.0])], "vec_id long, embedding array<float>")
    found = exact_top_k(df, F.col("vec_id") % 20 == 0).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in found} == {(20, 1, 41), (20, 2, 40), (40, 1, 41), (40, 2, 20)}
    assert exact_top_k(df.where("false"), F.lit(True)).count() == 0


def test_blocks_are_left_out():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 40, (8, 16)).round()
    vectors = np.repeat(centres, 128, axis=0) + rng.integers(-2, 3, (1024, 16))
    blocks = Blocks(np.arange(1024), vectors)
    bounds = np.maximum(vectors[:1], 0) @ blocks.high.T + np.minimum(vectors[:1], 0) @ blocks.low.T
    ids, scores = blocks.search(vectors[0], 0, bounds[0], 10)
    everything = vectors @ vectors[0]
    everything[0] = -1e9
    assert scores.tolist() == np.sort(everything)[::-1][:10].tolist()
    assert (bounds[0] < scores[-1]).sum() > len(blocks.starts) / 2  # never scored


def test_scores_beyond_exact_doubles_are_an_error(spark):
    df = spark.createDataFrame([(20, [1e7, 1.0]), (40, [1e7, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="2\\*\\*53"):
        exact_top_k(df, F.lit(True)).collect()
