"""Screening of groups by fits on pairs of subsets, for designs that are to be thinned out before a final fit."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from .groups import whole_groups
from .passes import Model, fit_models
from .score import shares
from .solver import Options


def subset_pairs(parts: int) -> list[tuple[int, int]]:
    return list(combinations(range(parts), 2))


def selected_genes(scores: DataFrame, sizes: DataFrame, parts: int, share: float = 1.0, shrink: float = 0.9) -> DataFrame:
    """gene of the best-scoring genes whose bytes are at most a part of all: the share of the total score that they must reach is
    lowered by a tenth at a time until they fit; genes are ranked once, for all shares. scores: gene, gss; sizes: gene, bytes."""
    tried = [share]
    while tried[-1] >= 1e-6:
        tried.append(tried[-1] * shrink)
    rows = shares(scores.where("gss > 0")).join(sizes, "gene", "left").na.fill(0, ["bytes"])
    taken = F.size(F.filter(F.array(*map(F.lit, tried)), lambda s: F.col("_before") < s * F.col("_total")))  # by so many of the shares
    ranked = stored(rows.select("gene", "bytes", taken.alias("_taken")), "shares")
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    held = {r[0]: r[1] for r in ranked.groupBy("_taken").agg(F.sum("bytes")).collect()}  # one row a share
    at = next((k for k in range(len(tried)) if sum(n for t, n in held.items() if t > k) <= total / parts), len(tried) - 1)
    return ranked.where(F.col("_taken") > at).select("gene")


def dealt(sizes: DataFrame, parts: int) -> DataFrame:
    """gene, part: genes dealt to parts of nearly equal bytes, the largest first and in turns that go forth and back, so that two parts
    differ by at most the largest gene. sizes: gene, bytes."""
    place = F.expr("row_number() OVER (ORDER BY bytes DESC, gene) - 1")  # one row a gene
    ranked = sizes.select("gene", place.alias("_at"))
    turn, at = F.floor(F.col("_at") / parts), F.pmod("_at", F.lit(parts))
    return ranked.select("gene", F.when(F.pmod(turn, F.lit(2)) == 0, at).otherwise(parts - 1 - at).cast("int").alias("part"))


def parts_needed(cells: int, features: int, budget: int) -> int:
    """The number of parts from which on two of them at once fit a budget of bytes: 8 for a cell and 64 for a feature's state."""
    held = 8 * cells + 64 * features
    return 1 if held <= budget else max(2, -(-2 * held // budget))


def screen_groups(spark: SparkSession, x: DataFrame, samples: DataFrame, features: DataFrame, members: DataFrame, sizes: DataFrame, parts: int, grid: list[tuple[float, float]], method: str = "logistic", options: Options = Options()) -> DataFrame:
    """gene, gss: genes are dealt to parts by bytes, each pair of parts is fitted over the grid, all of them side by side, and a gene's score
    is the sum of its |beta| over these fits. features: feature_id, gene; members: feature_id, group_ord, weight; sizes: gene, bytes."""
    of = features.select("feature_id", "gene").join(dealt(sizes, parts), "gene")
    models = [Model(float(a), float(b), grid_ord=i, subsets=pair) for pair in subset_pairs(parts) for i, (a, b) in enumerate(grid)]
    people = samples.select("seq_id", F.array(F.col("trait").cast("double")).alias("traits"), F.lit(0).alias("fold"))
    found = fit_models(x, people, members.join(of.select("feature_id", F.col("part").alias("subset")), "feature_id"), models, method, options)
    return found.where("feature_id IS NOT NULL").join(of, "feature_id").groupBy("gene").agg(F.sum(F.abs("beta")).alias("gss"))


def screened(spark: SparkSession, x: DataFrame, samples: DataFrame, features: DataFrame, members: DataFrame, sizes: DataFrame, parts: int, grid: list[tuple[float, float]], method: str = "logistic", options: Options = Options(), lines: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """feature_id, gene of the genes that the screening keeps, and the genes' scores: the best genes whose bytes are at most one part of
    all, with all genes of a group (lines: group_ord, gene_ord, gene) if one of it is kept. sizes: gene, bytes."""
    scores = stored(screen_groups(spark, x, samples, features, members, sizes, parts, grid, method, options), "screening")
    chosen = selected_genes(scores, sizes, parts)
    if lines is not None:
        chosen = whole_groups(lines, chosen).select("gene").distinct()
    return features.select("feature_id", "gene").join(chosen, "gene", "left_semi"), scores
