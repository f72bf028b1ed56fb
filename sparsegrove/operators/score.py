"""Scores of models and predictions, all as aggregates over long tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import sigmoid
from .encode import hits


def position_scores(model: DataFrame) -> DataFrame:
    """gene, pos, pss: summed |beta| of a position's bits. model: gene, pos, allele, beta."""
    return model.where("beta <> 0").groupBy("gene", "pos").agg(F.sum(F.abs("beta")).alias("pss"))


def gene_scores(model: DataFrame, group: str = "gene") -> DataFrame:
    """group, gss: summed |beta| of a group."""
    return model.where("beta <> 0").groupBy(group).agg(F.sum(F.abs("beta")).alias("gss"))


def hypothesis_score(genes: DataFrame) -> DataFrame:
    """hss: the sum of the gene scores."""
    return genes.agg(F.sum("gss").alias("hss"))


def contributions(alignment: DataFrame, model: DataFrame, data_type: str | None = None, salts: int = 1) -> DataFrame:
    """seq_id, gene, contribution: summed beta of the alleles that a sequence carries; genes of the model without a match are
    not listed. alignment: gene, seq_id, seq, normalised if no data_type is given."""
    carried = hits(alignment, model.where("beta <> 0").select("gene", "pos", "allele", "beta"), "beta", data_type, salts)
    return carried.groupBy("seq_id", "gene").agg(F.sum("beta").alias("contribution"))


def check_genes(model: DataFrame, alignment_genes: DataFrame) -> None:
    """Genes of the model that the input lacks are an error."""
    lacking = [r[0] for r in model.select("gene").distinct().join(alignment_genes.select("gene").distinct(), "gene", "left_anti").limit(5).collect()]
    if lacking:
        raise ValueError(f"present in the model, but not in the input: {lacking}")


def group_contributions(by_gene: DataFrame, groups: DataFrame) -> DataFrame:
    """seq_id, group, contribution: the sum over a group's genes. groups: group, gene."""
    return by_gene.join(groups.select("group", "gene").distinct(), "gene").groupBy("seq_id", "group").agg(F.sum("contribution").alias("contribution"))


def species_scores(people: DataFrame, by_gene: DataFrame, intercept: float) -> DataFrame:
    """seq_id, response, sps: the intercept and all contributions. people: seq_id, response."""
    total = by_gene.groupBy("seq_id").agg(F.sum("contribution").alias("_sum"))
    return people.join(total, "seq_id", "left").select("seq_id", "response", (F.coalesce("_sum", F.lit(0.0)) + F.lit(intercept)).alias("sps"))


def normalized_probabilities(scores: DataFrame) -> DataFrame:
    """seq_id, response, sps, spp: the probability's distance from 1/2 as a share of its class's extreme; null for a response of
    0 or none. An empty class takes the overall extreme."""
    p = sigmoid(F.col("sps"))
    extremes = scores.agg(
        F.coalesce(F.max(F.when(F.col("response") > 0, p)), F.max(p)).alias("_hi"),
        F.coalesce(F.min(F.when(F.col("response") < 0, p)), F.min(p)).alias("_lo"),
    )
    share = F.when(F.col("response") > 0, (p - 0.5) / (F.col("_hi") - 0.5)).when(F.col("response") < 0, (p - 0.5) / (F.col("_lo") - 0.5))
    return scores.join(F.broadcast(extremes)).select("seq_id", "response", "sps", share.alias("spp"))


def evaluate(scores: DataFrame) -> DataFrame:
    """accuracy (share of signs that agree) and rmse, over rows with a response."""
    known = scores.where("response IS NOT NULL AND NOT isnan(response)")
    return known.agg(F.avg((F.signum("sps") == F.signum("response")).cast("double")).alias("accuracy"), F.sqrt(F.avg(F.pow(F.col("response") - F.col("sps"), F.lit(2.0)))).alias("rmse"))


def rates(scores: DataFrame, cutoff: float = 0.0) -> DataFrame:
    """tpr, tnr, fpr, fnr with scores from the cutoff on as positive."""
    hit = (F.col("sps") >= cutoff).cast("double")
    pos, neg = F.avg(F.when(F.col("response") > 0, hit)), F.avg(F.when(F.col("response") < 0, hit))
    return scores.agg(pos.alias("tpr"), (1 - neg).alias("tnr"), neg.alias("fpr"), (1 - pos).alias("fnr"))


def roc_points(scores: DataFrame, points: int = 98) -> DataFrame:
    """k, cutoff, tpr, fpr for the cutoffs min + k * span / 100. The scores are counted by the last cutoff that they reach, and the
    counts summed from above, so each row is read once."""
    known = scores.where("response IS NOT NULL AND response <> 0 AND NOT isnan(response)")
    span = scores.agg(F.min("sps").alias("_min"), (F.max("sps") - F.min("sps")).alias("_span"))
    k = F.floor((F.col("sps") - F.col("_min")) * 100 / F.col("_span"))
    cut = F.col("_min") + k * F.col("_span") / 100
    k = F.when(F.col("sps") < cut, k - 1).when(F.col("sps") >= F.col("_min") + (k + 1) * F.col("_span") / 100, k + 1).otherwise(k)
    bins = known.join(F.broadcast(span)).groupBy(F.least(k, F.lit(points)).alias("k")).agg(F.count_if(F.col("response") > 0).alias("_p"), F.count_if(F.col("response") < 0).alias("_n"))
    steps = span.select("_min", "_span", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points).cast("long"))).alias("k"))
    every = steps.select("k", (F.col("_min") + F.col("k") * F.col("_span") / 100).alias("cutoff"))
    filled = every.join(bins, "k", "left").na.fill(0, ["_p", "_n"])  # points + 1 rows
    above, all_rows = Window.orderBy(F.desc("k")), Window.partitionBy()
    return filled.select("k", "cutoff", (F.sum("_p").over(above) / F.sum("_p").over(all_rows)).alias("tpr"), (F.sum("_n").over(above) / F.sum("_n").over(all_rows)).alias("fpr")).where("k > 0")


def median_summary(scores: DataFrame, key: str, value: str) -> DataFrame:
    """key, n, mean and exact median of a score over models."""
    return scores.groupBy(key).agg(F.count(F.lit(1)).alias("n_models"), F.avg(value).alias("mean"), F.median(value).alias("median"))


#: The letters of the statistics that a run can be asked for, their tables and what a summary's rows are keyed by.
STATISTICS = {"P": ("pss", ("gene", "pos")), "G": ("gss", ("gene",)), "H": ("hss", ()), "S": ("sps", ("seq_id",)), "C": ("gsc", ("seq_id", "gene"))}
VALUES = {"gsc": "contribution"}


def summaries(tables: dict[str, DataFrame], letters: str = "PGHSC") -> dict[str, DataFrame]:
    """For each letter the table's n_models, mean and median over the models, as <name>_summary."""
    out = {}
    for letter in letters:
        name, keys = STATISTICS[letter]
        value = VALUES.get(name, name)
        out[f"{name}_summary"] = tables[name].groupBy(*keys).agg(F.count(F.lit(1)).alias("n_models"), F.avg(value).alias("mean"), F.median(value).alias("median"))
    return out


def passing_models(evaluations: DataFrame, rmse_cutoff: float = 100.0, accuracy_cutoff: float = 0.0) -> DataFrame:
    """Models whose rmse is at most and whose accuracy is at least the cutoff."""
    return evaluations.where((F.col("rmse") <= rmse_cutoff) & (F.col("accuracy") >= accuracy_cutoff))


def shares(genes: DataFrame, key: str = "gene", score: str = "gss", bins: int = 1024) -> DataFrame:
    """key, score, the scores before it (largest first) and the total of all. Genes are ranked within ranges of their score, whose sums
    come first, so that no task sorts all of them."""
    top = genes.agg(F.max(score).alias("_max"), F.sum(score).alias("_total"))
    binned = genes.join(F.broadcast(top)).withColumn("_bin", F.floor(F.col(score) / F.col("_max") * bins))
    sums = binned.groupBy("_bin").agg(F.sum(score).alias("_sum"))
    above = sums.select("_bin", (F.sum("_sum").over(Window.orderBy(F.desc("_bin"))) - F.col("_sum")).alias("_above"))
    within = F.sum(score).over(Window.partitionBy("_bin").orderBy(F.desc(score), key))
    running = binned.withColumn("_within", within).join(above, "_bin")
    return running.select(key, score, ((F.col("_above") + F.col("_within")) / F.col("_total")).alias("running_share"), (F.col("_above") + F.col("_within") - F.col(score)).alias("_before"), "_total")


def top_share(genes: DataFrame, share: float, key: str = "gene", score: str = "gss", bins: int = 1024) -> DataFrame:
    """key, score, running share of the genes that together reach `share` of the total, largest first."""
    return shares(genes, key, score, bins).where(F.col("_before") < share * F.col("_total")).select(key, score, "running_share")
