"""Class balancing: clones, down-sampling and sample weights. Choices are by a hash of the id and a seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import shared_hash

KINDS = {"none": "none", "up": "up", "down": "down", "weight": "weighted", "weighted": "weighted", "phylo": "phylo", "phylo_1": "phylo_1", "phylo_2": "phylo_2"}


def imbalance(samples: DataFrame) -> DataFrame:
    """sum_trait, n_pos, n_neg."""
    return samples.agg(F.sum("trait").alias("sum_trait"), F.count_if(F.col("trait") > 0).alias("n_pos"), F.count_if(F.col("trait") < 0).alias("n_neg"))


def ranked(samples: DataFrame, seed: int) -> DataFrame:
    """samples with the sign of their class and their place in it by hash. The places come from counts of hash ranges, so
    that no task sorts a whole class."""
    hashed = samples.withColumn("_sign", F.signum("trait")).withColumn("_hash", shared_hash(F.col("seq_id"), seed)).withColumn("_range", F.floor(F.col("_hash") / 16777216))
    counts = hashed.groupBy("_sign", "_range").agg(F.count(F.lit(1)).alias("_n"))  # at most 256 a class
    before = counts.select("_sign", "_range", (F.sum("_n").over(Window.partitionBy("_sign").orderBy("_range")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_sign", "_range").orderBy("_hash", "seq_id"))
    return hashed.withColumn("_place", place).join(before, ["_sign", "_range"]).withColumn("class_rank", F.col("_before") + F.col("_place")).drop("_hash", "_range", "_place", "_before")


def upsample(samples: DataFrame, seed: int = 0) -> DataFrame:
    """samples (seq_id, trait) and clones of the smaller class until both are alike: seq_id string, trait, base_seq_id.

    Clone i of d is of the member whose place is hash(i) mod n; its id is the member's with `_pos_dup` or `_neg_dup` and
    0, -1, -2, ... and its trait 1 or -1. Nothing is added when the sum of traits is within 1 of 0 or a class is empty."""
    totals = imbalance(samples)
    small = F.when(F.col("sum_trait") <= -1, F.lit(1.0)).when(F.col("sum_trait") >= 1, F.lit(-1.0))
    size = F.when(F.col("sum_trait") <= -1, F.col("n_pos")).otherwise(F.col("n_neg"))
    plan = totals.select(small.alias("_sign"), size.alias("_n"), F.ceil(F.abs("sum_trait")).cast("long").alias("_d")).where("_sign IS NOT NULL AND _n > 0")
    step = 1 << 16  # clones of one row are numbered in ranges, which are dealt out
    starts = plan.select("_sign", "_n", "_d", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_d") - 1, F.lit(step).cast("long"))).alias("_from")).repartition("_from")
    picks = starts.select("_sign", "_n", F.explode(F.sequence("_from", F.least(F.col("_from") + step, F.col("_d")) - 1)).alias("_i")).select("_sign", "_i", (F.pmod(shared_hash(F.col("_i"), seed + 1), F.col("_n")) + 1).alias("class_rank"))
    tag = F.when(F.col("_sign") > 0, F.lit("_pos_dup")).otherwise(F.lit("_neg_dup"))
    own = F.col("seq_id").cast("string")
    clones = ranked(samples, seed).join(picks, ["_sign", "class_rank"]).select(F.concat(own, tag, (-F.col("_i")).cast("string")).alias("seq_id"), F.col("_sign").alias("trait"), own.alias("base_seq_id"))
    return samples.select(own.alias("seq_id"), "trait", own.alias("base_seq_id")).unionByName(clones)


def downsample(samples: DataFrame, seed: int = 0) -> DataFrame:
    """samples without the |sum of traits| members of the larger class that come last by hash."""
    totals = imbalance(samples).select(F.signum("sum_trait").alias("_large"), F.floor(F.abs("sum_trait")).alias("_d"), F.greatest("n_pos", "n_neg").alias("_size"))
    keep = (F.col("_sign") != F.col("_large")) | (F.col("class_rank") <= F.col("_size") - F.col("_d"))
    return ranked(samples, seed).join(F.broadcast(totals)).where(keep).select("seq_id", "trait")


def sample_weights(samples: DataFrame, w_pos: float | None = None, w_neg: float | None = None) -> DataFrame:
    """seq_id, trait, weight: w_pos / (n_pos w_pos + n_neg w_neg) for positives, likewise for the rest; inverse class sizes by
    default."""
    totals = F.broadcast(imbalance(samples).drop("sum_trait"))
    both = samples.join(totals)
    pos = F.lit(w_pos) if w_pos is not None else 1 / F.col("n_pos")
    neg = F.lit(w_neg) if w_neg is not None else 1 / F.col("n_neg")
    total = F.coalesce(F.col("n_pos") * pos, F.lit(0.0)) + F.coalesce(F.col("n_neg") * neg, F.lit(0.0))
    return both.select("seq_id", "trait", (F.when(F.col("trait") == 1, pos).otherwise(neg) / total).alias("weight"))
