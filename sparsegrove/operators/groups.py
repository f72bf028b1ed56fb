"""Groups of features: sizes, penalty weights, ranges and the field of overlapping groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gene_groups(features: DataFrame, flat_weights: bool = False) -> DataFrame:
    """gene, size, weight: each gene is a group; its weight is the root of its size, or 1."""
    weight = F.lit(1.0) if flat_weights else F.sqrt(F.count(F.lit(1)))
    return features.groupBy("gene").agg(F.count(F.lit(1)).alias("size"), weight.alias("weight"))


def field(features: DataFrame, groups: DataFrame) -> DataFrame:
    """group_ord, slot (from 1 within the group), feature_id: the features of every group, a gene of several groups in each
    of them. groups: group_ord, gene_ord, gene."""
    inside = Window.partitionBy("group_ord").orderBy("gene_ord", "feature_id")
    return groups.select("group_ord", "gene_ord", "gene").join(features.select("gene", "feature_id"), "gene").select("group_ord", F.row_number().over(inside).alias("slot"), "feature_id")


def group_index(members: DataFrame, flat_weights: bool = False) -> DataFrame:
    """group_ord, start, end (inclusive, in slots of the whole field), weight, from the members (group_ord, ...) of groups."""
    sizes = members.groupBy("group_ord").agg(F.count(F.lit(1)).alias("size"))  # one row a group
    end = F.sum("size").over(Window.orderBy("group_ord"))
    return sizes.select("group_ord", (end - F.col("size") + 1).alias("start"), end.alias("end"), (F.lit(1.0) if flat_weights else F.sqrt("size")).alias("weight"))


def group_weights(index: DataFrame, weights: DataFrame, group_names: DataFrame | None = None) -> DataFrame:
    """index with weights replaced: weights has (group, weight), joined through group_names (group_ord, group), or
    (group_ord, weight). Groups without a given weight keep theirs."""
    given = weights.join(group_names, "group") if "group" in weights.columns else weights
    given = given.select("group_ord", F.col("weight").cast("double").alias("_given"))
    return index.join(given, "group_ord", "left").withColumn("weight", F.coalesce("_given", "weight")).drop("_given")


def overlaps(groups: DataFrame) -> bool:
    """Whether a gene is in more than one group."""
    return not groups.groupBy("gene").agg(F.count_distinct("group_ord").alias("n")).where("n > 1").isEmpty()


def whole_groups(lines: DataFrame, chosen: DataFrame) -> DataFrame:
    """group_ord, gene_ord, gene of the groups in which any gene is chosen, with all their genes. chosen: gene."""
    own = lines.join(chosen.select("gene").distinct(), "gene", "left_semi").select("group_ord").distinct()
    return lines.join(own, "group_ord", "left_semi").select("group_ord", "gene_ord", "gene")
