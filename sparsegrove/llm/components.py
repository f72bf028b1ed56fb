"""Connected components of a link table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, for_each_salt, heavy_keys, salted

#: Neighbours of a hub in one task.
HUB = 1 << 16


def components(links: DataFrame, a: str, b: str, scratch: Scratch) -> DataFrame:
    """node, label for every node of the links: the smallest node that it can reach, in a table of scratch.

    Labels spread along the links and jump to their label's label until none moves; each step is a written table, so
    lineage stays short and nothing but one flag comes to the driver. The neighbours of a hub are dealt to several tasks.
    """
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = scratch.write(pairs.union(pairs.select("v", "u")).where("u <> v").distinct(), "neighbours")
    hubs = scratch.write(heavy_keys(both, "v", HUB), "hubs")
    dealt = salted(both, hubs, "v", "u")
    labels = scratch.write(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("l"), F.lit(True).alias("moved")), "labels")
    while not labels.where("moved").isEmpty():
        near = dealt.join(for_each_salt(labels.select(F.col("u").alias("v"), "l"), hubs, "v"), ["v", "_salt"]).groupBy("u").agg(F.min("l").alias("near"))
        spread = labels.join(near, "u").select("u", F.col("l").alias("old"), F.least("l", "near").alias("l"))
        jump = labels.select(F.col("u").alias("l"), F.col("l").alias("next"))
        label = F.least("l", F.coalesce("next", "l"))
        after = scratch.write(spread.join(jump, "l", "left").select("u", label.alias("l"), (label < F.col("old")).alias("moved")), "labels")
        scratch.drop(labels)
        labels = after
    scratch.drop(both, hubs)
    return labels.select(F.col("u").alias("node"), F.col("l").alias("label"))
