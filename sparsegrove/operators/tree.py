"""Trees as tables (node_id, parent_id, name, branch_length, is_leaf) and the hypotheses that their clades make.

A tree's leaves are numbered in the order of a walk around it, children by node_id, so that the leaves below a node are a range of
numbers. The walk goes down and up each edge once; places in it come from pointer doubling along the walk, with as many steps as its
length has binary digits, however deep the tree. Sizes are differences of numbers, and nothing holds a row for a node and each of
its ancestors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Tables, stored

END = -1


def walk(nodes: DataFrame) -> DataFrame:
    """at, next, leaves: the steps down to a node (2 * node) and up from it (2 * node + 1), the step that follows, and 1 for those down to a
    leaf. nodes: node_id, parent_id, is_leaf; a parent that is no node counts as none."""
    known = nodes.select(F.col("node_id").alias("parent_id"), F.lit(True).alias("_known"))
    own = nodes.select("node_id", "parent_id", "is_leaf").join(known, "parent_id", "left").select("node_id", "is_leaf", F.when(F.col("_known"), F.col("parent_id")).alias("parent_id"))
    siblings = Window.partitionBy("parent_id").orderBy("node_id")
    sided = own.withColumn("_next", F.lead("node_id").over(siblings)).withColumn("_first", F.row_number().over(siblings) == 1)
    child = sided.where("_first AND parent_id IS NOT NULL").select(F.col("parent_id").alias("node_id"), F.col("node_id").alias("_child"))
    both = sided.join(child, "node_id", "left")
    down = both.select((2 * F.col("node_id")).alias("at"), F.coalesce(2 * F.col("_child"), 2 * F.col("node_id") + 1).alias("next"), F.col("is_leaf").cast("long").alias("leaves"))
    up = both.select((2 * F.col("node_id") + 1).alias("at"), F.coalesce(2 * F.col("_next"), 2 * F.col("parent_id") + 1, F.lit(END)).alias("next"), F.lit(0).cast("long").alias("leaves"))
    return down.unionByName(up)


def leaf_ranges(nodes: DataFrame) -> DataFrame:
    """node_id, first, end: the numbers of the leaves below each node, from first to before end. node_id: not negative and given once; a
    cycle is an error."""
    tables = Tables(nodes.sparkSession, "walk")
    steps = tables.write(walk(nodes), "steps")
    length, total = steps.agg(F.count(F.lit(1)), F.sum("leaves")).first()
    done = 1
    while done < length:
        far = steps.select(F.col("at").alias("next"), F.col("next").alias("_next"), F.col("leaves").alias("_leaves"))
        new = tables.write(steps.join(far, "next", "left").select("at", F.coalesce("_next", F.lit(END)).alias("next"), (F.col("leaves") + F.coalesce("_leaves", F.lit(0))).alias("leaves")), "steps")
        tables.drop(steps)
        steps, done = new, 2 * done
    if not steps.where(F.col("next") != END).isEmpty():
        raise ValueError("the tree has a cycle")
    node, left = F.floor(F.col("at") / 2), F.lit(total) - F.col("leaves")
    first = F.max(F.when(F.col("at") % 2 == 0, left)).alias("first")
    end = F.max(F.when(F.col("at") % 2 == 1, left)).alias("end")
    ranges = stored(steps.groupBy(node.alias("node_id")).agg(first, end), "ranges")
    tables.drop(steps)
    return ranges


def numbered_leaves(nodes: DataFrame, ranges: DataFrame) -> DataFrame:
    """number, leaf (name) of the leaves."""
    return nodes.where("is_leaf").select("node_id", F.col("name").alias("leaf")).join(ranges, "node_id").select(F.col("first").alias("number"), "leaf")


def named_clades(nodes: DataFrame, ranges: DataFrame) -> DataFrame:
    """clade, first, end of the named internal nodes."""
    named = nodes.where("NOT is_leaf AND name IS NOT NULL AND name <> ''").select("node_id", F.col("name").alias("clade"))
    return named.join(ranges, "node_id").select("clade", "first", "end")


def clade_members(nodes: DataFrame) -> DataFrame:
    """clade (name of an internal node), leaf (name), for all named internal nodes."""
    ranges = leaf_ranges(nodes)
    held = named_clades(nodes, ranges).where("first < end").select("clade", F.explode(F.sequence("first", F.col("end") - 1)).alias("number"))
    return held.join(numbered_leaves(nodes, ranges), "number").select("clade", "leaf")


def clade_sizes(nodes: DataFrame, lower: int = 0, upper: int | None = None) -> DataFrame:
    """clade, n_leaves of the named internal nodes that have leaves, within [lower, upper]."""
    sizes = named_clades(nodes, leaf_ranges(nodes)).groupBy("clade").agg(F.sum(F.col("end") - F.col("first")).alias("n_leaves")).where(F.col("n_leaves") >= max(1, lower))
    return sizes if upper is None else sizes.where(F.col("n_leaves") <= upper)


def first_and_last(ranges: DataFrame, leaves: DataFrame) -> DataFrame:
    """node_id, _a, _z: the first and last leaf name below each node. Names over 2^k numbers come from two halves each; a range is two
    such stretches that may overlap."""
    tables = Tables(ranges.sparkSession, "names")
    level = tables.write(leaves.select("number", F.col("leaf").alias("_a"), F.col("leaf").alias("_z")), "level")
    own = ranges.where("first < end").withColumn("_k", F.floor(F.log2(F.col("end") - F.col("first"))).cast("int"))
    most, k, found = own.agg(F.max("_k")).first()[0], 0, None
    while most is not None and k <= most:
        here = own.where(F.col("_k") == k)
        left = here.join(level.select(F.col("number").alias("first"), "_a", "_z"), "first").select("node_id", "_a", "_z")
        right = here.withColumn("number", F.col("end") - (1 << k)).join(level, "number").select("node_id", "_a", "_z")
        both = tables.write(left.unionByName(right), "found")
        found = both if found is None else found.unionByName(both)
        if k < most:
            far = level.select((F.col("number") - (1 << k)).alias("number"), F.col("_a").alias("_a2"), F.col("_z").alias("_z2"))
            new = tables.write(level.join(far, "number").select("number", F.least("_a", "_a2").alias("_a"), F.greatest("_z", "_z2").alias("_z")), "level")
            tables.drop(level)
            level = new
        k += 1
    if found is None:
        return leaves.select(F.col("number").alias("node_id"), F.col("leaf").alias("_a"), F.col("leaf").alias("_z")).where("false")
    return found.groupBy("node_id").agg(F.min("_a").alias("_a"), F.max("_z").alias("_z"))


def auto_name(nodes: DataFrame, lower: int, upper: int, length: int = 5) -> DataFrame:
    """nodes with the unnamed internal nodes of lower to upper leaves named, by the first characters of their first and last
    leaf in name order and their number of leaves."""
    ranges = leaf_ranges(nodes)
    ends = first_and_last(ranges, numbered_leaves(nodes, ranges)).join(ranges, "node_id").select(F.col("node_id").alias("_node"), "_a", "_z", (F.col("end") - F.col("first")).alias("_n"))
    label = F.concat_ws("_", F.substring("_a", 1, length), F.substring("_z", 1, length), F.col("_n").cast("string"))
    fits = ~F.col("is_leaf") & (F.coalesce("name", F.lit("")) == "") & F.col("_n").between(lower, upper)
    return nodes.join(ends, nodes["node_id"] == ends["_node"], "left").withColumn("name", F.when(fits, label).otherwise(F.col("name"))).drop("_node", "_n", "_a", "_z")


def clade_hypothesis(members: DataFrame, leaves: DataFrame, clade: str) -> DataFrame:
    """seq_id, trait: 1 inside the clade, -1 outside. leaves: leaf."""
    inside = members.where(F.col("clade") == clade).select("leaf").distinct().withColumn("_in", F.lit(True))
    return leaves.select("leaf").distinct().join(inside, "leaf", "left").select(F.col("leaf").alias("seq_id"), F.when(F.col("_in"), 1.0).otherwise(-1.0).alias("trait"))


def all_hypotheses(nodes: DataFrame, clades: list[str]) -> DataFrame:
    """seq_id, traits: for every leaf 1 or -1 for each of the clades, in their order, by its number alone."""
    ranges = leaf_ranges(nodes)
    places = {r["clade"]: (r["first"], r["end"]) for r in named_clades(nodes, ranges).where(F.col("clade").isin(clades)).collect()}
    missing = [c for c in clades if c not in places]
    if missing:
        raise ValueError(f"the tree has no clades {missing[:3]}")
    traits = F.array(*[F.when(F.col("number").between(places[c][0], places[c][1] - 1), 1.0).otherwise(-1.0) for c in clades])
    return numbered_leaves(nodes, ranges).select(F.col("leaf").alias("seq_id"), traits.alias("traits"))


def near_outgroup(nodes: DataFrame, clade: str, level: int = 3) -> DataFrame:
    """seq_id, trait: the clade's leaves as 1 and, as -1, the leaves of the smallest clade around it that has at least as many
    leaves outside it as it has inside. level 1 stops at the first clade around it that has more leaves, 2 at the second, 3 goes on to the
    root."""
    ranges = leaf_ranges(nodes)
    own = nodes.where(F.col("name") == clade).where("NOT is_leaf").select("node_id").join(ranges, "node_id").first()
    if own is None:
        raise ValueError(f"the tree has no clade {clade}")
    size = own["end"] - own["first"]
    around = ranges.where((F.col("first") <= own["first"]) & (F.col("end") >= own["end"])).select("first", "end", (F.col("end") - F.col("first")).alias("_n")).where(F.col("_n") > size).distinct()
    ranked = around.orderBy("_n").limit(level) if level < 3 else around
    enough = ranked.agg(F.min(F.when(F.col("_n") >= 2 * size, F.struct("_n", "first", "end"))), F.max(F.struct("_n", "first", "end"))).first()
    held = enough[0] or enough[1] or own
    inside = F.col("number").between(own["first"], own["end"] - 1)
    return numbered_leaves(nodes, ranges).where(F.col("number").between(held["first"], held["end"] - 1)).select(F.col("leaf").alias("seq_id"), F.when(inside, 1.0).otherwise(-1.0).alias("trait"))
