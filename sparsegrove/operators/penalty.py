"""Penalties as aggregates: the gradient at zero, the largest useful penalties, norms and single proximal steps.

Everything here is a DataFrame plan over a sparse design (feature_id, seq_id, value) and a feature table with groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import shrink_factor, soft_threshold


def start_residual(weights: DataFrame) -> DataFrame:
    """seq_id, b: the logistic gradient's weights at zero, m2 * s for positives and -m1 * s for the rest, where m1 is the
    positives' share of the sample weights s and m2 the rest's. weights: seq_id, trait, weight."""
    share = F.broadcast(weights.agg((F.sum(F.when(F.col("trait") == 1, F.col("weight")).otherwise(F.lit(0.0))) / F.sum("weight")).alias("_m1")))
    return weights.join(share).select("seq_id", F.when(F.col("trait") == 1, (1 - F.col("_m1")) * F.col("weight")).otherwise(-F.col("_m1") * F.col("weight")).alias("b"))


def weighted_sums(x: DataFrame, b: DataFrame) -> DataFrame:
    """feature_id, atb: the sum of value * b over a feature's carriers. Features without carriers have no row."""
    return x.join(b, "seq_id").groupBy("feature_id").agg(F.sum(F.col("value") * F.col("b")).alias("atb"))


def lambda1_max(atb: DataFrame) -> DataFrame:
    """lambda1_max: the site penalty from which on all weights are zero."""
    return atb.agg(F.max(F.abs("atb")).alias("lambda1_max"))


def lambda2_max(atb: DataFrame, members: DataFrame, level) -> DataFrame:
    """lambda2_max: the group penalty from which on all groups are zero, given the site penalty `level` (absolute).
    members: feature_id, group, weight."""
    left = F.greatest(F.abs("atb") - level, F.lit(0.0))
    norms = atb.join(members, "feature_id").groupBy("group", "weight").agg((F.sqrt(F.sum(left * left)) / F.col("weight")).alias("_norm"))
    return norms.agg(F.max("_norm").alias("lambda2_max"))


def prox(v: DataFrame, members: DataFrame, l1, l2) -> DataFrame:
    """feature_id, group, x: the proximal step of the sparse group penalty at v (feature_id, v). Groups must not overlap."""
    soft = v.join(members, "feature_id").withColumn("_u", soft_threshold(F.col("v"), l1))
    norms = soft.groupBy("group").agg(F.sqrt(F.sum(F.col("_u") * F.col("_u"))).alias("_norm"))
    return soft.join(norms, "group").select("feature_id", "group", (F.col("_u") * shrink_factor(F.col("_norm"), l2 * F.col("weight"))).alias("x"))


def tree_norm(x: DataFrame, members: DataFrame, l1, l2) -> DataFrame:
    """penalty: l1 |x|_1 + l2 * sum of w_g |x_g|_2."""
    groups = x.join(members, "feature_id").groupBy("group", "weight").agg(F.sum(F.abs("x")).alias("_l1"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("_l2"))
    return groups.agg((l1 * F.sum("_l1") + l2 * F.sum(F.col("weight") * F.col("_l2"))).alias("penalty"))


def nonzero_groups(x: DataFrame, members: DataFrame) -> DataFrame:
    """nz_groups, nz_features."""
    return x.where("x <> 0").join(members.select("feature_id", "group"), "feature_id").agg(F.count_distinct("group").alias("nz_groups"), F.count_distinct("feature_id").alias("nz_features"))


def second_order_cone(rows: DataFrame) -> DataFrame:
    """id, t, scale: the projection of (u, v) to the cone |x| <= t; x is scale * u. rows: id, u array<double>, v double."""
    norm = F.sqrt(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x))
    inside, below = F.col("_n") <= F.col("v"), F.col("_n") <= -F.col("v")
    mid = (F.col("_n") + F.col("v")) / 2
    return rows.withColumn("_n", norm).select("id", F.when(inside, F.col("v")).when(below, F.lit(0.0)).otherwise(mid).alias("t"), F.when(inside, F.lit(1.0)).when(below, F.lit(0.0)).otherwise(mid / F.col("_n")).alias("scale"))


def l1_ball(vector, radius: float):
    """The nearest array with an absolute sum of at most radius. With the sizes in falling order the threshold is the largest of
    (sum of the first k - radius) / k, and 0 if that is negative."""
    falling = F.sort_array(F.transform(vector, F.abs), asc=False)
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("k"), F.lit(0.0).alias("level"))

    def add(a, x):
        total, k = a["sum"] + x, a["k"] + 1.0
        return F.struct(total.alias("sum"), k.alias("k"), F.greatest(a["level"], (total - radius) / k).alias("level"))

    level = F.aggregate(falling, start, add)["level"]
    return F.transform(vector, lambda x: F.signum(x) * F.greatest(F.abs(x) - level, F.lit(0.0)))


def p_norm(vector, p: float):
    """The p-norm of an array column; p from 1e6 on is the largest absolute value."""
    if p >= 1e6:
        return F.array_max(F.transform(vector, F.abs))
    return F.pow(F.aggregate(vector, F.lit(0.0), lambda a, x: a + F.pow(F.abs(x), F.lit(p))), F.lit(1.0 / p))


def p_prox(vector, level: float, p: float, steps: int = 60, inner: int = 10):
    """argmin of |x - v|^2 / 2 + level * |x|_p for an array column v and p between 1 and infinity, by fixed numbers of steps.

    The point is zero iff the dual norm of v is at most level. Else x solves x + c x^(p-1) = |v| with c = level * |x|_p^(1-p): log c is
    found by halving, from its lower bound at |x|_p = |v|_p on. For p = 1.5, 2 and 3 each coordinate is the root of a linear or quadratic
    equation; for others it is found by Newton from an upper bound, in x for p from 2 on and in x^(p-1) below, where the left side is convex."""
    if not 1 < p < 1e6 or level <= 0:
        raise ValueError("p lies between 1 and 1e6, and the level is positive")
    e, q = p - 1.0, p / (p - 1.0)
    r = F.lit(1.0 / e)
    count = lambda n: F.sequence(F.lit(1), F.lit(n))

    def root(a, c):
        if p == 1.5:
            return F.pow(2 * a / (F.sqrt(c * c + 4 * a) + c), F.lit(2.0))
        if p == 2:
            return a / (1 + c)
        if p == 3:
            return 2 * a / (1 + F.sqrt(1 + 4 * c * a))
        if e >= 1:
            step = lambda x, _: F.greatest(x - (x + c * F.pow(x, F.lit(e)) - a) / (1 + c * e * F.pow(x, F.lit(e - 1))), F.lit(0.0))
            return F.aggregate(count(inner), F.least(a, F.pow(a / c, r)), step)
        step = lambda u, _: F.greatest(u - (F.pow(u, r) + c * u - a) / (c + r * F.pow(u, r - 1)), F.lit(0.0))
        return F.pow(F.aggregate(count(inner), F.least(a / c, F.pow(a, F.lit(e))), step), r)

    once = lambda value, use: F.transform(F.array(value), use)[0]  # noqa: E731  an expression in a lambda is else evaluated wherever it stands
    sizes = F.transform(vector, F.abs)

    def halved(ends, _):
        norm = lambda c: F.pow(F.aggregate(sizes, F.lit(0.0), lambda t, a: t + F.pow(root(a, c), F.lit(p))), F.lit(e / p))
        cut = lambda mid, below: F.struct(F.when(below, mid).otherwise(ends["low"]).alias("low"), F.when(below, ends["high"]).otherwise(mid).alias("high"))
        return once((ends["low"] + ends["high"]) / 2, lambda mid: once(once(F.exp(mid), lambda c: c * norm(c) < level), lambda below: cut(mid, below)))

    low = F.log(F.lit(level)) - e * F.log(p_norm(vector, p))
    ends = F.aggregate(count(steps), F.struct(low.alias("low"), (low + 50).alias("high")), halved)
    found = once(once(ends, lambda b: F.exp((b["low"] + b["high"]) / 2)), lambda c: F.transform(vector, lambda v: F.signum(v) * root(F.abs(v), c)))
    return F.when(p_norm(vector, q) > level, found).otherwise(F.transform(vector, lambda v: v * 0.0))


def loss_slope(fitted: DataFrame, loss: str = "logistic") -> DataFrame:
    """seq_id, b: the slope of the loss in the fitted values. fitted: seq_id, trait, fitted; all samples weigh the same."""
    if loss == "leastr":
        return fitted.select("seq_id", (F.col("fitted") - F.col("trait")).alias("b"))
    y = F.when(F.col("trait") == 1, 1.0).otherwise(-1.0)
    n = F.broadcast(fitted.agg(F.count(F.lit(1)).alias("_n")))
    return fitted.join(n).select("seq_id", (-y / (1 + F.exp(y * F.col("fitted"))) / F.col("_n")).alias("b"))


def optimality(gradient: DataFrame, beta: DataFrame, members: DataFrame, l1, l2) -> DataFrame:
    """group, violation: how far each group is from the conditions of a minimum. gradient: feature_id, atb of the loss; beta: feature_id, beta of
    the weights that are not zero; members: feature_id, group, weight, each feature in one group.

    A group of zeros needs |soft(gradient, l1)| <= l2 * weight. In others, weights need gradient + l1 * sign + l2 * weight * beta / |beta| to be
    zero, and zeros |gradient| <= l1."""
    rows = members.join(gradient, "feature_id", "left").join(beta, "feature_id", "left").na.fill(0.0, ["atb", "beta"])
    left = F.greatest(F.abs("atb") - l1, F.lit(0.0))
    sums = rows.groupBy("group", "weight").agg(F.sqrt(F.sum(F.col("beta") * F.col("beta"))).alias("_norm"), F.sqrt(F.sum(left * left)).alias("_left"))
    each = rows.join(sums.drop("weight"), "group")
    gap = F.abs(F.col("atb") + l1 * F.signum("beta") + l2 * F.col("weight") * F.col("beta") / F.col("_norm"))
    own = F.when(F.col("_norm") == 0, F.greatest(F.col("_left") - l2 * F.col("weight"), F.lit(0.0))).when(F.col("beta") != 0, gap).otherwise(left)
    return each.groupBy("group").agg(F.max(own).alias("violation"))


def warm_start_scale(fitted: DataFrame, penalty, kind: str = "leastr") -> DataFrame:
    """scale: the factor that best scales a start x. fitted: y, ax (A x) a row for each sample; penalty: its penalty term, the
    squared radius for `leastc`, the product of the data for `nonnegative` kinds is cut at 0."""
    dots = fitted.agg(F.sum(F.col("ax") * F.col("y")).alias("_xy"), F.sum(F.col("ax") * F.col("ax")).alias("_xx"))
    if kind == "leastc":
        return dots.select((F.col("_xy") / F.col("_xx")).alias("scale"))
    return dots.select(F.greatest((F.col("_xy") - penalty) / F.col("_xx"), F.lit(0.0)).alias("scale"))
