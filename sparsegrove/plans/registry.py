"""Every query of the engine by name, with the SQL it is held against where SQL can express it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import lambda_label, soft_threshold
from ..operators import balance, encode, fit, grid, groups, penalty, score, screen, tree, view
from ..operators.passes import Model, fit_models
from ..operators.solver import Options
from ..session import shared_folder, stored
from ..sources import text
from . import views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

LEVELS = ("0.1", "0.3", "0.5", "0.7", "0.9")


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def r9(c):
    return F.round(c, 9)


# --- samples, characters, sites -------------------------------------------------------------------------------------


@query("SELECT doc_id AS seq_id, CASE WHEN quality = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS trait FROM labels WHERE quality IS NOT NULL")
def trait_scan(spark, d):
    return views.samples(spark, d)


@query("SELECT doc_id, upper(regexp_replace(text, '[^ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy]', '-', 'g')) AS seq FROM documents WHERE text IS NOT NULL")
def char_normalize(spark, d):
    docs = views.table(spark, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", encode.normalize_sequence(F.col("text"), "protein").alias("seq"))


@query(f"WITH {views.SQL_CELLS} SELECT gene, pos, ch, n FROM counts")
def site_allele_counts(spark, d):
    return encode.allele_counts(views.cells(spark, d))


@query(f"WITH {views.SQL_CELLS} SELECT * FROM sites WHERE alleles >= 2")
def variable_sites(spark, d):
    return encode.variable_sites(encode.allele_counts(views.cells(spark, d)))


@query(f"WITH {views.SQL_CELLS} SELECT * FROM sites WHERE alleles >= 2 AND total - most >= 2")
def singleton_filter(spark, d):
    return encode.without_singletons(encode.variable_sites(encode.allele_counts(views.cells(spark, d))))


@query(f"WITH {views.SQL_CELLS} SELECT gene, pos, ch AS allele, n AS support FROM counts JOIN sites USING (gene, pos) WHERE alleles >= 2 AND total - most >= 3 AND n >= 3")
def bit_count_filter(spark, d):
    return encode.kept_bits(encode.allele_counts(views.cells(spark, d)), encode.EncodeOptions("protein", 3, True))


@query(f"WITH {views.SQL_FEATURES} SELECT feature_id, gene, pos, allele, name, support FROM features")
def feature_dictionary(spark, d):
    return views.features(spark, d).select("feature_id", "gene", "pos", "allele", "name", "support")


@query(f"WITH {views.SQL_FEATURES} SELECT feature_id, seq_id, 1.0::DOUBLE AS value FROM x")
def onehot_coo(spark, d):
    return views.design(spark, d)[0]


@query(f"WITH {views.SQL_FEATURES} SELECT feature_id, count(*) AS carriers, round(1.0 / count(*), 9) AS value FROM x GROUP BY ALL HAVING count(*) >= 3")
def feature_normalize(spark, d):
    x = encode.normalize_columns(views.design(spark, d)[0], 3)
    return x.groupBy("feature_id").agg(F.count(F.lit(1)).alias("carriers"), r9(F.max("value")).alias("value"))


@query(f"WITH {views.SQL_FEATURES}, gaps AS (SELECT gene, pos, count(*) AS g FROM cells WHERE ch = '-' GROUP BY ALL) SELECT feature_id, support + coalesce(g, 0) AS cells, support + 0.5 * coalesce(g, 0)::DOUBLE AS total FROM features LEFT JOIN gaps USING (gene, pos)")
def indel_fuzz(spark, d):
    fuzzy = encode.fuzz_gaps(views.pieces(spark, d), stored(views.features(spark, d), "features"), salts=views.salts(spark, d))
    return fuzzy.groupBy("feature_id").agg(F.count(F.lit(1)).alias("cells"), F.sum("value").alias("total"))


@query(f"WITH {views.SQL_CELLS}, present AS (SELECT DISTINCT gene, seq_id FROM cells), genes AS (SELECT DISTINCT gene FROM present), n AS (SELECT count(*) AS m FROM samples) SELECT gene, m - count(*) AS missing FROM present, n GROUP BY gene, m HAVING m > count(*)")
def missing_sequences(spark, d):
    return encode.missing_counts(views.samples(spark, d), views.pieces(spark, d))


@query(f"WITH {views.SQL_CELLS}, present AS (SELECT DISTINCT gene, seq_id FROM cells), genes AS (SELECT DISTINCT gene FROM present) SELECT g.gene, s.seq_id FROM genes g, samples s ANTI JOIN present p ON p.gene = g.gene AND p.seq_id = s.seq_id")
def missing_log(spark, d):
    """Every gene and the samples that it lacks."""
    return encode.missing_sequences(views.samples(spark, d), views.pieces(spark, d))


@query(f"WITH {views.SQL_FEATURES} SELECT (SELECT count(*) FROM samples) AS samples, (SELECT count(*) FROM features) AS features")
def feature_stats(spark, d):
    return encode.feature_stats(views.samples(spark, d), views.features(spark, d))


SQL_NUMERIC = "v AS (SELECT vec_id AS seq_id, unnest(embedding) AS value, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL), n AS (SELECT 'e' || (p // 8) AS gene, CAST(p % 8 AS INTEGER) AS pos, seq_id, value::DOUBLE AS value FROM v)"


@query(f"WITH {SQL_NUMERIC} SELECT gene, pos, min(value) AS lo, max(value) AS hi FROM n GROUP BY ALL HAVING min(value) < max(value)")
def numeric_variable_columns(spark, d):
    return encode.variable_columns(encode.numeric_cells(views.numeric(spark, d)))


# --- groups ---------------------------------------------------------------------------------------------------------


@query(f"WITH {views.SQL_FEATURES} SELECT gene, size, weight FROM groups")
def group_sizes_weights(spark, d):
    return groups.gene_groups(views.features(spark, d))


SQL_OVERLAP = views.SQL_FEATURES + """,
og AS (SELECT DISTINCT CAST(substr(gene, 2) AS INTEGER) AS group_ord, 0 AS gene_ord, gene FROM features UNION ALL SELECT DISTINCT CAST(substr(gene, 2) AS INTEGER) - 1, 1, gene FROM features WHERE gene <> 'w0'),
field AS (SELECT group_ord, row_number() OVER (PARTITION BY group_ord ORDER BY gene_ord, feature_id) AS slot, feature_id FROM og JOIN features USING (gene))"""


@query(f"WITH {SQL_OVERLAP} SELECT group_ord, slot, feature_id FROM field")
def field_overlap(spark, d):
    found = views.features(spark, d)
    return groups.field(found, views.overlap_groups(found))


@query(f"WITH {SQL_OVERLAP}, s AS (SELECT group_ord, count(*) AS size FROM field GROUP BY ALL) SELECT group_ord, CAST(sum(size) OVER (ORDER BY group_ord) - size + 1 AS BIGINT) AS start, CAST(sum(size) OVER (ORDER BY group_ord) AS BIGINT) AS \"end\", sqrt(size) AS weight FROM s")
def group_index_ranges(spark, d):
    found = views.features(spark, d)
    return groups.group_index(groups.field(found, views.overlap_groups(found)))


# --- balancing ------------------------------------------------------------------------------------------------------

SQL_RANKED = "s AS (SELECT doc_id AS seq_id, CASE WHEN quality = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS trait FROM labels WHERE quality IS NOT NULL), t AS (SELECT sum(trait) AS st, count(*) FILTER (trait > 0) AS np, count(*) FILTER (trait < 0) AS nn FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY trait ORDER BY (seq_id * 2654435761) % 4294967296, seq_id) AS class_rank FROM s)"


@query(f"WITH {SQL_RANKED} SELECT st AS sum_trait, np AS n_pos, nn AS n_neg FROM t")
def class_imbalance(spark, d):
    return balance.imbalance(views.samples(spark, d))


@query(
    f"WITH {SQL_RANKED}, p AS (SELECT CASE WHEN st < 0 THEN 1.0 ELSE -1.0 END AS sign, CASE WHEN st < 0 THEN np ELSE nn END AS n, CAST(ceil(abs(st)) AS BIGINT) AS d FROM t WHERE abs(st) >= 1), "
    "c AS (SELECT sign, i, ((i + 1) * 2654435761 % 4294967296) % n + 1 AS class_rank FROM (SELECT *, unnest(range(d)) AS i FROM p WHERE n > 0)) "
    "SELECT seq_id::VARCHAR AS seq_id, trait, seq_id::VARCHAR AS base_seq_id FROM s UNION ALL "
    "SELECT seq_id || CASE WHEN sign > 0 THEN '_pos_dup' ELSE '_neg_dup' END || (-i), trait, seq_id::VARCHAR FROM c JOIN r ON r.trait = sign AND r.class_rank = c.class_rank"
)
def upsample(spark, d):
    return balance.upsample(views.samples(spark, d))


@query(f"WITH {SQL_RANKED} SELECT seq_id, trait FROM r, t WHERE trait <> sign(st) OR class_rank <= greatest(np, nn) - floor(abs(st))")
def downsample(spark, d):
    return balance.downsample(views.samples(spark, d))


@query(f"WITH {SQL_RANKED} SELECT seq_id, trait, round(CASE WHEN trait = 1 THEN 1.0::DOUBLE / np ELSE 1.0::DOUBLE / nn END / (coalesce(np * (1.0::DOUBLE / nullif(np, 0)), 0) + coalesce(nn * (1.0::DOUBLE / nullif(nn, 0)), 0)), 9) AS weight FROM s, t")
def sample_weights(spark, d):
    return balance.sample_weights(views.samples(spark, d)).withColumn("weight", r9("weight"))


# --- penalties and steps --------------------------------------------------------------------------------------------


def gradient(spark, d, x=None):
    people = views.samples(spark, d)
    weights = people.join(F.broadcast(people.agg((1 / F.count(F.lit(1))).alias("weight"))))
    return penalty.weighted_sums(views.design(spark, d)[0] if x is None else x, penalty.start_residual(weights))


def parts(spark, d):
    """Gradient at zero, its largest size, the genes as groups. The gradient is a table, as each step reads it."""
    x, found = views.design(spark, d)
    atb = stored(gradient(spark, d, x), "gradient")
    return atb, penalty.lambda1_max(atb), views.members(found)


@query(f"WITH {views.SQL_ATB} SELECT feature_id, round(atb, 9) AS atb FROM atb")
def atb_gradient(spark, d):
    return gradient(spark, d).withColumn("atb", r9("atb"))


@query(f"WITH {views.SQL_ATB} SELECT round(l1max, 9) AS lambda1_max FROM top")
def lambda1_max(spark, d):
    return penalty.lambda1_max(gradient(spark, d)).withColumn("lambda1_max", r9("lambda1_max"))


def with_level(atb, top, share=0.1):
    return atb.join(F.broadcast(top)).withColumn("_level", F.col("lambda1_max") * share)


@query(f"WITH {views.SQL_ATB} SELECT round(l2max, 9) AS lambda2_max FROM top2")
def lambda2_max(spark, d):
    atb, top, members = parts(spark, d)
    return penalty.lambda2_max(with_level(atb, top), members, F.col("_level")).withColumn("lambda2_max", r9("lambda2_max"))


@query(f"WITH {views.SQL_ATB} SELECT feature_id, round(sign(atb) * greatest(abs(atb) - 0.1 * l1max, 0), 9) + 0.0 AS x FROM atb, top")
def soft_thresholded(spark, d):
    atb, top, _ = parts(spark, d)
    return with_level(atb, top).select("feature_id", (r9(soft_threshold(F.col("atb"), F.col("_level"))) + 0.0).alias("x"))


def first_step(spark, d, s1=0.1, s2=0.1):
    """The first proximal step from zero with unit step size."""
    atb, top, members = parts(spark, d)
    level = with_level(atb, top, s1)
    most = penalty.lambda2_max(level, members, F.col("_level"))
    v = level.join(F.broadcast(most)).select("feature_id", F.col("atb").alias("v"), "_level", (F.col("lambda2_max") * s2).alias("_l2"))
    return penalty.prox(v, members, F.col("_level"), F.col("_l2")), members


SQL_STEP = views.SQL_ATB + ", u AS (SELECT feature_id, gene, weight, sign(atb) * greatest(abs(atb) - 0.1 * l1max, 0) AS u FROM atb JOIN features USING (feature_id) JOIN groups USING (gene), top), un AS (SELECT gene, sqrt(sum(u * u)) AS norm FROM u GROUP BY gene), x1 AS (SELECT feature_id, u.gene, weight, u * CASE WHEN norm > 0.1 * l2max * weight THEN 1 - 0.1 * l2max * weight / norm ELSE 0 END AS x FROM u JOIN un USING (gene), top2)"


@query(f"WITH {SQL_STEP} SELECT feature_id, gene AS \"group\", round(x, 9) + 0.0 AS x FROM x1")
def fista_first_step(spark, d):
    return first_step(spark, d)[0].select("feature_id", "group", (r9("x") + 0.0).alias("x"))


@query(f"WITH {SQL_STEP} SELECT gene AS \"group\", round(sqrt(sum(x * x)), 9) AS norm FROM x1 GROUP BY gene")
def group_shrink(spark, d):
    return first_step(spark, d)[0].groupBy("group").agg(r9(F.sqrt(F.sum(F.col("x") * F.col("x")))).alias("norm"))


@query(f"WITH {SQL_STEP}, g AS (SELECT gene, weight, sum(abs(x)) AS a, sqrt(sum(x * x)) AS b FROM x1 GROUP BY ALL) SELECT round(0.1 * sum(a) + 0.1 * sum(weight * b), 9) AS penalty FROM g")
def tree_norm(spark, d):
    x, members = first_step(spark, d)
    return penalty.tree_norm(x.select("feature_id", "x"), members, F.lit(0.1), F.lit(0.1)).withColumn("penalty", r9("penalty"))


@query(f"WITH {SQL_STEP} SELECT count(DISTINCT gene) AS nz_groups, count(*) AS nz_features FROM x1 WHERE x <> 0")
def nonzero_groups(spark, d):
    x, members = first_step(spark, d)
    return penalty.nonzero_groups(x.select("feature_id", "x"), members)


SQL_VEC = "v AS (SELECT vec_id AS id, list_transform(embedding, lambda e: e::DOUBLE) AS u FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL)"


def vectors(spark, d):
    return views.table(spark, d, "embeddings").where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda e: e.cast("double")).alias("u"))


@query(f"WITH {SQL_VEC}, n AS (SELECT id, sqrt(list_sum(list_transform(u, lambda e: e * e))) AS n, (id % 7 - 3) / 2.0::DOUBLE AS v FROM v) SELECT id, round(CASE WHEN n <= v THEN v WHEN n <= -v THEN 0 ELSE (n + v) / 2 END, 9) AS t, round(CASE WHEN n <= v THEN 1 WHEN n <= -v THEN 0 ELSE (n + v) / 2 / n END, 9) AS scale FROM n")
def soc_projection(spark, d):
    rows = vectors(spark, d).withColumn("v", (F.pmod("id", F.lit(7)) - 3) / 2.0)
    return penalty.second_order_cone(rows).select("id", r9("t").alias("t"), r9("scale").alias("scale"))


@query(f"WITH {SQL_VEC} SELECT id, round(pow(list_sum(list_transform(u, lambda e: pow(abs(e), 3))), 1.0 / 3), 9) AS norm3, round(list_max(list_transform(u, lambda e: abs(e))), 9) AS norm_max FROM v")
def lp_norm(spark, d):
    return vectors(spark, d).select("id", r9(penalty.p_norm(F.col("u"), 3.0)).alias("norm3"), r9(penalty.p_norm(F.col("u"), 1e6)).alias("norm_max"))


@query(f"WITH {views.SQL_CONTRIB}, f AS (SELECT seq_id, response AS y, sps - 0.125 AS ax FROM sps) SELECT round(greatest((sum(ax * y) - 0.5) / sum(ax * ax), 0), 9) AS scale FROM f")
def init_factor(spark, d):
    made, people = scores_of(spark, d)
    return penalty.warm_start_scale(people.select(F.col("response").alias("y"), (F.col("sps") - 0.125).alias("ax")), F.lit(0.5)).select(r9("scale").alias("scale"))


SQL_BALL = SQL_VEC + ", f AS (SELECT id, u, list_reverse_sort(list_transform(u, lambda e: abs(e))) AS a FROM v), k AS (SELECT id, u, greatest(0, list_max(list_transform(range(1, len(a) + 1), lambda k: (list_sum(a[1:k]) - 0.5) / k))) AS level FROM f)"


@query(f"WITH {SQL_BALL} SELECT id, list_transform(u, lambda e: round(sign(e) * greatest(abs(e) - level, 0), 6) + 0.0) AS x FROM k")
def l1_ball_projection(spark, d):
    return vectors(spark, d).select("id", F.transform(penalty.l1_ball(F.col("u"), 0.5), lambda e: F.round(e, 6) + 0.0).alias("x"))


#: For p = 1.5 a coordinate is a square: x + c sqrt(x) = a.
SQL_PROX = "WITH RECURSIVE " + SQL_VEC + """,
n AS (SELECT id, u, list_transform(u, lambda e: abs(e)) AS a, pow(list_sum(list_transform(u, lambda e: pow(abs(e), 1.5))), 1 / 1.5) AS norm, pow(list_sum(list_transform(u, lambda e: pow(abs(e), 3))), 1 / 3.0) AS dual FROM v),
h AS (SELECT id, a, ln(0.5) - 0.5 * ln(norm) AS low, ln(0.5) - 0.5 * ln(norm) + 50 AS high, 0 AS k FROM n WHERE dual > 0.5
  UNION ALL SELECT id, a, CASE WHEN below THEN mid ELSE low END, CASE WHEN below THEN high ELSE mid END, k + 1
  FROM (SELECT *, (low + high) / 2 AS mid, exp((low + high) / 2) * pow(list_sum(list_transform(a, lambda e: pow(2 * e / (sqrt(exp(low + high) + 4 * e) + exp((low + high) / 2)), 3))), 0.5 / 1.5) < 0.5 AS below FROM h WHERE k < 60)),
c AS (SELECT id, exp((low + high) / 2) AS c FROM h WHERE k = 60)
SELECT n.id, list_transform(u, lambda e: round(CASE WHEN c IS NULL THEN 0 ELSE sign(e) * pow(2 * abs(e) / (sqrt(c * c + 4 * abs(e)) + c), 2) END, 6) + 0.0) AS x FROM n LEFT JOIN c USING (id)"""


@query(SQL_PROX)
def lp_projection(spark, d):
    rows = vectors(spark, d).repartition("id")  # a few rows, each of them much work
    return rows.select("id", F.transform(penalty.p_prox(F.col("u"), 0.5, 1.5), lambda e: F.round(e, 6) + 0.0).alias("x"))


# --- grids ----------------------------------------------------------------------------------------------------------


def grid_frame(spark):
    pairs = grid.penalty_grid(list(LEVELS), list(LEVELS))
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "grid_ord int, l1 string, l2 string")


SQL_GRID = "lv AS (SELECT unnest(['0.1', '0.3', '0.5', '0.7', '0.9']) AS l, unnest(range(5)) AS i), gr AS (SELECT CAST(a.i * 5 + b.i AS INTEGER) AS grid_ord, a.l AS l1, b.l AS l2 FROM lv a, lv b)"


@query(f"WITH {views.SQL_ATB}, {SQL_GRID} SELECT grid_ord, l1, l2, '_' || regexp_replace(l1, '^0\\.', '') || '_' || regexp_replace(l2, '^0\\.', '') AS label, round(l1::DOUBLE * l1max, 9) AS level FROM gr, top")
def lambda_grid(spark, d):
    top = penalty.lambda1_max(gradient(spark, d))
    out = F.broadcast(grid_frame(spark)).join(top)
    return out.select("grid_ord", "l1", "l2", F.concat(lambda_label(F.col("l1")), lambda_label(F.col("l2"))).alias("label"), r9(F.col("l1").cast("double") * F.col("lambda1_max")).alias("level"))


def groups_by_pair(spark, d):
    """nz_groups of the first step for every penalty pair."""
    atb, top, members = parts(spark, d)
    firsts = F.broadcast(grid_frame(spark).select("l1").distinct())
    left = F.greatest(F.abs("atb") - F.col("l1").cast("double") * F.col("lambda1_max"), F.lit(0.0))
    norms = atb.join(members, "feature_id").join(F.broadcast(top)).join(firsts).groupBy("l1", "group", "weight").agg((F.sqrt(F.sum(left * left)) / F.col("weight")).alias("_norm"))
    most = norms.groupBy("l1").agg(F.max("_norm").alias("_most"))
    every = norms.join(F.broadcast(most), "l1").join(F.broadcast(grid_frame(spark)), "l1")
    return every.groupBy("grid_ord", "l1", "l2").agg(F.count_if(F.col("_norm") > F.col("l2").cast("double") * F.col("_most")).alias("nz_groups"))


SQL_PAIRS = f"WITH {views.SQL_ATB}, {SQL_GRID}, nm AS (SELECT l AS l1, gene, sqrt(sum(greatest(abs(atb) - l::DOUBLE * l1max, 0) ** 2)) / weight AS norm FROM atb JOIN features USING (feature_id) JOIN groups USING (gene), top, lv GROUP BY l, gene, weight), mx AS (SELECT l1, max(norm) AS most FROM nm GROUP BY l1)"


@query(f"{SQL_PAIRS} SELECT grid_ord, gr.l1, l2, count(*) FILTER (norm > l2::DOUBLE * most) AS nz_groups FROM gr JOIN nm ON nm.l1 = gr.l1 JOIN mx ON mx.l1 = gr.l1 GROUP BY ALL")
def grid_group_counts(spark, d):
    return groups_by_pair(spark, d)


SQL_SKIP = SQL_PAIRS.replace("WITH", "WITH RECURSIVE", 1) + """,
p AS MATERIALIZED (SELECT grid_ord, l2::DOUBLE AS l2, count(*) FILTER (norm > l2::DOUBLE * most) AS nz FROM gr JOIN nm ON nm.l1 = gr.l1 JOIN mx ON mx.l1 = gr.l1 GROUP BY ALL),
walk AS (
  SELECT -1 AS grid_ord, 1.0::DOUBLE AS least, 1.0::DOUBLE AS lim, false AS ended, false AS fits, false AS below
  UNION ALL
  SELECT p.grid_ord, least(w.least, p.l2), CASE WHEN NOT w.ended AND p.l2 <= w.lim AND p.nz <= 3 AND p.l2 > w.least THEN p.l2 ELSE w.lim END,
    w.ended OR (p.l2 <= w.lim AND p.nz <= 3 AND p.l2 <= w.least), NOT w.ended AND p.l2 <= w.lim, p.nz <= 3
  FROM walk w JOIN p ON p.grid_ord = w.grid_ord + 1)
SELECT grid_ord, below AS below_min_groups FROM walk WHERE fits"""


@query(SQL_SKIP)
def grid_skip_fold(spark, d):
    rows = [(r["grid_ord"], float(r["l1"]), float(r["l2"]), r["nz_groups"]) for r in groups_by_pair(spark, d).collect()]
    return spark.createDataFrame(grid.kept_pairs(rows, 3), "grid_ord int, below_min_groups boolean")


@query("SELECT doc_id AS seq_id, CASE WHEN quality = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS trait, CAST(((doc_id * 2654435761) % 4294967296 // 65536) % 5 + 1 AS INTEGER) AS fold FROM labels WHERE quality IS NOT NULL")
def cv_folds(spark, d):
    return fit.cv_folds(views.samples(spark, d), 5)


# --- models ---------------------------------------------------------------------------------------------------------


def numbered_members(spark, found, overlapping=False):
    """feature_id, group_ord, weight of genes, or of genes with their neighbours."""
    if not overlapping:
        return views.members(found).select("feature_id", F.substring("group", 2, 10).cast("int").alias("group_ord"), "weight")
    field = groups.field(found, views.overlap_groups(found))
    return field.join(groups.group_index(field).select("group_ord", "weight"), "group_ord").select("feature_id", "group_ord", "weight")


def gene_table(found, models):
    names = found.select("feature_id", "gene")
    got = models.where("feature_id IS NOT NULL").join(names, "feature_id").groupBy("grid_ord", "fold", "gene").agg(F.round(F.sum(F.abs("beta")), 6).alias("gss"), F.count(F.lit(1)).alias("n_bits"))
    empty = models.where("feature_id IS NULL").select("grid_ord", "fold", F.lit(None).cast("string").alias("gene"), F.lit(0.0).alias("gss"), F.lit(0).cast("long").alias("n_bits"))
    return got.unionByName(empty)


def fitted(spark, d, pairs, method="logistic", overlapping=False, folds=None, options=Options()):
    x, found = views.design(spark, d)
    return found, fit.fit_grid(spark, x, views.samples(spark, d), numbered_members(spark, found, overlapping), pairs, method, options, folds)


def flagship(spark: SparkSession, d: str, options: Options = Options()) -> DataFrame:
    return gene_table(*fitted(spark, d, [(0.1, 0.1)], options=options))


@query()
def sgl_logistic_fit(spark, d):
    return flagship(spark, d)


@query()
def sgl_leastr_fit(spark, d):
    return gene_table(*fitted(spark, d, [(0.1, 0.1)], "leastr"))


def optimality(spark, d, loss, share, options):
    """gene, optimal: whether the conditions of a minimum hold in each gene, to a millionth of the site penalty, for a fitted model. Its residuals,
    gradient and conditions are computed anew from the tables."""
    x, found = views.design(spark, d)
    x = stored(x, "design")
    people = views.samples(spark, d)
    start = gradient(spark, d, x) if loss == "logistic" else penalty.weighted_sums(x, people.select("seq_id", F.col("trait").alias("b")))
    return conditions(spark, x, found, people, start, loss, share, options)


def conditions(spark, x, found, people, start, loss, share, options):
    members = views.members(found)
    model = stored(fit.fit_grid(spark, x, people, numbered_members(spark, found), [(share, share)], loss, options, table=True), "model")
    start = stored(start, "gradient")
    level = with_level(start, penalty.lambda1_max(start), share)
    most = penalty.lambda2_max(level, members, F.col("_level"))
    levels = penalty.lambda1_max(start).join(most).select((F.col("lambda1_max") * share).alias("l1"), (F.col("lambda2_max") * share).alias("l2"))
    l1, l2 = levels.first()
    beta = model.where("feature_id IS NOT NULL").select("feature_id", "beta")
    sums = x.join(beta, "feature_id").groupBy("seq_id").agg(F.sum(F.col("value") * F.col("beta")).alias("_ax"))
    fitted_ = people.join(sums, "seq_id", "left").join(F.broadcast(model.select("intercept").distinct())).select("seq_id", "trait", (F.coalesce("_ax", F.lit(0.0)) + F.col("intercept")).alias("fitted"))
    slopes = penalty.weighted_sums(x, penalty.loss_slope(fitted_, loss))
    return penalty.optimality(slopes, beta, members, F.lit(l1), F.lit(l2)).select(F.col("group").alias("gene"), (F.col("violation") <= 1e-6 * l1).alias("optimal"))


SQL_OPTIMAL = f"WITH {views.SQL_FEATURES} SELECT gene, true AS optimal FROM groups"


@query(SQL_OPTIMAL)
def sgl_logistic_optimality(spark, d):
    return optimality(spark, d, "logistic", 0.8, Options(iterations=200, stop=4, tolerance=1e-10))


@query(SQL_OPTIMAL)
def sgl_leastr_optimality(spark, d):
    return optimality(spark, d, "leastr", 0.6, Options(iterations=400, stop=4, tolerance=1e-10))


@query(f"WITH {SQL_NUMERIC} SELECT DISTINCT gene, true AS optimal FROM n JOIN embeddings ON vec_id = seq_id WHERE label IS NOT NULL GROUP BY gene, pos HAVING min(value) < max(value)")
def numeric_leastr_optimality(spark, d):
    """Least squares on numbers: the labels of vectors by their components, in groups of eight."""
    numbers, people = views.numeric(spark, d), views.vector_labels(spark, d)
    numbers = numbers.join(people.select("seq_id"), "seq_id", "left_semi")
    found = stored(encode.numeric_features(encode.variable_columns(encode.numeric_cells(numbers)).withColumn("_g", views.gene_number()), F.col("_g")), "features")
    x = stored(encode.numeric_values(numbers, found, "feature_id").select("feature_id", "seq_id", "value"), "design")
    start = penalty.weighted_sums(x, people.select("seq_id", F.col("trait").alias("b")))
    return conditions(spark, x, found, people, start, "leastr", 0.2, Options(iterations=200, stop=4, tolerance=1e-11))


@query()
def ol_sgl_logistic_fit(spark, d):
    return gene_table(*fitted(spark, d, [(0.2, 0.2)], overlapping=True))


@query()
def ol_sgl_leastr_fit(spark, d):
    return gene_table(*fitted(spark, d, [(0.2, 0.2)], "leastr", overlapping=True))


@query()
def gl_logistic_fit(spark, d):
    return gene_table(*fitted(spark, d, [(0.2, 0.0)], "gl_logistic"))


@query()
def sgl_grid_fit(spark, d):
    return gene_table(*fitted(spark, d, [(a, b) for a in (0.2, 0.5, 0.8) for b in (0.2, 0.5, 0.8)]))


@query()
def cv_fit(spark, d):
    """A model for each fold that is left out, and one on all samples (fold 0)."""
    return gene_table(*fitted(spark, d, [(0.3, 0.3)], folds=fit.cv_folds(views.samples(spark, d), 3)))


@query()
def sgl_grid_early_stop(spark, d):
    """The 9 x 9 grid as a sequential search: from a pair with at most three groups on, larger second penalties are left out."""
    x, found = views.design(spark, d)
    pairs = [(a / 10, b / 10) for a in range(1, 10) for b in range(1, 10)]
    models, kept = fit.fit_sequential(spark, x, views.samples(spark, d), numbered_members(spark, found), pairs, 3)
    flags = F.broadcast(spark.createDataFrame(kept, "grid_ord int, below_min_groups boolean"))
    return models.groupBy("grid_ord", "l1", "l2", "nz_groups").agg(F.count("feature_id").alias("n_bits"), F.round(F.sum(F.abs("beta")), 6).alias("hss")).join(flags, "grid_ord")


SQL_PHASES = """WITH c AS (SELECT c_name AS seq_id, CASE WHEN c_acctbal > 4500 THEN 1.0 ELSE -1.0 END AS trait, rpad(c_mktsegment, 10, '-') AS segment, lpad(CAST(abs(CAST(round(c_acctbal * 100) AS BIGINT)) AS VARCHAR), 9, '0') AS balance, lpad(c_custkey::VARCHAR, 9, '0') AS number FROM customer),
g AS (SELECT seq_id, 'segment' AS gene, segment AS seq FROM c UNION ALL SELECT seq_id, 'balance', balance FROM c UNION ALL SELECT seq_id, 'number', number FROM c),
l AS (SELECT gene, seq_id, unnest(string_split(seq, '')) AS ch, generate_subscripts(string_split(seq, ''), 1) AS pos FROM g),
a AS (SELECT gene, pos, ch, count(*) AS n FROM l WHERE ch <> '-' GROUP BY ALL),
f AS (SELECT gene, pos, ch, n FROM a JOIN (SELECT gene, pos FROM a GROUP BY ALL HAVING count(*) >= 2) USING (gene, pos) WHERE n >= 2)
SELECT 'preprocessing' AS phase, 'design' AS "table", CAST(sum(n) AS BIGINT) AS rows FROM f UNION ALL SELECT 'preprocessing', unnest(['features', 'members']), count(*) FROM f UNION ALL SELECT 'analysis', unnest(['sps', 'hss', 'evaluation']), unnest([(SELECT count(*) FROM c), 1, 1])"""


@query(SQL_PHASES)
def phase_rows(spark, d):
    """The rows that the phases of a run over the customers wrote, where they do not depend on the weights."""
    from . import api

    customers = views.table(spark, d, "customer")
    traits = customers.select(F.col("c_name").alias("seq_id"), F.when(F.col("c_acctbal") > 4500, 1.0).otherwise(-1.0).alias("trait"))
    run = api.Training(spark, grid.Settings(bit_count=2, stats="HS", solver_options={"maxIter": "2"})).samples(traits).alignment(views.customer_alignment(spark, d))
    run.analysed(run.fit())
    return run.phases().where("table IN ('design', 'features', 'members', 'sps', 'hss', 'evaluation')").select("phase", "table", "rows")


@query()
def all_clades_fit(spark, d):
    """A model for every named clade of the customers' tree, each a hypothesis of its own over one design."""
    nodes, aligned = views.tree(spark, d), views.customer_alignment(spark, d)
    names = [r[0] for r in tree.clade_sizes(nodes, 2).orderBy("clade").select("clade").collect()]  # named inner nodes: regions and nations
    found = stored(encode.number_features(encode.kept_bits(encode.allele_counts(encode.explode_cells(aligned)), encode.EncodeOptions(bit_count=2))), "features")
    sizes = groups.gene_groups(found).select("gene", F.xxhash64("gene").alias("group_ord"), "weight")
    members = found.select("feature_id", "gene").join(sizes, "gene").select("feature_id", "group_ord", "weight")
    people = tree.all_hypotheses(nodes, names).withColumn("fold", F.lit(0))
    models = [Model(0.1, 0.1, hypothesis=i) for i in range(len(names))]
    fitted_ = fit_models(stored(encode.one_hot(aligned, found), "design"), people, members, models, options=Options(balanced=True))
    clade = F.get(F.array(*[F.lit(n) for n in names]), F.col("hypothesis"))
    return fitted_.join(found.select("feature_id", "gene"), "feature_id", "left").groupBy(clade.alias("clade"), "nz_groups", "gene").agg(F.round(F.sum(F.abs("beta")), 6).alias("gss"), F.count("feature_id").alias("n_bits"))


def screening(spark, d):
    """The design of all genes, and the features that the screening by three parts keeps. Genes come in files of four, which stay whole."""
    x, found = (stored(t, "design") for t in views.design(spark, d))
    members = stored(numbered_members(spark, found), "members")
    sizes = stored(views.pieces(spark, d).groupBy("gene").agg(F.sum(F.octet_length("seq")).alias("bytes")), "sizes")
    kept, scores = screen.screened(spark, x, views.samples(spark, d), found, members, sizes, 3, [(0.2, 0.2), (0.2, 0.5), (0.5, 0.2)], lines=views.gene_lines(found))
    return x, found, members, stored(kept, "screened"), scores


@query()
def screen_genes(spark, d):
    _, _, _, kept, scores = screening(spark, d)
    chosen = kept.select("gene").distinct().withColumn("chosen", F.lit(True))
    return scores.join(chosen, "gene", "full").select("gene", F.round(F.coalesce("gss", F.lit(0.0)), 6).alias("gss"), F.coalesce("chosen", F.lit(False)).alias("chosen"))


@query()
def screen_refit(spark, d):
    """The final model, on the genes that the screening keeps."""
    x, found, members, kept, _ = screening(spark, d)
    own = kept.select("feature_id")
    return gene_table(found, fit.fit_grid(spark, x.join(own, "feature_id", "left_semi"), views.samples(spark, d), members.join(own, "feature_id", "left_semi"), [(0.1, 0.1)]))


# --- scores ---------------------------------------------------------------------------------------------------------


@query(f"WITH {views.SQL_MODEL} SELECT gene, pos, sum(abs(beta)) AS pss FROM model WHERE beta <> 0 GROUP BY ALL")
def pss(spark, d):
    return score.position_scores(views.model(views.features(spark, d)))


@query(f"WITH {views.SQL_MODEL} SELECT gene, sum(abs(beta)) AS gss FROM model WHERE beta <> 0 GROUP BY ALL")
def gss(spark, d):
    return score.gene_scores(views.model(views.features(spark, d)))


@query(f"WITH {views.SQL_MODEL} SELECT sum(abs(beta)) AS hss FROM model")
def hss(spark, d):
    return score.hypothesis_score(gss(spark, d))


def contributions(spark, d):
    return score.contributions(views.pieces(spark, d), views.model(stored(views.features(spark, d), "features")), salts=views.salts(spark, d))


@query(f"WITH {views.SQL_CONTRIB} SELECT seq_id, gene, contribution FROM contrib")
def gsc(spark, d):
    return contributions(spark, d)


@query(f"WITH {views.SQL_CONTRIB} SELECT seq_id, CAST(substr(gene, 2) AS INTEGER) // 4 AS \"group\", sum(contribution) AS contribution FROM contrib GROUP BY ALL")
def group_contributions(spark, d):
    by_gene = contributions(spark, d)
    names = by_gene.select("gene").distinct().select("gene", F.floor(views.gene_number() / 4).cast("int").alias("group"))
    return score.group_contributions(by_gene, names)


def scores_of(spark, d):
    by_gene = contributions(spark, d)
    people = views.samples(spark, d).select("seq_id", F.col("trait").alias("response"))
    return by_gene, score.species_scores(people, by_gene, 0.125)


@query(f"WITH {views.SQL_CONTRIB} SELECT seq_id, response, sps FROM sps")
def sps(spark, d):
    return scores_of(spark, d)[1]


@query(f"WITH {views.SQL_CONTRIB} SELECT avg((sign(sps) = sign(response))::INTEGER)::DOUBLE AS accuracy, round(sqrt(avg((response - sps) ** 2)), 9) AS rmse FROM sps")
def model_eval(spark, d):
    return score.evaluate(sps(spark, d)).withColumn("rmse", r9("rmse"))


@query(f"WITH {views.SQL_CONTRIB}, b AS (SELECT min(sps) AS lo, max(sps) - min(sps) AS span FROM sps), k AS (SELECT unnest(range(1, 99)) AS k) SELECT k, lo + k * span / 100 AS cutoff, count(*) FILTER (response > 0 AND sps >= lo + k * span / 100) / count(*) FILTER (response > 0)::DOUBLE AS tpr, count(*) FILTER (response < 0 AND sps >= lo + k * span / 100) / count(*) FILTER (response < 0)::DOUBLE AS fpr FROM sps, b, k GROUP BY ALL")
def roc_points(spark, d):
    return score.roc_points(sps(spark, d))


@query(f"WITH {views.SQL_CONTRIB}, r AS (SELECT avg((sps >= 0)::INTEGER) FILTER (response > 0) AS p, avg((sps >= 0)::INTEGER) FILTER (response < 0) AS n FROM sps) SELECT round(p, 9) AS tpr, round(1 - n, 9) AS tnr, round(n, 9) AS fpr, round(1 - p, 9) AS fnr FROM r")
def confusion_rates(spark, d):
    return score.rates(sps(spark, d)).select(*[r9(c).alias(c) for c in ("tpr", "tnr", "fpr", "fnr")])


@query(f"WITH {views.SQL_CONTRIB} SELECT gene, count(*) AS n_models, avg(contribution) AS mean, median(contribution) AS median FROM contrib GROUP BY gene")
def median_summary(spark, d):
    return score.median_summary(contributions(spark, d), "gene", "contribution")


@query(f"WITH {views.SQL_MODEL}, g AS (SELECT gene, sum(abs(beta)) AS gss FROM model GROUP BY gene), c AS (SELECT gene, gss, sum(gss) OVER (ORDER BY gss DESC, gene) AS run, sum(gss) OVER () AS total FROM g WHERE gss > 0) SELECT gene, gss, run / total AS running_share FROM c WHERE run - gss < 0.9 * total")
def gss_cumulative_select(spark, d):
    return score.top_share(gss(spark, d), 0.9)


@query(f"WITH {views.SQL_MODEL}, g AS (SELECT gene, sum(abs(beta)) AS gss FROM model GROUP BY gene), c AS (SELECT gene, gss, sum(gss) OVER (ORDER BY gss DESC, gene) AS run, sum(gss) OVER () AS total FROM g WHERE gss > 0), ch AS (SELECT CAST(substr(gene, 2) AS INTEGER) AS n FROM c WHERE run - gss < 0.05 * total), ln AS (SELECT DISTINCT gene, CAST(substr(gene, 2) AS INTEGER) AS n FROM features) SELECT n // 4 AS group_ord, n % 4 AS gene_ord, gene FROM ln WHERE n // 4 IN (SELECT n // 4 FROM ch)")
def whole_file_groups(spark, d):
    found = stored(views.features(spark, d), "features")
    chosen = score.top_share(score.gene_scores(views.model(found)), 0.05)
    return groups.whole_groups(views.gene_lines(found), chosen)


@query(f"WITH {views.SQL_APPLY} SELECT doc_id AS seq_id, CASE WHEN quality = 1 THEN 1.0::DOUBLE WHEN quality IS NOT NULL THEN -1.0::DOUBLE END AS response, coalesce(total, 0) + 0.125 AS sps FROM (SELECT doc_id FROM documents WHERE text <> '') LEFT JOIN labels USING (doc_id) LEFT JOIN applied ON seq_id = doc_id")
def apply_model(spark, d):
    """All documents, labelled or not, scored by the model."""
    from . import api

    found = stored(views.features(spark, d), "features")
    sps, _ = api.predict(views.alignment(spark, d), views.model(found), 0.125, data_type="protein", salts=views.salts(spark, d, "documents"))
    return sps.drop("response").join(views.samples(spark, d).select("seq_id", F.col("trait").alias("response")), "seq_id", "left").select("seq_id", "response", "sps")


@query(f"WITH {views.SQL_CONTRIB}, m AS (SELECT seq_id, gene, contribution, 1 AS k FROM contrib UNION ALL SELECT seq_id, gene, contribution * 2, 2 FROM contrib), h AS (SELECT seq_id, k, sum(contribution) AS sps FROM m GROUP BY ALL) SELECT seq_id, count(*) AS n_models, avg(sps) AS mean, median(sps) AS median FROM h GROUP BY seq_id")
def sps_summary(spark, d):
    """The scores of two models, the second with doubled weights, over the models."""
    one = contributions(spark, d)
    every = one.withColumn("k", F.lit(1)).unionByName(one.withColumn("contribution", F.col("contribution") * 2).withColumn("k", F.lit(2)))
    return score.summaries({"sps": every.groupBy("seq_id", "k").agg(F.sum("contribution").alias("sps"))}, "S")["sps_summary"]


# --- prediction tables ----------------------------------------------------------------------------------------------


def people_of(spark, d):
    long = views.predictions(spark, d)
    totals = long.groupBy("seq_id", "response").agg(F.sum("contribution").alias("sps"))
    return long, score.normalized_probabilities(totals)


@query(f"WITH {views.SQL_PRED} SELECT seq_id, response, sps, round(spp, 7) AS spp FROM spp")
def spp_normalized(spark, d):
    return people_of(spark, d)[1].withColumn("spp", F.round("spp", 7))


@query(f"WITH {views.SQL_PRED} SELECT field, sum(contribution * contribution) AS ssq, sum(contribution) AS total, avg(abs(contribution)) FILTER (response = 1) AS afgsc FROM pred GROUP BY field")
def column_scores(spark, d):
    return view.column_scores(views.predictions(spark, d))


@query("WITH t AS (SELECT hour(ts) % 2 AS table_id, user_id AS seq_id, event_type AS field, sum(CAST(floor(coalesce(value, 0) * 64) AS BIGINT))::DOUBLE / 4096 AS contribution FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL) SELECT seq_id, field, avg(contribution) AS contribution FROM t GROUP BY ALL")
def merge_predictions(spark, d):
    return view.merge_predictions(views.tables_of_predictions(spark, d))


@query(f"WITH {views.SQL_PRED}, c AS (SELECT field, sum(contribution * contribution) AS score FROM pred GROUP BY field) SELECT field, score, CAST(row_number() OVER (ORDER BY score DESC, field) AS INTEGER) AS col_ord FROM c ORDER BY score DESC, field LIMIT 3")
def grid_top_genes(spark, d):
    return view.top_fields(view.column_scores(views.predictions(spark, d)), 3)


@query(f"WITH {views.SQL_PRED}, c AS (SELECT field, avg(abs(contribution)) FILTER (response = 1) AS score FROM pred GROUP BY field), f AS (SELECT field, row_number() OVER (ORDER BY score DESC, field) AS col_ord FROM c ORDER BY score DESC, field LIMIT 4), r AS (SELECT *, row_number() OVER (ORDER BY response DESC, coalesce(spp, 0) * response, seq_id) AS row_ord FROM spp WHERE response > 0.99), q AS (SELECT * FROM r WHERE row_ord <= 20) SELECT CAST(row_ord AS INTEGER) AS row_ord, CAST(col_ord AS INTEGER) AS col_ord, seq_id, field, contribution AS value, false AS missing, round(greatest(spp, 0), 7) AS label, max(abs(contribution)) OVER () AS bound FROM q JOIN pred USING (seq_id) JOIN f USING (field)")
def mgrid_cells(spark, d):
    long, people = people_of(spark, d)
    fields = view.top_fields(view.column_scores(long), 4, "afgsc")
    rows = view.ordered_rows(people, 20, m_grid=True)
    return view.grid_cells(long, rows, fields).withColumn("label", F.round("label", 7))


@query(f"WITH {views.SQL_PRED}, c AS (SELECT field, sum(contribution * contribution) AS score FROM pred GROUP BY field), f AS (SELECT field, row_number() OVER (ORDER BY score DESC, field) AS col_ord FROM c ORDER BY score DESC, field LIMIT 3), q AS (SELECT *, row_number() OVER (ORDER BY response DESC, coalesce(spp, 0) * response DESC, seq_id) AS row_ord FROM spp), t AS (SELECT * FROM q WHERE row_ord <= 40) SELECT CAST(row_ord AS INTEGER) AS row_ord, CAST(col_ord AS INTEGER) AS col_ord, seq_id, field, contribution AS value, false AS missing, round(greatest(coalesce(spp, 0), 0), 7) AS label, max(abs(contribution)) OVER () AS bound FROM t JOIN pred USING (seq_id) JOIN f USING (field)")
def contribution_grid(spark, d):
    long, people = people_of(spark, d)
    cells = view.grid_cells(long, view.ordered_rows(people, 40), view.top_fields(view.column_scores(long), 3))
    return cells.withColumn("label", F.round("label", 7))


# --- trees ----------------------------------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {views.SQL_TREE} SELECT clade, leaf FROM members")
def clade_members(spark, d):
    return tree.clade_members(views.tree(spark, d))


@query(f"WITH RECURSIVE {views.SQL_TREE} SELECT clade, count(*) AS n_leaves FROM members GROUP BY clade HAVING count(*) >= 5")
def clade_sizes(spark, d):
    return tree.clade_sizes(views.tree(spark, d), 5)


@query(f"WITH RECURSIVE {views.SQL_TREE}, s AS (SELECT ancestor_id, count(*) AS n, min(l.name) AS a, max(l.name) AS z FROM up JOIN nodes l ON l.node_id = up.node_id WHERE l.is_leaf GROUP BY ancestor_id) SELECT nodes.node_id, CASE WHEN NOT is_leaf AND n >= 1 THEN substr(a, 1, 12) || '_' || substr(z, 1, 12) || '_' || n ELSE name END AS name FROM nodes LEFT JOIN s ON s.ancestor_id = nodes.node_id")
def auto_named_clades(spark, d):
    bare = views.tree(spark, d).withColumn("name", F.when(F.col("is_leaf"), F.col("name")))
    return tree.auto_name(bare, 1, 1 << 40, 12).select("node_id", "name")


@query(f"WITH RECURSIVE {views.SQL_TREE}, c AS (SELECT clade, count(*) AS n FROM members GROUP BY clade ORDER BY n DESC, clade LIMIT 1) SELECT c_name AS seq_id, CASE WHEN c_name IN (SELECT leaf FROM members WHERE clade = (SELECT clade FROM c)) THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS trait FROM (SELECT DISTINCT c_name FROM customer)")
def clade_hypothesis(spark, d):
    members = tree.clade_members(views.tree(spark, d))
    largest = tree.clade_sizes(views.tree(spark, d)).orderBy(F.desc("n_leaves"), "clade").first()["clade"]
    return tree.clade_hypothesis(members, views.table(spark, d, "customer").select(F.col("c_name").alias("leaf")), largest)


SQL_PHYLO = """WITH n AS (SELECT k, (SELECT count(*) FROM customer WHERE c_nationkey >= k) AS n FROM (SELECT n_nationkey AS k FROM nation)), held AS (%s)
SELECT c_name AS seq_id, CASE WHEN c_nationkey >= 20 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS trait FROM customer WHERE c_nationkey >= (SELECT k FROM held)"""


@query(SQL_PHYLO % "SELECT coalesce(max(k) FILTER (n >= 2 * (SELECT n FROM n WHERE k = 20)), 0) AS k FROM n WHERE k < 20")
def phylo_sample(spark, d):
    """As many steps of the ladder around step 20 as it takes for as many leaves outside as inside."""
    return tree.near_outgroup(views.ladder(spark, d), "step20", 3)


@query(SQL_PHYLO % "SELECT 19 AS k")
def phylo_sample_1(spark, d):
    """Only the next step around it."""
    return tree.near_outgroup(views.ladder(spark, d), "step20", 1)


@query(SQL_PHYLO % "SELECT 18 AS k")
def phylo_sample_2(spark, d):
    """Up to the second step around it."""
    return tree.near_outgroup(views.ladder(spark, d), "step20", 2)


# --- files ----------------------------------------------------------------------------------------------------------


def file(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT doc_id::VARCHAR AS seq_id, CASE WHEN quality = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS trait FROM labels WHERE quality IS NOT NULL")
def trait_file(spark, d):
    path = file(spark, "traits")
    views.samples(spark, d).select(F.concat_ws("\t", F.col("seq_id").cast("string"), F.col("trait").cast("string"))).write.text(path)
    return text.read_traits(spark, path)


@query("SELECT vec_id::VARCHAR AS seq_id, list_transform(embedding, lambda x: x::DOUBLE) AS vals FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0")
def numeric_file(spark, d):
    path = file(spark, "numbers")
    rows = views.table(spark, d, "embeddings").where("vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0")
    rows.select(F.concat_ws("\t", F.col("vec_id").cast("string"), F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), "\t"))).write.text(path)
    return text.read_numeric(spark, path).select("seq_id", "vals")


@query(f"WITH {views.SQL_MODEL} SELECT gene, pos, allele, beta FROM model WHERE beta <> 0 UNION ALL SELECT NULL, NULL, 'Intercept', 0.125")
def model_file(spark, d):
    path = file(spark, "model")
    text.write_model(views.model(views.features(spark, d)), 0.125, path)
    bits, intercept = text.read_model(spark, path)
    last = spark.createDataFrame([(None, None, "Intercept", intercept)], "gene string, pos int, allele string, beta double")
    return bits.select("gene", "pos", "allele", "beta").unionByName(last)


@query(f"WITH {views.SQL_MODEL} SELECT name AS feature, beta, 0.1::DOUBLE AS lambda1, 0.2::DOUBLE AS lambda2, 0.125::DOUBLE AS intercept FROM model")
def model_xml_file(spark, d):
    path = file(spark, "xml")
    text.write_model_xml(views.model(views.features(spark, d)), 0.1, 0.2, 0.125, path)
    return spark.read.format("xml").option("rowTag", "weight").schema("feature string, beta double, lambda1 double, lambda2 double, intercept double").load(path)


@query(f"WITH {views.SQL_PRED}, fields AS (SELECT DISTINCT field FROM pred) SELECT s.seq_id::VARCHAR AS seq_id, s.response, s.sps AS prediction, 0.5::DOUBLE AS intercept, f.field, coalesce(p.contribution, 0) AS contribution FROM people s CROSS JOIN fields f LEFT JOIN pred p ON p.seq_id = s.seq_id AND p.field = f.field")
def prediction_file(spark, d):
    path = file(spark, "predictions")
    long, people = people_of(spark, d)
    fields = [r[0] for r in long.select("field").distinct().orderBy("field").collect()]  # the event types: a handful
    text.write_predictions(people.select("seq_id", "response", "sps"), long.withColumnRenamed("field", "group"), 0.5, fields, path)
    return text.read_predictions(spark, path)


@query(f"WITH {views.SQL_FEATURES} SELECT feature_id::VARCHAR AS feature_id, name FROM features")
def feature_map_file(spark, d):
    path = file(spark, "map")
    text.write_feature_map(views.features(spark, d), path)
    return spark.read.option("sep", "\t").schema("feature_id string, name string").csv(path)


@query(f"WITH {views.SQL_PRED} SELECT seq_id::VARCHAR AS seq_id, response, sps, round(spp, 7) AS spp FROM spp")
def scores_file(spark, d):
    path = file(spark, "scores")
    text.write_scores(people_of(spark, d)[1], path)
    rows = spark.read.option("sep", "\t").option("nullValue", "nan").schema("seq_id string, response double, sps double, spp double").csv(path)
    return rows.withColumn("spp", F.round("spp", 7))


@query("SELECT doc_id::VARCHAR AS seq_id, upper(regexp_replace(text, '[^ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy]', '-', 'g')) AS seq FROM documents WHERE doc_id IS NOT NULL AND text <> ''")
def fasta_file(spark, d):
    """All documents as records of one alignment, in lines of 60 characters, cut into records again by the blocks of its files."""
    path = file(spark, "fasta")
    docs = views.table(spark, d, "documents").where("doc_id IS NOT NULL AND text <> ''")
    text.write_fasta(docs.select(F.lit("texts").alias("gene"), F.col("doc_id").alias("seq_id"), encode.normalize_sequence(F.col("text"), "protein").alias("seq")), path)
    return text.read_fasta(spark, path, "protein").where("gene = 'texts'").select("seq_id", "seq")


@query(f"WITH {SQL_OVERLAP}, s AS (SELECT group_ord, count(*) AS size FROM field GROUP BY ALL) SELECT CAST(row_number() OVER (ORDER BY group_ord) - 1 AS INTEGER) AS group_ord, CAST(sum(size) OVER (ORDER BY group_ord) - size + 1 AS BIGINT) AS start, CAST(sum(size) OVER (ORDER BY group_ord) AS BIGINT) AS \"end\", sqrt(size) AS weight FROM s")
def group_index_file(spark, d):
    """The groups in three long lines; a group is known by its place in them."""
    path, found = file(spark, "groups"), views.features(spark, d)
    text.write_group_index(groups.group_index(groups.field(found, views.overlap_groups(found))), path)
    return text.read_group_index(spark, path)


@query(f"WITH {SQL_OVERLAP} SELECT row_number() OVER (ORDER BY group_ord, slot) AS at, feature_id FROM field")
def field_file(spark, d):
    """The features of all groups in one long line."""
    path, found = file(spark, "field"), views.features(spark, d)
    text.write_field(groups.field(found, views.overlap_groups(found)), path)
    return text.read_field(spark, path)


@query(f"WITH {SQL_NUMERIC}, f AS (SELECT gene, pos, row_number() OVER (ORDER BY CAST(substr(gene, 2) AS INTEGER), pos) AS feature_id FROM n GROUP BY gene, pos HAVING min(value) < max(value)), o AS (SELECT vec_id AS seq_id, row_number() OVER (ORDER BY vec_id) - 1 AS ord FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL) SELECT feature_id, ord, value FROM n JOIN f USING (gene, pos) JOIN o USING (seq_id) WHERE value <> 0")
def design_file(spark, d):
    """The design of the vectors as a dense table, a row a vector."""
    path, numbers = file(spark, "design"), views.numeric(spark, d)
    found = stored(encode.numeric_features(encode.variable_columns(encode.numeric_cells(numbers)).withColumn("_g", views.gene_number()), F.col("_g")), "features")
    people = views.numbered(numbers.select("seq_id").distinct(), "seq_id")
    text.write_design(encode.numeric_values(numbers, found, "feature_id"), people, found.count(), path, 24)
    return text.read_design(spark, path)


@query(f"WITH {views.SQL_CELLS}, present AS (SELECT DISTINCT gene, seq_id FROM cells), genes AS (SELECT DISTINCT gene FROM present) SELECT g.gene, s.seq_id::VARCHAR AS seq_id FROM genes g, samples s ANTI JOIN present p ON p.gene = g.gene AND p.seq_id = s.seq_id")
def missing_file(spark, d):
    path = file(spark, "missing")
    text.write_missing(missing_log(spark, d), path)
    return spark.read.option("sep", "\t").schema("gene string, seq_id string").csv(path)


@query("SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS ord, CASE WHEN quality = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS trait FROM labels WHERE quality IS NOT NULL")
def response_file(spark, d):
    """A trait a line, in the order of the samples."""
    path = file(spark, "response")
    text.write_response(views.numbered(views.samples(spark, d), "seq_id"), path)
    return text.in_order(spark.read.text(path)).select(F.col("number").alias("ord"), F.col("value").cast("double").alias("trait"))


@query(f"WITH {SQL_RANKED}, p AS (SELECT CASE WHEN st < 0 THEN 1.0 ELSE -1.0 END AS sign, CASE WHEN st < 0 THEN np ELSE nn END AS n, CAST(ceil(abs(st)) AS BIGINT) AS d FROM t WHERE abs(st) >= 1), c AS (SELECT sign, i, ((i + 1) * 2654435761 % 4294967296) % n + 1 AS class_rank FROM (SELECT *, unnest(range(d)) AS i FROM p WHERE n > 0)) SELECT seq_id::VARCHAR AS seq_id, trait FROM s UNION ALL SELECT seq_id || CASE WHEN sign > 0 THEN '_pos_dup' ELSE '_neg_dup' END || (-i), trait FROM c JOIN r ON r.trait = sign AND r.class_rank = c.class_rank")
def hypothesis_file(spark, d):
    """Ids and traits after upsampling."""
    path = file(spark, "hypothesis")
    text.write_hypothesis(upsample(spark, d), path)
    return text.read_traits(spark, path)


@query(f"WITH {views.SQL_FEATURES} SELECT gene, size, CAST(substr(gene, 2) AS INTEGER) % 7 + 0.5::DOUBLE AS weight FROM groups")
def group_weights_file(spark, d):
    """Penalty weights of groups from a file of names and weights."""
    path, sizes = file(spark, "weights"), groups.gene_groups(views.features(spark, d))
    index = sizes.select(views.gene_number().alias("group_ord"), "gene", "size", "weight")
    given = (F.pmod("group_ord", F.lit(7)) + F.lit(0.5)).cast("string")
    index.select(F.concat_ws("\t", "gene", given).alias("line")).write.text(path)
    names = index.select("group_ord", F.col("gene").alias("group"))
    return groups.group_weights(index, text.read_group_weights(spark, path), names).select("gene", "size", "weight")


@query("WITH t AS (SELECT hour(ts) % 2 AS table_id, user_id AS seq_id, event_type AS field, sum(CAST(floor(coalesce(value, 0) * 64) AS BIGINT))::DOUBLE / 4096 AS contribution FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL), m AS (SELECT seq_id, field, avg(contribution) AS contribution FROM t GROUP BY ALL), s AS (SELECT seq_id, sum(contribution) AS prediction FROM m GROUP BY ALL), f AS (SELECT DISTINCT field FROM m) SELECT s.seq_id::VARCHAR AS seq_id, CASE WHEN s.seq_id % 3 = 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS response, round(prediction, 9) AS prediction, f.field, coalesce(m.contribution, 0) AS contribution FROM s CROSS JOIN f LEFT JOIN m ON m.seq_id = s.seq_id AND m.field = f.field")
def merged_file(spark, d):
    """The merged prediction table, written wide and read again."""
    path = file(spark, "merged")
    merged = view.merge_predictions(views.tables_of_predictions(spark, d))
    fields = [r[0] for r in merged.select("field").distinct().orderBy("field").collect()]  # the event types: a handful
    people = merged.groupBy("seq_id").agg(F.sum("contribution").alias("sps")).withColumn("response", views.response())
    text.write_predictions(people, merged.withColumnRenamed("field", "group"), 0.0, fields, path)
    return text.read_predictions(spark, path).select("seq_id", "response", r9("prediction").alias("prediction"), "field", "contribution")


@query(f"WITH {views.SQL_MODEL} SELECT 'gss' AS stat, gene AS name, sum(abs(beta)) AS value FROM model WHERE beta <> 0 GROUP BY gene UNION ALL SELECT 'pss', gene || '_' || pos, sum(abs(beta)) FROM model WHERE beta <> 0 GROUP BY gene, pos UNION ALL SELECT 'hss', '', sum(abs(beta)) FROM model")
def stats_files(spark, d):
    """The scores of positions, genes and the hypothesis as files of their own."""
    path = file(spark, "stats")
    model = views.model(stored(views.features(spark, d), "features"))
    per_site = score.position_scores(model)
    tables = {"pss": per_site, "gss": score.gene_scores(model), "hss": score.hypothesis_score(score.gene_scores(model))}
    text.write_statistics(tables, path)
    return text.read_statistics(spark, path)


@query(f"WITH {views.SQL_APPLY} SELECT doc_id AS seq_id, CASE WHEN quality = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS response, coalesce(total, 0) + 0.125 AS sps FROM (SELECT doc_id FROM documents WHERE text <> '') JOIN labels USING (doc_id) LEFT JOIN applied ON seq_id = doc_id WHERE quality IS NOT NULL")
def apply_response(spark, d):
    """The model applied with a response file: only its sequences stay."""
    from . import api

    path = file(spark, "responses")
    views.samples(spark, d).select(F.concat_ws("\t", F.col("seq_id").cast("string"), F.col("trait").cast("string"))).write.text(path)
    found = stored(views.features(spark, d), "features")
    response = text.read_traits(spark, path, response=True).withColumn("seq_id", F.col("seq_id").cast("long"))
    return api.predict(views.alignment(spark, d), views.model(found), 0.125, response=response, data_type="protein", salts=views.salts(spark, d, "documents"))[0].select("seq_id", "response", "sps")
