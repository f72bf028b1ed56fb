"""Worked examples of single operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsegrove.functions.columns import lambda_label, name_parts, normalize_sequence
from sparsegrove.operators import balance, encode, grid, groups, penalty, prox, score, tree, view
from sparsegrove.operators.grid import Settings


def cells(spark, *columns):
    """One gene; each text is a site's characters by sample."""
    rows = [("g", p, s, c) for p, site in enumerate(columns) for s, c in enumerate(site)]
    return spark.createDataFrame(rows, "gene string, pos int, seq_id int, ch string")


def bits(spark, site, **options):
    made = cells(spark, site)
    return {(r["allele"], r["support"]) for r in encode.kept_bits(encode.allele_counts(made), encode.EncodeOptions(**options)).collect()}


def test_site_filters(spark):
    assert bits(spark, "AAACC-", drop_singletons=True) == {("A", 3), ("C", 2)}
    assert bits(spark, "AAAAAC", drop_singletons=True) == set()
    assert bits(spark, "AAAAAC", bit_count=2) == {("A", 5)}
    assert bits(spark, "AA--A", bit_count=1) == set()


def test_gap_fuzz_and_normalisation(spark):
    made = cells(spark, "AC-")
    found = encode.number_features(encode.kept_bits(encode.allele_counts(made)))
    aligned = spark.createDataFrame([("g", i, c) for i, c in enumerate("AC-")], "gene string, seq_id int, seq string")
    values = {(r["feature_id"], r["seq_id"]): r["value"] for r in encode.fuzz_gaps(aligned, found).collect()}
    assert values == {(1, 0): 1.0, (1, 2): 0.5, (2, 1): 1.0, (2, 2): 0.5}
    sums = encode.normalize_columns(encode.fuzz_gaps(aligned, found, salts=3)).groupBy("feature_id").agg(F.sum("value").alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-12 for r in sums)


def test_characters(spark):
    df = spark.createDataFrame([("acGTn?-u",)], "s string")
    assert df.select(normalize_sequence(F.col("s"), "nucleotide")).first()[0] == "ACGT---U"
    assert df.select(normalize_sequence(F.col("s"), "anything")).first()[0] == "acGTn--u"
    labels = spark.createDataFrame([("0.1",), ("0.25",), ("1.0",)], "l string").select(lambda_label(F.col("l"))).collect()
    assert [r[0] for r in labels] == ["_1", "_25", "_1.0"]
    gene, pos, allele = name_parts(F.lit("a_b_12_-"))
    assert spark.range(1).select(gene, pos, allele).first()[:] == ("a_b", 12, "-")


def test_overlapping_groups(spark):
    found = spark.createDataFrame([(i, "a" if i < 4 else "b") for i in range(1, 6)], "feature_id long, gene string")
    lines = spark.createDataFrame([(0, 0, "a"), (0, 1, "b"), (1, 0, "b")], "group_ord int, gene_ord int, gene string")
    members = groups.field(found, lines)
    assert [r["feature_id"] for r in members.orderBy("group_ord", "slot").collect()] == [1, 2, 3, 4, 5, 4, 5]
    index = [(r["start"], r["end"], r["weight"]) for r in groups.group_index(members).orderBy("group_ord").collect()]
    assert index == [(1, 5, 5**0.5), (6, 7, 2**0.5)] and groups.overlaps(lines)
    named = groups.group_weights(groups.group_index(members), spark.createDataFrame([("x", 9.0)], "group string, weight double"), spark.createDataFrame([(1, "x")], "group_ord int, group string"))
    assert {(r["group_ord"], r["weight"]) for r in named.collect()} == {(0, 5**0.5), (1, 9.0)}


def test_balancing(spark):
    people = spark.createDataFrame([(i, 1.0 if i < 2 else -1.0) for i in range(7)], "seq_id long, trait double")
    up = balance.upsample(people).collect()
    clones = sorted(r["seq_id"].split("_pos_dup")[1] for r in up if "_pos_dup" in r["seq_id"])
    assert len(up) == 10 and clones == ["-1", "-2", "0"] and sum(r["trait"] for r in up) == 0
    assert all(int(r["base_seq_id"]) < 2 for r in up if "dup" in r["seq_id"])
    down = balance.downsample(people).collect()
    assert len(down) == 4 and sum(r["trait"] for r in down) == 0
    four = people.where("seq_id < 6")
    weights = {r["seq_id"]: r["weight"] for r in balance.sample_weights(four, 2.0, 1.0).collect()}
    assert weights[0] == pytest.approx(2 / 8) and weights[5] == pytest.approx(1 / 8)
    assert sum(r["weight"] for r in balance.sample_weights(people).collect()) == pytest.approx(1)


def test_skip_rule():
    rows = [(1, 0.1, 0.1, 10), (2, 0.1, 0.2, 3), (3, 0.1, 0.3, 0), (4, 0.2, 0.1, 5), (5, 0.2, 0.2, 2), (6, 0.2, 0.3, 0), (7, 0.3, 0.1, 3), (8, 0.3, 0.2, 9)]
    assert grid.kept_pairs(rows, 3) == [(1, False), (2, True), (4, False), (5, True), (7, True)]


def test_settings():
    assert len(grid.preset(True).grid()) == 81 and grid.preset(True).grid()[-1] == ("0.9", "0.9")
    assert Settings(l1_grid=("0.1", "0.9", "0.1"), l2_grid=("0.1", "0.9", "0.1")).grid()[-1] == ("0.9", "0.9")
    assert Settings(l1="0.3", group_penalty=False).grid() == [("0.3", "0")]
    with pytest.raises(ValueError):
        Settings(l1_grid=("0", "1", "0.1")).grid()
    with pytest.raises(ValueError):
        grid.penalty_range("0", "1", "0")


def test_projections():
    v = np.array([3.0, -1.0, 0.5])
    one = np.zeros(3, int)
    assert prox.sparse_group(v, one, np.array([1.0]), 1.0, 0.5).tolist() == [1.5, 0, 0]
    assert np.allclose(prox.p_prox(np.array([3.0, 4.0]), 1.0, 2), [2.4, 3.2])
    for v0, want in ((1, (1.8, 2.4, 3)), (6, (3, 4, 6)), (-6, (0, 0, 0))):
        x, t = prox.second_order_cone(np.array([3.0, 4.0]), v0)
        assert np.allclose([*x, t], want)
    rng = np.random.default_rng(1)
    for p in (1.2, 1.7, 2.5, 6):
        v = rng.normal(0, 1, 20)
        x = prox.p_prox(v, 0.7, p)
        n = (np.abs(x) ** p).sum() ** (1 / p)
        assert np.abs(x - v + 0.7 * np.sign(x) * np.abs(x) ** (p - 1) * n ** (1 - p)).max() < 1e-9
    v = rng.normal(0, 1, 20)
    assert np.abs(prox.p_prox(v, 0.7, 1e6) - prox.p_prox(v, 0.7, 200)).max() < 0.02
    assert np.abs(prox.l1_ball(v, 3.0)).sum() == pytest.approx(3)
    assert not prox.p_prox(v, 100.0, 3).any()
    with pytest.raises(ValueError):
        prox.p_prox(v, -1.0, 2)


def test_overlapping_step_with_disjoint_groups_is_the_plain_one():
    rng = np.random.default_rng(2)
    v, group, weight = rng.normal(0, 1, 30), np.repeat(np.arange(5), 6), np.sqrt(np.full(5, 6.0))
    a = prox.sparse_group(v, group, weight, 0.2, 0.3)
    b = prox.sparse_overlapping(v, np.arange(30), group, weight, 0.2, 0.3, 500, 1e-10)
    assert np.abs(a - b).max() < 1e-6


def test_overlapping_step_is_the_minimum():
    rng = np.random.default_rng(3)
    v = rng.normal(0, 1, 10)
    slot, group = np.array([0, 1, 2, 3, 4, 5, 3, 4, 5, 6, 7, 8, 9]), np.array([0] * 6 + [1] * 7)
    weight = np.array([1.0, 1.5])
    value = lambda x: 0.5 * ((x - v) ** 2).sum() + 0.1 * np.abs(x).sum() + 0.4 * sum(w * np.linalg.norm(x[slot[group == g]]) for g, w in enumerate(weight))
    x = prox.sparse_overlapping(v, slot, group, weight, 0.1, 0.4, 2000, 1e-12)
    assert all(value(x) <= value(x + e) + 1e-9 for e in rng.normal(0, 0.01, (300, 10)))


def test_scores(spark):
    model = spark.createDataFrame([("g", 0, "A", 0.5), ("g", 2, "C", -0.2)], "gene string, pos int, allele string, beta double")
    alignment = spark.createDataFrame([("g", "s", "ATC"), ("g", "t", "AAA")], "gene string, seq_id string, seq string")
    got = {r["seq_id"]: r["contribution"] for r in score.contributions(alignment, model, "universal").collect()}
    assert got == {"s": pytest.approx(0.3), "t": pytest.approx(0.5)}
    with pytest.raises(ValueError):
        score.check_genes(model, spark.createDataFrame([("h",)], "gene string"))
    people = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 0.5), ("c", -1.0, -1.0), ("d", 0.0, 1.0), ("e", None, 1.0)], "seq_id string, response double, sps double")
    spp = {r["seq_id"]: r["spp"] for r in score.normalized_probabilities(people).collect()}
    assert spp["a"] == pytest.approx(1) and spp["b"] == pytest.approx(0.3216, abs=1e-4) and spp["c"] == pytest.approx(1) and spp["d"] is None and spp["e"] is None
    e = score.evaluate(people.where("response <> 0")).first()
    assert e["accuracy"] == 1.0
    assert score.passing_models(spark.createDataFrame([(1, 0.5, 0.9), (2, 200.0, 0.9)], "m int, rmse double, accuracy double")).count() == 1


def test_views(spark):
    nan = float("nan")
    long = spark.createDataFrame([("a", 1.0, "g", 3.0), ("b", -1.0, "g", nan), ("a", 1.0, "h", -1.0), ("b", -1.0, "h", None)], "seq_id string, response double, field string, contribution double")
    scores = {r["field"]: r for r in view.column_scores(long).collect()}
    assert scores["g"]["ssq"] == 9 and scores["h"]["afgsc"] == 1 and np.isnan(scores["g"]["total"])
    merged = view.merge_predictions(spark.createDataFrame([(1, "a", "g", 1.0), (2, "a", "g", 3.0), (1, "a", "h", 5.0)], "table_id int, seq_id string, field string, contribution double"))
    assert {(r["field"], r["contribution"]) for r in merged.collect()} == {("g", 2.0), ("h", 5.0)}
    with pytest.raises(ValueError):
        view.check_same_rows(spark.createDataFrame([(1, "a"), (2, "a"), (1, "b")], "table_id int, seq_id string"))
    rows = spark.createDataFrame([("a", 1.0, 2.0, 0.9), ("b", 1.0, 1.0, 0.2), ("c", -1.0, 0.0, 0.5)], "seq_id string, response double, sps double, spp double")
    assert [r["seq_id"] for r in view.ordered_rows(rows, 9).orderBy("row_ord").collect()] == ["a", "b", "c"]
    assert [r["seq_id"] for r in view.ordered_rows(rows, 9, m_grid=True).orderBy("row_ord").collect()] == ["b", "a"]
    cells_ = view.grid_cells(long, view.ordered_rows(rows, 9), view.top_fields(view.column_scores(long), 1)).collect()
    assert {(r["seq_id"], r["value"], r["missing"]) for r in cells_} == {("a", 3.0, False), ("b", None, True)}


def test_trees(spark):
    nodes = spark.createDataFrame([(0, None, None, False), (1, 0, "x", False), (2, 0, "l3", True), (3, 1, "l1", True), (4, 1, None, False), (5, 4, "l2", True), (6, 4, "l4", True)], "node_id long, parent_id long, name string, is_leaf boolean")
    assert {(r["clade"], r["leaf"]) for r in tree.clade_members(nodes).collect()} == {("x", "l1"), ("x", "l2"), ("x", "l4")}
    assert {r["name"] for r in tree.auto_name(nodes, 2, 3, 2).where("NOT is_leaf").collect()} == {None, "x", "l2_l4_2"}
    hypothesis = tree.clade_hypothesis(tree.clade_members(nodes), nodes.where("is_leaf").select(F.col("name").alias("leaf")), "x")
    assert {(r["seq_id"], r["trait"]) for r in hypothesis.collect()} == {("l1", 1), ("l2", 1), ("l4", 1), ("l3", -1)}
    near = tree.near_outgroup(nodes.withColumn("name", F.when(F.col("node_id") == 4, "y").otherwise(F.col("name"))), "y", 1)
    assert {(r["seq_id"], r["trait"]) for r in near.collect()} == {("l2", 1), ("l4", 1), ("l1", -1)}
    assert tree.clade_sizes(nodes, 0, 2).count() == 0 and [tuple(r) for r in tree.clade_sizes(nodes).collect()] == [("x", 3)]


def test_top_share(spark):
    genes = spark.createDataFrame([("a", 5.0), ("b", 3.0), ("c", 1.0), ("d", 1.0)], "gene string, gss double")
    assert {r["gene"] for r in score.top_share(genes, 0.8).collect()} == {"a", "b"}
    assert score.top_share(genes, 1.0).count() == 4


def test_roc(spark):
    rng = np.random.default_rng(5)
    rows = [(i, 1.0 if rng.random() < 0.5 else -1.0, float(rng.normal())) for i in range(200)]
    people = spark.createDataFrame(rows, "seq_id int, response double, sps double")
    y, s = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    for r in score.roc_points(people).collect():
        assert r["tpr"] == pytest.approx((s[y > 0] >= r["cutoff"]).mean()) and r["fpr"] == pytest.approx((s[y < 0] >= r["cutoff"]).mean())


def test_hits_are_those_of_a_join(spark):
    """Against cells joined one by one; sites without bits, characters of several bytes, short sequences and salts."""
    rng = np.random.default_rng(6)
    rows = [(g, i, "".join(rng.choice(list("ACG-é漢?"), rng.integers(0, 9)))) for g in ("g", "h", "none") for i in range(40)] + [("g", 99, None)]
    aligned = spark.createDataFrame(rows, "gene string, seq_id int, seq string")
    cells = encode.explode_cells(aligned)
    found = encode.number_features(encode.kept_bits(encode.allele_counts(cells.where("gene <> 'none' AND pos NOT IN (1, 4)"))))
    want = {(r["gene"], r["seq_id"], r["pos"], r["feature_id"]) for r in cells.join(found.withColumnRenamed("allele", "ch"), ["gene", "pos", "ch"]).collect()}
    for salts in (1, 4):
        got = encode.hits(aligned, found, "feature_id", "universal", salts).collect()
        assert {(r["gene"], r["seq_id"], r["pos"], r["feature_id"]) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("width", [1, 3, 7, 10_000])
def test_hits_of_long_genes_in_windows(spark, width):
    rows = [("g", "a", "ACGTACGTACGTACGTACGT"), ("g", "b", "ACG"), ("g", "c", ""), ("g", "d", "\U0001f600CG\U0001f600ACGTC\u00e9"), ("h", "a", "TTT"), ("h", "n", None)]
    aligned = spark.createDataFrame(rows, "gene string, seq_id string, seq string")
    known = [("g", p, c, 10 * p + i) for p in (0, 2, 3, 8, 9, 17) for i, c in enumerate("ACGT\u00e9")] + [("h", 2, "T", 999)]
    marked = spark.createDataFrame(known, "gene string, pos int, allele string, id int")
    want = {(r["gene"], r["seq_id"], r["pos"], r["id"]) for r in encode.explode_cells(aligned).join(marked.withColumnRenamed("allele", "ch"), ["gene", "pos", "ch"]).collect()}
    found = encode.hits(aligned, marked, "id", salts=2, width=width).collect()
    assert {(r["gene"], r["seq_id"], r["pos"], r["id"]) for r in found} == want and len(found) == len(want) > 8


def test_pieces_of_whole_texts(spark):
    texts = spark.createDataFrame([(1, "abcdefg\nhié漢"), (2, ""), (3, None)], "seq_id int, text string")
    got = sorted((r["gene"], r["seq_id"], r["seq"]) for r in encode.pieces(texts, 4).collect())
    assert got == [("w0", 1, "abcd"), ("w1", 1, "efg\n"), ("w2", 1, "hié漢")]


def test_missing_sequences(spark):
    people = spark.createDataFrame([(i,) for i in range(50)], "seq_id int")
    aligned = spark.createDataFrame([("g", i, "A") for i in range(50)] + [("h", i, "A") for i in range(0, 50, 3)] + [("i", 99, "A")], "gene string, seq_id int, seq string")
    want = {("h", i) for i in range(50) if i % 3} | {("i", i) for i in range(50)}
    for together in (7, 1024):
        assert {(r["gene"], r["seq_id"]) for r in encode.missing_sequences(people, aligned, together).collect()} == want
    assert {(r["gene"], r["missing"]) for r in encode.missing_counts(people, aligned).collect()} == {("h", 33), ("i", 50)}


def test_files_of_chosen_genes_stay_whole(spark):
    lines = spark.createDataFrame([(0, 0, "a"), (0, 1, "b"), (1, 0, "c"), (2, 0, "b"), (2, 1, "d")], "group_ord int, gene_ord int, gene string")
    chosen = spark.createDataFrame([("b",), ("x",)], "gene string")
    assert sorted((r["group_ord"], r["gene"]) for r in groups.whole_groups(lines, chosen).collect()) == [(0, "a"), (0, "b"), (2, "b"), (2, "d")]


def test_selected_genes_fit_their_share(spark):
    from sparsegrove.operators.screen import selected_genes

    scores = spark.createDataFrame([(f"g{i}", float(2**-i)) for i in range(8)] + [("zero", 0.0)], "gene string, gss double")
    sizes = spark.createDataFrame([(f"g{i}", 10 + i) for i in range(8)] + [("zero", 500)], "gene string, bytes long")
    chosen = {r["gene"] for r in selected_genes(scores, sizes, 20).collect()}
    assert chosen == {"g0", "g1"}  # 608 / 20 bytes
    assert {r["gene"] for r in selected_genes(scores, sizes, 2).collect()} == {f"g{i}" for i in range(8)}


def test_l1_ball_column(spark):
    from sparsegrove.operators import penalty

    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(0, 1, 9).round(2).tolist()) for i in range(30)] + [(98, [0.1, -0.1]), (99, [])]
    got = spark.createDataFrame(rows, "id int, u array<double>").select("id", penalty.l1_ball(F.col("u"), 0.5).alias("x")).collect()
    for r in got:
        assert np.allclose(r["x"], prox.l1_ball(np.array(dict(rows)[r["id"]]), 0.5))


def test_upsampling_by_many_clones(spark):
    people = spark.createDataFrame([(0, 1.0)], "seq_id long, trait double").unionByName(spark.range(1, 70_002).select(F.col("id").alias("seq_id"), F.lit(-1.0).alias("trait")))
    up = balance.upsample(people)
    assert up.count() == 140_002 and up.where("base_seq_id = '0'").select("seq_id").distinct().count() == 70_001


def test_cycles_in_trees(spark):
    nodes = spark.createDataFrame([(1, 2, "a", True), (2, 1, "b", False)], "node_id long, parent_id long, name string, is_leaf boolean")
    with pytest.raises(ValueError):
        tree.leaf_ranges(nodes)


def test_a_deep_ladder(spark):
    """Step k holds leaf k and step k + 1: as deep as it has leaves."""
    n = 5_000
    steps = spark.range(n).select((2 * F.col("id")).alias("node_id"), F.when(F.col("id") > 0, 2 * F.col("id") - 2).alias("parent_id"), F.when(F.col("id") % 1000 == 0, F.concat(F.lit("s"), F.col("id").cast("string"))).alias("name"), F.lit(False).alias("is_leaf"))
    leaves = spark.range(n).select((2 * F.col("id") + 1).alias("node_id"), (2 * F.col("id")).alias("parent_id"), F.concat(F.lit("l"), F.col("id").cast("string")).alias("name"), F.lit(True).alias("is_leaf"))
    ladder = steps.unionByName(leaves)
    assert {r["clade"]: r["n_leaves"] for r in tree.clade_sizes(ladder).collect()} == {f"s{k}": n - k for k in range(0, n, 1000)}
    near = tree.near_outgroup(ladder, f"s{n - 1000}", 3).groupBy("trait").count().collect()
    assert {r["trait"]: r["count"] for r in near} == {1.0: 1000, -1.0: 1000}
    assert tree.near_outgroup(ladder, f"s{n - 1000}", 2).count() == 1002


def test_random_trees(spark):
    rng = np.random.default_rng(1)
    for size in (1, 60):
        parent = [None] + [int(rng.integers(max(0, i - 6), i)) for i in range(1, size)]
        inner = set(parent)
        nodes = spark.createDataFrame([(i, p, f"n{i}", i not in inner) for i, p in enumerate(parent)], "node_id long, parent_id long, name string, is_leaf boolean")
        want = set()
        for i in range(size):
            at = parent[i]
            while i not in inner and at is not None:
                want.add((f"n{at}", f"n{i}"))
                at = parent[at]
        assert {(r["clade"], r["leaf"]) for r in tree.clade_members(nodes).collect()} == want
        named = {r["node_id"]: r["name"] for r in tree.auto_name(nodes.withColumn("name", F.when(F.col("is_leaf"), F.col("name"))), 1, 1000, 9).where("NOT is_leaf").collect()}
        for i in inner - {None}:
            below = sorted(b for a, b in want if a == f"n{i}")
            assert named[i] == f"{below[0]}_{below[-1]}_{len(below)}"
        chosen = [f"n{i}" for i in sorted(inner - {None})[:3]]
        for r in tree.all_hypotheses(nodes, chosen).collect():
            assert r["traits"] == [1.0 if (c, r["seq_id"]) in want else -1.0 for c in chosen]


def test_p_prox_column(spark):
    from sparsegrove.operators import penalty

    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(0, 1, 7).tolist()) for i in range(12)] + [(50, [0.1, -0.1, 0.0]), (51, [3.0, 0.0, -1e-9]), (52, [])]
    for p in (1.2, 1.5, 2.0, 3.5):
        for r in spark.createDataFrame(rows, "id int, u array<double>").select("id", penalty.p_prox(F.col("u"), 0.7, p).alias("x")).collect():
            assert np.allclose(r["x"], prox.p_prox(np.array(dict(rows)[r["id"]]), 0.7, p), atol=1e-9), (p, r["id"])


def test_genes_dealt_by_bytes(spark):
    from sparsegrove.operators.screen import dealt, parts_needed

    sizes = spark.createDataFrame([(f"g{i}", 100 + i) for i in range(301)], "gene string, bytes long")
    held = [r[1] for r in dealt(sizes, 7).join(sizes, "gene").groupBy("part").agg(F.sum("bytes")).collect()]
    assert len(held) == 7 and max(held) - min(held) <= 400 and max(held) <= 1.05 * min(held)
    assert parts_needed(10, 10, 1 << 20) == 1 and parts_needed(1 << 20, 0, 1 << 22) == 4


def test_p_prox_evaluates_each_norm_once(spark):
    """A step of the halving has one norm, and for p = 1.5 no inner iteration."""
    plan = spark.createDataFrame([(1, [3.0, -4.0])], "id int, u array<double>").select(penalty.p_prox(F.col("u"), 0.7, 1.5).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.split("AS x")[0].count("aggregate(") <= 5  # the dual norm, the halving, where it starts (two ends), its norm


def test_missing_log_is_compressed(spark, tmp_path):
    from sparsegrove.sources import text

    rows = [(f"w{g}", f"s{i}") for g in range(20) for i in range(300)]
    text.write_missing(spark.createDataFrame(rows, "gene string, seq_id string"), str(tmp_path / "m"))
    assert sum(p.stat().st_size for p in (tmp_path / "m").glob("part-*")) < sum(len(g) + len(s) + 2 for g, s in rows) / 3
    assert sorted(tuple(r) for r in spark.read.option("sep", "\t").csv(str(tmp_path / "m")).collect()) == sorted(rows)


def test_a_gene_meets_the_applied_model_in_several_groups(spark, monkeypatch):
    from sparsegrove.plans import registry, views

    want = {name: set(registry.QUERIES[name](spark, "/root/testdata/sf0.001").collect()) for name in ("apply_model", "apply_response")}
    used, once = [], score.contributions
    monkeypatch.setattr(views, "TOGETHER", 60)
    monkeypatch.setattr(score, "contributions", lambda a, m, t=None, salts=1: (used.append(salts), once(a, m, t, salts))[1])
    assert {name: set(registry.QUERIES[name](spark, "/root/testdata/sf0.001").collect()) for name in want} == want
    assert len(used) == 2 and min(used) > 1


def test_genes_are_ranked_once_for_all_shares(spark, monkeypatch):
    """However often the share is lowered, scores and sizes are read a fixed number of times; genes without a size weigh nothing."""
    from sparsegrove.operators import screen

    ranked, shares = [], score.shares
    monkeypatch.setattr(screen, "shares", lambda genes: (ranked.append(1), shares(genes))[1])
    scores = spark.createDataFrame([(f"g{i}", float(2**-i)) for i in range(16)], "gene string, gss double")
    sizes = spark.createDataFrame([(f"g{i}", 10) for i in range(15)], "gene string, bytes long")
    assert {r["gene"] for r in screen.selected_genes(scores, sizes, 15).collect()} == {"g0"}
    assert {r["gene"] for r in screen.selected_genes(scores, sizes, 40).collect()} == {"g0"}  # the last share that is tried
    assert len(ranked) == 2
