"""Files in and out, and a training run from them."""

import pytest
from pyspark.sql import functions as F

from sparsegrove.operators.grid import Settings
from sparsegrove.plans.api import Training, contribution_grid, predict
from sparsegrove.sources import text
from sparsegrove.streaming.apply import score_stream


FEW = {"maxIter": "2"}


def put(folder, name, content):
    path = folder / name
    path.write_text(content)
    return str(path)


def test_traits(spark, tmp_path):
    path = put(tmp_path, "t.txt", "a\t1\n\n b \t-1\r\nc\t0\nd\t0.5\n")
    assert {(r["seq_id"], r["trait"]) for r in text.read_traits(spark, path).collect()} == {("a", 1.0), ("b", -1.0), ("d", 0.5)}
    response = {r["seq_id"]: r["trait"] for r in text.read_traits(spark, put(tmp_path, "r.txt", "a\nb\t1\n"), response=True).collect()}
    assert response == {"a": None, "b": 1.0}
    with pytest.raises(ValueError):
        text.read_traits(spark, put(tmp_path, "d.txt", "a\t1\na\t-1\n"))


def test_fasta_and_lists(spark, tmp_path):
    one = put(tmp_path, "g_1.fasta", ">s one\nac\nGT\n>s2\nAC?n\n>none\n>s2\nTTTT\n")
    two = put(tmp_path, "g2.fas", ">s2\nA\n")
    rows = {(r["gene"], r["seq_id"], r["seq"]) for r in text.read_fasta(spark, [one, two], "nucleotide").collect()}
    assert rows == {("g_1", "s one", "ACGT"), ("g_1", "s2", "TTTT"), ("g2", "s2", "A")}
    only = spark.createDataFrame([("s2",)], "seq_id string")
    assert text.read_fasta(spark, [one], samples=only).count() == 1
    text.check_lengths(text.read_fasta(spark, [one, two]))
    with pytest.raises(ValueError):
        text.check_lengths(text.read_fasta(spark, put(tmp_path, "bad.fasta", ">a\nAC\n>b\nA\n")))
    lines = text.read_alignment_list(spark, put(tmp_path, "list.txt", f"{one}\n\n{one},{two}\n"))
    assert {(r["group_ord"], r["gene_ord"], r["gene"]) for r in lines.collect()} == {(0, 0, "g_1"), (1, 0, "g_1"), (1, 1, "g2")}
    assert {r["gene"]: r["bytes"] for r in text.alignment_bytes(spark, [two]).collect()} == {"g2": 6}


@pytest.fixture
def small_blocks(spark):
    """f(bytes): files are read in blocks of so many bytes."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    yield lambda n: [spark.conf.set(k, f"{n}b") for k in keys]
    for k, v in before.items():
        spark.conf.set(k, v)


def plain_fasta(content):
    out = {}
    for record in ("\n" + content).replace("\r", "").split("\n>")[1:]:
        name, _, body = record.partition("\n")
        if name.strip() and "".join(body.split()):
            out[name.strip()] = "".join(body.split())
    return out


@pytest.mark.parametrize("block", [1, 2, 3, 7, 16, 50, 1000])
def test_fasta_records_over_blocks(spark, tmp_path, small_blocks, block):
    content = ">a\nAC\nGT\n>long one\n" + "ACGT\n" * 9 + ">empty\n>\nAA\n>b\r\nC\r\nG\r\n\n>a\nTT\n>last\nG"
    path = put(tmp_path, "g.fa", content)
    small_blocks(block)
    found = text.read_fasta(spark, path)
    assert {r["seq_id"]: r["seq"] for r in found.collect()} == plain_fasta(content)
    assert spark.read.option("lineSep", "\n>").text(path).rdd.getNumPartitions() == -(-len(content) // block)


def test_fasta_written_and_read(spark, tmp_path, small_blocks):
    rows = [(g, f"s{i}", ("ACGT" * 50)[i : i + 20 * i + 1]) for i in range(9) for g in ("one", "a b/c=d", "x_1")]
    text.write_fasta(spark.createDataFrame(rows, "gene string, seq_id string, seq string"), str(tmp_path / "f"), 7)
    small_blocks(40)
    assert {tuple(r) for r in text.read_fasta(spark, str(tmp_path / "f")).collect()} == set(rows)
    text.write_fasta(spark.createDataFrame([], "gene string, seq_id string, seq string"), str(tmp_path / "none"))
    assert text.read_fasta(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("block", [3, 20, 100000])
def test_long_lines_and_dense_tables(spark, tmp_path, small_blocks, block):
    index = [(i, 3 * i + 1, 3 * i + 3, i + 0.5) for i in range(40)]
    text.write_group_index(spark.createDataFrame(index, "group_ord int, start long, end long, weight double").repartition(5), str(tmp_path / "i"))
    members = [(g, slot, 100 * g + slot) for g in range(6) for slot in range(1, 5)]
    text.write_field(spark.createDataFrame(members, "group_ord int, slot int, feature_id long").repartition(3), str(tmp_path / "f"))
    cells = [(f, f"s{i}", f + i / 8) for f in range(1, 12) for i in range(7) if (f * i) % 3 == 1]
    people = spark.createDataFrame([(f"s{i}", i) for i in range(7)], "seq_id string, ord long")
    text.write_design(spark.createDataFrame(cells, "feature_id long, seq_id string, value double"), people, 11, str(tmp_path / "d"), 4)
    whole = b"".join(p.read_bytes() for p in sorted((tmp_path / "d").glob("part-*"))).decode().split("\n")
    held = {(f, int(s[1:])): v for f, s, v in cells}
    assert [[float(v) for v in line.rstrip(",").split(",")] for line in whole] == [[held.get((f, i), 0.0) for f in range(1, 12)] for i in range(7)]
    small_blocks(block)
    assert [tuple(r) for r in text.read_group_index(spark, str(tmp_path / "i")).collect()] == index
    assert [r["feature_id"] for r in text.read_field(spark, str(tmp_path / "f")).orderBy("at").collect()] == [m[2] for m in members]
    with pytest.raises(ValueError):
        text.read_field(spark, str(tmp_path / "i"))
    one = put(tmp_path, "d.csv", "\n".join(whole))
    assert {(r["feature_id"], r["ord"]): r["value"] for r in text.read_design(spark, one).collect()} == held


def test_dense_tables_of_many_parts(spark, tmp_path, small_blocks):
    """Parts that are read as they lie, with rows of several records."""
    cells = [(f, f"s{i}", float(100 * i + f)) for f in range(1, 12) for i in range(60) if (f * i) % 3 == 1]
    people = spark.createDataFrame([(f"s{i}", i) for i in range(60)], "seq_id string, ord long")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # no parts are put together
    text.write_design(spark.createDataFrame(cells, "feature_id long, seq_id string, value double"), people, 11, str(tmp_path / "d"), 2)
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert len([p for p in (tmp_path / "d").glob("part-*") if p.stat().st_size]) > 2
    for block in (50, 100000):
        small_blocks(block)
        assert {(r["feature_id"], f"s{r['ord']}", r["value"]) for r in text.read_design(spark, str(tmp_path / "d")).collect()} == set(cells)


def test_numeric_training(spark):
    rows = [(g, f"s{i}", [float(i < 5) if g == "g" else 0.25, (i * 7 % 10) / 8, 3.0]) for i in range(10) for g in ("g", "h") if (g, i) != ("h", 3)]
    numbers = spark.createDataFrame(rows, "gene string, seq_id string, vals array<double>")
    traits = spark.createDataFrame([(f"s{i}", 2.0 if i < 5 else -1.0) for i in range(10)], "seq_id string, trait double")
    run = Training(spark, Settings(method="leastr", l1="0.05", l2="0.05", solver_options={"maxIter": "12"})).samples(traits).numeric(numbers)
    x, found, _ = run.encoded()
    assert {r["name"] for r in found.collect()} == {"g_0", "g_1", "h_0", "h_1", "h_2"}  # s3 lacks h, so its constants differ from zero
    values = {(r["name"], r["seq_id"]): r["value"] for r in x.join(found, "feature_id").collect()}
    assert values == {(f"{g}_{p}", s): v for g, s, vals in rows for p, v in enumerate(vals) if v and (g, p) != ("g", 2)}
    tables = run.scores(models := run.fit())
    beta = {r["feature_id"]: r["beta"] for r in models.where("feature_id IS NOT NULL").collect()}
    names = {r["feature_id"]: r["name"] for r in found.collect()}
    want = {f"s{i}": sum(b * values.get((names[f], f"s{i}"), 0.0) for f, b in beta.items()) for i in range(10)}
    assert {r["seq_id"]: r["sps"] for r in tables["sps"].collect()} == pytest.approx(want)
    assert tables["evaluation"].first()["rmse"] < 1.0


def test_numbers_grids_and_options(spark, tmp_path):
    rows = text.read_numeric(spark, put(tmp_path, "n.txt", "a\t1.5\t-\nb\t?\t2\n")).collect()
    assert {(r["gene"], r["seq_id"], tuple(r["vals"])) for r in rows} == {("n", "a", (1.5, 0.0)), ("n", "b", (0.0, 2.0))}
    assert text.read_grid(spark, put(tmp_path, "l.txt", "0.1\t0.2\n1.0\t0.25\n")) == [("0.1", "0.2"), ("1.0", "0.25")]
    assert text.read_options(spark, put(tmp_path, "o.txt", "maxIter\t9\nnothing\n")) == {"maxIter": "9"}
    assert text.read_group_weights(spark, put(tmp_path, "w1.txt", "2\n3\n")).collect()[1]["weight"] == 3.0
    assert text.read_group_weights(spark, put(tmp_path, "w2.txt", "g\t2.5\n")).first()[:] == ("g", 2.5)
    labels = text.model_labels(spark.createDataFrame([("0.1", "0.25")], "l1 string, l2 string")).first()
    assert labels["label"] == "_1_25"


def test_models_and_predictions(spark, tmp_path):
    model = spark.createDataFrame([("a_b", 3, "A", 0.25), ("g", 0, "-", -1e-7), ("g", 1, "C", 0.0)], "gene string, pos int, allele string, beta double")
    text.write_model(model, -0.5, str(tmp_path / "m"))
    back, intercept = text.read_model(spark, str(tmp_path / "m"))
    assert {tuple(r) for r in back.collect()} == {("a_b", 3, "A", 0.25), ("g", 0, "-", -1e-7)} and intercept == -0.5
    text.write_model_xml(model, 0.1, 0.2, -0.5, str(tmp_path / "x"))
    assert spark.read.format("xml").option("rowTag", "weight").load(str(tmp_path / "x")).count() == 3
    people = spark.createDataFrame([("s", 1.0, 0.75), ("t", None, 0.5)], "seq_id string, response double, sps double")
    by_group = spark.createDataFrame([("s", "g", 0.25)], "seq_id string, group string, contribution double")
    text.write_predictions(people, by_group, 0.5, ["g", "h"], str(tmp_path / "p"))
    rows = {(r["seq_id"], r["field"]): r for r in text.read_predictions(spark, str(tmp_path / "p")).collect()}
    assert rows["s", "g"]["contribution"] == 0.25 and rows["t", "h"]["contribution"] == 0 and rows["t", "g"]["response"] is None and rows["s", "h"]["prediction"] == 0.75


def test_newick(spark, tmp_path):
    nodes = text.read_newick(spark, put(tmp_path, "t.nwk", "((a:1, b)in:0.5,(c,'d e':2.5)[note],f);")).collect()
    by = {r["name"]: r for r in nodes if r["name"]}
    assert {k for k, r in by.items() if r["is_leaf"]} == {"a", "b", "c", "d e", "f"} and not by["in"]["is_leaf"]
    assert by["a"]["parent_id"] == by["b"]["parent_id"] == by["in"]["node_id"] and by["in"]["branch_length"] == 0.5 and by["d e"]["branch_length"] == 2.5
    assert len(nodes) == 8 and sum(r["parent_id"] is None for r in nodes) == 1
    with pytest.raises(ValueError):
        text.parse_newick("((a,b);")


def test_training_and_prediction(spark):
    rows = []
    for i in range(12):
        first = "A" if i < 6 else "C"
        rows += [("g", f"s{i}", first + "ACG"[i % 3] + "T"), ("h", f"s{i}", "GGT"[i % 3] + "A")]
    sequences = spark.createDataFrame(rows, "gene string, seq_id string, seq string")
    traits = spark.createDataFrame([(f"s{i}", 1.0 if i < 6 else -1.0) for i in range(12)] + [("zero", 0.0)], "seq_id string, trait double")
    run = Training(spark, Settings(l1_grid=("0.1", "0.3", "0.2"), l2_grid=("0.1", "0.3", "0.2"), class_balance="weighted", solver_options=FEW)).samples(traits).alignment(sequences)
    models = run.fit().cache()
    assert {r["grid_ord"] for r in models.select("grid_ord").distinct().collect()} == {0, 1, 2, 3}
    tables = run.scores(models)
    assert all(r["accuracy"] == 1.0 for r in tables["evaluation"].collect())
    assert tables["gss"].where("grid_ord = 0").orderBy(F.desc("gss")).first()["gene"] == "g"
    assert tables["hss"].count() == 4 and tables["gss_summary"].where("gene = 'g'").first()["n_models"] == 4 and tables["pss"].count() > 0
    one = models.where("grid_ord = 0 AND feature_id IS NOT NULL").select("gene", "pos", "allele", "beta")
    shift = models.where("grid_ord = 0").first()["intercept"]
    scores, by_group = predict(sequences, one, shift, response=traits)
    want = {r["seq_id"]: r["sps"] for r in tables["sps"].where("grid_ord = 0").collect()}
    assert all(abs(r["sps"] - want[r["seq_id"]]) < 1e-9 for r in scores.collect())
    cells = contribution_grid(scores, by_group, Settings(m_grid=(3, 1))).collect()
    assert len(cells) == 3 and {c["field"] for c in cells} == {"g"}
    folds = Training(spark, Settings(kfold=3, solver_options=FEW)).samples(traits).alignment(sequences).fit()
    assert {r["fold"] for r in folds.select("fold").distinct().collect()} == {0, 1, 2, 3}  # and one on all samples
    assert set(run.seconds) == {"preprocessing", "fit", "analysis"}
    phases = {(r["phase"], r["table"]): r["rows"] for r in run.phases().collect()}
    assert phases["preprocessing", "members"] == phases["preprocessing", "features"] > 0 and phases["fit", "models"] == models.count()
    short = Training(spark, Settings(stats="GH", summary_only=True, solver_options=FEW)).samples(traits).alignment(sequences)
    assert set(short.scores(short.fit())) == {"evaluation", "gss_summary", "hss_summary"}
    early = Training(spark, Settings(l1_grid=("0.1", "0.9", "0.4"), l2_grid=("0.1", "0.9", "0.4"), min_groups=1, solver_options=FEW)).samples(traits).alignment(sequences).fit()
    assert 0 < early.select("grid_ord").distinct().count() < 9 and early.where("below_min_groups").count() > 0
    screened = Training(spark, Settings(subsets=2, solver_options=FEW)).samples(traits).alignment(sequences).fit()
    assert {r["gene"] for r in screened.where("feature_id IS NOT NULL").select("gene").distinct().collect()} <= {"g", "h"}
    with pytest.raises(ValueError):
        Training(spark, Settings(class_balance="odd")).samples(traits)
    with pytest.raises(ValueError):
        run.samples(traits)
    with pytest.raises(ValueError):
        Settings(stats="X")
    with pytest.raises(ValueError):
        Training(spark, Settings(kfold=2)).clade(None, "c")
    with pytest.raises(ValueError):
        predict(sequences.where("gene = 'h'"), one, shift)


def test_inputs_of_a_run_by_path(spark, tmp_path):
    rows = [(g, f"s{i}", ("A" if (i < 4) == (g == "g") else "C") + "ACG"[i % 3]) for i in range(8) for g in ("g", "h")]
    sequences = spark.createDataFrame(rows, "gene string, seq_id string, seq string")
    traits = spark.createDataFrame([(f"s{i}", 1.0 if i < 4 else -1.0) for i in range(8)], "seq_id string, trait double")
    lines = spark.createDataFrame([(0, 0, "g"), (1, 0, "h")], "group_ord int, gene_ord int, gene string")
    plain = Training(spark, Settings(solver_options={"maxIter": "3"})).samples(traits)
    run = plain.files(put(tmp_path, "l.txt", "0.2\t0.1\n0.3\t0.1\n"), put(tmp_path, "o.txt", "maxIter\t2\nnote\n"), put(tmp_path, "w.txt", "g\t9\nh\t0.5\n"), put(tmp_path, "f.txt", "1\n2\n1\n2\n1\n2\n1\n2\n"))
    run.alignment(sequences, lines)
    assert run.settings.grid() == [("0.2", "0.1"), ("0.3", "0.1")] and run.settings.solver_options == {"maxIter": "2"}
    assert {(r["group_ord"], r["weight"]) for r in run.encoded()[2].select("group_ord", "weight").distinct().collect()} == {(0, 9.0), (1, 0.5)}
    models = run.fit()
    assert {(r["fold"], r["grid_ord"]) for r in models.select("fold", "grid_ord").distinct().collect()} == {(f, g) for f in (0, 1, 2) for g in (0, 1)}
    with pytest.raises(ValueError):
        Training(spark, Settings()).files(folds="x")


def test_stream(spark, tmp_path):
    model = spark.createDataFrame([("g", 0, "A", 0.5), ("g", 2, "C", -0.2)], "gene string, pos int, allele string, beta double")
    rows = spark.createDataFrame([("g", "s", "ATC"), ("g", "t", "AAA"), ("h", "s", "A")], "gene string, seq_id string, seq string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = score_stream(stream, model, 0.1).writeStream.format("memory").queryName("scored").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
        got = {r["seq_id"]: r["contribution"] for r in spark.table("scored").collect()}
    finally:
        query.stop()
    assert got == {"s": pytest.approx(0.3), "t": pytest.approx(0.5)}


def test_small_files(spark, tmp_path):
    samples = spark.createDataFrame([("a", 1.0, 0), ("b", -1.0, 1), ("c", 1.0, 2)], "seq_id string, trait double, ord long")
    folds = text.read_folds(spark, put(tmp_path, "f.txt", "1\n2\n1\n"), samples)
    assert {(r["seq_id"], r["fold"]) for r in folds.collect()} == {("a", 1), ("b", 2), ("c", 1)}
    with pytest.raises(ValueError):
        text.read_folds(spark, put(tmp_path, "f2.txt", "1"), samples)
    assert {r["name"] for r in text.read_clades(spark, put(tmp_path, "c.txt", "x\n\ny\nx\n")).collect()} == {"x", "y"}
    assert text.read_vector(spark, put(tmp_path, "v.txt", "2\n0.5\n")) == [2.0, 0.5]
    index = text.read_group_index(spark, put(tmp_path, "g.txt", "1,4\n3,5\n1.5,2\n")).collect()
    assert [(r["start"], r["end"], r["weight"]) for r in index] == [(1, 3, 1.5), (4, 5, 2.0)]
    with pytest.raises(ValueError):
        text.read_group_index(spark, put(tmp_path, "g2.txt", "1,4\n3\n1,2\n"))
    design = {(r["feature_id"], r["ord"], r["value"]) for r in text.read_design(spark, put(tmp_path, "x.csv", "1,0,0.5\n0,0,1\n")).collect()}
    assert design == {(1, 0, 1.0), (3, 0, 0.5), (3, 1, 1.0)}
    text.write_response(samples, str(tmp_path / "y"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "y")).collect()] == ["1.0", "-1.0", "1.0"]
    text.write_hypothesis(samples, str(tmp_path / "h"))
    assert text.read_traits(spark, str(tmp_path / "h")).count() == 3


def test_a_run_encodes_once_and_deals_the_sequences_of_a_gene(spark, monkeypatch):
    """Features and scores are tables that all later steps read, and a gene's sequences meet its sites in several groups."""
    from sparsegrove.operators import encode
    from sparsegrove.plans import api

    kept, groups, stored, hits = [], [], api.stored, encode.hits
    monkeypatch.setattr(api, "TOGETHER", 3)
    monkeypatch.setattr(api, "stored", lambda df, name: (kept.append(name), stored(df, name))[1])
    monkeypatch.setattr(encode, "hits", lambda a, bits, column, kind=None, salts=1: (groups.append(salts), hits(a, bits, column, kind, salts))[1])
    sequences = spark.createDataFrame([(g, f"s{i}", ("A" if i < 4 else "C") + "ACG"[i % 3]) for i in range(8) for g in ("g", "h")], "gene string, seq_id string, seq string")
    traits = spark.createDataFrame([(f"s{i}", 1.0 if i < 4 else -1.0) for i in range(8)], "seq_id string, trait double")
    run = Training(spark, Settings(stats="S", solver_options=FEW)).samples(traits).alignment(sequences)
    x, found, _ = run.encoded()
    assert kept == ["features"] and x.count() == 32 and found.count() == 10
    models = spark.createDataFrame([(0, 0, 1, 0.5, 0.25, "g", 0, "A")], "fold int, grid_ord int, feature_id long, beta double, intercept double, gene string, pos int, allele string")
    tables = run.scores(models)
    assert kept == ["features", "sps"] and groups == [3, 3]
    assert {(r["seq_id"], r["sps"]) for r in tables["sps"].collect()} == {(f"s{i}", 0.75 if i < 4 else 0.25) for i in range(8)}
