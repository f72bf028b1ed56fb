"""Readers and writers of the text formats: trait tables, alignment lists, FASTA, numeric tables, grids, options, models,
predictions and trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import lambda_label, name_parts, normalize_sequence


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines that are not blank."""
    return spark.read.text(path).select(F.trim(F.regexp_replace("value", "\r$", "")).alias("line")).where("line <> ''")


def read_traits(spark: SparkSession, path: str, response: bool = False) -> DataFrame:
    """seq_id, trait of a table without header; rows with trait 0 are left out. response: a value may be absent, and zeros stay.
    An id that occurs twice is an error."""
    cells = F.split("line", "\t")
    value = F.try_element_at(cells, F.lit(2))
    table = lines(spark, path).select(F.trim(cells[0]).alias("seq_id"), F.expr("try_cast(trim(try_element_at(split(line, '\t'), 2)) AS double)").alias("trait"), value.alias("_given"))
    twice = table.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(3).collect()
    if twice:
        raise ValueError(f"ids occur more than once: {[r[0] for r in twice]}")
    return table.drop("_given") if response else table.drop("_given").where("trait <> 0")


def read_alignment_list(spark: SparkSession, path: str) -> DataFrame:
    """group_ord, gene_ord, gene, path: a line is a group, its files are comma-separated, a gene is a file's stem."""
    with_place = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("_at", "line")).where("trim(line) <> ''")
    files = with_place.select("_at", F.posexplode(F.split(F.trim("line"), ",")).alias("gene_ord", "path"))
    groups = with_place.select("_at").withColumn("group_ord", F.expr("row_number() OVER (ORDER BY _at) - 1"))
    return files.join(groups, "_at").select("group_ord", "gene_ord", stem(F.trim("path")).alias("gene"), F.trim("path").alias("path"))


def stem(path):
    return F.regexp_replace(F.regexp_extract(path, "([^/\\\\]*)$", 1), r"\.[^.]*$", "")


def unescaped(path):
    """A path without its percent codes; others are left as they are."""
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)


def read_fasta(spark: SparkSession, paths: list[str] | str, data_type: str | None = None, samples: DataFrame | None = None) -> DataFrame:
    """gene, seq_id, seq: a file, or a folder gene=<name> of files, is a gene, a record's id its whole header, its lines are joined. With a
    data_type characters are normalised; with samples only theirs are kept. Of repeated ids the last stays; empty records are left out, as is
    a further `>` before an id.
    Records are cut by Spark's reader, so a large file is read by many tasks, and a record lies where it starts."""
    file, parts = unescaped(F.col("_metadata.file_path")), F.split("value", "\r?\n", 2)
    folder = F.regexp_extract(file, "/gene=([^/]*)/[^/]*$", 1)
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("_at")  # a block is read by one task, in order
    scan = spark.read.option("lineSep", "\n>").option("recursiveFileLookup", True).text(paths)
    header = F.trim(F.regexp_replace(parts[0], "^>", ""))
    sequence = F.regexp_replace(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")), "\\s", "")
    records = scan.select(F.when(folder != "", unescaped(folder)).otherwise(stem(file)).alias("gene"), place, header.alias("seq_id"), sequence.alias("seq")).where("seq <> '' AND seq_id <> ''")
    if samples is not None:
        records = records.join(samples.select(F.col("seq_id").cast("string").alias("seq_id")).distinct(), "seq_id", "left_semi")
    last = records.groupBy("gene", "seq_id").agg(F.max_by("seq", "_at").alias("seq"))
    return last.select("gene", "seq_id", F.col("seq") if data_type is None else normalize_sequence(F.col("seq"), data_type).alias("seq"))


def write_fasta(alignment: DataFrame, path: str, width: int = 60) -> None:
    """A folder gene=<name> for each gene, its records in lines of `width` characters."""
    body = F.array_join(F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{width}}}"), F.lit(0)), "\n")
    alignment.select("gene", F.concat(F.lit(">"), F.col("seq_id").cast("string"), F.lit("\n"), body).alias("value")).write.partitionBy("gene").text(path)


def check_lengths(alignment: DataFrame) -> None:
    """Sequences of one gene with different lengths are an error."""
    bad = alignment.groupBy("gene").agg(F.min(F.length("seq")).alias("lo"), F.max(F.length("seq")).alias("hi")).where("lo <> hi").limit(3).collect()
    if bad:
        raise ValueError(f"sequences of different lengths in {[r['gene'] for r in bad]}")


def read_numeric(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """gene, seq_id, vals: tab-separated numbers after the id; `-` and `?` are 0."""
    cells = F.split("value", "\t")
    number = lambda c: F.when(F.trim(c).isin("-", "?"), 0.0).otherwise(F.trim(c).cast("double"))
    rows = spark.read.text(paths).where("trim(value) <> ''").select(stem(unescaped(F.col("_metadata.file_path"))).alias("gene"), F.trim(cells[0]).alias("seq_id"), F.expr("slice(split(value, '\t'), 2, size(split(value, '\t')))").alias("_v"))
    return rows.select("gene", "seq_id", F.transform("_v", number).alias("vals"))


def read_grid(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Pairs of penalties in file order, as text."""
    text = spark.read.text(path, wholetext=True).first()
    return [tuple(x.split("\t")[:2]) for x in (text["value"] if text else "").splitlines() if "\t" in x]


def read_options(spark: SparkSession, path: str) -> dict[str, str]:
    """Solver options by key; lines without a tab are passed over."""
    text = spark.read.text(path, wholetext=True).first()
    return dict(x.strip().split("\t", 1) for x in (text["value"] if text else "").splitlines() if "\t" in x)


def read_group_weights(spark: SparkSession, path: str) -> DataFrame:
    """group, weight from two columns, or group_ord, weight from one weight a line."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("group_ord", "line")).where("trim(line) <> ''")
    if rows.where(F.instr("line", "\t") > 0).isEmpty():
        return rows.select("group_ord", F.trim("line").cast("double").alias("weight"))
    return rows.select(F.trim(F.split("line", "\t")[0]).alias("group"), F.trim(F.split("line", "\t")[1]).cast("double").alias("weight"))


def alignment_bytes(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """gene, bytes of alignment files, without reading them."""
    return spark.read.format("binaryFile").load(paths).select(stem(F.col("path")).alias("gene"), F.col("length").alias("bytes"))


def write_model(model: DataFrame, intercept: float, path: str) -> None:
    """Tab-separated names and weights of the non-zero bits, and the intercept. model: gene, pos, allele, beta."""
    name = F.concat_ws("_", "gene", F.col("pos").cast("string"), "allele")
    bits = model.where("beta <> 0").select(F.concat(name, F.lit("\t"), F.format_string("%.17e", "beta")).alias("line"))
    last = model.sparkSession.createDataFrame([(f"Intercept\t{intercept:.6f}",)], "line string")
    bits.unionByName(last).write.text(path)


def read_model(spark: SparkSession, path: str) -> tuple[DataFrame, float]:
    """gene, pos, allele, beta and the intercept of a written model."""
    cells = F.split("line", "\t")
    rows = lines(spark, path).select(cells[0].alias("name"), cells[1].cast("double").alias("beta"))
    gene, pos, allele = name_parts(F.col("name"))
    first = rows.where("name = 'Intercept'").first()
    return rows.where("name <> 'Intercept'").select(gene.alias("gene"), pos.alias("pos"), allele.alias("allele"), "beta"), float(first["beta"]) if first else 0.0


def write_model_xml(model: DataFrame, l1: float, l2: float, intercept: float, path: str) -> None:
    """A dense model as XML, a row for each feature, with its penalties and intercept."""
    rows = model.select(F.concat_ws("_", "gene", F.col("pos").cast("string"), "allele").alias("feature"), "beta", F.lit(l1).alias("lambda1"), F.lit(l2).alias("lambda2"), F.lit(intercept).alias("intercept"))
    rows.write.format("xml").option("rootTag", "model").option("rowTag", "weight").save(path)


def model_labels(grid: DataFrame) -> DataFrame:
    """grid (l1, l2 as text) with the label that file names carry."""
    return grid.withColumn("label", F.concat(lambda_label(F.col("l1")), lambda_label(F.col("l2"))))


LEAD = ("SeqID", "Response", "Prediction", "Intercept")


def write_predictions(people: DataFrame, by_group: DataFrame, intercept: float, groups: list[str], path: str) -> None:
    """The wide prediction table: id, response, prediction, intercept and a column for each group. people: seq_id, response, sps."""
    wide = by_group.groupBy("seq_id").pivot("group", groups).agg(F.sum("contribution")).na.fill(0.0)
    out = people.join(wide, "seq_id", "left").select(F.col("seq_id").alias("SeqID"), F.col("response").alias("Response"), F.col("sps").alias("Prediction"), F.lit(intercept).alias("Intercept"), *[F.coalesce(F.col(f"`{g}`"), F.lit(0.0)).alias(g) for g in groups])
    out.write.option("header", True).option("sep", "\t").option("nullValue", "nan").csv(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """seq_id, response, prediction, intercept, field, contribution of a wide prediction table; N/A and nan are null."""
    table = spark.read.option("header", True).option("sep", "\t").option("nullValue", "N/A").csv(path)
    fields = [c for c in table.columns if c not in LEAD]
    number = lambda c: F.nullif(F.expr(f"try_cast(`{c}` AS double)"), F.lit(float("nan")))
    long = table.select("SeqID", *[number(c).alias(c) for c in LEAD[1:]], F.explode(F.array(*[F.struct(F.lit(c).alias("field"), number(c).alias("contribution")) for c in fields])).alias("_cell"))
    return long.select(F.col("SeqID").alias("seq_id"), F.col("Response").alias("response"), F.col("Prediction").alias("prediction"), F.col("Intercept").alias("intercept"), "_cell.field", "_cell.contribution")


def parse_newick(text: str) -> list[tuple[int, int | None, str | None, float | None, bool]]:
    """node_id, parent_id, name, branch_length, is_leaf of a tree in Newick form; labels may be quoted, comments in brackets go."""
    nodes: list[list] = []
    stack: list[int] = []
    at, done, fresh = 0, False, True

    def add() -> int:
        nodes.append([len(nodes), stack[-1] if stack else None, None, None, True])
        return len(nodes) - 1

    current = None
    while at < len(text) and not done:
        c = text[at]
        if c == "[":
            at = text.index("]", at)
        elif c == "(":
            current = add()
            nodes[current][4] = False
            stack.append(current)
            fresh = True
        elif c in ",)":
            if fresh:
                add()
            fresh = c == ","
            if c == ")":
                current, fresh = stack.pop(), False
        elif c == ";":
            done = True
        elif c == ":":
            end = at + 1
            while end < len(text) and text[end] not in ",();[":
                end += 1
            if fresh:
                current, fresh = add(), False
            nodes[current][3] = float(text[at + 1 : end])
            at = end - 1
        elif not c.isspace():
            if c == "'":
                end = text.index("'", at + 1)
                label, at = text[at + 1 : end], end
            else:
                end = at
                while end < len(text) and text[end] not in ",():;[":
                    end += 1
                label, at = text[at:end].strip(), end - 1
            if fresh:
                current, fresh = add(), False
            nodes[current][2] = label
        at += 1
    if stack:
        raise ValueError("a parenthesis is not closed")
    return [tuple(n) for n in nodes]


NODES = "node_id long, parent_id long, name string, branch_length double, is_leaf boolean"


def read_newick(spark: SparkSession, path: str) -> DataFrame:
    """The nodes of a tree file."""
    text = spark.read.text(path, wholetext=True).first()["value"]
    return spark.createDataFrame(parse_newick(text), NODES)


def read_clades(spark: SparkSession, path: str) -> DataFrame:
    """name: one clade a line."""
    return lines(spark, path).select(F.col("line").alias("name")).distinct()


def read_folds(spark: SparkSession, path: str, samples: DataFrame) -> DataFrame:
    """seq_id, trait, fold: one fold number a line (or separated by commas), in the order of the samples' ord column."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"[\s,]+")).alias("ord", "fold"))
    joined = samples.join(text.select(F.col("ord").cast("long").alias("ord"), F.col("fold").cast("int").alias("fold")), "ord", "left")
    if not joined.where("fold IS NULL").isEmpty():
        raise ValueError("there are fewer folds than samples")
    return joined.select("seq_id", "trait", "fold")


def read_vector(spark: SparkSession, path: str) -> list[float]:
    """One number a line, such as class weights."""
    text = spark.read.text(path, wholetext=True).first()
    return [float(x) for x in (text["value"] if text else "").split()]


def in_order(rows: DataFrame) -> DataFrame:
    """rows with `number`, from 0 on, by their place in the files in order of name. Only the sizes of blocks are numbered one after the other."""
    key = ["_file", "_start"]
    placed = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    sizes = placed.groupBy(*key).agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_n"))  # one row a block
    before = sizes.select(*key, "_least", (F.sum("_n").over(Window.orderBy(*key)) - F.col("_n")).alias("_before"))
    return placed.join(before, key).withColumn("number", F.col("_before") + F.col("_id") - F.col("_least")).drop("_id", "_least", "_before", *key)


def write_cells(cells: DataFrame, path: str, sep: str = ",", cut_lines: bool = True) -> None:
    """line, at, value as lines of values in order of `at`. Each value is a record of Spark's writer, sorted in ranges: the parts, put
    together by name, are the file, and no line is held whole. A separator ends each value, also a line's last. cut_lines: a line may go on
    in the next part; else each part has whole lines, so that it can be read line by line."""
    starts = cells.groupBy("line").agg(F.min("at").alias("_first"))
    head = F.when((F.col("at") == F.col("_first")) & (F.col("line") > 0), "\n").otherwise("")
    placed = cells.join(starts, "line")
    ordered = placed.orderBy("line", "at") if cut_lines else placed.repartitionByRange("line").sortWithinPartitions("line", "at")
    ordered.select(F.concat(head, F.col("value")).alias("value")).write.option("lineSep", sep).text(path)


def read_cells(spark: SparkSession, path: str, lines_at_most: int, sep: str = ",") -> DataFrame:
    """line, at, value of a few long lines, which many tasks read: a value is a record. Blank values are left out; more lines are an error."""
    records = in_order(spark.read.option("lineSep", sep).text(path))
    breaks = records.where(F.instr("value", "\n") > 0).select("number", F.regexp_count("value", F.lit("\n")).alias("n")).orderBy("number").limit(lines_at_most + 1).collect()
    starts, line = [(0, -1, 0)], 0  # line, the record in which it starts, the records before
    for r in breaks:
        starts += [(line + i, r["number"], r["number"]) for i in range(1, r["n"] + 1)]
        line += r["n"]
    parts = records.select("number", F.posexplode(F.split("value", "\n")).alias("_part", "value"))
    known = spark.createDataFrame(starts, "line int, _record long, _before long")
    line_before = F.expr("CAST(" + " + ".join(["0", *[f"IF(number > {r['number']}, {r['n']}, 0)" for r in breaks]]) + " AS INT)")
    found = parts.withColumn("line", line_before + F.col("_part")).where("trim(value) <> ''").join(F.broadcast(known), "line")
    if not found.where(F.col("line") >= lines_at_most).isEmpty():
        raise ValueError(f"there are more than {lines_at_most} lines")
    return found.select("line", (F.col("number") - F.col("_before")).alias("at"), F.trim("value").alias("value"))


def write_group_index(index: DataFrame, path: str) -> None:
    """Three lines of starts, ends and weights of the groups in their order. index: group_ord, start, end, weight."""
    values = F.posexplode(F.array(*[F.col(c).cast("string") for c in ("start", "end", "weight")])).alias("line", "value")
    write_cells(index.select(F.col("group_ord").alias("at"), values), path)


def read_group_index(spark: SparkSession, path: str) -> DataFrame:
    """group_ord, start, end, weight from three lines of starts, ends and weights."""
    cells = read_cells(spark, path, 3)
    rows = cells.groupBy(F.col("at").cast("int").alias("group_ord")).agg(*[F.max(F.when(F.col("line") == i, F.col("value").cast("double"))).alias(c) for i, c in enumerate(("start", "end", "weight"))])
    if not rows.where("start IS NULL OR end IS NULL OR weight IS NULL").isEmpty():
        raise ValueError("a group index has three lines of equal length")
    return rows.select("group_ord", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "weight").orderBy("group_ord")


def write_field(members: DataFrame, path: str) -> None:
    """One line of the features of all groups, by group and slot. members: group_ord, slot, feature_id."""
    write_cells(members.select(F.lit(0).alias("line"), F.struct("group_ord", "slot").alias("at"), F.col("feature_id").cast("string").alias("value")), path)


def read_field(spark: SparkSession, path: str) -> DataFrame:
    """at, feature_id: the slots of a field, from 1 on, as a group index counts them."""
    return read_cells(spark, path, 1).select((F.col("at") + 1).alias("at"), F.col("value").cast("long").alias("feature_id"))


def write_design(x: DataFrame, samples: DataFrame, features: int, path: str, together: int = 1024) -> None:
    """A dense table, a row for each sample (seq_id, ord from 0 on) and a column for each of the features 1 to `features`; what x lacks is 0.
    A record of the writer is `together` columns of a row, so a row is never one value. Rows are not cut over parts."""
    block = F.floor((F.col("feature_id") - 1) / together)
    held = x.join(samples.select("seq_id", "ord"), "seq_id").groupBy("ord", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("feature_id", "value"))).alias("_cells"))
    every = samples.select("ord", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((features - 1) // together).cast("long"))).alias("block"))
    low, high = F.col("block") * together, F.least((F.col("block") + 1) * together, F.lit(features))
    zeros = lambda n: F.array_repeat(F.lit("0"), n.cast("int"))
    known = F.coalesce("_cells", F.array().cast(held.schema["_cells"].dataType))
    gap = lambda c, i: c["feature_id"] - F.when(i == 0, low).otherwise(F.get("_cells", i - 1)["feature_id"]) - 1
    inner = F.flatten(F.transform(known, lambda c, i: F.concat(zeros(gap(c, i)), F.array(c["value"].cast("string")))))
    last = F.coalesce(F.get("_cells", F.size("_cells") - 1)["feature_id"], low)
    values = F.array_join(F.concat(inner, zeros(high - last)), ",")
    rows = every.join(held, ["ord", "block"], "left").select(F.col("ord").alias("line"), F.col("block").alias("at"), values.alias("value"))
    write_cells(rows, path, cut_lines=False)


def read_design(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """feature_id, ord, value of a dense table without header, a row for each sample in file order; zeros and
    blank lines, as where a part ends, are left out."""
    rows = in_order(spark.read.text(path).where("trim(value) <> ''"))
    cells = rows.select(F.col("number").alias("ord"), F.posexplode(F.split("value", sep)).alias("_at", "v")).where("trim(v) <> ''")
    return cells.select((F.col("_at") + 1).cast("long").alias("feature_id"), "ord", F.trim("v").cast("double").alias("value")).where("value <> 0")


def write_table(df: DataFrame, path: str, columns: list[str], order: list[str] | None = None, compression: str = "none") -> None:
    """Tab-separated rows without header, sorted within the whole table if an order is given."""
    out = df.select(*[F.col(c).cast("string") for c in columns]) if order is None else df.orderBy(*order).select(*[F.col(c).cast("string") for c in columns])
    out.write.option("sep", "\t").option("nullValue", "nan").option("compression", compression).csv(path)


def write_response(samples: DataFrame, path: str) -> None:
    """A trait a line, in the order of the samples."""
    write_table(samples, path, ["trait"], ["ord"] if "ord" in samples.columns else ["seq_id"])


def write_hypothesis(samples: DataFrame, path: str) -> None:
    """Ids and traits after balancing."""
    write_table(samples, path, ["seq_id", "trait"], ["seq_id"])


def write_feature_map(features: DataFrame, path: str) -> None:
    """Numbers and names of the features."""
    write_table(features, path, ["feature_id", "name"], ["feature_id"])


def write_missing(missing: DataFrame, path: str) -> None:
    """Genes and the samples that they lack, as gzip files: there are nearly as many rows as genes times samples, and a gene's name repeats."""
    write_table(missing, path, ["gene", "seq_id"], compression="gzip")


def write_scores(scores: DataFrame, path: str) -> None:
    """seq_id, response, sps, spp."""
    write_table(scores, path, ["seq_id", "response", "sps", "spp"])


def write_statistics(tables: dict[str, DataFrame], path: str) -> None:
    """A folder of names and values for each statistic: positions by gene_pos, genes by name, the hypothesis without one."""
    for stat, table in tables.items():
        keys = [c for c in ("seq_id", "gene", "pos") if c in table.columns]
        value = next(c for c in table.columns if c not in keys)
        name = F.concat_ws("_", *[F.col(k).cast("string") for k in keys]) if keys else F.lit("")
        write_table(table.select(name.alias("name"), F.col(value).alias("value")), f"{path}/{stat}.txt", ["name", "value"], ["name"])


def read_statistics(spark: SparkSession, path: str, stats: tuple[str, ...] = ("pss", "gss", "hss")) -> DataFrame:
    """stat, name, value of written statistics; nan is null."""
    rows = lambda stat: spark.read.option("sep", "\t").option("emptyValue", "").option("nullValue", "nan").schema("name string, value double").csv(f"{path}/{stat}.txt")
    out = None
    for stat in stats:
        own = rows(stat).select(F.lit(stat).alias("stat"), F.coalesce("name", F.lit("")).alias("name"), "value")
        out = own if out is None else out.unionByName(own)
    return out
