"""The engine's inputs as views of the given tables: samples, alignments of whole texts, numeric vectors, trees, predictions.

Each view has the SQL that other engines build it with, so that a query and its SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import encode, groups
from ..session import stored

WIDTH, BIT_COUNT = 40, 2
OPTIONS = encode.EncodeOptions("protein", BIT_COUNT)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, d: str) -> DataFrame:
    """seq_id, trait: labelled documents, 1 for quality 1, else -1."""
    return table(spark, d, "labels").where("quality IS NOT NULL").select(F.col("doc_id").alias("seq_id"), F.when(F.col("quality") == 1, 1.0).otherwise(-1.0).alias("trait"))


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt to all cores by a key where they lie in fewer files than there are cores, as a file may be one block that only one
    task reads; else as they are, without a shuffle."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if len(rows.inputFiles()) < cores else rows


def texts(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select(F.col("doc_id").alias("seq_id"), "text"), "seq_id")
    return docs.join(samples(spark, d), "seq_id").select("seq_id", "text")


def pieces(spark: SparkSession, d: str) -> DataFrame:
    """gene, seq_id, seq: the whole texts of the samples, normalised, in genes of 40 characters."""
    return encode.pieces(texts(spark, d), WIDTH, data_type="protein")


def cells(spark: SparkSession, d: str) -> DataFrame:
    """gene, pos, seq_id, ch of the pieces."""
    return encode.explode_cells(pieces(spark, d), None)


#: Sequences of a gene that meet its sites in one group.
TOGETHER = 25_000


def salts(spark: SparkSession, d: str, name: str = "labels") -> int:
    """A gene has at most one piece of each row of the table (labels: the samples; documents: all texts): groups of about TOGETHER."""
    return max(1, -(-table(spark, d, name).count() // TOGETHER))


def alignment(spark: SparkSession, d: str) -> DataFrame:
    """gene, seq_id, seq: the whole texts of all documents, labelled or not, in genes of 40 characters."""
    docs = table(spark, d, "documents").where("doc_id IS NOT NULL").select(F.col("doc_id").alias("seq_id"), "text")
    return encode.pieces(spread(docs, "seq_id"), WIDTH, data_type="protein")


def gene_lines(found: DataFrame, together: int = 4) -> DataFrame:
    """group_ord, gene_ord, gene: genes in files of four."""
    genes = found.select("gene", gene_number().alias("_g")).distinct()
    return genes.select(F.floor(F.col("_g") / together).cast("int").alias("group_ord"), F.pmod("_g", F.lit(together)).alias("gene_ord"), "gene")


def gene_number(gene="gene"):
    return F.substring(gene, 2, 10).cast("int")


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """rows with ord, from 0 on by the key: rows are sorted in ranges, and only the ranges' sizes are summed one after the other."""
    placed = stored(rows.orderBy(key).withColumn("_part", F.spark_partition_id()), "sorted")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row a range
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return placed.withColumn("_in", inside).join(before, "_part").withColumn("ord", F.col("_before") + F.col("_in") - 1).drop("_part", "_in", "_before")


def features(spark: SparkSession, d: str, options: encode.EncodeOptions = OPTIONS) -> DataFrame:
    bits = encode.kept_bits(encode.allele_counts(cells(spark, d)), options)
    return encode.number_features(bits.withColumn("gene_ord", gene_number()), F.col("gene_ord"))


def design(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The one-hot design and its features, which are a table, as several steps read them."""
    found = stored(features(spark, d), "features")
    return encode.one_hot(pieces(spark, d), found, salts=salts(spark, d)), found


def members(found: DataFrame) -> DataFrame:
    """feature_id, group, weight: genes as groups."""
    sizes = groups.gene_groups(found).select("gene", "weight")
    return found.join(sizes, "gene").select("feature_id", F.col("gene").alias("group"), "weight")


def overlap_groups(found: DataFrame) -> DataFrame:
    """group_ord, gene_ord, gene: each gene with the next one."""
    genes = found.select("gene", gene_number().alias("_g")).distinct()
    own = genes.select(F.col("_g").alias("group_ord"), F.lit(0).alias("gene_ord"), "gene")
    return own.unionByName(genes.where("_g > 0").select((F.col("_g") - 1).alias("group_ord"), F.lit(1).alias("gene_ord"), "gene"))


def model(found: DataFrame) -> DataFrame:
    """Features with a fixed weight each: ((37 id) mod 101 - 50) / 1024, which doubles sum exactly."""
    return found.withColumn("beta", (F.pmod(F.col("feature_id") * 37, F.lit(101)) - 50) / F.lit(1024.0))


def numeric(spark: SparkSession, d: str) -> DataFrame:
    """gene, seq_id, vals: embeddings in genes of eight components."""
    v = table(spark, d, "embeddings").where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    parts = F.transform(F.sequence(F.lit(0), (F.size("embedding") - 1).cast("int"), F.lit(8)), lambda i: F.struct(F.concat(F.lit("e"), (i / 8).cast("int").cast("string")).alias("gene"), F.slice("embedding", i + 1, F.lit(8)).alias("vals")))
    return v.select(F.col("vec_id").alias("seq_id"), F.explode(parts).alias("p")).select("p.gene", "seq_id", F.transform("p.vals", lambda x: x.cast("double")).alias("vals"))


def vector_labels(spark: SparkSession, d: str) -> DataFrame:
    """seq_id, trait: the vectors' labels as numbers."""
    v = table(spark, d, "embeddings").where("vec_id IS NOT NULL AND embedding IS NOT NULL AND label IS NOT NULL")
    return v.select(F.col("vec_id").alias("seq_id"), F.col("label").cast("double").alias("trait"))


def tree(spark: SparkSession, d: str) -> DataFrame:
    """Regions, nations and customers under one root; customers are the leaves."""
    region = table(spark, d, "region").select((F.col("r_regionkey").cast("long") + 1).alias("node_id"), F.lit(0).cast("long").alias("parent_id"), F.col("r_name").alias("name"), F.lit(False).alias("is_leaf"))
    nation = table(spark, d, "nation").select((F.col("n_nationkey").cast("long") + 100).alias("node_id"), (F.col("n_regionkey").cast("long") + 1).alias("parent_id"), F.col("n_name").alias("name"), F.lit(False).alias("is_leaf"))
    customer = table(spark, d, "customer").select((F.col("c_custkey") + 1000).alias("node_id"), (F.col("c_nationkey").cast("long") + 100).alias("parent_id"), F.col("c_name").alias("name"), F.lit(True).alias("is_leaf"))
    root = region.limit(1).select(F.lit(0).cast("long").alias("node_id"), F.lit(None).cast("long").alias("parent_id"), F.lit(None).cast("string").alias("name"), F.lit(False).alias("is_leaf"))
    return root.unionByName(region).unionByName(nation).unionByName(customer)


def customer_alignment(spark: SparkSession, d: str) -> DataFrame:
    """gene, seq_id, seq of the customers: their market segment, and the digits of their balance and number as two genes."""
    c = table(spark, d, "customer")
    digits = lambda v: F.lpad(v.cast("string"), 9, "0")
    genes = F.create_map(F.lit("segment"), F.rpad("c_mktsegment", 10, "-"), F.lit("balance"), digits(F.abs(F.round(F.col("c_acctbal") * 100).cast("long"))), F.lit("number"), digits(F.col("c_custkey")))
    return c.select(F.col("c_name").alias("seq_id"), F.explode(genes).alias("gene", "seq")).select("gene", "seq_id", "seq")


def ladder(spark: SparkSession, d: str) -> DataFrame:
    """A tree as deep as there are nations: step k holds the customers of nation k and step k + 1, so that its leaves are the customers of
    the nations from k on."""
    nation = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    step = nation.select((F.col("k") + 1).alias("node_id"), F.when(F.col("k") > 0, F.col("k")).alias("parent_id"), F.concat(F.lit("step"), F.col("k").cast("string")).alias("name"), F.lit(False).alias("is_leaf"))
    leaf = table(spark, d, "customer").select((F.col("c_custkey") + 1000).alias("node_id"), (F.col("c_nationkey").cast("long") + 1).alias("parent_id"), F.col("c_name").alias("name"), F.lit(True).alias("is_leaf"))
    return step.unionByName(leaf)


def tables_of_predictions(spark: SparkSession, d: str) -> DataFrame:
    """table_id, seq_id, field, contribution: users' events by type, a table for even and one for odd hours."""
    e = table(spark, d, "events").where("user_id IS NOT NULL AND event_type IS NOT NULL")
    value = F.sum(F.floor(F.coalesce("value", F.lit(0.0)) * 64)).cast("double") / 4096
    return e.groupBy(F.pmod(F.hour("ts"), F.lit(2)).alias("table_id"), F.col("user_id").alias("seq_id"), F.col("event_type").alias("field")).agg(value.alias("contribution"))


def response():
    return F.when(F.pmod("seq_id", F.lit(3)) == 0, -1.0).otherwise(1.0)


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """seq_id, response, field, contribution of all events, in one table."""
    e = table(spark, d, "events").where("user_id IS NOT NULL AND event_type IS NOT NULL")
    value = (F.sum(F.floor(F.coalesce("value", F.lit(0.0)) * 64)).cast("double") - 64 * F.count(F.lit(1)) * 40) / 4096
    return e.groupBy(F.col("user_id").alias("seq_id"), F.col("event_type").alias("field")).agg(value.alias("contribution")).withColumn("response", response())


SQL_CELLS = """
samples AS (SELECT doc_id AS seq_id, CASE WHEN quality = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS trait FROM labels WHERE quality IS NOT NULL),
chars AS (SELECT s.seq_id, string_split(upper(regexp_replace(d.text, '[^ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy]', '-', 'g')), '') AS a FROM documents d JOIN samples s ON d.doc_id = s.seq_id),
pairs AS (SELECT seq_id, unnest(a) AS ch, generate_subscripts(a, 1) - 1 AS p FROM chars),
cells AS (SELECT 'w' || (p // 40) AS gene, CAST(p % 40 AS INTEGER) AS pos, seq_id, ch FROM pairs),
counts AS (SELECT gene, pos, ch, count(*) AS n FROM cells WHERE ch <> '-' GROUP BY ALL),
sites AS (SELECT gene, pos, count(*) AS alleles, CAST(sum(n) AS BIGINT) AS total, max(n) AS most FROM counts GROUP BY ALL)"""
SQL_FEATURES = (
    SQL_CELLS
    + """,
features AS (SELECT row_number() OVER (ORDER BY CAST(substr(gene, 2) AS INTEGER), pos, ch) AS feature_id, gene, pos, ch AS allele, gene || '_' || pos || '_' || ch AS name, n AS support
  FROM counts JOIN sites USING (gene, pos) WHERE alleles >= 2 AND n >= 2),
groups AS (SELECT gene, count(*) AS size, sqrt(count(*)) AS weight FROM features GROUP BY gene),
x AS (SELECT feature_id, seq_id FROM cells c JOIN features f ON c.gene = f.gene AND c.pos = f.pos AND c.ch = f.allele)"""
)
SQL_MODEL = SQL_FEATURES + """,
model AS (SELECT *, ((feature_id * 37) % 101 - 50) / 1024.0::DOUBLE AS beta FROM features)"""
SQL_ATB = SQL_FEATURES + """,
tot AS (SELECT count(*)::DOUBLE AS m, count(*) FILTER (trait = 1)::DOUBLE AS pos, count(*) FILTER (trait <> 1)::DOUBLE AS neg FROM samples),
atb AS (SELECT feature_id, sum(CASE WHEN trait = 1 THEN neg / m / m ELSE -(pos / m) / m END) AS atb FROM x JOIN samples USING (seq_id), tot GROUP BY feature_id),
top AS (SELECT max(abs(atb)) AS l1max FROM atb),
norms AS (SELECT gene, sqrt(sum(greatest(abs(atb) - 0.1 * l1max, 0) ** 2)) / weight AS norm FROM atb JOIN features USING (feature_id) JOIN groups USING (gene), top GROUP BY gene, weight),
top2 AS (SELECT max(norm) AS l2max FROM norms)"""
SQL_CONTRIB = SQL_MODEL + """,
contrib AS (SELECT seq_id, m.gene, sum(beta) AS contribution FROM x JOIN model m USING (feature_id) WHERE beta <> 0 GROUP BY ALL),
sps AS (SELECT s.seq_id, s.trait AS response, coalesce(sum(contribution), 0) + 0.125 AS sps FROM samples s LEFT JOIN contrib USING (seq_id) GROUP BY ALL)"""
SQL_APPLY = SQL_MODEL + """,
new_pairs AS (SELECT seq_id, unnest(a) AS ch, generate_subscripts(a, 1) - 1 AS p FROM (SELECT doc_id AS seq_id, string_split(upper(regexp_replace(text, '[^ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy]', '-', 'g')), '') AS a FROM documents WHERE text <> '')),
applied AS (SELECT n.seq_id, sum(beta) AS total FROM new_pairs n JOIN model m ON m.gene = 'w' || (p // 40) AND m.pos = p % 40 AND m.allele = n.ch WHERE beta <> 0 GROUP BY n.seq_id)"""
SQL_TREE = """
nodes AS (
  SELECT 0::BIGINT AS node_id, NULL::BIGINT AS parent_id, NULL AS name, false AS is_leaf
  UNION ALL SELECT r_regionkey + 1, 0, r_name, false FROM region UNION ALL SELECT n_nationkey + 100, n_regionkey + 1, n_name, false FROM nation
  UNION ALL SELECT c_custkey + 1000, c_nationkey + 100, c_name, true FROM customer),
up AS (SELECT node_id, node_id AS ancestor_id, parent_id AS next FROM nodes UNION ALL SELECT u.node_id, n.node_id, n.parent_id FROM up u JOIN nodes n ON u.next = n.node_id),
members AS (SELECT a.name AS clade, l.name AS leaf FROM up JOIN nodes a ON a.node_id = ancestor_id JOIN nodes l ON l.node_id = up.node_id WHERE l.is_leaf AND NOT a.is_leaf AND a.name IS NOT NULL)"""
SQL_PRED = """
pred AS (SELECT user_id AS seq_id, event_type AS field, (sum(CAST(floor(coalesce(value, 0) * 64) AS BIGINT))::DOUBLE - 64 * count(*) * 40) / 4096 AS contribution, CASE WHEN user_id % 3 = 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS response
  FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL),
people AS (SELECT seq_id, response, sum(contribution) AS sps FROM pred GROUP BY ALL),
ext AS (SELECT coalesce(max(1 / (1 + exp(-sps))) FILTER (response > 0), max(1 / (1 + exp(-sps)))) AS hi, coalesce(min(1 / (1 + exp(-sps))) FILTER (response < 0), min(1 / (1 + exp(-sps)))) AS lo FROM people),
spp AS (SELECT seq_id, response, sps, CASE WHEN response > 0 THEN (1 / (1 + exp(-sps)) - 0.5) / (hi - 0.5) WHEN response < 0 THEN (1 / (1 + exp(-sps)) - 0.5) / (lo - 0.5) END AS spp FROM people, ext)"""
