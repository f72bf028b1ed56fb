"""From aligned sequences to sparse one-hot features grouped by gene.

Cells are (gene, pos, seq_id, ch); they only exist between an explode and the aggregate or filter above it, and are never
shuffled. What is joined to sequences is one row a gene: an array over its sites, with the bits that count. Sites and alleles
are filtered by two levels of counts, so no distinct is needed. Features are numbered within their gene and shifted by the
sizes of the genes before, so no window spans the feature table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import GAP, feature_name, normalize_sequence


@dataclass(frozen=True)
class EncodeOptions:
    """data_type: a restricted alphabet or universal. bit_count: carriers that a bit needs. drop_singletons: a site needs
    that many carriers besides its commonest allele (2 if bit_count is not set)."""

    data_type: str = "universal"
    bit_count: int | None = None
    drop_singletons: bool = False

    @property
    def threshold(self) -> int:
        return self.bit_count if self.bit_count is not None else (2 if self.drop_singletons else 1)


def explode_cells(alignment: DataFrame, data_type: str | None = "universal") -> DataFrame:
    """gene, pos (from 0), seq_id, ch of an alignment (gene, seq_id, seq); null sequences have no cells. data_type None: the sequences
    are normalised already."""
    seq = F.col("seq") if data_type is None else normalize_sequence(F.col("seq"), data_type)
    return alignment.select("gene", "seq_id", F.posexplode(F.split(seq, "")).alias("pos", "ch")).where("ch <> ''")


def pieces(texts: DataFrame, width: int = 40, seq_id: str = "seq_id", text: str = "text", data_type: str = "universal") -> DataFrame:
    """gene, seq_id, seq: whole texts, normalised and cut into genes w0, w1, ... of `width` characters."""
    parts = F.regexp_extract_all(normalize_sequence(F.col(text), data_type), F.lit(f"(?s).{{1,{width}}}"), F.lit(0))
    cut = texts.select(F.col(seq_id).alias("seq_id"), F.posexplode(parts).alias("_at", "seq"))
    return cut.select(F.concat(F.lit("w"), F.col("_at").cast("string")).alias("gene"), "seq_id", "seq")


def windows(texts: DataFrame, width: int = 40, seq_id: str = "seq_id", text: str = "text", data_type: str = "universal") -> DataFrame:
    """Cells of pieces()."""
    return explode_cells(pieces(texts, width, seq_id, text, data_type), None)


#: Positions of a gene whose bits meet its sequences as one row.
SITES = 10_000


def indexed_sites(bits: DataFrame, column: str, width: int = SITES) -> DataFrame:
    """gene, _window, sites: an array over each `width` positions of a gene of pos, alleles (the bits' alleles as one string, null for none)
    and values (the column's values, in the same order), so no row holds a whole long gene. bits: gene, pos, allele and the column."""
    each = bits.groupBy("gene", "pos").agg(F.sort_array(F.collect_list(F.struct("allele", F.col(column).alias("value")))).alias("_bits"))
    window = F.expr(f"CAST(pos DIV {width} AS INT)").alias("_window")
    every = each.groupBy("gene", window).agg(F.max("pos").alias("_last")).select("gene", "_window", F.explode(F.sequence(F.col("_window") * width, F.col("_last").cast("int"))).alias("pos"))
    site = F.struct("pos", F.array_join("_bits.allele", "").alias("alleles"), F.col("_bits.value").alias("values"))
    return every.join(each, ["gene", "pos"], "left").groupBy("gene", "_window").agg(F.sort_array(F.collect_list(site)).alias("sites"))


def hits(alignment: DataFrame, bits: DataFrame, column: str, data_type: str | None = None, salts: int = 1, width: int = SITES) -> DataFrame:
    """gene, seq_id, pos and the column's value for every bit that a sequence carries. Each `width` characters of a sequence meet their gene's
    sites there as one row, and the characters that match no bit go no further. salts: the groups that a gene's sequences are dealt to."""
    sites = indexed_sites(bits, column, width)
    windows_ = F.sequence(F.lit(0), F.expr(f"CAST((greatest(length(seq), 1) - 1) DIV {width} AS INT)"))
    cut = alignment.select("gene", "seq_id", "seq", F.explode(windows_).alias("_window")).withColumn("seq", F.substr("seq", F.col("_window") * width + 1, F.lit(width)))
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64("seq_id"), F.lit(salts)))
    met = salted.join(sites.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))), ["gene", "_window", "_salt"])
    seq = F.col("seq") if data_type is None else normalize_sequence(F.col("seq"), data_type)
    place = "instr(get(sites, _at).alleles, ch)"
    cells = met.select("gene", "seq_id", "sites", "_window", F.posexplode(F.split(seq, "")).alias("_at", "ch")).where(f"ch <> '' AND {place} > 0")
    return cells.select("gene", "seq_id", (F.col("_window") * width + F.col("_at")).alias("pos"), F.expr(f"get(get(sites, _at).values, {place} - 1)").alias(column))


def allele_counts(cells: DataFrame) -> DataFrame:
    """n by gene, pos, ch; gaps do not count."""
    return cells.where(F.col("ch") != GAP).groupBy("gene", "pos", "ch").agg(F.count(F.lit(1)).alias("n"))


def site_totals(counts: DataFrame) -> DataFrame:
    """alleles, total and most by site."""
    return counts.groupBy("gene", "pos").agg(F.count(F.lit(1)).alias("alleles"), F.sum("n").alias("total"), F.max("n").alias("most"))


def variable_sites(counts: DataFrame) -> DataFrame:
    """Sites with at least two alleles."""
    return site_totals(counts).where("alleles >= 2")


def without_singletons(sites: DataFrame, threshold: int = 2) -> DataFrame:
    """Sites with at least `threshold` carriers besides those of the commonest allele."""
    return sites.where(F.col("total") - F.col("most") >= threshold)


def kept_bits(counts: DataFrame, options: EncodeOptions = EncodeOptions()) -> DataFrame:
    """gene, pos, allele, support of the bits that stay. A site's alleles are judged together as one row; the counts are dealt out by gene, so
    that what numbers features within their gene needs no other shuffle."""
    least = options.threshold
    sites = counts.repartition("gene").groupBy("gene", "pos").agg(F.sum("n").alias("total"), F.max("n").alias("most"), F.collect_list(F.struct(F.col("ch").alias("allele"), F.col("n").alias("support"))).alias("_bits")).where(F.size("_bits") >= 2)
    if options.drop_singletons:
        sites = without_singletons(sites, least)
    return sites.select("gene", "pos", F.inline(F.filter("_bits", lambda b: b["support"] >= least)))


def number_features(bits: DataFrame, gene_order: Column | None = None) -> DataFrame:
    """bits with feature_id (dense, from 1, by gene order, pos, allele) and name. gene_order: a column of the bits that
    sorts genes; their names by default."""
    ordered = bits.withColumn("_ord", F.col("gene") if gene_order is None else gene_order)
    sizes = ordered.groupBy("gene", "_ord").agg(F.count(F.lit(1)).alias("_size"))  # one row a gene
    before = sizes.select("gene", (F.sum("_size").over(Window.orderBy("_ord", "gene")) - F.col("_size")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("gene").orderBy("pos", "allele"))
    numbered = ordered.withColumn("_within", within).join(before, "gene")
    return numbered.select((F.col("_before") + F.col("_within")).alias("feature_id"), "gene", "pos", "allele", feature_name(F.col("gene"), F.col("pos"), F.col("allele")).alias("name"), "support")


def one_hot(alignment: DataFrame, features: DataFrame, data_type: str | None = None, salts: int = 1) -> DataFrame:
    """feature_id, seq_id, value 1.0 for every carrier of a kept bit."""
    return hits(alignment, features, "feature_id", data_type, salts).select("feature_id", "seq_id", F.lit(1.0).alias("value"))


def fuzz_gaps(alignment: DataFrame, features: DataFrame, data_type: str | None = None, salts: int = 1) -> DataFrame:
    """one_hot with 0.5 in every bit of a site for the samples that have a gap there."""
    at_gap = features.groupBy("gene", "pos").agg(F.collect_list("feature_id").alias("feature_ids")).withColumn("allele", F.lit(GAP))
    gaps = hits(alignment, at_gap, "feature_ids", data_type, salts).select(F.explode("feature_ids").alias("feature_id"), "seq_id", F.lit(0.5).alias("value"))
    return one_hot(alignment, features, data_type, salts).unionByName(gaps)


def normalize_columns(x: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Values divided by their column's sum; columns that sum to less than the threshold are dropped."""
    sums = x.groupBy("feature_id").agg(F.sum("value").alias("_sum")).where(F.col("_sum") >= threshold)
    return x.join(sums, "feature_id").select("feature_id", "seq_id", (F.col("value") / F.col("_sum")).alias("value"))


def numeric_cells(numeric: DataFrame) -> DataFrame:
    """gene, pos, seq_id, value of a numeric table (gene, seq_id, vals)."""
    return numeric.select("gene", "seq_id", F.posexplode("vals").alias("pos", "value"))


def variable_columns(cells: DataFrame) -> DataFrame:
    """gene, pos of numeric columns that are not constant."""
    return cells.groupBy("gene", "pos").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("lo < hi")


def numeric_features(columns: DataFrame, gene_order: Column | None = None) -> DataFrame:
    """number_features() of numeric columns (gene, pos): they have no allele and no support, and are named gene_pos."""
    return number_features(columns.withColumn("allele", F.lit(None).cast("string")).withColumn("support", F.lit(None).cast("long")), gene_order)


def numeric_values(numeric: DataFrame, bits: DataFrame, column: str) -> DataFrame:
    """gene, seq_id, value and the column's value for every column of bits (gene, pos and it) that is not 0 in a sample; nulls and NaN are 0.
    A sample's numbers meet their gene's columns as one row, so no cell is shuffled."""
    places = bits.groupBy("gene").agg(F.collect_list(F.struct("pos", column)).alias("_places"))
    cells = numeric.join(places, "gene").select("gene", "seq_id", "vals", F.inline("_places"))
    return cells.select("gene", "seq_id", F.nanvl(F.get("vals", "pos"), F.lit(0.0)).alias("value"), column).where("value <> 0")


def missing_counts(samples: DataFrame, alignment: DataFrame) -> DataFrame:
    """gene, missing: how many of the samples a gene's alignment lacks, for genes that lack some."""
    own = samples.select("seq_id").distinct()
    present = alignment.select("gene", "seq_id").distinct().join(own, "seq_id", "left_semi")
    total = own.agg(F.count(F.lit(1)).alias("_all"))
    some = present.groupBy("gene").agg(F.count(F.lit(1)).alias("_n"))
    every = alignment.select("gene").distinct().join(some, "gene", "left")
    return every.join(F.broadcast(total)).select("gene", (F.col("_all") - F.coalesce("_n", F.lit(0))).alias("missing")).where("missing > 0")


def missing_sequences(samples: DataFrame, alignment: DataFrame, together: int = 1024) -> DataFrame:
    """gene, seq_id of samples that a gene's alignment lacks. Samples are dealt to buckets of about `together`; a gene and a bucket meet as
    counts first, and ids are only compared where they differ. What is shuffled is one set of ids for a gene and a bucket, once; the
    buckets' own ids are broadcast up to a million samples."""
    own = samples.select("seq_id").distinct()
    n = own.count()
    near, buckets = (F.broadcast if n <= 1 << 20 else lambda t: t), max(1, -(-n // together))
    bucket = F.pmod(F.xxhash64("seq_id"), F.lit(buckets)).alias("_bucket")
    people = own.select("seq_id", bucket).groupBy("_bucket").agg(F.collect_list("seq_id").alias("_ids"))
    present = alignment.select("gene", "seq_id").join(near(own), "seq_id", "left_semi").select("gene", "seq_id", bucket)
    have = present.groupBy("gene", "_bucket").agg(F.collect_set("seq_id").alias("_have"))
    pairs = alignment.select("gene").distinct().select("gene", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))).alias("_bucket"))
    sizes = people.select("_bucket", F.size("_ids").alias("_n"))
    short = pairs.join(near(sizes), "_bucket").join(have, ["gene", "_bucket"], "left").where(F.coalesce(F.size("_have"), F.lit(0)) < F.col("_n"))
    none = F.array().cast(people.schema["_ids"].dataType)
    return short.join(near(people), "_bucket").select("gene", F.explode(F.array_except("_ids", F.coalesce("_have", none))).alias("seq_id"))


def feature_stats(samples: DataFrame, features: DataFrame) -> DataFrame:
    """samples, features."""
    return samples.agg(F.count(F.lit(1)).alias("samples")).join(features.agg(F.count(F.lit(1)).alias("features")))
