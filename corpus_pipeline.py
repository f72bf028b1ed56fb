"""A corpus from raw documents to packed sequences, in stages that each call one operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the shared folder and
reads again as the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsegrove.llm.common import table, written
from sparsegrove.llm.exact_dedup import exact_dedup
from sparsegrove.llm.jaccard_join import jaccard_join
from sparsegrove.llm.language_id import fold, identify, learn_languages
from sparsegrove.llm.packing import pack
from sparsegrove.llm.suffix_dedup import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; texts that are null or have no letter go. Labels of four fifths of the
    documents teach the languages; a document never goes for its label, nor where no label teaches a language."""
    parser = learn_languages(docs, fold(F.col("doc_id"), 5) != 0)
    if not parser.langs:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    rest = tuple(c for c in COLUMNS if c != "doc_id")
    return identify(docs, parser, carry=rest).where("lang_pred <> 'und'").select(*COLUMNS)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays; a row that is given several times stays once."""
    kept = written(exact_dedup(docs, keep="largest").where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct(), "pipeline-kept")
    own = docs.select(*COLUMNS).withColumn("_own", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    return own.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_sha")), "left_semi").dropDuplicates(["doc_id", "_own"]).select(*COLUMNS)


def keyed(docs: DataFrame) -> DataFrame:
    """docs with row_key, null for null ids: the id, or where an id is given again, numbers of the ids' texts that follow the
    order of the ids and then of the texts' hashes. Rows of equal id and text have equal keys."""
    if docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return docs.select(*COLUMNS, F.col("doc_id").alias("row_key"))
    own = docs.select(*COLUMNS).withColumn("_own", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    ordered = own.where("doc_id IS NOT NULL").select("doc_id", "_own").distinct().repartitionByRange("doc_id", "_own").sortWithinPartitions("doc_id", "_own")
    numbers = written(ordered.withColumn("row_key", F.monotonically_increasing_id()), "pipeline-numbers")
    return written(own.join(numbers, ["doc_id", "_own"], "left").select(*COLUMNS, "row_key"), "pipeline-keyed")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more of their five-word shingles, directly or through
    others, the one with the smallest id stays. Texts that share an id are documents of their own."""
    rows = keyed(docs)
    goes = jaccard_join(rows, id_col="row_key", words_per_token=5, percent=80).where("component_id <> row_key").select("row_key").distinct()
    return rows.join(goes, "row_key", "left_anti").select(*COLUMNS)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every byte of a string of 100 bytes that also starts earlier goes; bytes that then are no character go with it, and
    a document of which nothing is left. n_chars is that of the text that stays. Texts that share an id are documents of
    their own."""
    left = remove_repeats(keyed(docs), id_col="row_key", carry=("doc_id", "lang", "source"), characters=True).where("kept <> ''")
    return left.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in full sequences of 1024 ids."""
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("jaccard_join", near_copies),
    ("suffix_dedup", repeated_strings),
    ("packing", packing),
]

#: SQL can express neither the language model nor the tokens; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents of sf_dir, after all stages."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
