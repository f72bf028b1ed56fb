"""Exact deduplication: group by a 128-bit content hash, then compare the bytes inside the groups.

The grouping key is (hash, text). Spark sums each task's copies before the shuffle, so a text that holds a third
of all rows reaches the reducers once per task, and texts that only share a hash stay apart because their bytes
differ. Documents find their class again by (hash, SHA-256): two texts of one class key would have to collide in
both. That join carries no texts; the documents of a large class are dealt to several tasks, each of which has the class's row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MOST_HEAVY, Scratch, for_each_salt, id_and_text, salted, table

#: Documents of a class in one task.
CLASS_ROWS = 1 << 17


def md5_bits(text: Column) -> Column:
    """128 bits of content hash as 16 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise: Callable[[Column], Column] | None = None, content_hash: Callable[[Column], Column] = md5_bits) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    keep: "smallest" or "largest", the id that stays of equal texts. normalise: applied to the text before it is
    compared (none by default). Defined cases: a null text is an empty one, and all empty texts are one group; a null
    id never is the one that stays unless its whole group has null ids, and then keep_id is null and every row of
    the group counts as kept; a row given twice (same id, same text) comes back twice, counts twice in group_size and
    has the same flags; an empty table gives an empty result; other columns are not looked at.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    best = F.min if keep == "smallest" else F.max
    base = id_and_text(df, id_col, text_col)
    if normalise is not None:
        base = base.withColumn("_text", normalise(F.col("_text")))
    base = base.withColumn("_hash", content_hash(F.col("_text")))
    sha = F.sha2(F.col("_text").cast("binary"), 256)
    classes = base.groupBy("_hash", "_text").agg(F.count(F.lit(1)).alias("group_size"), best("_id").alias("keep_id")).select("_hash", sha.alias("text_sha256"), "group_size", "keep_id")
    classes = Scratch(df.sparkSession, "copies").write(classes, "classes")
    most = max(CLASS_ROWS, -(-(classes.agg(F.sum("group_size")).first()[0] or 0) // MOST_HEAVY))
    heavy = classes.where(F.col("group_size") > most).groupBy("text_sha256").agg(F.ceil(F.sum("group_size") / most).alias("_parts"))  # at most MOST_HEAVY
    members = salted(base.select("_id", "_hash", sha.alias("text_sha256")), heavy, "text_sha256", "_id")
    found = members.join(for_each_salt(classes, heavy, "text_sha256"), ["_hash", "text_sha256", "_salt"])
    return found.select(F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


OP10_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
