"""Exact token counts by a length histogram.

Every document is encoded once; its length goes to a histogram that Spark sums up before the shuffle, and that is written.
The histogram has a row for each length that occurs, however many documents there are. Suffix sums over it answer totals, quantiles and
totals cut at any context limit, without another look at the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, table, written

#: Lengths whose sums are taken together first.
SPAN = 512


def encoded_lengths(df: DataFrame, text_col: str = "text", rank_path: str | None = None) -> DataFrame:
    """n_tokens of every row; a null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokenizer import by_ranks

        encode = by_ranks(rank_path).encode_ordinary
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.fromiter((len(encode(t)) if t else 0 for t in batch.column(0).to_pylist()), np.int64, batch.num_rows))], names=["n_tokens"])

    return df.select(F.col(text_col).alias("_text")).mapInArrow(lean(run), "n_tokens long")


def length_histogram(df: DataFrame, text_col: str = "text", rank_path: str | None = None) -> DataFrame:
    """n_tokens, n_docs for every length that occurs."""
    return encoded_lengths(df, text_col, rank_path).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """n_tokens, n_docs, docs_at_least, tokens_at_least, truncated_tokens, quantile, in one row for each length.

    docs_at_least and tokens_at_least sum over documents of this length or longer; truncated_tokens is the total if each
    document is cut at this length; quantile is the share of documents that are no longer. For a limit c between two
    rows take the next longer row b: docs_at_least holds for c, and the total at c is that of all tokens without
    b's tokens_at_least, plus c times its docs_at_least. Sums are taken within spans of lengths and over the spans' totals,
    so that no task sees the whole histogram. An empty histogram gives no rows.
    """
    spans = histogram.withColumn("_span", F.floor(F.col("n_tokens") / SPAN))
    tokens = F.col("n_tokens") * F.col("n_docs")
    totals = spans.groupBy("_span").agg(F.sum("n_docs").alias("_docs"), F.sum(tokens).alias("_tokens"))
    longer = Window.orderBy(F.desc("_span")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    after = totals.select("_span", *[F.coalesce(F.sum(c).over(longer), F.lit(0)).alias(f"{c}_after") for c in ("_docs", "_tokens")], *[F.sum(c).over(everything).alias(f"{c}_all") for c in ("_docs", "_tokens")])
    within = Window.partitionBy("_span").orderBy(F.desc("n_tokens"))
    out = spans.join(after, "_span").select(
        "n_tokens",
        "n_docs",
        (F.sum("n_docs").over(within) + F.col("_docs_after")).alias("docs_at_least"),
        (F.sum(tokens).over(within) + F.col("_tokens_after")).alias("tokens_at_least"),
        "_docs_all",
        "_tokens_all",
    )
    cut = F.col("_tokens_all") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")
    below = (F.col("_docs_all") - F.col("docs_at_least") + F.col("n_docs")) / F.col("_docs_all")
    return out.select("n_tokens", "n_docs", "docs_at_least", "tokens_at_least", cut.alias("truncated_tokens"), below.alias("quantile"))


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """context_limit, docs_longer, total_tokens when every document is cut at the limit."""
    spark = sums.sparkSession
    asked = spark.createDataFrame([(int(c),) for c in limits], "context_limit long")
    whole = sums.agg(F.max(F.col("tokens_at_least")).alias("_all"))
    next_longer = sums.select("n_tokens", "docs_at_least", "tokens_at_least")
    found = F.broadcast(asked).join(next_longer, F.col("n_tokens") > F.col("context_limit"), "left").groupBy("context_limit").agg(F.min_by(F.struct("docs_at_least", "tokens_at_least"), "n_tokens").alias("_next"))
    docs, tokens = F.coalesce("_next.docs_at_least", F.lit(0)), F.coalesce("_next.tokens_at_least", F.lit(0))
    return found.join(F.broadcast(whole)).select("context_limit", docs.alias("docs_longer"), (F.coalesce("_all", F.lit(0)) - tokens + F.col("context_limit") * docs).alias("total_tokens"))


def token_counts(df: DataFrame, text_col: str = "text", rank_path: str | None = None) -> DataFrame:
    """The suffix sums of the lengths of all texts. Null and empty texts have length 0; repeated rows count each; an
    empty table gives no rows; no other column is looked at."""
    return suffix_sums(written(length_histogram(df, text_col, rank_path), "lengths"))


def op3_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"))
