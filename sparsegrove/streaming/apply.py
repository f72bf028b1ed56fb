"""A fitted model over a stream of new sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import normalize_sequence


def score_stream(sequences: DataFrame, model: DataFrame, intercept: float, data_type: str = "universal") -> DataFrame:
    """gene, seq_id, contribution for each arriving record (gene, seq_id, seq). Nothing is kept between records: a model's bits
    are joined as a map for each gene, so the stream needs neither state nor watermark. intercept is spread by the reader, once
    for each sequence."""
    at = F.concat_ws("_", F.col("pos").cast("string"), F.col("allele"))
    maps = model.where("beta <> 0").groupBy("gene").agg(F.map_from_entries(F.collect_list(F.struct(at, "beta"))).alias("_bits"), F.lit(intercept).alias("intercept"))
    chars = F.split(normalize_sequence(F.col("seq"), data_type), "")
    hit = lambda c, i: F.coalesce(F.try_element_at(F.col("_bits"), F.concat_ws("_", i.cast("string"), c)), F.lit(0.0))
    total = F.aggregate(F.transform(chars, hit), F.lit(0.0), lambda a, x: a + x)
    return sequences.join(maps, "gene").select("gene", "seq_id", total.alias("contribution"), "intercept")
