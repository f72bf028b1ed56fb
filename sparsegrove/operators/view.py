"""Tables behind contribution grids: column scores, merged predictions, row and column choice.

Predictions are long: seq_id, response, field, contribution, and sps, spp by sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def clean(c):
    """NaN and null as 0."""
    return F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0))


def column_scores(long: DataFrame) -> DataFrame:
    """field, ssq (sum of squares), total (sum, NaN if one is), afgsc (mean |x| over rows with response 1)."""
    x = clean("contribution")
    return long.groupBy("field").agg(F.sum(x * x).alias("ssq"), F.sum("contribution").alias("total"), F.avg(F.when(F.col("response") == 1, F.abs(x))).alias("afgsc"))


def merge_predictions(tables: DataFrame) -> DataFrame:
    """seq_id, field, contribution: the mean over the tables that have the cell (NaN stays NaN). tables: table_id, seq_id, field,
    contribution."""
    return tables.groupBy("seq_id", "field").agg(F.avg("contribution").alias("contribution"))


def check_same_rows(tables: DataFrame) -> None:
    """Tables that do not list the same sequences are an error."""
    sizes = tables.select("table_id", "seq_id").distinct().groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"))
    n = tables.select("table_id").distinct().count()
    if not sizes.where(F.col("n") < n).isEmpty():
        raise ValueError("the tables list different sequences")


def top_fields(scores: DataFrame, limit: int, by: str = "ssq", cutoff: float = 0.0) -> DataFrame:
    """field, score, col_ord of the best fields with a score from the cutoff on; ties by name."""
    best = scores.where(F.col(by) >= cutoff).select("field", F.col(by).alias("score")).orderBy(F.desc("score"), "field").limit(limit)
    return best.withColumn("col_ord", F.row_number().over(Window.orderBy(F.desc("score"), "field")))  # `limit` rows


def ordered_rows(people: DataFrame, limit: int, m_grid: bool = False) -> DataFrame:
    """seq_id, response, sps, spp, row_ord: by response, then by spp * response (falling; rising in an M-grid); an M-grid only has
    rows with a response over 0.99. people: seq_id, response, sps, spp."""
    key = F.coalesce(F.col("spp"), F.lit(0.0)) * F.coalesce(F.nanvl("response", F.lit(0.0)), F.lit(0.0))
    chosen = people.where("response > 0.99") if m_grid else people
    order = [F.desc_nulls_last("response"), key.asc() if m_grid else key.desc(), F.col("seq_id").asc()]
    return chosen.orderBy(*order).limit(limit).withColumn("row_ord", F.row_number().over(Window.orderBy(*order)))


def grid_cells(long: DataFrame, rows: DataFrame, fields: DataFrame) -> DataFrame:
    """row_ord, col_ord, seq_id, field, value, missing, label (spp cut at 0), bound (largest |value|): what a heat map shows.
    rows and fields are the bounded choices above."""
    cells = rows.select("row_ord", "seq_id", F.greatest(F.coalesce("spp", F.lit(0.0)), F.lit(0.0)).alias("label")).join(long.join(F.broadcast(fields.select("field", "col_ord")), "field").select("seq_id", "field", "col_ord", "contribution"), "seq_id")
    missing = F.col("contribution").isNull() | F.isnan("contribution")
    return cells.select("row_ord", "col_ord", "seq_id", "field", F.when(~missing, F.col("contribution")).alias("value"), missing.alias("missing"), "label", F.max(F.when(~missing, F.abs("contribution"))).over(Window.partitionBy()).alias("bound"))


def wide(long: DataFrame, fields: list[str]) -> DataFrame:
    """One column for each of the given fields."""
    return long.groupBy("seq_id").pivot("field", fields).agg(F.first("contribution"))
