"""Column expressions that several operators share; all of them stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Value domains of sequence characters (fixed values).
ALPHABETS = {
    "nucleotide": "ATCGU",
    "protein": "ACDEFGHIKLMNPQRSTVWY",
    "molecular": "ACDEFGHIKLMNPQRSTVWYU",
}
GAP = "-"


def normalize_sequence(seq: Column, data_type: str = "universal") -> Column:
    """Characters outside a restricted alphabet become gaps and its letters upper case; a `?` always is a gap.

    Unknown type names count as universal. The alphabet test comes before the upper-casing, so that letters whose upper
    case has several characters do not shift positions."""
    letters = ALPHABETS.get(data_type)
    if letters is None:
        return F.translate(seq, "?", GAP)
    return F.upper(F.regexp_replace(seq, f"[^{letters}{letters.lower()}]", GAP))


def soft_threshold(v: Column, level: Column) -> Column:
    """sign(v) * max(|v| - level, 0)."""
    return F.signum(v) * F.greatest(F.abs(v) - level, F.lit(0.0))


def shrink_factor(norm: Column, level: Column) -> Column:
    """max(0, 1 - level / norm), 0 for a zero norm."""
    return F.when(norm > level, 1 - level / norm).otherwise(F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def feature_name(gene: Column, pos: Column, allele: Column | None = None) -> Column:
    """gene_pos_allele, or gene_pos for numeric features."""
    parts = [gene, pos.cast("string")] + ([] if allele is None else [allele])
    return F.concat_ws("_", *parts)


def name_parts(name: Column) -> tuple[Column, Column, Column]:
    """gene, position and allele of a feature name; the gene may hold underscores."""
    pattern = "^(.*)_([0-9]+)_(.)$"
    return F.regexp_extract(name, pattern, 1), F.regexp_extract(name, pattern, 2).cast("int"), F.regexp_extract(name, pattern, 3)


def lambda_label(text: Column) -> Column:
    """The part of a model's file name that a penalty gives: a leading `0.` goes."""
    return F.concat(F.lit("_"), F.regexp_replace(text, r"^0\.", ""))


def shared_hash(key: Column, seed: int = 0) -> Column:
    """A hash that SQL engines can share: (key mod 2^31 + seed) * 2654435761 mod 2^32."""
    return F.pmod((F.pmod(key.cast("long"), F.lit(2147483648)) + F.lit(seed)) * F.lit(2654435761), F.lit(4294967296))
