"""Quality scores by a factorisation machine.

A document is a sparse vector: its hashed words, weighted by how often they occur and scaled to length one, and a handful of
statistics of its structure and metadata. The machine adds to the linear score the low-rank interactions of all pairs
of features, in linear time: for each rank, half of the squared sum less the sum of squares. It is fitted on a bounded
sample of labelled rows and scores every document in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, lean, ranges, table, utf8
from .language_id import fold
from .words import words

BUCKETS = 1 << 14
BLOCK = 1 << 21
STATISTICS = ("log_bytes", "log_words", "word_length", "letters", "digits", "capitals", "symbols", "spaces", "high_bytes", "lines", "line_words", "distinct_words", "common_word", "doubled_words", "log_n_chars")


def byte_kinds() -> np.ndarray:
    """For each byte: letter, digit, capital, symbol, white space, high byte (columns)."""
    b = np.arange(256)
    capital = (b >= 65) & (b <= 90)
    letter = capital | (b >= 97) & (b <= 122) | (b >= 128)
    digit, space, high = (b >= 48) & (b <= 57), (b == 32) | (b >= 9) & (b <= 13), b >= 128
    return np.stack([letter, digit, capital, ~(letter | digit | space), space, high], 1).astype(np.float64)


KINDS = byte_kinds()


@dataclass
class Features:
    """Sparse rows: indices and values between offsets; statistics: one dense row each."""

    indices: np.ndarray
    values: np.ndarray
    offsets: np.ndarray
    statistics: np.ndarray


def features(data: np.ndarray, offsets: np.ndarray, n_chars: np.ndarray) -> Features:
    """Of every text. An empty text has no words and statistics of 0."""
    rows, sizes = len(offsets) - 1, np.diff(offsets)
    hashes, lengths, row = words(data, offsets)
    bucket = (hashes % np.uint64(BUCKETS)).astype(np.int64)
    key = np.sort(row * BUCKETS + bucket)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    often = np.diff(np.concatenate([at, [len(key)]]))
    owner, index = key[at] // BUCKETS, key[at] % BUCKETS
    value = 1 + np.log(often)
    norm = np.sqrt(np.bincount(owner, weights=value**2, minlength=rows))
    value = value / norm[owner] if len(owner) else value
    n_words = np.bincount(row, minlength=rows)
    kinds = np.stack([np.diff(np.concatenate([[0], np.cumsum(KINDS[:, k].astype(bool)[data])])[offsets]) for k in range(KINDS.shape[1])], 1)
    lines = np.diff(np.concatenate([[0], np.cumsum(data == 10)])[offsets]) + (sizes > 0)
    twice = np.zeros(len(hashes), bool)
    twice[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    some, most = np.maximum(n_words, 1), np.zeros(rows)
    np.maximum.at(most, owner, often)
    share = kinds / np.maximum(sizes, 1)[:, None]
    statistics = np.column_stack([np.log1p(sizes), np.log1p(n_words), np.bincount(row, weights=lengths, minlength=rows) / some, share, np.log1p(lines), n_words / np.maximum(lines, 1), np.bincount(owner, minlength=rows) / some, most / some, np.bincount(row, weights=twice, minlength=rows) / some, np.log1p(np.maximum(n_chars, 0))])
    return Features(index, value, np.searchsorted(owner, np.arange(rows + 1)), statistics)


class FactorisationMachine:
    """Weights of BUCKETS hashed words and the statistics; fitted by Adagrad on the logistic loss."""

    def __init__(self, rank: int = 8, seed: int = 7):
        self.rank = rank
        n = BUCKETS + len(STATISTICS)
        self.bias, self.linear = 0.0, np.zeros(n)
        self.factors = np.random.default_rng(seed).normal(0, 0.05, (n, rank))
        self.mean, self.spread = np.zeros(len(STATISTICS)), np.ones(len(STATISTICS))

    def rows(self, x: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words and standardised statistics as one sparse matrix."""
        n, k = len(x.offsets) - 1, len(STATISTICS)
        sizes = np.diff(x.offsets)
        offsets = np.concatenate([[0], np.cumsum(sizes + k)])
        index, value = np.empty(offsets[-1], np.int64), np.empty(offsets[-1])
        to = ranges(offsets[:-1], sizes)
        index[to], value[to] = x.indices, x.values
        to = ranges(offsets[1:] - k, np.full(n, k))
        index[to] = np.tile(np.arange(BUCKETS, BUCKETS + k), n)
        value[to] = np.clip((x.statistics - self.mean) / self.spread, -6, 6).ravel() / np.sqrt(k)
        return index, value, offsets

    def raw(self, index: np.ndarray, value: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and the summed factors of each row."""
        part = self.factors[index] * value[:, None]
        sums = np.add.reduceat(part, offsets[:-1], axis=0)
        squares = np.add.reduceat((part**2).sum(1), offsets[:-1])
        return self.bias + np.add.reduceat(self.linear[index] * value, offsets[:-1]) + 0.5 * ((sums**2).sum(1) - squares), sums

    def fit(self, x: Features, y: np.ndarray, epochs: int | None = None, batch: int = 64, rate: float = 0.1, decay: float = 1e-4, seed: int = 3) -> FactorisationMachine:
        rng, n = np.random.default_rng(seed), len(y)
        epochs = epochs or max(8, min(60, 24_000 // max(1, n)))
        if not n or y.min() == y.max():  # nothing to tell apart
            self.bias = 0.0 if not n else (4.0 if y[0] else -4.0)
            return self
        self.mean, self.spread = x.statistics.mean(0), np.maximum(x.statistics.std(0), 1e-6)
        index, value, offsets = self.rows(x)
        self.bias = float(np.log(y.mean() / (1 - y.mean())))
        g_bias, g_linear, g_factors = 1.0, np.full(len(self.linear), 1e-2), np.full(self.factors.shape, 1e-2)
        for _ in range(epochs):
            order = rng.permutation(n)
            for at in range(0, n, batch):
                take = order[at : at + batch]
                sizes = np.diff(offsets)[take]
                where = ranges(offsets[take], sizes)
                i, v, o = index[where], value[where], np.concatenate([[0], np.cumsum(sizes)])
                score, sums = self.raw(i, v, o)
                error = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - y[take]
                row = np.repeat(np.arange(len(take)), sizes)
                e = error[row] * v
                hot, back = np.unique(i, return_inverse=True)
                d_linear = np.bincount(back, weights=e, minlength=len(hot)) + decay * self.linear[hot]
                slope = e[:, None] * (sums[row] - self.factors[i] * v[:, None])
                d_factors = np.stack([np.bincount(back, weights=slope[:, r], minlength=len(hot)) for r in range(self.rank)], 1) + decay * self.factors[hot]
                g_bias += error.sum() ** 2
                g_linear[hot] += d_linear**2
                g_factors[hot] += d_factors**2
                self.bias -= rate * error.sum() / np.sqrt(g_bias)
                self.linear[hot] -= rate * d_linear / np.sqrt(g_linear[hot])
                self.factors[hot] -= rate * d_factors / np.sqrt(g_factors[hot])
        return self

    def score(self, x: Features) -> np.ndarray:
        """Probabilities of label 1."""
        if len(x.offsets) < 2:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.raw(*self.rows(x))[0], -30, 30)))


def feature_rows(df: DataFrame, id_col: str, text_col: str, chars_col: str) -> DataFrame:
    """_id, _index, _value, _statistics of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            chars = batch.column(2).fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
            for at, to in blocks(np.diff(offsets), BLOCK):
                x = features(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], chars[at:to])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.ListArray.from_arrays(pa.array(x.offsets, pa.int32()), pa.array(x.indices, pa.int32())), pa.ListArray.from_arrays(pa.array(x.offsets, pa.int32()), pa.array(x.values)), pa.array(list(x.statistics), pa.list_(pa.float64()))], names=["_id", "_index", "_value", "_statistics"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(chars_col).alias("_chars")).mapInArrow(lean(run), f"_id {kind}, _index array<int>, _value array<double>, _statistics array<double>")


def fit_quality(df: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", label_col: str = "quality", sample_rows: int = 4096, rank: int = 8, epochs: int | None = None) -> FactorisationMachine:
    """A machine fitted on at most sample_rows labelled rows, those with the smallest hashed ids where learn (of the id)
    holds. The sample is bounded, so its ids are broadcast to the documents and its features come to the driver. Rows
    whose label or id is null are not used."""
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & learn)
    sample = usable.select(F.col(id_col).alias("_label_id"), F.col(label_col).cast("double").alias("_y")).orderBy(F.xxhash64("_label_id"), "_y").limit(sample_rows)
    picked = df.select(F.col(id_col), F.col(text_col), F.col(chars_col)).join(F.broadcast(sample), F.col(id_col) == F.col("_label_id"), "left_semi")
    found = feature_rows(picked, id_col, text_col, chars_col).join(F.broadcast(sample), F.col("_id") == F.col("_label_id")).groupBy("_id", "_y").agg(F.min(F.struct("_index", "_value", "_statistics")).alias("_x"))  # one row for each id
    found = found.select("_id", "_y", "_x._index", "_x._value", "_x._statistics").toPandas().sort_values(["_id", "_y"])
    machine = FactorisationMachine(rank)
    if not len(found):
        return machine
    offsets = np.concatenate([[0], np.cumsum(found["_index"].map(len))])
    x = Features(np.concatenate(found["_index"].tolist()).astype(np.int64), np.concatenate(found["_value"].tolist()), offsets, np.array(found["_statistics"].tolist()))
    return machine.fit(x, found["_y"].to_numpy(), epochs=epochs)


def score_quality(df: DataFrame, machine: FactorisationMachine, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """id, score, predicted for every row.

    Defined cases: a null text is an empty one and is scored by its statistics; a null n_chars counts as 0; without any
    labelled row every score is 0.5; repeated rows and null ids each give a row; an empty table gives an empty result;
    other columns are not looked at.
    """
    shared = df.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            chars = batch.column(2).fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
            for at, to in blocks(np.diff(offsets), BLOCK):
                score = shared.value.score(features(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], chars[at:to]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[batch.schema.names[0], "score", "predicted"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col), F.col(chars_col)).mapInArrow(lean(run), f"`{id_col}` {kind}, score double, predicted int")


def op2_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    machine = fit_quality(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 4) != 2)
    return score_quality(docs, machine).select("doc_id", held_out.alias("held_out"), "score", "predicted")
