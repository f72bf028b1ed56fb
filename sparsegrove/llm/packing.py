"""Packing along a space-filling curve.

Each document is encoded once and its tokens hashed into a few projected dimensions; the point's place on a Hilbert
curve, with the hashed id below it against ties, is its sort key. Keys are cut into buckets at their quantiles, the
buckets' token totals give every bucket its place in one long stream, and each bucket is sorted and cut on its own.
Sequences are the stream cut at every seq_len tokens; what is left at the end is cut into powers of two, so that no
sequence needs padding.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, lean, ranges, segment_sums, splitmix, table, written

DIMS, BITS = 4, 8
#: Tokens of a bucket, and the most buckets that the driver keeps totals of; beyond that buckets grow.
BUCKET_TOKENS, MOST_BUCKETS = 1 << 18, 1 << 14
#: Bytes that a task encodes or cuts at once.
BLOCK = 1 << 20


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of integer points (rows), by Skilling's transposition."""
    x = points.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(high, q - 1, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def encoded(df: DataFrame, id_col: str, text_col: str, end_id: int | None) -> DataFrame:
    """_id, _ids (little-endian unsigned 16-bit ids), _n (with the end id), _p (projected document vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokenizer import token_ids

        signs = (splitmix((1 << 16) * DIMS, 5).reshape(-1, DIMS) >> np.uint64(63)).astype(np.int8) * np.int8(2) - np.int8(1)
        end = [] if end_id is None else [end_id]
        for batch in batches:
            for lo, hi in blocks(np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0)), BLOCK):
                part = batch.slice(lo, hi - lo)
                found = token_ids([t or "" for t in part.column(1).to_pylist()])
                sizes = np.fromiter(map(len, found), np.int64, len(found))
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                flat = np.fromiter((i for ids in found for i in ids), np.int32, int(offsets[-1]))
                sums = np.stack([segment_sums(signs[flat, d], offsets) for d in range(DIMS)], 1) / np.sqrt(np.maximum(sizes, 1))[:, None]
                ids = [np.array(x + end, "<u2").tobytes() for x in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(sizes + len(end)), pa.array(list(sums), pa.list_(pa.float64()))], names=["_id", "_ids", "_n", "_p"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(lean(run), f"_id {kind}, _ids binary, _n long, _p array<double>")


def curve_key(moments: list[tuple[float, float]], bounds: np.ndarray) -> Column:
    """key and bucket: the 63-bit sort key, which is the Hilbert place of the standardised vector, then hashed bits of the id, and
    its place among the bounds. One call gives both, so that a task needs one worker."""
    mean, spread = np.array([m for m, _ in moments]), np.array([max(s, 1e-9) for _, s in moments])

    @F.pandas_udf("key long, bucket int")
    def place(p: pd.Series, low: pd.Series) -> pd.DataFrame:
        z = (np.array(p.tolist()).reshape(-1, DIMS) - mean) / spread
        cells = ((np.tanh(z * 0.8) + 1) * (1 << (BITS - 1))).astype(np.int64).clip(0, (1 << BITS) - 1)
        key = hilbert(cells) << 31 | low.to_numpy()
        return pd.DataFrame({"key": key, "bucket": np.searchsorted(bounds, key, "right").astype(np.int32)})

    return place("_p", F.shiftrightunsigned(F.xxhash64("_id"), 33))


def tail_cuts(total: int, seq_len: int) -> np.ndarray:
    """Starts of the sequences that follow the last whole one: the rest in powers of two, the largest first."""
    at, rest = total - total % seq_len, total % seq_len
    out = []
    for bit in range(rest.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            out.append(at)
            at += 1 << bit
    return np.array(out, np.int64)


def cut_pieces(start: np.ndarray, sizes: np.ndarray, tail: np.ndarray, total: int, seq_len: int) -> tuple[np.ndarray, ...]:
    """Row, start in the document, length, sequence and offset of every piece of documents that lie at start."""
    full = total // seq_len

    def sequence(at: np.ndarray) -> np.ndarray:
        return np.where(at < full * seq_len, at // seq_len, full - 1 + np.searchsorted(tail, at, "right"))

    def first(seq: np.ndarray) -> np.ndarray:
        return np.where(seq < full, seq * seq_len, np.concatenate([tail, [total]])[np.clip(seq - full, 0, len(tail))])

    lo, hi = sequence(start), sequence(start + np.maximum(sizes, 1) - 1)
    count = np.where(sizes > 0, hi - lo + 1, 0)
    row = np.repeat(np.arange(len(start)), count)
    seq = ranges(lo, count)
    begin = np.maximum(first(seq), start[row])
    end = np.minimum(first(seq + 1), (start + sizes)[row])
    return row, begin - start[row], end - begin, seq, begin - first(seq)


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seq_len: int = 1024, end_id: int | None = 0) -> DataFrame:
    """One row per piece: id, start (the document's ids before it), length, ids (little-endian unsigned 32-bit), doc_tokens
    (with the end id), sequence_id, offset.

    Every id lies in exactly one piece and every sequence is full: all have seq_len ids, but for at most one of each
    smaller power of two at the end. Defined cases: a null or empty text is the end id alone (no piece where end_id is
    None); repeated rows and null ids are documents of their own; an empty table gives no pieces; other columns are not
    looked at. A token never is dropped, however long its document.
    """
    spark = df.sparkSession
    ids = written(encoded(df, id_col, text_col, end_id), "packing")
    each = [F.element_at("_p", d + 1) for d in range(DIMS)]
    first = ids.agg(F.sum("_n"), *[f(x) for x in each for f in (F.avg, F.stddev_pop)]).first()
    total = first[0] or 0
    moments = [(first[1 + 2 * d] or 0.0, first[2 + 2 * d] or 0.0) for d in range(DIMS)]
    n = max(1, math.ceil(total / max(BUCKET_TOKENS, total / MOST_BUCKETS)))
    keys = ids.select(curve_key(moments, np.zeros(0, np.int64))["key"].alias("_key"))
    cuts = keys.agg(F.percentile_approx("_key", [i / n for i in range(1, n)], 10 * n)).first()[0] if n > 1 and total else []
    bounds = np.array(sorted(set(cuts or [])), np.int64)
    dealt = ids.withColumn("_at", curve_key(moments, bounds)).select("_id", "_ids", "_n", F.col("_at.key").alias("_key"), F.col("_at.bucket").alias("_bucket"))
    sums = {r["_bucket"]: r["_sum"] for r in dealt.groupBy("_bucket").agg(F.sum("_n").alias("_sum")).collect()}
    begins, at = {}, 0
    for b in sorted(sums):
        begins[b], at = at, at + sums[b]
    begins, tail = spark.sparkContext.broadcast(begins), tail_cuts(total, seq_len)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, at = None, 0
        for whole in batches:
            for lo, hi in blocks(whole.column(3).to_numpy(), BLOCK):
                batch = whole.slice(lo, hi - lo)
                buckets, sizes = batch.column(0).to_numpy(), batch.column(3).to_numpy()
                before = np.concatenate([[0], np.cumsum(sizes)])
                heads = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
                start = np.zeros(len(buckets), np.int64)
                for h, e in zip(heads, [*heads[1:], len(buckets)], strict=True):
                    if buckets[h] != current:
                        current, at = buckets[h], begins.value[buckets[h]]
                    start[h:e] = at + before[h:e] - before[h]
                    at += before[e] - before[h]
                row, begin, length, seq, offset = cut_pieces(start, sizes, tail, total, seq_len)
                data = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u2").astype("<u4")
                flat = data[ranges(before[row] + begin, length)]
                ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32) * 4
                binary = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
                columns = [batch.column(1).take(pa.array(row)), pa.array(begin), pa.array(length), binary, pa.array(sizes[row]), pa.array(seq), pa.array(offset)]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    kind = df.schema[id_col].dataType.simpleString()
    parts = max(1, min(n, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    placed = dealt.select("_bucket", "_id", "_ids", "_n", "_key").repartition(parts, "_bucket").sortWithinPartitions("_bucket", "_key", "_id", "_ids")
    return placed.mapInArrow(lean(run), f"`{id_col}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def op9_packing(spark, sf_dir):
    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
