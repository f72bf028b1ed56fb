"""What the operators share: table access, the shared folder, and byte views of Arrow text columns."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a scale-factor folder, by whatever path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """An operator's tables in the shared folder: lineage ends at each, and lost executors cost no recomputation. A table that
    nothing needs any more is dropped; what a lazy result still reads stays, and the session's owner clears it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.tables: list[tuple[DataFrame, str]] = []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}-{len(self.tables)}"
        with shuffles_go(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        for path in (p for t, p in self.tables if any(t is x for x in tables)):
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it has ended: its result is a table, and nothing reads them again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder."""
    return Scratch(df.sparkSession, name).write(df, name)


MOST_HEAVY = 1 << 16


def heavy_keys(df: DataFrame, key: str, least: int) -> DataFrame:
    """key, _parts of the keys that have more than `least` rows of df and more than their 65536th share: so there are at most 65536
    of them, and they may be broadcast. _parts is the number of groups that a key's rows are dealt to."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    most = max(least, -(-df.count() // MOST_HEAVY))
    return counts.where(F.col("_rows") > most).select(key, F.ceil(F.col("_rows") / most).alias("_parts"))


def salted(df: DataFrame, heavy: DataFrame, key: str, other: str) -> DataFrame:
    """df with _salt: rows of a heavy key are dealt out by another column."""
    return df.join(F.broadcast(heavy), key, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(other), F.col("_parts")), F.lit(0).cast("long"))).drop("_parts")


def for_each_salt(df: DataFrame, heavy: DataFrame, key: str) -> DataFrame:
    """df, which has one row for each key, once for each salt of salted()."""
    parts = F.coalesce(F.col("_parts"), F.lit(1).cast("long"))
    return df.join(F.broadcast(heavy), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")


def lean(run: Callable) -> Callable:
    """run for mapInArrow, whose worker gives unused memory back when a task ends: workers live on beside others and the JVM."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps freed pages otherwise
            if trim is not None:
                trim(0)

    return wrapped


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just the id and the text, null read as empty, so that no other column can clash."""
    return df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows in them; null rows are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("" if not pa.types.is_binary(array.type) and not pa.types.is_large_binary(array.type) else b"")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def blocks(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose sizes sum to at most `most`, or of one row."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield at, to
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit words over all of them (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one big-endian number; zeros follow the end."""
    x = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    for width in (1, 2, 4):
        x = (x[: len(x) - width] << np.uint64(8 * width)) | x[width:]
    return x[: len(data)]


def splitmix(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random words from a rule."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * GOLDEN)


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i+1]], 0 for empty segments."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, start + length), one after the other."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) - np.repeat(ends - lengths, lengths) + np.repeat(starts.astype(np.int64), lengths)


def numbered(ids: pa.ChunkedArray) -> tuple[np.ndarray, list | None]:
    """Ids as numbers of the same order, and what they stand for if they are not numbers themselves."""
    if pa.types.is_integer(ids.type):
        return ids.to_numpy(), None
    values = ids.to_pylist()
    ranked = sorted(set(values))
    place = {v: i for i, v in enumerate(ranked)}
    return np.array([place[v] for v in values], np.int64), ranked


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], text: str, most: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches sorted by keys, cut so that each part holds whole groups and at most `most` bytes of text, or one group."""
    ready: list[pa.RecordBatch] = []  # whole groups
    going: list[pa.RecordBatch] = []  # the last group, which the next batch may go on with
    size, going_size, last = 0, 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        new[0] = last != tuple(c[0] for c in columns)
        last = tuple(c[-1] for c in columns)
        before = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)))])
        heads = np.flatnonzero(new)
        if not len(heads):
            going.append(batch)
            going_size += before[-1]
            continue
        at = heads[0]
        if at:
            going.append(batch.slice(0, at))
            going_size += before[at]
        if ready and size + going_size > most:
            yield ready
            ready, size = [], 0
        ready, size = ready + going, size + going_size
        for h, stop in zip(heads[:-1], heads[1:], strict=True):
            if size + before[stop] - before[at] > most and (ready or h > at):
                yield ready + ([batch.slice(at, h - at)] if h > at else [])
                ready, size, at = [], 0, h
        if heads[-1] > at:
            ready.append(batch.slice(at, heads[-1] - at))
            size += before[heads[-1]] - before[at]
        going, going_size = [batch.slice(heads[-1])], before[-1] - before[heads[-1]]
    if ready and size + going_size > most:
        yield ready
        ready = []
    if ready or going:
        yield ready + going
