"""Byte-level BPE encoding and decoding with a two-tier lookup.

Texts are split into pre-tokens on their UTF-8 bytes, whole blocks at a time. A minimal perfect hash of the vocabulary
resolves every pre-token that is a token as it stands, and its bytes are compared. The misses are made distinct by their
bytes, looked up in a worker's bounded memory of earlier ones, and the rest are merged one by one: a heap of byte pairs by rank over
linked byte positions.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, blocks, lean, mix, ranges, segment_sums, table, utf8
from .tokenizer import ranks

LETTER, NUMBER, SPACE, OTHER = range(4)
BLOCK = 1 << 20
BASE = np.uint64(0xD6E8FEB86659FD93)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Misses a worker remembers; the memory is emptied when full.
REMEMBERED = 300_000


@functools.lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point in the pre-token pattern."""
    import regex

    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for found in regex.finditer(pattern, everything):
            lo, hi = found.span()
            for a, b, shift in ((lo, min(hi, 0xD800), 0), (max(lo, 0xD800), hi, 0x800)):
                if a < b:
                    out[a + shift : b + shift] = kind
    return out


@functools.lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, BASE_INVERSE):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(16, int(size).bit_length()))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span. Spans can be built that share one, so it only routes."""
    up, down = powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * GOLDEN)


def edges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last eight bytes of each span; with the length they are all of a span of up to 16 bytes."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    first, last, sizes = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64), ends - starts
    for k in range(8):
        inside = k < sizes
        first |= np.where(inside, padded[starts + k], 0).astype(np.uint64) << np.uint64(8 * k)
        last |= np.where(inside, padded[np.maximum(ends - 1 - k, 0)], 0).astype(np.uint64) << np.uint64(8 * k)
    return first, last


def differ(data: np.ndarray, one: np.ndarray, two: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the spans of these sizes that start at one and at two differ."""
    apart = data[ranges(one, sizes)] != data[ranges(two, sizes)]
    return segment_sums(apart, np.concatenate([[0], np.cumsum(sizes)])) > 0


class PerfectHash:
    """A minimal perfect hash: n keys, n slots. Keys are dealt to buckets; each bucket, the largest first, gets the first
    seed that sends its keys to free slots; a bucket of one key names its slot instead."""

    def __init__(self, keys: np.ndarray):
        n = self.n = max(1, len(keys))
        self.buckets = n // 3 + 1
        self.seeds = np.zeros(self.buckets, np.int64)
        bucket = self._bucket(keys)
        order = np.argsort(bucket, kind="stable")
        heads = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        free = np.ones(n, bool)
        sizes = np.diff(heads)
        for b in np.argsort(-sizes, kind="stable"):
            own = keys[order[heads[b] : heads[b + 1]]]
            if len(own) < 2:
                break
            first, width = 1, 64
            while True:
                slots = self._slot(own[None, :], np.arange(first, first + width, dtype=np.uint64)[:, None])
                good = free[slots].all(1)
                ordered = np.sort(slots[good], axis=1)
                apart = (np.diff(ordered, axis=1) > 0).all(1)
                if apart.any():
                    pick = np.flatnonzero(good)[np.argmax(apart)]
                    self.seeds[b] = first + pick
                    free[slots[pick]] = False
                    break
                first, width = first + width, min(width * 2, 4096)
        alone = np.flatnonzero(sizes == 1)
        self.seeds[alone] = -1 - np.flatnonzero(free)[: len(alone)]

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        return ((keys >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)

    def _slot(self, keys: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        return (mix(keys + seeds * GOLDEN) % np.uint64(self.n)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        seeds = self.seeds[self._bucket(keys)]
        return np.where(seeds < 0, -1 - seeds, self._slot(keys, np.maximum(seeds, 0).astype(np.uint64)))


def merge(piece: bytes, of: dict[bytes, int]) -> list[int]:
    """Ranks of a pre-token's tokens: the pair of lowest rank, leftmost first, is merged until none is left."""
    n = len(piece)
    after, before, end, heap = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), []
    for i in range(n - 1):
        rank = of.get(piece[i : i + 2])
        if rank is not None:
            heap.append((rank, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if end[i] else n
        if j >= n or end[j] != stop:
            continue  # one of the two is gone
        end[i], end[j], after[i] = stop, 0, after[j]
        k, p = after[i], before[i]
        if k < n:
            before[k] = i
            rank = of.get(piece[i : end[k]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, end[k]))
        if p >= 0:
            rank = of.get(piece[p:stop])
            if rank is not None:
                heapq.heappush(heap, (rank, p, stop))
    out, i = [], 0
    while i < n:
        out.append(of[piece[i : end[i]]])
        i = after[i]
    return out


def pre_token_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of the texts begin. The runs of one class decide: the last character of white space goes with
    what follows if it is a space, stands alone if not; an apostrophe with a contraction's letters takes those."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kinds = classes()[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        wide = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
        a, b, c, d = (wide[lead + k] for k in range(4))
        b, c, d = b & 63, c & 63, d & 63
        size = 2 + (a >= 0xE0) + (a >= 0xF0)
        point = np.where(size == 2, (a & 31) << 6 | b, np.where(size == 3, (a & 15) << 12 | b << 6 | c, (a & 7) << 18 | b << 12 | c << 6 | d))
        kind = classes()[np.minimum(point, 0x10FFFF)]
        for k in range(4):
            has = size > k
            kinds[lead[has] + k] = kind[has]
    head = np.ones(n, bool)
    head[1:] = kinds[1:] != kinds[:-1]
    doc_head = np.zeros(n + 1, bool)
    doc_head[offsets] = True
    head |= doc_head[:n]
    runs = np.flatnonzero(head)
    stops = np.concatenate([runs[1:], [n]])
    kind, last_of_doc, first_of_doc = kinds[runs], doc_head[stops], doc_head[runs]
    space_before = np.zeros(len(runs), bool)
    space_before[1:] = (kind[:-1] == SPACE) & (data[runs[1:] - 1] == 32) & ~first_of_doc[1:]
    start = np.zeros(n + 1, bool)
    white = kind == SPACE
    start[(runs - space_before)[~white]] = True
    start[runs[white & last_of_doc]] = True
    inner = white & ~last_of_doc
    lc = stops[inner] - 1  # the first byte of the last character
    for _ in range(3):
        lc = lc - ((data[lc] & 0xC0) == 0x80)
    start[runs[inner][lc > runs[inner]]] = True
    start[lc[data[lc] != 32]] = True
    mark = np.flatnonzero((kind[:-1] == OTHER) & (stops[:-1] - runs[:-1] == 1) & (data[runs[:-1]] == 39) & ~space_before[:-1] & (kind[1:] == LETTER) & ~first_of_doc[1:])
    if len(mark):
        at, stop = runs[mark + 1], stops[mark + 1]
        one = data[at]
        two = np.where(at + 1 < stop, data[np.minimum(at + 1, n - 1)], 0)
        took = np.where(np.isin(one, list(b"stmd")), 1, np.where((two == ord("e")) & np.isin(one, list(b"rv")) | (one == ord("l")) & (two == ord("l")), 2, 0))
        at, stop, took = at[took > 0], stop[took > 0], took[took > 0]
        start[at] = False
        rest = at + took
        start[rest[rest < stop]] = True
    return np.flatnonzero(start[:n])


class Encoder:
    """Encodes blocks of texts; ship it to the workers once."""

    def __init__(self, path: str | None = None):
        self.path = path
        tokens = list(ranks(path).items())
        data, ends = np.frombuffer(b"".join(t for t, _ in tokens), np.uint8), np.cumsum([len(t) for t, _ in tokens])
        starts = np.concatenate([[0], ends[:-1]])
        keys = span_hashes(data, starts, ends)
        self.hash = PerfectHash(keys)
        place = self.hash.slots(keys)
        first, last = edges(data, starts, ends)
        self.keys, self.first, self.last, self.sizes, self.ids = (np.zeros_like(x) for x in (keys, first, last, starts, starts))
        self.keys[place], self.first[place], self.last[place], self.sizes[place], self.ids[place] = keys, first, last, ends - starts, [r for _, r in tokens]
        self.seen: dict[bytes, list[int]] = {}

    def __getstate__(self):
        return self.__dict__ | {"seen": {}}

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the offsets of each text's ids."""
        of = ranks(self.path)
        starts = pre_token_starts(data, offsets)
        ends = np.concatenate([starts[1:], [len(data)]]).astype(np.int64) if len(starts) else starts
        keys, sizes = span_hashes(data, starts, ends), ends - starts
        first, last = edges(data, starts, ends)
        slot = self.hash.slots(keys)
        hit = (self.keys[slot] == keys) & (self.sizes[slot] == sizes) & (self.first[slot] == first) & (self.last[slot] == last)
        raw = data.tobytes()
        for i in np.flatnonzero(hit & (sizes > 16)).tolist():
            hit[i] = of.get(raw[starts[i] : ends[i]]) == self.ids[slot[i]]
        miss = np.flatnonzero(~hit)
        order = miss[np.argsort(keys[miss])]
        new = np.ones(len(order), bool)
        for x in (keys, sizes, first, last):
            new[1:] = (x[order[1:]] != x[order[:-1]]) if x is keys else new[1:] | (x[order[1:]] != x[order[:-1]])
        long = np.flatnonzero(~new & (sizes[order] > 16))  # the two edges hold all bytes of the others
        new[long] = differ(data, starts[order[long]], starts[order[long - 1]], sizes[order[long]])
        heads = order[new]
        merged: list[list[int]] = []
        seen = self.seen
        for a, b in zip(starts[heads].tolist(), ends[heads].tolist(), strict=True):
            piece = raw[a:b]
            ids = seen.get(piece)
            if ids is None:
                ids = merge(piece, of)
                if b - a <= 64:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[piece] = ids
            merged.append(ids)
        lengths = np.fromiter(map(len, merged), np.int64, len(merged))
        pool = np.fromiter((i for ids in merged for i in ids), np.int64, int(lengths.sum()))
        group = np.zeros(len(starts), np.int64)
        group[order] = np.cumsum(new) - 1
        count = np.ones(len(starts), np.int64)
        count[miss] = lengths[group[miss]]
        from_pool = np.cumsum(lengths) - lengths
        begin = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int32)
        out[begin[hit]] = self.ids[slot[hit]]
        out[ranges(begin[miss], count[miss])] = pool[ranges(from_pool[group[miss]], count[miss])]
        heads_of_docs = np.searchsorted(starts, offsets)
        return out, np.concatenate([begin, [len(out)]])[heads_of_docs]


def bpe_encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_path: str | None = None) -> DataFrame:
    """id, ids array<int>: the BPE ids of every whole text, without special tokens.

    Defined cases: null and empty texts have no ids (an empty array); repeated rows and null ids each give a row; an
    empty table gives an empty result; other columns are not looked at. Texts are taken in blocks of whole texts, so
    memory follows the longest text and not the partition.
    """
    shared = df.sparkSession.sparkContext.broadcast(Encoder(rank_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for at, to in blocks(np.diff(offsets), BLOCK):
                ids, ends = encoder.encode(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))], names=[batch.schema.names[0], "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(lean(run), f"`{id_col}` {kind}, ids array<int>")


def bpe_decode(df: DataFrame, ids_col: str = "ids", out_col: str = "decoded", rank_path: str | None = None) -> DataFrame:
    """df with out_col binary: the bytes of the ids. A null array gives null; an id outside the vocabulary is an error."""
    if out_col in df.columns:
        raise ValueError(f"{out_col} is a column already")
    at, schema = df.columns.index(ids_col), df.withColumn(out_col, F.lit(None).cast("binary")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = {rank: token for token, rank in ranks(rank_path).items()}.__getitem__
        for batch in batches:
            ids = batch.column(at)
            flat, offsets, null = ids.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]), ids.is_null().to_numpy(zero_copy_only=False)
            texts = [None if null[i] else b"".join(map(of, flat[offsets[i] : offsets[i + 1]].tolist())) for i in range(len(ids))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, out_col])

    return df.mapInArrow(lean(run), schema)


def op5_bpe(spark, sf_dir):
    both = bpe_decode(bpe_encode(table(spark, sf_dir, "documents")))
    decimal = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
