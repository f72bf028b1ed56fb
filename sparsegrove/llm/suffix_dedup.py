"""Removal of repeated byte strings by suffix arrays.

Every string of `length` bytes that occurs again must meet its other occurrences in one suffix array, wherever its document
lies. Each string is therefore owned by its anchor, the smallest-hashed k-gram in it, which is the same for equal strings;
neighbouring strings of a document mostly share theirs. An anchor's strings in one place, with the bytes that they cover, are
a piece. Anchors that occur once cannot hold a repeat and go no further. Pieces that are equal as a whole (128 bits of BLAKE2b,
salted anew for each run) are one: all strings of all but the first start earlier too. They are put together within each block of
texts first, so that a passage that very many documents share reaches its reducer once a block. Only anchors that then
still have different pieces need their bytes; those go to the anchor's shard, and an anchor with very many pieces is dealt to
several shards.

A shard sorts its suffixes by Larsson and Sadakane's refinement: ranks of 8 bytes, then of twice as many, and only groups
that are not yet sorted are sorted again. Kasai's argument gives the common prefixes of neighbours: where both step on by
one byte, the prefix is one shorter, so only the heads of such chains are compared. Runs of common prefixes of `length` or
more are equal strings; the first by (id, position) stays. What is first in one of several shards of an anchor is held
against the others' by binary search in their sorted lists.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, blocks, eight_bytes, for_each_salt, heavy_keys, lean, mix, numbered, ranges, salted, table, utf8, whole_groups

GRAM = 24
BLOCK = 1 << 20
#: Suffixes that are sorted at once: three numbers below it fit a 63-bit key.
INDEX_BITS = 21
#: Pieces of an anchor in one shard, beyond which they are dealt to several; and bytes, of which two strings have at most as many.
SHARD, SHARD_BYTES = 1024, 1 << 19
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the anchor, text's row, first owned start in the text and number of owned starts, for each anchor."""
    sizes = np.diff(offsets)
    starts = np.maximum(sizes - length + 1, 0)
    if not starts.any():
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    x = eight_bytes(data)
    n = len(data) - GRAM + 1
    h = mix(x[:n] * M1 + x[8 : n + 8] * M2 + x[16 : n + 16] * M3)
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    window, width = length - GRAM + 1, 1
    while width * 2 <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < window:
        least = np.minimum(least[: len(least) - (window - width)], least[window - width :])
    at = ranges(offsets[:-1], starts)
    anchor = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), starts)
    head = np.ones(len(at), bool)
    head[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    heads = np.flatnonzero(head)
    return h[anchor[heads]], row[heads], at[heads] - offsets[row[heads]], np.diff(np.concatenate([heads, [len(at)]]))


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: bytes) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of BLAKE2b of each span, as two numbers."""
    raw = data.tobytes()
    found = b"".join([blake2b(raw[a:b], digest_size=16, salt=salt).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    both = np.frombuffer(found, np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def block_pieces(ids: pa.Array, data: np.ndarray, offsets: np.ndarray, length: int, salt: bytes) -> pa.RecordBatch:
    """_span, _anchor, _hash, _more, _id, _start, _count: the pieces of a block of texts; of equal ones the first stays, and the others
    are spans whose key is their own."""
    h, row, start, count = anchors(data, offsets, length)
    begin = offsets[row] + start
    piece, more = digests(data, begin, begin + count + length - 1, salt)
    key = mix(h ^ piece)
    order = np.argsort(key)
    new = np.ones(len(order), bool)
    for x in (h, piece, more):
        new[1:] = (x[order[1:]] != x[order[:-1]]) if x is h else new[1:] | (x[order[1:]] != x[order[:-1]])
    group = np.cumsum(new) - 1
    span, drop = np.zeros(len(h), bool), np.zeros(len(h), bool)
    many = np.bincount(group, minlength=len(order))[group] > 1 if len(order) else new
    if many.any():
        at, of = order[many], group[many]
        number, _ = numbered(pa.chunked_array([ids]))
        by = np.lexsort((start[at], number[row[at]], of))
        at, of = at[by], of[by]
        later = np.zeros(len(at), bool)
        later[1:] = of[1:] == of[:-1]
        twice = np.zeros(len(at), bool)
        twice[1:] = later[1:] & (number[row[at[1:]]] == number[row[at[:-1]]]) & (start[at[1:]] == start[at[:-1]])  # a row given twice
        span[at], drop[at] = later, twice
    anchor = np.where(span, mix(key + begin.astype(np.uint64) * M3), h).view(np.int64)
    keep = ~drop
    return pa.RecordBatch.from_arrays([pa.array(span[keep]), pa.array(anchor[keep]), pa.array(piece.view(np.int64)[keep]), pa.array(more.view(np.int64)[keep]), ids.take(pa.array(row[keep])), pa.array(start[keep]), pa.array(count[keep].astype(np.int64))], names=["_span", "_anchor", "_hash", "_more", "_id", "_start", "_count"])


def suffix_array(data: np.ndarray, room: np.ndarray, depth: int) -> np.ndarray:
    """Positions whose room (bytes to the end of their text) is at least depth, sorted by their first depth bytes.

    Ranks are places of groups in the order. Each pass doubles the bytes that ranks stand for, the last one overlaps; only
    positions in groups of several are sorted again, by (rank, rank of what follows, position) in one 63-bit key."""
    bits, n = np.uint64(INDEX_BITS), len(data)
    if n > 1 << INDEX_BITS:
        raise ValueError("too many suffixes for one array")
    known = min(8, depth)
    live = np.flatnonzero(room >= known)
    word = eight_bytes(data)[live] >> np.uint64(64 - 8 * known)
    order = np.argsort(word)
    rank = np.zeros(n, np.int64)
    rank[live[order]] = group_places(word[order])
    while known < depth:
        step = min(known, depth - known)
        known += step
        live = live[room[live] >= known]
        held = rank[live]
        several = live[np.bincount(held, minlength=n)[held] > 1]
        key = (rank[several].astype(np.uint64) << bits | rank[several + step].astype(np.uint64)) << bits | several.astype(np.uint64)
        key.sort()
        where = (key & np.uint64((1 << INDEX_BITS) - 1)).astype(np.int64)
        pair = key >> bits
        old = (pair >> bits).astype(np.int64)
        new = old.copy()
        if len(key):
            first_old = np.flatnonzero(np.concatenate([[True], old[1:] != old[:-1]]))
            new = old + group_places(pair) - np.repeat(first_old, np.diff(np.concatenate([first_old, [len(key)]])))
        rank[where] = new
    return live[np.argsort(rank[live], kind="stable")]


def group_places(ordered: np.ndarray) -> np.ndarray:
    """For each of sorted values the place of the first one equal to it."""
    head = np.ones(len(ordered), bool)
    head[1:] = ordered[1:] != ordered[:-1]
    return np.maximum.accumulate(np.where(head, np.arange(len(ordered)), 0))


def common_prefixes(data: np.ndarray, room: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each suffix of the order shares with the one before it, within both texts. Where a suffix and its
    predecessor are both one byte on from another such pair, the prefix is one shorter; only the others are compared."""
    before = np.full(len(data) + 1, -2, np.int64)
    before[order[1:]] = order[:-1]
    places = np.sort(order)
    prior = before[places]
    chained = np.zeros(len(places), bool)
    chained[1:] = (places[1:] == places[:-1] + 1) & (prior[1:] == prior[:-1] + 1) & (prior[:-1] >= 0)
    chained[1:] &= (room[places[1:]] < room[places[:-1]]) & (room[np.maximum(prior[1:], 0)] < room[np.maximum(prior[:-1], 0)])  # in one text
    heads = np.flatnonzero(~chained)
    p, q = places[heads], prior[heads]
    shared = np.zeros(len(heads), np.int64)
    most = np.where(q >= 0, np.minimum(room[p], room[np.maximum(q, 0)]), 0)
    word = np.concatenate([eight_bytes(data), np.zeros(8, np.uint64)])
    going = np.flatnonzero(most > 0)
    while len(going):
        differ = word[p[going] + shared[going]] ^ word[q[going] + shared[going]]
        same = np.full(len(going), 8)
        odd = differ != 0
        for k in range(7, -1, -1):  # the highest byte that differs decides
            same[odd & ((differ >> np.uint64(56 - 8 * k)) != 0)] = k
        got = shared[going] + same
        shared[going] = np.minimum(got, most[going])
        going = going[(same == 8) & (got < most[going])]
    of = np.cumsum(~chained) - 1
    lcp = np.zeros(len(data) + 1, np.int64)
    lcp[places] = np.maximum(shared[of] - (places - places[heads][of]), 0)
    return lcp[order]


def first_of_equals(data: np.ndarray, room: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions with room for length bytes, and for each the first position with the same length bytes."""
    order = suffix_array(data, room, length)
    if not len(order):
        return order, order
    run = np.flatnonzero(np.concatenate([[True], common_prefixes(data, room, order)[1:] < length]))
    first = np.repeat(np.minimum.reduceat(order, run), np.diff(np.concatenate([run, [len(order)]])))
    return order, first


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers in sorted values."""
    cut = np.flatnonzero(np.diff(values) != 1)
    return values[np.concatenate([[0], cut + 1]).astype(np.int64)], values[np.concatenate([cut, [len(values) - 1]]).astype(np.int64)]


FOUND = "_key long, _shard long, _id {0}, _start long, _end long, _string binary"


def shard_repeats(ids: np.ndarray, starts: np.ndarray, texts: list[bytes], dealt: np.ndarray, shard: np.ndarray, length: int) -> dict[str, list]:
    """Repeats among the pieces of shards: spans of those that are not first, and the first strings of dealt anchors."""
    order = np.lexsort((starts, ids))
    keep = np.ones(len(order), bool)
    keep[1:] = (ids[order[1:]] != ids[order[:-1]]) | (starts[order[1:]] != starts[order[:-1]])  # a row that is given twice
    order = order[keep]
    ids, starts, dealt, shard, texts = ids[order], starts[order], dealt[order], shard[order], [texts[i] for i in order]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts), np.uint8)
    room = np.repeat(ends, sizes) - np.arange(len(data))
    place, first = first_of_equals(data, room, length)
    out: dict[str, list] = {k: [] for k in ("_key", "_shard", "_id", "_start", "_end", "_string")}
    again = np.sort(place[place != first])
    if len(again):
        piece = np.searchsorted(ends, again, "right")
        # runs that leave a piece are cut: a gap in numbering stands for each piece's end
        lo, hi = runs(again + piece)
        piece = np.searchsorted(ends, lo - np.searchsorted(ends + np.arange(1, len(ends) + 1), lo, "right"), "right")
        base = starts[piece] - (ends - sizes)[piece] - piece
        out["_id"] += ids[piece].tolist()
        out["_start"] += (lo + base).tolist()
        out["_end"] += (hi + base + length).tolist()
        out["_key"] += [None] * len(lo)
        out["_shard"] += [None] * len(lo)
        out["_string"] += [None] * len(lo)
    head = np.sort(place[place == first])
    piece = np.searchsorted(ends, head, "right")
    head, piece = head[dealt[piece]], piece[dealt[piece]]
    whole = data.tobytes()
    for p, k in zip(head.tolist(), piece.tolist(), strict=True):
        out["_string"].append(whole[p : p + length])
    out["_id"] += ids[piece].tolist()
    out["_start"] += (starts[piece] + head - (ends - sizes)[piece]).tolist()
    out["_end"] += (starts[piece] + head - (ends - sizes)[piece] + length).tolist()
    out["_shard"] += shard[piece].tolist()
    out["_key"] += [None] * len(head)
    return out


def merged_firsts(shard: np.ndarray, ids: np.ndarray, starts: np.ndarray, strings: list[bytes]) -> np.ndarray:
    """Which of the shards' first strings also occur earlier in another shard: each shard's sorted strings are looked up in
    the sorted strings of those before it, by binary search."""
    texts = np.array([s + b"\1" for s in strings])  # a last byte that is not zero, as numpy drops zeros at the end
    lost = np.zeros(len(strings), bool)
    known, owner = texts[:0], np.zeros(0, np.int64)
    for k in np.unique(shard):
        own = np.flatnonzero(shard == k)
        own = own[np.argsort(texts[own], kind="stable")]
        at = np.searchsorted(known, texts[own])
        found = np.zeros(len(own), bool)
        inside = at < len(known)
        found[inside] = known[at[inside]] == texts[own[inside]]
        mine, other = own[found], owner[at[found]]
        earlier = (ids[mine] < ids[other]) | (ids[mine] == ids[other]) & (starts[mine] < starts[other])
        lost[np.where(earlier, other, mine)] = True
        owner[at[found]] = np.where(earlier, mine, other)
        known, owner = np.insert(known, at[~found], texts[own[~found]]), np.insert(owner, at[~found], own[~found])
    return lost


def remove_repeats(df: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), characters: bool = False) -> DataFrame:
    """id, n_bytes, spans array<struct<start, end>> (removed bytes, maximal and in order), kept binary, for every row, and
    the columns named in carry. With characters kept is a string instead: bytes that no longer are a character go, too.

    A byte of a text's UTF-8 is removed if a string of `length` bytes covers it that also starts earlier: in a row with a
    smaller id, or earlier in the same text. Strings are judged on the input. Defined cases: null and shorter texts lose
    nothing; a row with a null id loses nothing and removes nothing elsewhere; a row that is given twice counts once and
    both come back alike; an id with several texts loses in each what was found for the id; an empty table gives an empty
    result; other columns are not looked at.
    """
    if not GRAM <= length <= SHARD_BYTES >> 5:
        raise ValueError(f"length is from {GRAM} to {SHARD_BYTES >> 5}")
    id_type = df.schema[id_col].dataType.simpleString()
    if set(carry) & {id_col, "n_bytes", "spans", "kept"}:
        raise ValueError("carried columns clash with the result's")
    docs = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *[F.col(c).alias(f"_carry_{c}") for c in carry])
    known = docs.where("_id IS NOT NULL")
    scratch, salt = Scratch(df.sparkSession, "repeats"), os.urandom(16)
    most = min(SHARD, SHARD_BYTES // (2 * length))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for lo, hi in blocks(np.diff(offsets), BLOCK):
                yield block_pieces(batch.column(0).slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], length, salt)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = ()
        held: pa.Table | None = None  # the last piece, of which it is not known yet whether its anchor has another
        for batch in batches:
            t = pa.Table.from_batches([batch])
            span = t.column("_span").to_numpy()
            yield from spans_of(t.filter(pa.array(span)), length)
            t = t.filter(pa.array(~span))
            if not t.num_rows:
                continue
            anchor, piece, more, start = (t.column(k).to_numpy() for k in ("_anchor", "_hash", "_more", "_start"))
            number = t.column("_id").to_pylist()
            fresh, again = np.ones(len(anchor), bool), np.zeros(len(anchor), bool)
            same = (anchor[1:] == anchor[:-1]) & (piece[1:] == piece[:-1]) & (more[1:] == more[:-1])
            fresh[1:] = ~same
            again[1:] = same & np.array([a == b for a, b in zip(number[1:], number[:-1], strict=True)], bool) & (start[1:] == start[:-1])  # a row given twice
            if last and last[:3] == (anchor[0], piece[0], more[0]):
                fresh[0], again[0] = False, last[3:] == (number[0], start[0])
            last = (anchor[-1], piece[-1], more[-1], number[-1], start[-1])
            yield from spans_of(t.filter(pa.array(~fresh & ~again)), length)
            kept = t.filter(pa.array(fresh)).append_column("_known", pa.array(np.zeros(int(fresh.sum()), bool)))
            kept = kept if held is None else pa.concat_tables([held, kept])
            if not kept.num_rows:
                continue
            of = kept.column("_anchor").to_numpy()
            mixed = kept.column("_known").to_numpy().copy()
            mixed[1:] |= of[1:] == of[:-1]
            mixed[:-1] |= of[1:] == of[:-1]
            held = kept.slice(kept.num_rows - 1).drop(["_known"]).append_column("_known", pa.array(mixed[-1:]))
            yield from asked(kept.slice(0, kept.num_rows - 1).filter(pa.array(mixed[:-1])))
        if held is not None:
            yield from asked(held.filter(held.column("_known")))

    def asked(t: pa.Table) -> Iterator[pa.RecordBatch]:
        for b in t.to_batches():
            yield pa.RecordBatch.from_arrays([b.column("_anchor"), b.column("_id"), b.column("_start"), b.column("_count")], names=["_anchor", "_id", "_start", "_count"])

    def spans_of(t: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
        for b in t.to_batches():
            yield pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.int64()), b.column("_id"), b.column("_start"), b.column("_count")], names=["_anchor", "_id", "_start", "_count"])

    order = ["_span", "_anchor", "_hash", "_more", "_id", "_start"]
    found = known.select("_id", "_text").mapInArrow(lean(find), f"_span boolean, _anchor long, _hash long, _more long, _id {id_type}, _start long, _count long")
    settled = scratch.write(found.repartition("_anchor").sortWithinPartitions(*order).mapInArrow(lean(settle), f"_anchor long, _id {id_type}, _start long, _count long"), "settled")
    whole = settled.where("_anchor IS NULL").select("_id", "_start", (F.col("_start") + F.col("_count") + length - 1).alias("_end"))
    mixed = settled.where("_anchor IS NOT NULL")
    often = mixed.groupBy("_anchor").agg(F.count(F.lit(1)).alias("_often"))
    heavy = heavy_keys(mixed, "_anchor", 4096)
    several = salted(mixed, heavy, "_anchor", "_id").join(for_each_salt(often, heavy, "_anchor"), ["_anchor", "_salt"]).groupBy("_id").agg(F.collect_set(F.struct("_start", "_count", "_anchor", "_often")).alias("_pieces"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            pieces = batch.column(2)
            counts = pieces.value_lengths().to_numpy(zero_copy_only=False)
            values = pieces.flatten()
            start, size, anchor, times = (values.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            row = np.repeat(np.arange(batch.num_rows), counts)
            size = size + length - 1
            good = start + size <= np.diff(offsets)[row]  # else it is from another text of this id
            row, start, size, anchor, times = row[good], start[good], size[good], anchor[good], times[good]
            for lo, hi in blocks(size, BLOCK):
                flat = data[ranges(offsets[row[lo:hi]] + start[lo:hi], size[lo:hi])]
                ends = np.concatenate([[0], np.cumsum(size[lo:hi])]).astype(np.int32)
                text = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(anchor[lo:hi]), pa.array(times[lo:hi]), batch.column(0).take(pa.array(row[lo:hi])), pa.array(start[lo:hi]), text], names=["_anchor", "_often", "_id", "_start", "_piece"])

    carried = [f"_carry_{c}" for c in carry]
    pieces = known.select("_id", "_text").join(several, "_id").select("_id", "_text", "_pieces").mapInArrow(lean(cut), f"_anchor long, _often long, _id {id_type}, _start long, _piece binary")
    shard = F.when(F.col("_often") > most, F.pmod(F.xxhash64("_id", "_start"), F.ceil(F.col("_often") / most))).otherwise(F.lit(0)).cast("long")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(rows)
            number, ranked = numbered(t.column("_id"))
            out = shard_repeats(number, t.column("_start").to_numpy(), t.column("_piece").to_pylist(), t.column("_often").to_numpy() > most, t.column("_shard").to_numpy(), length)
            if ranked is not None:
                out["_id"] = [ranked[i] for i in out["_id"]]
            kinds = [pa.int64(), pa.int64(), t.schema.field("_id").type, pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(out[k], kind) for k, kind in zip(out, kinds, strict=True)], names=list(out))

        yield from map(done, whole_groups(batches, ["_anchor", "_shard"], "_piece", 1 << (INDEX_BITS - 1)))

    dealt = pieces.select("_anchor", shard.alias("_shard"), "_often", "_id", "_start", "_piece").repartition("_anchor", "_shard").sortWithinPartitions("_anchor", "_shard")
    repeats = dealt.mapInArrow(lean(sort), FOUND.format(id_type))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def passed(batches: Iterator[pa.RecordBatch], out: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out.append(batch.filter(batch.column(5).is_null()).select(["_id", "_start", "_end"]))
                yield batch.filter(batch.column(5).is_valid())

        ready: list[pa.RecordBatch] = []
        for rows in whole_groups(passed(batches, ready), ["_key"], "_string", 1 << (INDEX_BITS - 1)):
            t = pa.Table.from_batches(rows)
            number, _ = numbered(t.column("_id"))
            lost = merged_firsts(t.column("_shard").to_numpy(), number, t.column("_start").to_numpy(), t.column("_string").to_pylist())
            yield from t.filter(pa.array(lost)).select(["_id", "_start", "_end"]).to_batches()
            yield from ready
            ready.clear()
        yield from ready

    keyed = repeats.withColumn("_key", F.when(F.col("_string").isNotNull(), F.xxhash64("_string")).otherwise(F.xxhash64("_id")))
    spans = keyed.repartition("_key").sortWithinPartitions("_key").mapInArrow(lean(merge), f"_id {id_type}, _start long, _end long")
    lost = scratch.write(spans.unionByName(whole).groupBy("_id").agg(F.collect_set(F.struct("_start", "_end")).alias("_spans")), "spans")
    scratch.drop(settled)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            sizes, all_spans, kept = np.diff(offsets), [], []
            lists = batch.column(2)
            for i in range(batch.num_rows):
                own = data[offsets[i] : offsets[i + 1]]
                merged: list[list[int]] = []
                for x in sorted((s["_start"], s["_end"]) for s in lists[i].as_py() or ()):
                    lo, hi = min(x[0], len(own)), min(x[1], len(own))
                    if merged and lo <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], hi)
                    elif lo < hi:
                        merged.append([lo, hi])
                edge = [0, *(e for s in merged for e in s), len(own)]
                raw = own.tobytes()
                kept.append(b"".join(raw[edge[k] : edge[k + 1]] for k in range(0, len(edge), 2)))
                all_spans.append([{"start": lo, "end": hi} for lo, hi in merged])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(all_spans, kind), pa.array([b.decode("utf-8", "ignore") for b in kept], pa.string()) if characters else pa.array(kept, pa.binary()), *batch.columns[3:]], names=[id_col, "n_bytes", "spans", "kept", *carry])

    nameless = docs.where("_id IS NULL").select("*", F.lit(None).cast(lost.schema["_spans"].dataType).alias("_spans"))
    every = known.join(lost, "_id", "left").unionByName(nameless).select("_id", "_text", "_spans", *carried)
    shape = "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in carry)
    return every.mapInArrow(lean(keep), f"`{id_col}` {id_type}, n_bytes long, spans array<struct<start:long,end:long>>, kept {'string' if characters else 'binary'}{shape}")


def op7_suffix_dedup(spark, sf_dir):
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

