"""Runs of repeated words, found on a grammar of the word ids.

A block of texts is compressed by Re-Pair in rounds: pairs of neighbouring symbols are ranked by how often they occur, and
each pair that outranks both pairs it overlaps becomes one new symbol, the same for all its places (of overlapping places of one
pair every other one). What no repeated pair joins any more is joined two by two, until each text is one symbol. A rule's
places in the texts are those where it was made.

A run lies across the boundary of the two parts of exactly one lowest symbol that holds it whole. So every rule is looked at
once, at one of its places: half of a run lies on one side of the boundary, so the words next to the boundary come again one
period further on that side, far enough that `gram` of them do. Places of the same gram give the periods to try; single words
further on rule most of them out, and the rest is extended word by word as far as the rule goes. What is found is translated to
all places of the rule; of the stretches of one period those that lie in no other are the runs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, lean, ranges, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPARK_WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that share a grammar, and candidates that are tried at once.
BLOCK, TRIED = 1 << 20, 1 << 20
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def matched(rank: np.ndarray) -> np.ndarray:
    """Places of which no two are neighbours: where rank is higher than on both sides; of equal neighbours every other one."""
    head = np.concatenate([[True], rank[1:] != rank[:-1]])
    segment, starts = np.cumsum(head) - 1, np.flatnonzero(head)
    value = rank[starts]
    top = (value > np.concatenate([[0], value[:-1]])) & (value > np.concatenate([value[1:], [0]]))
    return top[segment] & ((np.arange(len(rank)) - starts[segment]) % 2 == 0)


def derivation(word: np.ndarray, text: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """rule, start, left, length of every place of the rules that stand for `least` words or more: word ids, and the number of each
    word's text, which no rule crosses."""
    symbol, at, of = word.astype(np.int64), np.arange(len(word)), text
    length = np.ones(int(word.max()) + 1 if len(word) else 1, np.int64)
    found, repeated = [], True
    while (inside := of[1:] == of[:-1]).any():
        key = np.where(inside, symbol[:-1] * len(length) + symbol[1:], -1)
        if repeated:
            pairs, which, count = np.unique(key, return_inverse=True, return_counts=True)
            rank = np.empty(len(pairs), np.int64)
            rank[np.argsort(count, kind="stable")] = np.arange(1, len(pairs) + 1)
            rank[(count < 2) | (pairs < 0)] = 0
            take = matched(rank[which])
            repeated = 100 * int(take.sum()) >= len(take)
        if not repeated:
            heads = np.concatenate([[0], np.flatnonzero(~inside) + 1])
            take = inside & ((np.arange(len(inside)) - heads[np.searchsorted(heads, np.arange(len(inside)), "right") - 1]) % 2 == 0)
        i = np.flatnonzero(take)
        _, first, which = np.unique(key[i], return_index=True, return_inverse=True)
        left, whole = length[symbol[i]], length[symbol[i]] + length[symbol[i + 1]]
        new, long = len(length) + which, whole >= least
        found.append((new[long], at[i][long], left[long], whole[long]))
        length = np.concatenate([length, whole[first]])
        symbol[i] = new
        stays = np.ones(len(symbol), bool)
        stays[i + 1] = False
        symbol, at, of = symbol[stays], at[stays], of[stays]
    return tuple(np.concatenate(c) if found else np.zeros(0, np.int64) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4


def grams(word: np.ndarray, size: int) -> np.ndarray:
    """A number for the `size` words from each place on, equal for equal words."""
    name, have = word.astype(np.int64), 1
    while have < size:
        step = min(have, size - have)
        a, b = name[: len(name) - step], name[step:]
        name, have = np.unique(a * (int(name.max()) + 1) + b, return_inverse=True)[1] if len(a) else np.zeros(0, np.int64), have + step
    return name


def agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many values agree from the start on."""
    at, step, n = 0, 64, min(len(a), len(b))
    while at < n:
        differs = a[at : at + step] != b[at : at + step]
        if differs.any():
            return at + int(differs.argmax())
        at, step = at + step, step * 4
    return n


def crossing(word: np.ndarray, start: np.ndarray, left: np.ndarray, length: np.ndarray, least: int, times: int) -> list[tuple[int, int, int, int]]:
    """(number of the rule, offset, length, period) of the stretches across the boundaries of rules, each given by one place."""
    size = min(max(-(-least // 2), -(-times * q // 2)) - q for q in range(1, least + 1))
    name, n = grams(word, size), len(word)
    order = np.argsort(name, kind="stable")
    keys = name[order] * n + order
    edge, end = start + left, start + length
    found: dict[tuple[int, int, int], int] = {}
    for right in (True, False):
        if right:  # the gram at the edge, and further right
            own = edge
            low, high = edge + 1, np.minimum(end - size, edge + np.minimum(2 * (end - edge), length) // times)
        else:
            own = edge - size
            low, high = np.maximum(start, own - np.minimum(2 * left, length) // times), own - 1
        fits = (own >= start) & (own + size <= end) & (low <= high)
        rule, gram = np.flatnonzero(fits), name[own[fits]] * n
        lo, hi = np.searchsorted(keys, gram + low[fits]), np.searchsorted(keys, gram + high[fits], "right")
        for a, b in blocks(hi - lo, TRIED):
            r = np.repeat(rule[a:b], (hi - lo)[a:b])
            q = np.abs(order[ranges(lo[a:b], (hi - lo)[a:b])] - own[r])
            need = np.maximum(-(-least // 2), -(-times * q // 2)) - q
            ok = edge[r] + q + need <= end[r] if right else edge[r] - q - need >= start[r]
            for part in (1, 2, 3, 4):
                r, q, need = r[ok], q[ok], need[ok]
                t = np.maximum(need * part // 4 - 1, 0)
                ok = word[edge[r] + t] == word[edge[r] + q + t] if right else word[edge[r] - 1 - t] == word[edge[r] - 1 - q - t]
            known: tuple[int, list] = (-1, [])
            for x, p in zip(*(c.tolist() for c in (lambda o: (r[ok][o], q[ok][o]))(np.lexsort((q[ok], r[ok])))), strict=True):
                if x != known[0]:
                    known = (x, [])
                if any(p % less == 0 and p < room for less, room in known[1]):
                    continue  # the same stretch
                s, e, b_ = int(start[x]), int(end[x]), int(edge[x])
                if right:
                    s, e = b_ - agree(word[s:b_][::-1], word[s + p : b_ + p][::-1]), b_ + p + agree(word[b_ : e - p], word[b_ + p : e])
                else:
                    s, e = b_ - p - agree(word[s : b_ - p][::-1], word[s + p : b_][::-1]), b_ + agree(word[b_ - p : e - p], word[b_:e])
                known[1].append((p, e - b_ if right else b_ - s))
                if e - s >= max(least, times * p):
                    place = (x, s - int(start[x]), e - s)
                    found[place] = min(p, found.get(place, p))
    return [(x, s, long, p) for (x, s, long), p in found.items()]


def block_runs(word: np.ndarray, text: np.ndarray, least: int, times: int) -> tuple[np.ndarray, ...]:
    """text, start in the block, length, period of all runs, by text, start and period."""
    rule, at, left, length = derivation(word, text, least)
    names, first, which = np.unique(rule, return_index=True, return_inverse=True)
    stretches = crossing(word, at[first], left[first], length[first], least, times) if len(names) else []
    if not stretches:
        return (np.zeros(0, np.int64),) * 4
    x, offset, long, period = np.array(stretches, np.int64).T
    order = np.argsort(which, kind="stable")
    lo, hi = np.searchsorted(which[order], x), np.searchsorted(which[order], x, "right")
    start = at[order[ranges(lo, hi - lo)]] + np.repeat(offset, hi - lo)
    long, period = np.repeat(long, hi - lo), np.repeat(period, hi - lo)
    own = text[start]
    by = np.lexsort((-long, start, period, own))
    own, start, period, end = own[by], start[by], period[by], (start + long)[by]
    group = np.cumsum(np.concatenate([[0], (own[1:] != own[:-1]) | (period[1:] != period[:-1])]))
    far = len(word) + 1
    reach = np.maximum.accumulate(end + group * far)
    stays = np.concatenate([[True], (end + group * far)[1:] > np.maximum(reach[:-1], group[1:] * far)])
    own, start, period, end = own[stays], start[stays], period[stays], end[stays]
    by = np.lexsort((period, start, own))
    return own[by], start[by], (end - start)[by], period[by]


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """id, runs (start, length and smallest period in words, from 0, by start and period), collapsed: every text's maximal stretches of
    `least` words or more that hold their period `times` times or more, and the text without the words that a run repeats, joined
    by one space.

    Defined cases: null and empty texts have no runs and collapse to nothing; repeated rows and null ids each give a row; an empty
    table gives an empty result; other columns are not looked at. A text is held whole by its task, a very long one alone in a block,
    with about 100 bytes a word.
    """
    if times < 3 or least < 2 * times:
        raise ValueError("a run holds its period three times or more, and is at least twice as long as that")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in blocks(np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0)), BLOCK):
                ids, texts = batch.column(0).slice(lo, hi - lo), [WORD.findall(t or "") for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
                ends = np.cumsum([0, *map(len, texts)])
                words = [w for t in texts for w in t]
                number = pa.array(words, pa.string()).dictionary_encode().indices.to_numpy().astype(np.int64)
                own, start, length, period = block_runs(number, np.repeat(np.arange(len(texts)), np.diff(ends)), least, times)
                gone = np.zeros(len(words) + 1, np.int64)
                np.add.at(gone, start + period, 1)
                np.add.at(gone, start + length, -1)
                stays = np.cumsum(gone) == 0
                some = set(own.tolist())
                kept = [" ".join(t if i not in some else [w for w, s in zip(t, stays[ends[i] : ends[i + 1]], strict=True) if s]) for i, t in enumerate(texts)]
                offsets = np.searchsorted(own, np.arange(len(texts) + 1)).astype(np.int32)
                each = pa.StructArray.from_arrays([pa.array(start - ends[own]), pa.array(length), pa.array(period)], names=["start", "length", "period"])
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(offsets), each), pa.array(kept, pa.string())], names=["_id", "runs", "collapsed"])

    kind = df.schema[id_col].dataType.simpleString()
    found = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(lean(run), f"_id {kind}, runs {RUNS}, collapsed string")
    return found.select(F.col("_id").alias(id_col), "runs", "collapsed")


def planted(doc_id: Column, text: Column) -> Column:
    """The text, or for one id in ten a text whose words from some place on come again with some period, both by the id's hash."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    words = F.regexp_extract_all(text, F.lit(SPARK_WORD), F.lit(0))

    def again(w: Column) -> Column:
        n, g = F.size(w).cast("long"), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, F.when(i >= a, a + (i - a) % p).otherwise(i).cast("int"))), " ")

    return F.when((h % 10 == 0) & F.regexp_like(text, F.lit(SPARK_WORD)), F.element_at(F.transform(F.array(words), again), 1)).otherwise(text)


def op11_periodic_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.aggregate("runs", none, lambda a, r: F.when(a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"]), r).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("_best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    exponent = F.expr("(1000 * _best.length) div _best.period")
    return out.select("doc_id", "n_runs", "_best.start", "_best.length", "_best.period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
