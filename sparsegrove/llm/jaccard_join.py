"""N-gram Jaccard self-join with token-combination prefixes.

A document is the set of its word shingles ("tokens"). Tokens are ordered by how often they occur, the rare first, then by
hash. Rare tokens are indexed alone; frequent ones only in combinations of k that follow each other in the order. A
document's prefix is as short as the pigeonhole allows: with n tokens, at most t = n - ceil(p * n) of them may be missing
from a linked document, so t + 1 rare tokens do; with only r <= t rare ones, all r are indexed and the prefix goes on into
the frequent tokens. If no rare token is shared, t - r frequent ones may still be missing, each breaking k combinations,
and the other document may have floor(n * (1 - p) / p) tokens of its own in between, each breaking k - 1; so
k * (t - r) + (k - 1) * floor(n * (1 - p) / p) + k frequent tokens leave a combination that both documents index.

Documents of the same words are one class. Classes that share a signature are candidates, but the pairs of a signature's
list are never rows of a table: where members neither link nor share a label its blocks all meet, which are rows as the square
of the number of blocks. First each is compared with its signature's most central class, one that shares most with others, and takes
that one's label if they link. Then the lists are read as groups: pairs with different labels and sizes that allow a link
are compared by sketch, in blocks, first each member with one partner, then, with the labels that this gives, all with all. A sketch is a string of bits, of which each token flips one; two sketches differ in at most
as many bits as the sets differ in tokens, so a pair whose sketches differ more than linked sets can is none, for certain.
The pairs that are left are verified on their whole texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, MOST_HEAVY, Scratch, blocks, for_each_salt, heavy_keys, lean, mix, numbered, ranges, salted, table, utf8, whole_groups
from .components import components
from .words import exact_shingles, shingle_sets, shingles

BLOCK = 1 << 20
#: Counters of the token counts; a fixed size, whatever the input.
COUNTERS, SLICE = 1 << 20, 1 << 12
#: Bits of a sketch; members of a list that are compared in one block; pairs that are compared at once.
SKETCH, LIST, PAIRS = 2048, 1024, 1 << 16
#: Rows of a heavy mark in one group, documents of a class of the same words in one task.
SPREAD, CLASS_ROWS = 4096, 1 << 17


def token_counters(docs: DataFrame, size: int) -> np.ndarray:
    """How often the tokens of each hashed counter occur in the whole table. Every task sums its own; the slices of the
    counters are summed as streams. A token never occurs more often than its counter says."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for lo, hi in blocks(np.diff(offsets), BLOCK):
                flat, _ = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size)
                total += np.bincount((flat % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        if total.any():
            yield slices(total, np.uint32)

    def slices(total: np.ndarray, kind: type) -> pa.RecordBatch:
        parts = [p.astype(kind).tobytes() for p in total.reshape(-1, SLICE)]
        return pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(part.as_buffer(), np.uint32).astype(np.int64)
        for k, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([v.tobytes()], pa.binary())], names=["slice", "counts"])

    out = np.zeros((COUNTERS // SLICE, SLICE), np.int64)
    parts = docs.select("_text").mapInArrow(lean(count), "slice int, counts binary").repartition("slice").mapInArrow(lean(add), "slice int, counts binary")
    for row in parts.collect():
        out[row["slice"]] = np.frombuffer(row["counts"], np.int64)
    return out.ravel()


def missing(n: int, percent: int) -> int:
    """How many of n tokens a linked document may lack."""
    return n - -(-percent * n // 100)


def sketch(tokens: np.ndarray) -> bytes:
    """SKETCH bits; each token flips one. The bits in which two sketches differ are at most the tokens in which two sets do."""
    flips = np.bincount(((tokens >> np.uint64(20)) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(flips.astype(np.uint8)).tobytes()


def may_link(n: np.ndarray, m: np.ndarray, apart: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and m tokens that differ in `apart` or more can link: with d tokens in one only, the similarity is
    (n + m - d) / (n + m + d)."""
    return apart * (100 + percent) <= (n + m) * (100 - percent)


def signatures(tokens: np.ndarray, n: int, counters: np.ndarray, rare: float, percent: int, k: int) -> np.ndarray:
    """The signatures of a set of n shingles with these distinct hashes: single rare tokens, then combinations of k frequent ones.
    Where shingles share a hash there are fewer tokens than n; bounds hold with n all the same, as a hash that two sets do not
    share stands for at least one shingle that they do not share. A set too small to link to any but an equal one has one
    signature, of the whole."""
    t = missing(n, percent)
    if 100 * n < percent * (n + 1):
        return mix(np.bitwise_xor.reduce(mix(tokens + GOLDEN)) + np.uint64([n])) if n else tokens
    often = counters[(tokens % np.uint64(COUNTERS)).astype(np.int64)]
    order = np.lexsort((tokens, often))
    r = int((often <= rare).sum())
    alone = tokens[order[: min(r, t + 1)]]
    if r > t:
        return alone
    p = k * (t - r) + (k - 1) * (n * (100 - percent) // percent) + k
    frequent = tokens[order[r : r + p]]
    if len(frequent) < k:
        return alone
    combined = np.zeros(len(frequent) - k + 1, np.uint64)
    for j in range(k):
        combined = mix(combined * GOLDEN + frequent[j : len(frequent) - k + 1 + j])
    return np.concatenate([alone, combined])


def signed(docs: DataFrame, counters: np.ndarray, size: int, percent: int, k: int, id_type: str) -> DataFrame:
    """_id, _n (set size), _words (128-bit digest of the words, null if there are none), _sketch, _signatures."""
    mean = counters.sum() / COUNTERS
    rare = mean + 8 * np.sqrt(mean) + 32
    shared = docs.sparkSession.sparkContext.broadcast(counters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for lo, hi in blocks(np.diff(offsets), BLOCK):
                sets, sizes, _ = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size)
                raw = data[offsets[lo] : offsets[hi]].tobytes()
                own = [raw[a:b] for a, b in zip((offsets[lo:hi] - offsets[lo]).tolist(), (offsets[lo + 1 : hi + 1] - offsets[lo]).tolist(), strict=True)]
                digests = [hashlib.blake2b(b" ".join(t.lower().split()), digest_size=16).digest() if n else None for t, n in zip(own, sizes, strict=True)]
                marks = [signatures(s, int(n), shared.value, rare, percent, k).view(np.int64) for s, n in zip(sets, sizes, strict=True)]
                ends = np.concatenate([[0], np.cumsum([len(m) for m in marks])])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sizes), pa.array(digests, pa.binary()), pa.array([sketch(x) if len(m) else None for x, m in zip(sets, marks, strict=True)], pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(marks)))], names=["_id", "_n", "_words", "_sketch", "_signatures"])

    return docs.select("_id", "_text").mapInArrow(lean(run), f"_id {id_type}, _n long, _words binary, _sketch binary, _signatures array<long>")


class Text:
    """A text with its set of hashes, and the set itself where it is asked for."""

    def __init__(self, raw: bytes, tokens: np.ndarray, shared: bool, size: int):
        self.raw, self.tokens, self.shared, self.size = raw, tokens, shared, size
        self._exact: set | None = None

    @property
    def exact(self) -> set:
        if self._exact is None:
            self._exact = exact_shingles(self.raw, self.size)
        return self._exact

    def links(self, other: Text, percent: int) -> bool:
        """Whether the sets link. Hashes can only find more in common than there is, unless shingles of one text share a hash; so
        hashes decide on no, and the words themselves on yes and on such texts."""
        if not (self.shared or other.shared or linked(self.tokens, other.tokens, percent)):
            return False
        both = len(self.exact & other.exact)
        return both > 0 and 100 * both >= percent * (len(self.exact) + len(other.exact) - both)


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int, id_type: str, together: int = 128) -> DataFrame:
    """a, b of the pairs whose sets link. b's text goes with a group of its a's; a popular b gets several groups. Groups are read as
    a stream, b's text first, so they fill no memory."""
    heavy = heavy_keys(pairs, "b", together)
    dealt_out = salted(pairs, heavy, "b", "a").select("a", "b", "_salt")
    members = dealt_out.join(texts.select(F.col("_id").alias("a"), "_text"), "a").select("b", "_salt", F.col("a"), "_text")
    heads = dealt_out.select("b", "_salt").distinct().join(texts.select(F.col("_id").alias("b"), "_text"), "b").select("b", "_salt", F.lit(None).cast(id_type).alias("a"), "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, pivots = None, []
        for batch in batches:
            data, offsets = utf8(batch.column(3))
            for lo, hi in blocks(np.diff(offsets), BLOCK):
                sets, _, shared = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size)
                found = []
                for i, s in enumerate(sets, lo):
                    b, share, a = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                    text = Text(data[offsets[i] : offsets[i + 1]].tobytes(), s, shared[i - lo], size)
                    if (b, share) != current:
                        current, pivots = (b, share), []
                    if a is None:
                        pivots.append(text)
                    elif any(text.links(p, percent) for p in pivots):
                        found.append((a, b))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], batch.schema.field(0).type) for k in (0, 1)], names=["a", "b"])

    dealt = members.unionByName(heads).repartition("b", "_salt").sortWithinPartitions("b", "_salt", F.col("a").asc_nulls_first())
    return dealt.mapInArrow(lean(run), f"a {id_type}, b {id_type}")


def in_blocks(lists: DataFrame) -> DataFrame:
    """Members of lists in blocks of about LIST, of which each two that need comparing meet in a group of their own. lists: _mark, _id,
    _n, _label, _sketch, _first (whether the member has the list's commonest label), _with and _without (members that have
    it, or not). Blocks of the commonest label, whose members are known to hang together, only meet the others. So there are
    rows in proportion to the members as long as few lack the label, however many have it."""
    others, most = (F.ceil(F.col(k) / LIST).cast("int") for k in ("_without", "_with"))
    hashed = F.xxhash64("_id")
    own = F.when(F.col("_first"), others + F.pmod(hashed, most)).otherwise(F.pmod(hashed, others)).cast("int")
    last = F.when(F.col("_first"), others - 1).otherwise(others + most - 1)
    own = lists.withColumn("_own", own).select("*", F.explode(F.sequence(F.lit(0), last)).alias("_other"))
    return own.select("_mark", F.least("_own", "_other").alias("_lo"), F.greatest("_own", "_other").alias("_hi"), "_label", "_own", "_id", "_n", "_sketch")


def close_pairs(lists: DataFrame, percent: int, id_type: str, first_only: bool) -> DataFrame:
    """a, b, _mark: pairs of lists' members whose labels differ and whose sketches allow a link. With first_only each member comes
    with one earlier member at most, and a row with _mark alone tells that a list has more pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["_mark", "_lo", "_hi"], "_sketch", 1 << 23):
            t = pa.Table.from_batches(rows)
            ids, (label, _) = t.column("_id").combine_chunks(), numbered(t.column("_label"))
            mark, lo, hi, own, n = (t.column(k).to_numpy() for k in ("_mark", "_lo", "_hi", "_own", "_n"))
            bits = np.frombuffer(b"".join(t.column("_sketch").to_pylist()), np.uint64).reshape(len(n), -1)
            other_group = np.concatenate([[True], (mark[1:] != mark[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
            other_label = other_group | np.concatenate([[True], label[1:] != label[:-1]])
            end, begin = next_head(other_group), next_head(other_label)  # partners: from the next label on, in the group
            taken, found, more = np.zeros(len(n), bool), [], []
            for at, to in blocks(end - begin, PAIRS):
                first, second = np.repeat(np.arange(at, to), (end - begin)[at:to]), ranges(begin[at:to], (end - begin)[at:to])
                fits = (lo[first] == hi[first]) | (own[first] != own[second])
                fits &= 100 * np.minimum(n[first], n[second]) >= percent * np.maximum(n[first], n[second])
                first, second = first[fits], second[fits]
                apart = np.bitwise_count(bits[first] ^ bits[second]).sum(1, dtype=np.int64)
                near = may_link(n[first], n[second], apart, percent)
                first, second = first[near], second[near]
                if first_only and len(second):
                    order = np.argsort(second, kind="stable")
                    new = np.zeros(len(second), bool)
                    new[order] = np.concatenate([[True], second[order[1:]] != second[order[:-1]]])
                    new &= ~taken[second]
                    more.append(mark[second[~new]])
                    first, second = first[new], second[new]
                    taken[second] = True
                found.append((first, second))
            first, second = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            left = np.unique(np.concatenate(more)) if more else mark[:0]
            pairs = pa.Table.from_arrays([ids.take(pa.array(first)), ids.take(pa.array(second))], names=["a", "b"]).group_by(["a", "b"]).aggregate([])
            yield from pairs.append_column("_mark", pa.nulls(pairs.num_rows, pa.int64())).combine_chunks().to_batches()
            yield pa.RecordBatch.from_arrays([pa.nulls(len(left), ids.type), pa.nulls(len(left), ids.type), pa.array(left)], names=["a", "b", "_mark"])

    near = in_blocks(lists).repartition("_mark", "_lo", "_hi").sortWithinPartitions("_mark", "_lo", "_hi", "_label").mapInArrow(lean(run), f"a {id_type}, b {id_type}, _mark long")
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "_mark").where("_mark IS NOT NULL OR a <> b").distinct()


def next_head(heads: np.ndarray) -> np.ndarray:
    """For each place the next one that is a head, or the length."""
    at = np.flatnonzero(heads)
    return np.repeat(np.concatenate([at[1:], [len(heads)]]), np.diff(np.concatenate([at, [len(heads)]])))


def near_sketches(pairs: DataFrame, percent: int, id_type: str) -> DataFrame:
    """a, b of the pairs (a, an, a_bits, b, bn, b_bits) whose sketches allow a link, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for k in (2, 5))
            apart = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
            near = may_link(batch.column(1).to_numpy(), batch.column(4).to_numpy(), apart, percent)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3)], names=["a", "b"]).filter(pa.array(near))

    return pairs.select("a", "an", "a_bits", "b", "bn", "b_bits").mapInArrow(lean(run), f"a {id_type}, b {id_type}").distinct()


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or 100 * len(x) < percent * len(y):
        return False
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_token: int = 5, percent: int = 80, combination: int = 2) -> DataFrame:
    """id, n_shingles, component_id for every row: the set's size and the smallest id reachable by links.

    Two documents link when 100 * intersection >= percent * union of their shingle sets (percent from 80 on). Defined
    cases: null texts and texts without words have an empty set and link to nothing; a row with a null id has a null
    component and links to nothing; an id given with several texts links by any of them; repeated rows come back as
    often; an empty table gives an empty result; other columns are not looked at.
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent is from 80 to 100")
    if combination != 2 and not (combination == 3 and percent >= 90):
        raise ValueError("combinations are of 2 tokens, or of 3 from 90 percent on: longer ones outgrow small sets")
    id_type = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    scratch = Scratch(df.sparkSession, "jaccard")
    made = scratch.write(signed(docs, token_counters(docs, words_per_token), words_per_token, percent, combination, id_type), "signed")
    sets = scratch.write(made.select("_id", "_n", "_words"), "sets")
    classes = scratch.write(sets.where("_words IS NOT NULL").groupBy("_words").agg(F.min("_id").alias("_class"), F.count(F.lit(1)).alias("_copies")), "classes")
    firsts = made.where("size(_signatures) > 0").join(classes, [made["_words"] == classes["_words"], made["_id"] == classes["_class"]], "left_semi")
    single = firsts.select("_id", "_n", F.explode("_signatures").alias("_mark"))
    common = scratch.write(single.groupBy("_mark").agg(F.count(F.lit(1)).alias("_often")).where("_often > 1"), "common")
    least = max(SPREAD, -(-(common.agg(F.sum("_often")).first()[0] or 0) // MOST_HEAVY))
    heavy = common.where(F.col("_often") > least).select("_mark", F.ceil(F.col("_often") / least).alias("_parts"))  # at most MOST_HEAVY
    of_marks = lambda members, marks, how: members.join(for_each_salt(marks, heavy, "_mark"), ["_mark", "_salt"], how)
    marks = scratch.write(of_marks(salted(single, heavy, "_mark", "_id"), common, "inner").select("_mark", "_salt", "_often", "_id", "_n"), "marks")
    central = scratch.write(marks.groupBy("_id").agg((F.sum("_often") / F.max("_n")).alias("_weight")), "central")
    bits = scratch.write(made.where("_sketch IS NOT NULL").select("_id", "_sketch").join(central.select("_id").hint("merge"), "_id", "left_semi"), "bits")
    scratch.drop(made)
    pivots = marks.join(central, "_id").groupBy("_mark").agg(F.max_by(F.struct("_id", "_n"), F.struct("_weight", "_id")).alias("_pivot"))
    to_pivot = of_marks(marks, pivots, "inner").select(F.col("_id").alias("a"), F.col("_n").alias("an"), F.col("_pivot._id").alias("b"), F.col("_pivot._n").alias("bn"))
    to_pivot = to_pivot.where("a <> b").where(100 * F.least("an", "bn") >= percent * F.greatest("an", "bn")).distinct()
    side = lambda k: bits.select(F.col("_id").alias(k), F.col("_sketch").alias(f"{k}_bits"))
    stars = scratch.write(near_sketches(to_pivot.join(side("a"), "a").join(side("b"), "b"), percent, id_type), "pairs")

    def check(pairs: DataFrame) -> DataFrame:
        """The pairs that link. The texts that they need are written once, for all that reads them."""
        needed = pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct()
        texts = scratch.write(docs.join(needed.hint("merge"), "_id", "left_semi"), "texts")
        found = scratch.write(verified(pairs, texts, words_per_token, percent, id_type), "links")
        scratch.drop(texts)
        return found

    def lists(of: DataFrame, labels: DataFrame) -> DataFrame:
        """The lists of marks that hold several labels, with sketches."""
        known = of.join(labels, "_id")
        each = known.groupBy("_mark", "_label").agg(F.count(F.lit(1)).alias("_members"))
        mixed = each.groupBy("_mark").agg(F.max(F.struct("_members", "_label")).alias("_top"), F.sum("_members").alias("_all")).where("_all > _top._members")
        mixed = mixed.select("_mark", F.col("_top._label").alias("_top"), F.col("_top._members").alias("_with"), (F.col("_all") - F.col("_top._members")).alias("_without"))
        return of_marks(known, mixed, "inner").withColumn("_first", F.col("_label") == F.col("_top")).join(bits, "_id")

    def labels_of(found: DataFrame) -> DataFrame:
        return central.select("_id").join(found, "_id", "left").select("_id", F.coalesce("_label", "_id").alias("_label"))

    links = check(stars)
    scratch.drop(stars)
    some = scratch.write(close_pairs(lists(marks, labels_of(links.groupBy(F.col("a").alias("_id")).agg(F.max("b").alias("_label")))), percent, id_type, True), "pairs")
    links = links.union(check(some.where("_mark IS NULL").select("a", "b")))
    labelled = components(links, "a", "b", scratch).select(F.col("node").alias("_class"), F.col("label").alias("_label"))
    more = some.where("_mark IS NOT NULL").select("_mark").distinct()
    if not more.isEmpty():
        rest = close_pairs(lists(of_marks(marks, more, "left_semi"), labels_of(labelled.withColumnRenamed("_class", "_id"))), percent, id_type, False).select("a", "b")
        rest = scratch.write(rest.join(some.where("_mark IS NULL").select("a", "b"), ["a", "b"], "left_anti"), "pairs")
        links = links.union(check(rest))
        scratch.drop(rest)
        labelled = components(links, "a", "b", scratch).select(F.col("node").alias("_class"), F.col("label").alias("_label"))
    scratch.drop(marks, bits, common, central, some)
    of_class = classes.join(labelled, "_class", "left").select("_words", F.coalesce("_label", "_class").alias("_component"))
    most = max(CLASS_ROWS, -(-(classes.agg(F.sum("_copies")).first()[0] or 0) // MOST_HEAVY))
    copied = classes.where(F.col("_copies") > most).select("_words", F.ceil(F.col("_copies") / most).alias("_parts"))  # at most MOST_HEAVY
    out = scratch.write(salted(sets, copied, "_words", "_id").join(for_each_salt(of_class, copied, "_words"), ["_words", "_salt"], "left").select("_id", "_n", F.when(F.col("_id").isNotNull(), F.coalesce("_component", "_id")).alias("_component")), "components")
    scratch.drop(sets, classes)
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), F.col("_component").alias("component_id"))


def op4_jaccard_join(spark, sf_dir):
    return jaccard_join(table(spark, sf_dir, "documents"), words_per_token=3, percent=90)
