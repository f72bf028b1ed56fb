"""Language identification by cross-parsing entropy.

One suffix automaton per language, of a bounded sample of its labelled documents, recognises every substring of that
sample. A text is parsed greedily into the longest phrases that the automaton knows (Ziv and Merhav's cross parsing);
the language that needs the fewest phrases per byte wins. The automata are dense transition tables, so that one numpy
step advances thousands of pieces of text by one byte at once; where a phrase crosses into the next piece, it is followed
there until both parses begin a phrase at the same byte, from where on they are one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, lean, ranges, table, utf8

#: Texts are parsed in pieces of so many bytes, and the pieces' parses joined.
PIECE = 512
#: Bytes that are stepped through at once.
BLOCK = 1 << 20
LETTER = r"\pL"


def symbols(text: bytes, of: np.ndarray) -> np.ndarray:
    return of[np.frombuffer(text, np.uint8)]


def suffix_automaton(word: np.ndarray, width: int) -> np.ndarray:
    """Transitions of the smallest automaton that knows all substrings of word; state 0 is the start, -1 no way on."""
    jump: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in word.tolist():
        new = len(jump)
        jump.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in jump[p]:
            jump[p][c] = new
            p = link[p]
        if p >= 0:
            q = jump[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(jump)
                jump.append(dict(jump[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = copy
                while p >= 0 and jump[p].get(c) == q:
                    jump[p][c] = copy
                    p = link[p]
        last = new
    dense = np.full((len(jump) + 1, width), -1, np.int32)  # the last state knows nothing: an unknown symbol leads to it
    for state, ways in enumerate(jump):
        if ways:
            dense[state, list(ways)] = list(ways.values())
    return dense


class CrossParser:
    """Automata of several languages over one alphabet: bytes of lower-cased text, all ASCII but letters as a space."""

    def __init__(self, samples: dict[str, bytes]):
        self.langs = sorted(samples)
        seen = sorted({b for s in samples.values() for b in s if b >= 128 or 97 <= b <= 122})
        self.of = np.zeros(256, np.int16)
        self.of[128:] = self.of[97:123] = len(seen) + 1  # letters that no sample has: no way on
        self.of[seen] = np.arange(1, len(seen) + 1)
        self.width = len(seen) + 2
        self.tables = [suffix_automaton(symbols(samples[k], self.of), self.width).ravel() for k in self.langs]

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The number of phrases of each text, by language."""
        sizes = np.diff(offsets)
        pieces = -(-sizes // PIECE)
        owner = np.repeat(np.arange(len(sizes)), pieces)
        starts = ranges(np.zeros(len(sizes), np.int64), pieces) * PIECE + np.repeat(offsets[:-1], pieces)
        lengths = np.minimum(PIECE, np.repeat(offsets[1:], pieces) - starts)
        order = np.argsort(-lengths, kind="stable")
        owner, starts, lengths = owner[order], starts[order], lengths[order]
        word = self.of[data].astype(np.int32)
        begins = np.zeros((len(self.langs), len(data)), bool)  # where the pieces' own parses begin a phrase
        begins[:, starts] = True
        states = np.zeros((len(self.langs), len(starts)), np.int32)
        for step in range(int(lengths[0]) if len(lengths) else 0):
            live = int(np.searchsorted(-lengths, -step, "left"))  # lengths > step come first
            at = starts[:live] + step
            letter = word[at]
            for k, ways in enumerate(self.tables):
                to = ways[states[k, :live] * self.width + letter]
                stuck = np.flatnonzero(to < 0)
                if len(stuck):
                    begins[k, at[stuck]] = True
                    to[stuck] = self.anew(ways, letter[stuck])
                states[k, :live] = to
        counts = [self.joined(ways, word, offsets, owner, starts, lengths, begins[k], states[k]) for k, ways in enumerate(self.tables)]
        return np.stack(counts) if counts else np.zeros((0, len(sizes)), np.int64)

    def anew(self, ways: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The states of phrases that begin with these letters."""
        to = ways[letter]
        to[to < 0] = len(ways) // self.width - 1
        return to

    def joined(self, ways: np.ndarray, word: np.ndarray, offsets: np.ndarray, owner: np.ndarray, starts: np.ndarray, lengths: np.ndarray, begins: np.ndarray, states: np.ndarray) -> np.ndarray:
        """The phrases of each text, from its pieces' own parses: the last phrase of a piece is followed into the next one until a
        phrase begins where that piece's own parse has one begin, too. A text with a piece but the last in which that never happens
        is parsed from its first byte to its last."""
        upto = np.concatenate([[0], np.cumsum(begins)])
        true = upto[starts + lengths] - upto[starts]
        place = np.argsort(starts)  # pieces in the order of the text
        later = place[np.flatnonzero(starts[place] != offsets[owner[place]])]
        before = place[np.flatnonzero(starts[place] != offsets[owner[place]]) - 1]
        live, state, met, step = later, states[before], np.zeros(len(later), np.int64), 0
        while len(live):
            ended = lengths[live] == step
            if ended.any():
                last = ended & ((starts + lengths)[live] == offsets[owner[live] + 1])  # with the text
                true[live[last]] = met[last]
                live, state, met, ended = live[~last], state[~last], met[~last], ended[~last]
            if ended.any():
                for text in np.unique(owner[live[ended]]).tolist():  # never met
                    true[owner == text] = 0
                    true[np.flatnonzero(owner == text)[0]] = self.one_by_one(ways, word[offsets[text] : offsets[text + 1]].tolist())
                    going = owner[live] != text
                    live, state, met, ended = live[going], state[going], met[going], ended[going]
            if not len(live):
                break
            at = starts[live] + step
            to = ways[state * self.width + word[at]]
            stuck = to < 0
            done = stuck & begins[at]
            true[live[done]] = met[done] + upto[(starts + lengths)[live[done]]] - upto[at[done]]
            met += stuck & ~done
            to[stuck] = self.anew(ways, word[at[stuck]])
            live, state, met, step = live[~done], to[~done], met[~done], step + 1
        return np.bincount(owner, weights=true, minlength=len(offsets) - 1).astype(np.int64)

    def one_by_one(self, ways: np.ndarray, letters: list[int]) -> int:
        """The phrases of one text."""
        state, count, dead = -1, 0, len(ways) // self.width - 1
        for letter in letters:
            to = -1 if state < 0 else int(ways[state * self.width + letter])
            if to < 0:
                count, to = count + 1, int(ways[letter])
                to = dead if to < 0 else to
            state = to
        return count


def fold(text_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.crc32(text_id.cast("string").cast("binary")) % folds


def learn_languages(df: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = 64, sample_bytes: int = 32768, longest_doc: int = 16384) -> CrossParser:
    """Automata from a sample of the rows where learn holds: of each language the text whose hashed id is the smallest of its
    bucket, in sample_docs buckets, until sample_bytes bytes are reached. Texts of at most longest_doc characters come
    first and whole; a longer one counts where a bucket has no other, with its first longest_doc characters from a letter on.

    The buckets are summed up before the shuffle, so that no task gathers a language. What comes to the driver is bounded
    by sample_docs * longest_doc for each language."""
    long = F.length(text_col) > longest_doc
    part = F.when(long, F.left(F.regexp_replace(text_col, r"^\P{L}+", ""), F.lit(longest_doc))).otherwise(F.col(text_col))
    hashed = F.xxhash64(id_col)
    order = F.shiftright(hashed, 1) + F.when(long, F.lit(1 << 62)).otherwise(F.lit(-(1 << 62)))  # long texts after all others
    fit = df.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).alias("_lang"), part.alias("_text"), order.alias("_order"), F.pmod(hashed, F.lit(sample_docs)).alias("_bucket"))
    first = [r["_least"] for r in fit.groupBy("_lang", "_bucket").agg(F.min("_order").alias("_least")).collect()]
    texts: dict[str, list[tuple[int, str]]] = {}
    picked = fit.where(F.col("_order").isin(first)).groupBy("_lang", "_order").agg(F.min("_text").alias("_text"))  # one text for each id
    for row in picked.collect() if first else []:
        texts.setdefault(row["_lang"], []).append((row["_order"], row["_text"].lower()))
    return CrossParser({k: cut([t for _, t in sorted(set(v))], sample_bytes) for k, v in texts.items()})


def cut(texts: list[str], most: int) -> bytes:
    """Whole texts, one after the other, until `most` bytes are there."""
    out: list[bytes] = []
    for text in texts:
        if out and sum(map(len, out)) + len(text.encode()) > most:
            break
        out.append(text.encode())
    return b" ".join(out)


def identify(df: DataFrame, parser: CrossParser, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """id, lang_pred, score for every row, and the columns named in carry.

    lang_pred is the language with the fewest phrases per byte (ties: the first by name); score is 1 minus the ratio of
    its phrases to the runner-up's, 1 when only one language is known. Defined cases: null texts, texts without a letter
    and all texts when no language is known give `und` with score 0; repeated rows and null ids each give a row; an
    empty table gives an empty result; other columns are not looked at.
    """
    if set(carry) & {id_col, "lang_pred", "score"}:
        raise ValueError("carried columns clash with the result's")
    shared = df.sparkSession.sparkContext.broadcast(parser)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for at, to in blocks(np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0)), BLOCK):
                yield score(known, batch.slice(at, to - at))

    def score(known: CrossParser, batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1)
        letters = np.asarray(pc.fill_null(pc.match_substring_regex(texts, LETTER), False))
        counts = known.phrases(*utf8(pc.utf8_lower(texts)))
        n = batch.num_rows
        if not known.langs:
            best, sure, letters = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, bool)
        else:
            best = counts.argmin(0)
            ranked = np.sort(counts, axis=0)
            sure = 1 - ranked[0] / np.maximum(ranked[1], 1) if len(ranked) > 1 else np.ones(n)
        names = np.array([*known.langs, "und"], dtype=object)
        pred = names[np.where(letters, best, len(known.langs))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(np.where(letters, sure, 0.0)), *batch.columns[2:]], names=[id_col, "lang_pred", "score", *carry])

    kind = df.schema[id_col].dataType.simpleString()
    shape = "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in carry)
    return df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *carry).mapInArrow(lean(run), f"`{id_col}` {kind}, lang_pred string, score double{shape}")


def op8_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    parser = learn_languages(docs, fold(F.col("doc_id"), 5) != 0)
    return identify(docs, parser).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
