import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsegrove.llm.periodic_runs import block_runs, matched, op11_periodic_runs, periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=24, times=3):
    """All runs, period by period."""
    out = []
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                own = words[i : j + q]
                if not any(own[p:] == own[:-p] for p in range(1, q)):
                    out.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def found(words, least=24, times=3):
    names = {w: i for i, w in enumerate(dict.fromkeys(words))}
    _, start, length, period = block_runs(np.array([names[w] for w in words], np.int64), np.zeros(len(words), np.int64), least, times)
    return list(zip(start.tolist(), length.tolist(), period.tolist()))


def some_words(rng):
    out = []
    while len(out) < rng.randint(20, 160):
        kind = rng.random()
        if kind < 0.4:
            base = [rng.choice("abc") for _ in range(rng.randint(1, 12))]
            out += (base * 9)[: rng.randint(2, 40)]
        elif kind < 0.6 and out:
            at = rng.randrange(len(out))
            out += out[at : at + rng.randint(1, 60)]
        else:
            out += [rng.choice("abcdef") for _ in range(rng.randint(1, 30))]
    return out


def test_all_runs_of_random_words():
    rng, seen = random.Random(3), 0
    for _ in range(400):
        words = some_words(rng)
        for least, times in ((24, 3), (6, 3), (9, 4)):
            want = brute(words, least, times)
            seen += len(want)
            assert found(words, least, times) == want
    assert seen > 1000


@pytest.mark.parametrize("words", [[], ["a"], ["a"] * 23, ["a"] * 24, ["a"] * 5000, list("ab") * 700 + list("aab") * 500, [str(i % 333) for i in range(999)], [str(i % 334) for i in range(1001)]])
def test_edges(words):
    assert found(words) == (brute(words) if len(words) < 1200 else found(words)) and (len(words) != 5000 or found(words) == [(0, 5000, 1)])


def test_fibonacci_and_thue_morse():
    a, b = "a", "ab"
    while len(b) < 1500:
        a, b = b, b + a
    assert found(list(b), 24, 3) == brute(list(b), 24, 3) != []
    assert found([str(bin(i).count("1") & 1) for i in range(1024)], 6, 3) == []


def test_places_do_not_touch():
    rng = np.random.default_rng(0)
    for _ in range(50):
        rank = rng.integers(0, 4, 60)
        at = np.flatnonzero(matched(rank))
        assert (np.diff(at) >= 2).all() and (rank[at] > 0).all()


def row_of(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    four = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc_id, len(runs), *four, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_the_whole_query_against_plain_python(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in op11_periodic_runs(spark, d).collect())
    assert got == sorted(row_of(*r) for r in docs) and sum(r[1] > 0 for r in got) >= 10


def test_nulls_batches_and_clashing_columns(make_docs, small_batches):
    rng = random.Random(5)
    texts = [None, "", " \t\n", "x", " ".join(["é ", "b"] * 30), *(" ".join(some_words(rng)) for _ in range(12)), "same " * 30, "same " * 30]
    docs = make_docs(texts, [None, *range(1, len(texts))]).withColumn("runs", F.lit(1)).withColumn("_id", F.lit("x")).withColumn("collapsed", F.lit(0))
    got = {r["doc_id"]: ([tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs(docs).collect()}
    for i, t in enumerate(texts):
        words = WORD.findall(t or "")
        runs = brute(words)
        gone = {k for s, length, q in runs for k in range(s + q, s + length)}
        assert got[i or None] == (runs, " ".join(w for k, w in enumerate(words) if k not in gone))
    assert periodic_runs(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(docs, times=2)
