import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sparsegrove.llm.common import utf8
from sparsegrove.llm.words import words as hashed_words
from sparsegrove.llm.quality import BUCKETS, STATISTICS, FactorisationMachine, features, fit_quality, score_quality


def test_interactions_by_the_sum_of_squares():
    x = features(*utf8(pa.array(["a b c a", "", "b d"])), np.array([7, 0, 3]))
    m = FactorisationMachine()
    m.linear = np.random.default_rng(1).normal(0, 1, len(m.linear))
    index, value, offsets = m.rows(x)
    raw = m.raw(index, value, offsets)[0]
    for r in range(3):
        i, v = index[offsets[r] : offsets[r + 1]], value[offsets[r] : offsets[r + 1]]
        pairs = sum(m.factors[i[a]] @ m.factors[i[b]] * v[a] * v[b] for a in range(len(i)) for b in range(a))
        assert abs(raw[r] - (m.bias + m.linear[i] @ v + pairs)) < 1e-9


def test_held_out_accuracy_and_edge_cases(spark, make_docs, words):
    rng = random.Random(3)
    good = [rng.random() < 0.7 for _ in range(300)]
    texts = [" ".join(rng.choice(words) + ("" if g else rng.choice(("$$$", "%%%", "###"))) for _ in range(rng.randint(3, 60))) for g in good]
    docs = make_docs(texts)
    labels = spark.createDataFrame([(i, int(g), 0) for i, g in enumerate(good)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    machine = fit_quality(docs, labels, F.col("doc_id") % 4 != 2)
    found = {r["doc_id"]: r for r in score_quality(docs, machine).collect()}
    held = [i for i in range(300) if i % 4 == 2]
    assert np.mean([found[i]["predicted"] == good[i] for i in held]) >= 0.95
    odd = score_quality(make_docs([None, "", "x" * 400_000, texts[0], texts[0]], [1, 2, 3, None, None]).withColumn("score", F.lit("s")), machine).collect()
    assert len(odd) == 5 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in odd) and odd[3]["score"] == odd[4]["score"]
    assert score_quality(docs.where("false"), machine).count() == 0
    unlearned = fit_quality(docs, labels.where("false"), F.lit(True))
    assert score_quality(docs, unlearned).count() == 300
    alike = fit_quality(docs, labels.where("quality = 1"), F.lit(True))
    assert all(r["predicted"] == 1 for r in score_quality(docs, alike).collect())


def plain_score(m, text, n_chars):
    """One text's score, word by word and pair by pair."""
    data = (text or "").encode()
    own = re.findall(rb"[^\x20\x09-\x0d]+", bytes(b + 32 if 65 <= b <= 90 else b for b in data))
    bucket = [int(hashed_words(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0]) % BUCKETS for w in own]
    often = Counter(bucket)
    values = {b: 1 + math.log(n) for b, n in often.items()}
    norm = math.sqrt(sum(v * v for v in values.values()))
    x = [(b, v / norm) for b, v in sorted(values.items())]
    capital, digit, space, high = (lambda b: 65 <= b <= 90), (lambda b: 48 <= b <= 57), (lambda b: b == 32 or 9 <= b <= 13), (lambda b: b >= 128)
    letter = lambda b: capital(b) or 97 <= b <= 122 or high(b)
    kinds = [letter, digit, capital, lambda b: not (letter(b) or digit(b) or space(b)), space, high]
    n, some, lines = len(data), max(len(own), 1), data.count(b"\n") + bool(data)
    stats = [math.log1p(n), math.log1p(len(own)), sum(map(len, own)) / some, *(sum(map(k, data)) / max(n, 1) for k in kinds), math.log1p(lines), len(own) / max(lines, 1)]
    stats += [len(often) / some, max(often.values(), default=0) / some, sum(a == b for a, b in zip(own, own[1:])) / some, math.log1p(n_chars)]
    x += [(BUCKETS + i, min(6, max(-6, (s - m.mean[i]) / m.spread[i])) / math.sqrt(len(stats))) for i, s in enumerate(stats)]
    total = m.bias + sum(m.linear[i] * v for i, v in x) + sum(m.factors[i] @ m.factors[j] * v * w for k, (i, v) in enumerate(x) for j, w in x[:k])
    return 1 / (1 + math.exp(-total))


def test_whole_scores(make_docs, words):
    rng = random.Random(7)
    texts = ["", None, "One  one\nTWO two 3 $ é", *(" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(20))]
    m, draw = FactorisationMachine(), np.random.default_rng(2)
    m.bias, m.linear = 0.3, draw.normal(0, 0.5, len(m.linear))
    m.factors = draw.normal(0, 0.2, m.factors.shape)
    m.mean, m.spread = draw.normal(0, 1, len(STATISTICS)), draw.uniform(0.5, 2, len(STATISTICS))
    for r in score_quality(make_docs(texts), m).collect():
        text = texts[r["doc_id"]]
        assert abs(r["score"] - plain_score(m, text, len(text or ""))) < 1e-9


def test_an_id_that_is_given_very_often(spark, make_docs):
    docs = make_docs(["some words", "some words", "other words"], [1, 1, 2])
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    once = fit_quality(docs.dropDuplicates(["doc_id"]), labels, F.lit(True))
    assert np.array_equal(fit_quality(docs, labels, F.lit(True)).linear, once.linear)
