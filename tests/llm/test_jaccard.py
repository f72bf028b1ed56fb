import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsegrove.llm import components as hubs
from sparsegrove.llm import jaccard_join as jj
from tests.llm.brute import components


def found(df, **kw):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jj.jaccard_join(df, **kw).collect()}


def edited(rng, text, words, most):
    w = text.split()
    for _ in range(rng.randint(0, most)):
        i = rng.randrange(len(w))
        w[i : i + rng.randint(0, 1)] = [rng.choice(words)]
    return " ".join(w)


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_against_brute_force(make_docs, words, size, percent):
    rng = random.Random(size)
    base = [" ".join(rng.choice(words) for _ in range(rng.choice((6, 12, 60, 300)))) for _ in range(12)]
    texts = [edited(rng, rng.choice(base), words, 6) for _ in range(150)] + ["", None, "one", "one two", "ONE two", "a a a a a a a"]
    texts += [texts[0], texts[0].upper()]
    rng.shuffle(texts)
    docs = make_docs(texts)
    assert found(docs, words_per_token=size, percent=percent) == components(dict(enumerate(texts)), size, percent)


def test_frequent_tokens_only(make_docs, monkeypatch, words):
    """Every token counts as frequent, so only combinations are indexed; lists are dealt in small blocks."""
    rng = random.Random(9)
    base = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(3)]
    texts = [edited(rng, rng.choice(base), words, 9) for _ in range(90)]
    plain = jj.signatures
    monkeypatch.setattr(jj, "signatures", lambda tokens, n, counters, rare, percent, k: plain(tokens, n, counters, -1.0, percent, k))
    monkeypatch.setattr(jj, "LIST", 8)
    monkeypatch.setattr(jj, "PAIRS", 16)
    assert found(make_docs(texts), words_per_token=3, percent=90) == components(dict(enumerate(texts)), 3, 90)


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(0)
    for _ in range(50):
        x, y = (np.unique(rng.integers(0, 2**63, 900).astype(np.uint64)[rng.random(900) < 0.7]) for _ in range(2))
        both = np.union1d(x[:500], y[:100])
        bits = [np.frombuffer(jj.sketch(s), np.uint64) for s in (x, both)]
        apart = int(np.bitwise_count(bits[0] ^ bits[1]).sum())
        assert apart <= len(np.setxor1d(x, both))
        if jj.linked(x, both, 90):
            assert jj.may_link(np.array([len(x)]), np.array([len(both)]), np.array([apart]), 90)[0]


def test_null_ids_repeats_and_empty_tables(make_docs):
    text = " ".join(f"w{i}" for i in range(40))
    docs = make_docs([text, text + " end", text, text], [7, 3, None, 7]).withColumn("component_id", F.lit("x"))
    got = sorted(((r["doc_id"], r["component_id"]) for r in jj.jaccard_join(docs).collect()), key=str)
    assert got == [(3, 3), (7, 3), (7, 3), (None, None)]
    assert jj.jaccard_join(docs.where("false")).count() == 0
    for bad in ({"percent": 70}, {"combination": 4}):
        with pytest.raises(ValueError):
            jj.jaccard_join(docs, **bad)


def test_small_arrow_batches(make_docs, words, small_batches):
    rng = random.Random(small_batches)
    base = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(3)]
    texts = [edited(rng, rng.choice(base), words, 4) for _ in range(60)]
    assert found(make_docs(texts), words_per_token=3, percent=90) == components(dict(enumerate(texts)), 3, 90)


def test_words_of_one_hash_are_told_apart(make_docs, words, one_hash):
    x, y = one_hash
    rest = " ".join(words[:50])
    texts = [x, y, f"{x} {y}", f"{rest} {x}", f"{rest} {y}", f"{x} {y} {x} {y}", " ".join([x] * 30 + [y] * 30), " ".join([x] * 30 + [y] * 29)]
    for size, percent in ((1, 80), (3, 90)):
        assert found(make_docs(texts), words_per_token=size, percent=percent) == components(dict(enumerate(texts)), size, percent)


def test_equal_small_sets_of_other_words_link(make_docs):
    texts = ["a a a a", "a a a a a a", "b b b", "a b c", "A  b\tc", "b"]
    assert found(make_docs(texts), words_per_token=3, percent=90) == components(dict(enumerate(texts)), 3, 90)


def test_other_ids_and_a_long_text(spark, words):
    rng = random.Random(4)
    long = " ".join(rng.choice(words) for _ in range(120_000))
    docs = spark.createDataFrame([("b", long), ("a", long + " end"), ("c", "other words"), ("d", None)], "doc_id string, text string")
    got = {r["doc_id"]: r["component_id"] for r in jj.jaccard_join(docs).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "d"}


def test_rows_of_a_long_list_stay_in_proportion(spark):
    """A mark of 20000 members, of which 100 lack the commonest label."""
    rows = spark.range(20_000).selectExpr("0L AS _mark", "id AS _id", "100L AS _n", "if(id < 100, id + 1, 0) AS _label", "cast('' AS binary) AS _sketch", "id >= 100 AS _first", "19900L AS _with", "100L AS _without")
    dealt = jj.in_blocks(rows)
    assert dealt.count() <= 2 * 20_000 + 100 * 21
    assert dealt.groupBy("_lo", "_hi").count().agg(F.max("count")).first()[0] < 2 * jj.LIST


def test_a_very_large_group_of_near_copies(make_docs, words, monkeypatch):
    rng = random.Random(12)
    monkeypatch.setattr(jj, "SPREAD", 64)
    base = " ".join(rng.choice(words) for _ in range(80))
    texts = [edited(rng, base, words, 2) for _ in range(400)] + [edited(rng, base, words, 30) for _ in range(60)]
    assert found(make_docs(texts), words_per_token=3, percent=90) == components(dict(enumerate(texts)), 3, 90)


def test_large_classes_and_hubs_are_dealt_to_several_tasks(make_docs, words, monkeypatch):
    rng = random.Random(17)
    base = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(2)]
    texts = [base[0]] * 40 + [base[1]] * 5 + [edited(rng, rng.choice(base), words, 3) for _ in range(60)] + [None, "one"]
    rng.shuffle(texts)
    monkeypatch.setattr(jj, "CLASS_ROWS", 4)
    monkeypatch.setattr(hubs, "HUB", 2)
    assert found(make_docs(texts), words_per_token=3, percent=90) == components(dict(enumerate(texts)), 3, 90)
