import random

import numpy as np

import corpus_pipeline as cp
from sparsegrove.llm.tokenizer import by_json
from tests.llm.brute import components, kept, repeats

COLUMNS = list(cp.COLUMNS)


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def test_stages_against_brute_force(spark, make_docs, words, tmp_path):
    rng = random.Random(6)
    base = [prose(rng, words, 150) for _ in range(8)]
    passage = prose(rng, words, 60)
    texts = list(base)
    texts += [base[0], base[1] + " end", base[2].replace(words[3], "x"), prose(rng, words, 50) + " " + passage, prose(rng, words, 40) + " " + passage, None, "12 !!", base[0]]
    docs = make_docs(texts, langs=["en"] * len(texts))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = docs
    first = cp.language_id(spark, out, str(tmp_path))
    assert first.columns == COLUMNS and {r["doc_id"] for r in first.collect()} == {i for i, t in enumerate(texts) if t and t != "12 !!"}
    second = cp.exact_copies(spark, first, str(tmp_path))
    left = {r["doc_id"]: r["text"] for r in second.collect()}
    assert second.columns == COLUMNS and set(left) == {max(j for j, u in enumerate(texts) if u == texts[i]) for i, t in enumerate(texts) if t and t != "12 !!"}
    third = cp.near_copies(spark, second, str(tmp_path))
    near = components(left, 5, 80)
    left = {i: t for i, t in left.items() if near[i][1] == i}
    assert third.columns == COLUMNS and {r["doc_id"]: r["text"] for r in third.collect()} == left
    fourth = cp.repeated_strings(spark, third, str(tmp_path))
    covers = repeats(left, 100)
    want = {i: kept(t, covers[i]).decode("utf-8", "ignore") for i, t in left.items()}
    got = {r["doc_id"]: r for r in fourth.collect()}
    assert fourth.columns == COLUMNS and {i: r["text"] for i, r in got.items()} == {i: t for i, t in want.items() if t}
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    pieces = cp.run(spark, str(tmp_path)).toPandas()
    assert set(pieces["doc_id"]) == set(got)
    for i, own in pieces.groupby("doc_id"):
        own = own.sort_values("start")
        assert np.frombuffer(b"".join(own["ids"]), "<u4").tolist() == by_json().encode(got[i]["text"], add_special_tokens=False).ids + [0]
    sizes = pieces.groupby("sequence_id")["length"].sum()
    assert all(n & (n - 1) == 0 for n in sizes)


def test_empty_documents_and_nulls(spark, make_docs, tmp_path):
    make_docs([]).where("false").write.parquet(str(tmp_path / "a/documents.parquet"))
    assert cp.run(spark, str(tmp_path / "a")).count() == 0
    text = "some words that are said twice and then once more for good measure, as it were, in a text of some length"
    long = " ".join(f"w{i}" for i in range(40_000))
    clash = make_docs([text, text, None, text, long], [None, 1, 2, 1, 3], ["en", None, "en", "en", "en"]).selectExpr("*", "1 AS row_key", "'x' AS _id", "2 AS kept", "3 AS component_id")
    clash.write.parquet(str(tmp_path / "b/documents.parquet"))
    got = cp.run(spark, str(tmp_path / "b"))
    assert {r["doc_id"] for r in got.collect()} == {1, 3}


def test_documents_stay_where_no_language_is_known(spark, make_docs, tmp_path):
    docs = make_docs(["some words", None, "12 !!", "été"], [1, 2, 3, None])
    assert {r["text"] for r in cp.language_id(spark, docs, str(tmp_path)).collect()} == {"some words", "été"}


def test_texts_that_share_an_id_are_documents_of_their_own(spark, make_docs, words, tmp_path):
    rng = random.Random(8)
    base, other, passage = (prose(rng, words, 150) for _ in range(3))
    near = make_docs([base, base + " end", other, other, other[::-1]], [1, 5, 5, 5, None])
    assert {(r["doc_id"], r["text"]) for r in cp.near_copies(spark, near, str(tmp_path)).collect()} == {(1, base), (5, other), (None, other[::-1])}
    after = prose(rng, words, 150)
    repeats_in = make_docs([passage, passage + after, other], [1, 5, 5])
    got = {(r["doc_id"], r["text"]) for r in cp.repeated_strings(spark, repeats_in, str(tmp_path)).collect()}
    assert got == {(1, passage), (5, after), (5, other)}
