import hashlib

import pytest
from pyspark.sql import functions as F

from sparsegrove.llm import exact_dedup as module
from sparsegrove.llm.exact_dedup import exact_dedup


def rows(df):
    return {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in df.collect()}


def test_groups_nulls_ties_and_long_texts(make_docs):
    long = "x" * 300_000
    docs = make_docs(["a", "b", "a", None, "", long, long, "A"])
    assert rows(exact_dedup(docs)) == {(0, 0, 2, True), (2, 0, 2, False), (1, 1, 1, True), (3, 3, 2, True), (4, 3, 2, False), (5, 5, 2, True), (6, 5, 2, False), (7, 7, 1, True)}
    largest = exact_dedup(docs, keep="largest")
    assert (0, 2, 2, False) in rows(largest) and (2, 2, 2, True) in rows(largest)
    assert {r["text_sha256"] for r in largest.where("doc_id = 1").collect()} == {hashlib.sha256(b"b").hexdigest()}


def test_texts_that_share_a_hash_stay_apart(make_docs):
    docs = make_docs(["a", "b", "a"])
    assert rows(exact_dedup(docs, content_hash=lambda c: F.lit(b"same"))) == {(0, 0, 2, True), (1, 1, 1, True), (2, 0, 2, False)}


def test_null_ids_repeats_empty_tables_and_clashing_columns(make_docs):
    docs = make_docs(["a", "a", "b", "c", "c"], [None, 4, None, 5, 5]).withColumn("keep_id", F.lit("x")).withColumn("kept", F.lit("y"))
    found = sorted(exact_dedup(docs).collect(), key=str)
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in found} == {(None, 4, False), (4, 4, True), (None, None, True), (5, 5, True)} and len(found) == 5
    assert exact_dedup(docs.where("false")).count() == 0
    assert rows(exact_dedup(make_docs(["A", "a"]), normalise=F.lower)) == {(0, 0, 2, True), (1, 0, 2, False)}
    with pytest.raises(ValueError):
        exact_dedup(docs, keep="first")


def test_large_classes_are_dealt_to_several_tasks(make_docs, monkeypatch):
    texts = ["hot"] * 60 + ["warm"] * 9 + ["a", "b", None, ""]
    docs = make_docs(texts + texts[:3], [*range(len(texts)), 0, 1, 2])
    plain = sorted(exact_dedup(docs, keep="largest").collect(), key=str)
    monkeypatch.setattr(module, "CLASS_ROWS", 4)
    assert sorted(exact_dedup(docs, keep="largest").collect(), key=str) == plain
    hot = [r for r in plain if r["keep_id"] == 59]
    assert len(hot) == 63 and {r["group_size"] for r in hot} == {63} and [r["doc_id"] for r in hot if r["kept"]] == [59]
