import random

import numpy as np
import pyarrow as pa
import pytest

from sparsegrove.llm.bpe import Encoder, PerfectHash, bpe_decode, bpe_encode, merge, op5_bpe
from sparsegrove.llm.common import utf8
from sparsegrove.llm.tokenizer import by_json, by_ranks, ranks, token_ids

TRICKY = ["", " ", "  ", "'", "'s", "don't", "I'll've", "'S", " 'tis", "\n\n x", "a  b", "\t\tq", "tail  \n", "é'll", "x" * 3000, "12٣ 4", "漢字 かな", "😀😀 !", " a ", "\x1c\x85x", "<|endoftext|>", "a\x00b", "Ünï ß"]


@pytest.fixture(scope="module")
def encoder():
    return Encoder()


def encode(encoder, texts):
    ids, ends = encoder.encode(*utf8(pa.array(texts, pa.string())))
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]


def test_same_ids_as_the_library(encoder):
    rng = random.Random(1)
    parts = list("abcSTRE's''   \n\n\t!?.,$12٣éßñ漢😀  relvmd") + ["'s", "'re", " 'll", "'ve ", "\r\n", "ﬁ", "́"]
    texts = TRICKY + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    assert encode(encoder, texts) == [by_ranks().encode_ordinary(t) for t in texts]


def test_both_libraries_agree():
    rng = random.Random(2)
    texts = TRICKY + ["".join(chr(rng.choice((rng.randint(32, 0x24F), rng.randint(32, 126)))) for _ in range(60)) for _ in range(300)]
    assert token_ids(texts) == [by_json().encode(t, add_special_tokens=False).ids for t in texts]


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(0).integers(0, 2**63, 5000).astype(np.uint64)
    assert sorted(PerfectHash(keys).slots(keys).tolist()) == list(range(5000))


def test_merge_takes_the_lowest_rank_leftmost_first():
    of = {b"a": 0, b"b": 1, b"c": 2, b"bc": 3, b"ab": 4, b"aa": 5}
    assert merge(b"abc", of) == [0, 3] and merge(b"aaa", of) == [5, 0] and merge(b"abab", of) == [4, 4]


def test_round_trip_and_edge_cases(spark, make_docs):
    texts = [*TRICKY, None, TRICKY[5]]
    docs = make_docs(texts)
    both = bpe_decode(bpe_encode(docs)).collect()
    for r in both:
        assert bytes(r["decoded"]).decode() == (texts[r["doc_id"]] or "")
        assert r["ids"] == by_ranks().encode_ordinary(texts[r["doc_id"]] or "")
    assert bpe_encode(docs.where("false")).count() == 0
    null = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bpe_decode(null).first()["decoded"] is None
    with pytest.raises(ValueError):
        bpe_decode(null.withColumnRenamed("doc_id", "decoded"))


def test_query(spark):
    import hashlib

    d = "/root/testdata/sf0.001"
    of = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in op5_bpe(spark, d).collect():
        ids = by_ranks().encode_ordinary(of[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(of[r["doc_id"]].encode()).hexdigest()
    assert len(ranks()) == 50256


def test_pieces_of_one_hash_are_told_apart(encoder, one_hash):
    x, y = one_hash
    texts = [f"q{'b' * 9}{t}{'b' * 9}" for t in (x, y, x, y, y, x)]
    assert encode(encoder, texts) == [by_ranks().encode_ordinary(t) for t in texts]


def test_clashing_columns(make_docs):
    docs = make_docs(["some text"]).selectExpr("doc_id", "text", "1 AS ids", "2 AS decoded")
    assert bpe_encode(docs).first()["ids"] == by_ranks().encode_ordinary("some text")
