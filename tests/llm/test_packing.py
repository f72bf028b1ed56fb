import numpy as np
from pyspark.sql import functions as F

from sparsegrove.llm.packing import cut_pieces, hilbert, pack, tail_cuts
from sparsegrove.llm.tokenizer import by_json, token_ids


def test_hilbert_steps_are_one_cell():
    grid = np.array([[a, b] for a in range(8) for b in range(8)])
    path = grid[np.argsort(hilbert(grid, 3))]
    assert sorted(hilbert(grid, 3).tolist()) == list(range(64)) and (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_tail_has_no_padding():
    assert tail_cuts(1024 + 700, 1024).tolist() == [1024, 1536, 1664, 1696, 1712, 1720] and tail_cuts(2048, 1024).tolist() == []
    row, begin, length, seq, offset = cut_pieces(np.array([0, 10]), np.array([10, 3]), tail_cuts(13, 8), 13, 8)
    assert list(zip(row, begin, length, seq, offset)) == [(0, 0, 8, 0, 0), (0, 8, 2, 1, 0), (1, 0, 2, 1, 2), (1, 2, 1, 2, 0)]


def test_every_id_is_in_one_piece(make_docs, words):
    texts = [" ".join(words[i % 7 : i % 7 + i * 3]) for i in range(60)] + [None, "", "漢字 <|endoftext|>", " ".join(words * 12), "same", "same"]
    docs = make_docs(texts, [*range(len(texts) - 1), None]).withColumn("length", F.lit("x"))
    pieces = pack(docs).toPandas()
    assert (pieces["ids"].map(len) == 4 * pieces["length"]).all()
    for i, own in pieces[pieces.doc_id.notna()].groupby("doc_id"):
        own = own.sort_values("start")
        ids = by_json().encode(texts[int(i)] or "", add_special_tokens=False).ids + [0]
        assert np.frombuffer(b"".join(own["ids"]), "<u4").tolist() == ids and (own["doc_tokens"] == len(ids)).all()
        assert own["start"].tolist() == np.concatenate([[0], own["length"].cumsum()[:-1]]).tolist()
    assert pieces.doc_id.nunique() == len(texts) - 1 and pieces.doc_id.isna().sum() >= 1
    sizes = pieces.groupby("sequence_id")["length"].sum()
    assert sizes.index.tolist() == list(range(len(sizes))) and all(n & (n - 1) == 0 for n in sizes) and (sizes[:-10] == 1024).all()
    for _, own in pieces.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["offset"].tolist() == np.concatenate([[0], own["length"].cumsum()[:-1]]).tolist()


def test_empty_tables_and_no_end(make_docs):
    assert pack(make_docs([]).where("false")).count() == 0
    assert {r["doc_id"] for r in pack(make_docs(["a b", "", None]), end_id=None).collect()} == {0}


def test_a_very_long_text(make_docs, words):
    text = " ".join(words * 500)
    own = pack(make_docs([text, "short"])).where("doc_id = 0").toPandas().sort_values("start")
    assert np.frombuffer(b"".join(own["ids"]), "<u4").tolist() == by_json().encode(text, add_special_tokens=False).ids + [0]


def test_ids_are_those_of_an_unmodified_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext|", "x\n<|endoftext|>漢", "plain text, plain text", ""]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert token_ids(texts) == want and any(50256 in ids for ids in want[:1])


def test_small_batches_give_the_same_pieces(make_docs, words, small_batches):
    texts = [" ".join(words[i : i + 9 * i]) for i in range(20)] + [None, ""]
    own = pack(make_docs(texts)).toPandas()
    for i, t in enumerate(texts):
        ids = np.frombuffer(b"".join(own[own.doc_id == i].sort_values("start")["ids"]), "<u4").tolist()
        assert ids == by_json().encode(t or "", add_special_tokens=False).ids + [0]
