import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsegrove.llm import suffix_dedup as sd
from tests.llm.brute import kept, repeats


def test_suffix_array_and_prefixes():
    rng = random.Random(3)
    for _ in range(40):
        texts = [bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(0, 60))) for _ in range(5)]
        data, sizes = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
        room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))
        for length in (1, 3, 8, 9, 17, 30):
            order, first = sd.first_of_equals(data, room, length)
            strings = [data[p : p + length].tobytes() for p in order]
            assert strings == sorted(strings) and sorted(order) == [p for p in range(len(data)) if room[p] >= length]
            want = {}
            for p in sorted(order):
                want.setdefault(data[p : p + length].tobytes(), p)
            assert [want[s] for s in strings] == first.tolist()


def corpus(rng, n):
    base = ["".join(rng.choice("abcdefgh é") for _ in range(400)) for _ in range(5)]
    texts = []
    for _ in range(n):
        text = ""
        for _ in range(rng.randint(0, 5)):
            b, i = rng.choice(base), rng.randint(0, 300)
            text += b[i : i + rng.randint(1, 300)] + rng.choice(("", "xyz" * 12, "a" * 150))
        texts.append(text)
    return texts


def test_small_arrow_batches(make_docs, small_batches):
    texts = corpus(random.Random(small_batches), 30)
    covers = repeats(dict(enumerate(texts)), 100)
    for r in sd.remove_repeats(make_docs(texts)).collect():
        assert bytes(r["kept"]) == kept(texts[r["doc_id"]], covers[r["doc_id"]])


def test_pieces_of_one_polynomial_hash(make_docs, one_hash):
    rng = random.Random(5)
    x, y = one_hash
    texts = ["".join(rng.choice("cdef") for _ in range(50)) + t + "." * 3 for t in (x, y, x, y)]
    covers = repeats(dict(enumerate(texts)), 100)
    for r in sd.remove_repeats(make_docs(texts)).collect():
        assert bytes(r["kept"]) == kept(texts[r["doc_id"]], covers[r["doc_id"]])


def test_long_strings(make_docs):
    rng = random.Random(6)
    base = "".join(rng.choice("abcdefgh") for _ in range(9000))
    texts = [base[i : i + 6000] for i in range(0, 3000, 100)]
    covers = repeats(dict(enumerate(texts)), 4000)
    for r in sd.remove_repeats(make_docs(texts), length=4000).collect():
        assert bytes(r["kept"]) == kept(texts[r["doc_id"]], covers[r["doc_id"]])


@pytest.mark.parametrize("shard", [1024, 2])
def test_against_brute_force(make_docs, monkeypatch, shard):
    monkeypatch.setattr(sd, "SHARD", shard)
    texts = [*corpus(random.Random(shard), 40), None, "", "short"]
    covers = repeats(dict(enumerate(texts)), 100)
    for r in sd.remove_repeats(make_docs(texts)).collect():
        t, cover = texts[r["doc_id"]], covers[r["doc_id"]]
        assert r["n_bytes"] == len(cover) and bytes(r["kept"]) == kept(t, cover)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], np.array(cover, int), [0]])))
        assert [(s["start"], s["end"]) for s in r["spans"]] == list(zip(edges[::2], edges[1::2]))


def test_null_ids_repeats_other_ids_and_empty_tables(spark, make_docs):
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefghij") for _ in range(260))
    docs = make_docs([text, text, text, "q" + text], [None, 2, 2, 1]).withColumn("kept", F.lit("x"))
    got = {(r["doc_id"], len(r["kept"])) for r in sd.remove_repeats(docs).collect()}
    assert got == {(None, 260), (2, 0), (1, 261)} and sd.remove_repeats(docs).count() == 4
    named = spark.createDataFrame([("b", text), ("a", text)], "doc_id string, text string")
    assert {(r["doc_id"], len(r["kept"])) for r in sd.remove_repeats(named).collect()} == {("a", 260), ("b", 0)}
    assert sd.remove_repeats(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        sd.remove_repeats(docs, length=10)
    with pytest.raises(ValueError):
        sd.remove_repeats(docs, carry=("kept",))


def test_a_long_text(make_docs):
    rng = random.Random(1)
    unit = "".join(rng.choice("abcdefghij") for _ in range(1000))
    text = "".join(unit if i % 2 else "".join(rng.choice("klmnop") for _ in range(3000)) for i in range(300))
    cover = repeats({0: text}, 100)[0]
    assert bytes(sd.remove_repeats(make_docs([text])).first()["kept"]) == kept(text, cover)


def test_kept_characters(make_docs):
    """A removed string that ends within a character takes the rest of it along."""
    shared = "x" + "é" * 60
    texts = ["ab" + shared, "cd" + shared[:50] + "è" + "end"]
    covers = repeats(dict(enumerate(texts)), 100)
    for r in sd.remove_repeats(make_docs(texts), characters=True).collect():
        assert r["kept"] == kept(texts[r["doc_id"]], covers[r["doc_id"]]).decode("utf-8", "ignore")
