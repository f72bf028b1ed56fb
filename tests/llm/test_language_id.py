import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparsegrove.llm.common import utf8
from sparsegrove.llm import language_id
from sparsegrove.llm.language_id import CrossParser, cut, identify, learn_languages


def phrases(text, sample):
    """Greedy longest matches."""
    n = i = 0
    while i < len(text):
        k = i
        while k < len(text) and text[i : k + 1] in sample:
            k += 1
        n, i = n + 1, max(k, i + 1)
    return n


def test_phrases_are_longest_matches():
    rng = random.Random(5)
    for _ in range(20):
        sample = bytes(rng.choice(b"abc ") for _ in range(200))
        other = bytes(rng.choice(b"abd ") for _ in range(200))
        texts = [bytes(rng.choice(b"abcd ") for _ in range(rng.choice((0, 1, 50, 1300)))) for _ in range(8)]
        got = CrossParser({"x": sample, "y": other}).phrases(*utf8(pa.array(texts, pa.binary())))
        assert got[0].tolist() == [phrases(t, sample) for t in texts]
        assert got[1].tolist() == [phrases(t, other) for t in texts]


@pytest.mark.parametrize("piece", [3, 8, 40])
def test_phrases_over_pieces(monkeypatch, piece):
    """Pieces so short that phrases span several, and periodic texts whose parses never meet."""
    monkeypatch.setattr(language_id, "PIECE", piece)
    rng = random.Random(piece)
    for _ in range(30):
        sample = rng.choice((b"ab" * 60, b"abc" * 50, bytes(rng.choice(b"abc ") for _ in range(150))))
        texts = [bytes(rng.choice(b"abcd ") for _ in range(rng.choice((0, 1, 50, 300)))) for _ in range(5)] + [b"ab" * 200, b"abc" * 99, sample * 3, b"d" * 70, b"abcab" * 40]
        got = CrossParser({"x": sample}).phrases(*utf8(pa.array(texts, pa.binary())))
        assert got[0].tolist() == [phrases(t, sample) for t in texts]


def test_whole_predictions(make_docs):
    """Labels and scores from counts that plain Python makes, with the parser's own samples."""
    rng = random.Random(9)
    samples = {k: prose(rng, parts.split(), 300).encode() for k, parts in (("aa", "la me ni qu est pour"), ("bb", "sch ein ung zu der mit"), ("cc", "la me sch ein"))}
    texts = [prose(rng, "la me ni sch ein zu est".split(), rng.randint(1, 400)) for _ in range(25)]
    for r in identify(make_docs(texts), CrossParser(samples)).collect():
        counts = sorted((phrases(texts[r["doc_id"]].encode(), s), k) for k, s in samples.items())
        assert r["lang_pred"] == counts[0][1] and abs(r["score"] - (1 - counts[0][0] / counts[1][0])) < 1e-12


def test_a_text_that_is_given_very_often_is_learnt_once(make_docs, monkeypatch):
    docs = make_docs(["la me ni"] * 200, [1] * 200, langs=["aa"] * 200)
    assert learn_languages(docs, F.lit(True)).langs == ["aa"]


def prose(rng, parts, n):
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_held_out_accuracy_and_edge_cases(make_docs):
    rng = random.Random(2)
    kinds = {"aa": "la me ni qu est pour".split(), "bb": "sch ein ung zu der mit".split(), "cc": "th ing ed the wh and".split()}
    langs = [rng.choice(sorted(kinds)) for _ in range(120)]
    texts = [prose(rng, kinds[k], rng.randint(5, 200)) for k in langs]
    docs = make_docs(texts, langs=[k if i % 10 else None for i, k in enumerate(langs)])
    parser = learn_languages(docs, F.col("doc_id") % 4 != 0)
    found = {r["doc_id"]: r for r in identify(docs, parser).collect()}
    held = [i for i in range(120) if i % 4 == 0]
    assert np.mean([found[i]["lang_pred"] == langs[i] for i in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in found.values())
    odd = identify(make_docs([None, "", "12 !?", texts[0], texts[0], "É" * 200_000], [1, 2, 3, 4, None, 6]).withColumn("score", F.lit("x")), parser).collect()
    assert [r["lang_pred"] for r in odd[:3]] == ["und"] * 3 and odd[3]["lang_pred"] == odd[4]["lang_pred"] == langs[0] and odd[5]["lang_pred"] != "und"
    assert identify(docs.where("false"), parser).count() == 0
    nobody = learn_languages(docs.where("false"), F.lit(True))
    assert {r["lang_pred"] for r in identify(docs, nobody).collect()} == {"und"}
    one = learn_languages(docs.where("lang = 'aa'"), F.lit(True))
    assert {r["lang_pred"] for r in identify(docs, one).collect()} == {"aa"}


def test_languages_of_long_texts_are_learnt(make_docs):
    rng = random.Random(3)
    books = ["1 " * 9000 + prose(rng, "la me ni qu est pour".split(), 9000) for _ in range(3)]
    short = [prose(rng, "sch ein ung zu der mit".split(), 60) for _ in range(6)]
    docs = make_docs(books + short, langs=["aa"] * 3 + ["bb"] * 6)
    parser = learn_languages(docs, F.lit(True))
    assert parser.langs == ["aa", "bb"]
    assert [r["lang_pred"] for r in identify(docs, parser).orderBy("doc_id").collect()] == ["aa"] * 3 + ["bb"] * 6


def test_cut_takes_whole_texts():
    assert cut(["abc", "de", "f"], 5) == b"abc de" and cut(["abcdefgh", "x"], 3) == b"abcdefgh"
