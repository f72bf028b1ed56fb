import numpy as np

from sparsegrove.llm.token_counts import token_counts, truncated_totals
from sparsegrove.llm.tokenizer import by_ranks


def test_against_all_lengths(make_docs, words):
    texts = [" ".join(words[: i * 7 % 300]) for i in range(80)] + [None, "", "same", "same", " ".join(words * 5)]
    lengths = np.array([len(by_ranks().encode_ordinary(t or "")) for t in texts])
    sums = token_counts(make_docs(texts))
    rows = {r["n_tokens"]: r for r in sums.collect()}
    assert sorted(rows) == sorted(set(lengths.tolist()))
    for n, r in rows.items():
        assert (r["n_docs"], r["docs_at_least"], r["tokens_at_least"]) == ((lengths == n).sum(), (lengths >= n).sum(), lengths[lengths >= n].sum())
        assert r["truncated_tokens"] == np.minimum(lengths, n).sum() and abs(r["quantile"] - (lengths <= n).mean()) < 1e-12
    for r in truncated_totals(sums, [0, 1, 100, 333, 10**6]).collect():
        c = r["context_limit"]
        assert r["docs_longer"] == (lengths > c).sum() and r["total_tokens"] == np.minimum(lengths, c).sum()


def test_empty_table(make_docs):
    sums = token_counts(make_docs([]).where("false"))
    assert sums.count() == 0 and truncated_totals(sums, [5]).first()["total_tokens"] == 0


def test_a_very_long_text_and_clashing_columns(spark):
    docs = spark.createDataFrame([("word " * 200_000, 7), (None, 8)], "text string, n_tokens int")
    assert {(r["n_tokens"], r["n_docs"]) for r in token_counts(docs).collect()} == {(len(by_ranks().encode_ordinary("word " * 200_000)), 1), (0, 1)}
