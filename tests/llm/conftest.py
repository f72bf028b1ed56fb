import random

import pytest

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, ids=None, langs=None):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, None if langs is None else langs[k], "s", None if t is None else len(t)) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
        return spark.createDataFrame(rows, SHAPE)

    return make


@pytest.fixture(scope="session")
def words():
    rng = random.Random(11)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]


@pytest.fixture(params=[1, 3, 7])
def small_batches(spark, request):
    """Arrow batches of so many rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(request.param))
    yield request.param
    spark.conf.set(key, before)


@pytest.fixture(scope="session")
def one_hash():
    """Two words of 1024 letters with one polynomial hash modulo 2**64, whatever its base: a Thue-Morse word and its complement."""
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    return tuple("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
