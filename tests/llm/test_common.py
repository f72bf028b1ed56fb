import pyarrow as pa
import pytest

from sparsegrove.llm.common import for_each_salt, heavy_keys, salted, whole_groups


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
@pytest.mark.parametrize("most", [1, 6, 1000])
def test_whole_groups(size, most):
    keys = [1, 1, 2, 2, 2, 2, 2, 2, 2, 2, 2, 3, 4, 4, 4, 4, 5]
    rows = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + size]), pa.array(["xy"] * len(keys[i : i + size]))], names=["k", "t"]) for i in range(0, len(keys), size)]
    rows.insert(1, rows[0].slice(0, 0))
    parts = [[k for b in part for k in b.column(0).to_pylist()] for part in whole_groups(iter(rows), ["k"], "t", most)]
    assert [k for p in parts for k in p] == keys and all(not set(a) & set(b) for a, b in zip(parts, parts[1:]))
    assert all(2 * len(p) <= most or len(set(p)) == 1 for p in parts)


def test_salts_meet(spark):
    rows = spark.createDataFrame([("hot" if i < 60 else f"k{i}", i) for i in range(100)], "k string, v long")
    heavy = heavy_keys(rows, "k", 8)
    assert {(r["k"], r["_parts"]) for r in heavy.collect()} == {("hot", 8)}
    one_each = rows.groupBy("k").count()
    met = salted(rows, heavy, "k", "v").join(for_each_salt(one_each, heavy, "k"), ["k", "_salt"])
    assert met.count() == 100 and met.where("k = 'hot'").select("_salt").distinct().count() > 4
