import hashlib

import duckdb
from pyspark.sql import functions as F

from sparsegrove.llm.chat_format import AND, CLOSE, OP13_SQL, OPEN, escaped, format_conversations, op13_chat_format, read_loss, read_turns, sums_before, unescaped

SHAPE = "conv_id long, turn long, role string, text string"
ODD = [OPEN, CLOSE, AND, "\\", "\\0", "\\1", "\\\\2", "</turn>", "<turn", "<and/>\\3<and/>", "<<turn user>", "", "é漢😀\n", "</turn></turn>", "<turn <turn "]


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode()))


def test_every_text_comes_back(spark):
    rows = [(k % 4, k, ("user", "assistant", "assistant", "a>b<turn \\4", None)[k % 5], t) for k, t in enumerate([*ODD, None] * 4)]
    rows += [(9, None, "assistant", "null turn"), (9, 1, "assistant", "b"), (9, 1, "assistant", "b"), (None, 5, "system", "x"), (11, 0, "assistant", "")]
    df = spark.createDataFrame(rows, SHAPE).withColumn("formatted", F.lit(1)).withColumn("_conv", F.lit("x"))
    made = format_conversations(df)
    for r in made.select("conv_id", "formatted", "loss_spans", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect():
        own = order([x for x in rows if x[0] == r["conv_id"]])
        assert [tuple(t) for t in r["turns"]] == [(x[2] or "", x[3] or "") for x in own]
        assert r["loss"] == [x[3] or "" for x in own if x[2] == "assistant"]
        runs = sum(1 for i, x in enumerate(own) if i == 0 or (x[2] or "") != (own[i - 1][2] or ""))
        assert r["formatted"].count(CLOSE) == runs and r["formatted"].count(AND) == len(own) - runs
        data = r["formatted"].encode()
        assert all(not any(m.encode() in data[s["start"] : s["start"] + s["length"]] for m in (OPEN, CLOSE.strip(), AND)) for s in r["loss_spans"])
    assert format_conversations(df.where("false")).count() == 0


def test_escapes_and_sums(spark):
    one = spark.createDataFrame([(a + b + c,) for a in ODD for b in ODD for c in ODD], "t string")
    assert one.where(~unescaped(escaped(F.col("t"))).eqNullSafe(F.col("t"))).isEmpty() and one.where(escaped(F.col("t")).rlike("<turn |</turn>|<and/>")).isEmpty()
    sizes = [list(range(k)) for k in (0, 1, 511, 512, 513, 2000)]
    for r in spark.createDataFrame([(s,) for s in sizes], "s array<bigint>").select("s", sums_before(F.col("s")).alias("b")).collect():
        assert r["b"] == [sum(r["s"][:i]) for i in range(len(r["s"]))]


def test_a_long_conversation(spark):
    many = spark.range(5000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("é"), F.col("id").cast("string")).alias("text"))
    r = format_conversations(many).select(read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert r["loss"] == [f"é{i}" for i in range(5000) if i % 3]


def test_the_whole_query(spark):
    d = "/root/testdata/sf0.001"
    got = sorted(map(tuple, op13_chat_format(spark, d).collect()))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet'")
    assert got == sorted(db.execute(OP13_SQL).fetchall())
    said = r"\### Assistant: </turn> ok"
    assert got[0][:5] == (-7, 2, sha(f"user\n{said}\nassistant\n{said}\n"), len(said), sha(said))
