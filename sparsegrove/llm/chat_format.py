"""Conversations as one text each, by Spark expressions only.

A conversation's turns are collected, sorted and cut into runs of one role; the texts of a run stand in one block, with a mark
between them, and blocks follow each other:

    <turn user>text<and/>next text</turn>
    <turn assistant>text</turn>

Within texts and roles the marks, and the sign that escapes them, are escaped by strings that hold no mark, so that blocks
and texts are found again by their marks alone. The loss mask is a list of byte ranges: the assistant's texts without any mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

OPEN, CLOSE, AND = "<turn ", "</turn>\n", "<and/>"
#: What is escaped, in this order, and read back in the other; in roles the end of their mark too.
ESCAPES = (("\\", "\\0"), (OPEN, "\\1"), (CLOSE.strip(), "\\2"), (AND, "\\3"))
ROLE_ESCAPES = (*ESCAPES, (">", "\\4"))
#: Texts whose places are summed at once.
PLACES = 512


def escaped(text: Column, by: tuple = ESCAPES) -> Column:
    for plain, code in by:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column, by: tuple = ESCAPES) -> Column:
    for plain, code in reversed(by):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def sums_before(sizes: Column) -> Column:
    """For each number of an array the sum of those before it: within slices of PLACES first, then over the slices."""
    none = F.array().cast("array<bigint>")

    def add(state: Column, x: Column) -> Column:
        return F.struct((state["total"] + x).alias("total"), F.concat(state["before"], F.array(state["total"])).alias("before"))

    start = F.struct(F.lit(0).cast("long").alias("total"), none.alias("before"))
    slices = F.transform(F.sequence(F.lit(1), F.greatest(F.size(sizes), F.lit(1)), F.lit(PLACES)), lambda i: F.aggregate(F.slice(sizes, i, F.lit(PLACES)), start, add))
    above = F.aggregate(F.transform(slices, lambda s: s["total"]), start, add)["before"]
    return F.flatten(F.zip_with(slices, above, lambda s, a: F.transform(s["before"], lambda b: a + b)))


def format_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """conv, formatted, loss_spans (start and length in UTF-8 bytes of each text of loss_role): one row for each conversation.

    Defined cases: rows are taken by turn, nulls first, rows of one turn by role and text; null texts and roles are empty, an
    empty text is one all the same; repeated rows are turns of their own; rows of null conversations are one conversation; an empty table
    gives an empty result; other columns are not looked at. A conversation's text is one value, as that is what is asked for, so the
    memory of a task is bounded by the longest conversation; no work grows faster than in proportion to it.
    """
    own = df.select(F.col(conv_col).alias("_conv"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("_turn"))
    turns = own.groupBy("_conv").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    place = F.sequence(F.lit(1), F.size("_turns"))
    heads = turns.withColumn("_heads", F.filter(place, lambda i: (i == 1) | (F.get("_turns", i - 1)["role"] != F.get("_turns", i - 2)["role"])))
    nexts = F.concat(F.slice("_heads", F.lit(2), F.size("_heads")), F.array(F.size("_turns") + 1))
    runs = heads.withColumn("_runs", F.zip_with("_heads", nexts, lambda a, b: F.struct(F.get("_turns", a - 1)["role"].alias("role"), F.transform(F.slice("_turns", a, b - a), lambda t: escaped(t["text"])).alias("texts"))))
    opened = lambda r: F.concat(F.lit(OPEN), escaped(r["role"], ROLE_ESCAPES), F.lit(">"))
    blocks = runs.select("_conv", "_runs", F.transform("_runs", lambda r: F.concat(opened(r), F.array_join(r["texts"], AND), F.lit(CLOSE))).alias("_blocks"))
    size = lambda c: F.octet_length(c).cast("long")
    placed = blocks.withColumn("_at", sums_before(F.transform("_blocks", size)))

    def spans(r: Column, at: Column) -> Column:
        first = at + size(opened(r))
        before = sums_before(F.transform(r["texts"], lambda t: size(t) + len(AND)))
        return F.zip_with(before, r["texts"], lambda b, t: F.struct((first + b).alias("start"), size(t).alias("length")))

    own_runs = F.filter(F.arrays_zip(F.col("_runs").alias("run"), F.col("_at").alias("at")), lambda x: x["run"]["role"] == loss_role)
    return placed.select(F.col("_conv").alias(conv_col), F.array_join("_blocks", "").alias("formatted"), F.flatten(F.transform(own_runs, lambda x: spans(x["run"], x["at"]))).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """role and text of every turn of a formatted conversation."""
    blocks = F.split(formatted, CLOSE, -1)

    def turns(block: Column) -> Column:
        role = F.substring_index(F.substr(block, F.lit(len(OPEN) + 1)), ">", 1)
        texts = F.split(F.substr(block, F.length(role) + len(OPEN) + 2), AND, -1)
        return F.transform(texts, lambda t: F.struct(unescaped(role, ROLE_ESCAPES).alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), turns))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask."""
    data = formatted.cast("binary")
    return F.transform(spans, lambda s: unescaped(data.substr((s["start"] + 1).cast("int"), s["length"].cast("int")).cast("string")))


def op13_chat_format(spark, sf_dir):
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    made = format_conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more))
    read = made.withColumn("_turns", read_turns(F.col("formatted"))).withColumn("_loss", F.array_join(read_loss(F.col("formatted"), F.col("loss_spans")), ""))
    lines = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return read.select("conv_id", F.size("_turns").cast("long").alias("n_turns"), sha(lines).alias("turns_sha256"), F.length("_loss").cast("long").alias("loss_chars"), sha(F.col("_loss")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def _sql_escaped(text: str, by: tuple = ESCAPES) -> str:
    for plain, code in by:
        text = f"replace({text}, '{plain}', '{code}')"
    return text


OP13_SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
o AS (SELECT *, row_number() OVER w AS k, coalesce(role <> lag(role) OVER w, true) AS head FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
a AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY k) AS turns, coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '') AS loss,
  CAST(sum(length({_sql_escaped("text")}) + CASE WHEN head THEN length({_sql_escaped("role", ROLE_ESCAPES)}) + {len(OPEN) + 1 + len(CLOSE)} ELSE {len(AND)} END) AS BIGINT) AS formatted_chars
  FROM o GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM a
"""
