"""Cheapest repair of the turn structure of conversations, shared over all of them by a grammar.

A row is a symbol: whether it must go, or the class of its role (system, user, assistant, other) and whether its text is cut
off. What may stand where is an automaton of four states: nothing yet, a system turn, a user turn that waits, an answered one.
An edit of a row leads from state to state at a cost; so a symbol is a matrix of cheapest costs from state to state, with the
initials of the edits that cost so much, and a sequence of symbols is the min-plus product of its matrices. Of equal costs the
least initials in ASCII order stay: two edits of the same rows never are one the beginning of the other at one cost, so this order
survives concatenation.

Re-Pair over the sequences of all conversations, counted in Spark, round by round, gives rules for pairs of symbols that come
often. A rule's matrix is the product of its parts', made once, bottom up; its initials are a rope of its parts'. A conversation
is the product of the few symbols that the rules leave of it. Rows meet their edits in one sorted stream, texts are not
collected.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean, table

BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
#: Rules and rounds of Re-Pair: they change cost only.
MOST_RULES, ROUNDS = 512, 12
#: States: nothing yet, system, user, answered.
START, SYSTEM, USER, ANSWERED = range(4)
SYSTEM_ROLE, USER_ROLE, ASSISTANT_ROLE, OTHER_ROLE = range(4)
LEGAL = {(SYSTEM_ROLE, USER_ROLE), (USER_ROLE, ASSISTANT_ROLE), (ASSISTANT_ROLE, USER_ROLE)}
#: What may follow a state as a made turn, and where a kept turn leads.
MADE = {START: USER, SYSTEM: USER, USER: ANSWERED, ANSWERED: USER}
KEPT = {SYSTEM_ROLE: {START: SYSTEM}, USER_ROLE: {START: USER, SYSTEM: USER, ANSWERED: USER}, ASSISTANT_ROLE: {USER: ANSWERED}, OTHER_ROLE: {}}
NAMES = {USER: "user", ANSWERED: "assistant"}
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)

Rope = str | tuple
Matrix = dict[tuple[int, int], tuple[int, Rope]]


def text_of(rope: Rope) -> str:
    out, stack = [], [rope]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            stack += (x[1], x[0])
    return "".join(out)


def less(a: tuple[int, Rope], b: tuple[int, Rope] | None) -> bool:
    """Whether the edits a are cheaper than b, or as cheap with lesser initials."""
    return b is None or a[0] < b[0] or a[0] == b[0] and text_of(a[1]) < text_of(b[1])


def joined(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product, which is the matrix of both sequences one after the other."""
    out: Matrix = {}
    for (p, q), (cost, rope) in a.items():
        for r in range(4):
            more = b.get((q, r))
            if more is not None and less(new := (cost + more[0], (rope, more[1]) if rope and more[1] else rope or more[1]), out.get((p, r))):
                out[p, r] = new
    return out


def inserted() -> Matrix:
    """Made turns between two rows, or none: after two of them a third only repeats a state."""
    out: Matrix = {(p, p): (0, "") for p in range(4)}
    for p in range(4):
        q = MADE[p]
        for cost, rope in ((INSERT, "I"), (2 * INSERT, "II")):
            if less((cost, rope), out.get((p, q))):
                out[p, q] = (cost, rope)
            q = MADE[q]
    return out


INSERTED = inserted()


def symbol_of(role: int, fault: int) -> str:
    return "0" if fault in (BLANK, DUPLICATE) else chr(49 + 2 * role + (fault == TRUNCATED))


def terminals() -> dict[str, Matrix]:
    """The matrix of each symbol, with what is inserted before it."""
    out = {"0": {(p, p): (DELETE, "D") for p in range(4)}}
    for role in range(4):
        for fault in (NONE, TRUNCATED):
            more = CUT_OFF if fault == TRUNCATED else 0
            own: Matrix = {(p, p): (DELETE, "D") for p in range(4)}
            for options in (((p, q, KEEP + more, "K") for p, q in KEPT[role].items()), ((p, q, REROLE + more, "R") for p, q in MADE.items())):
                for p, q, cost, letter in options:
                    if less((cost, letter), own.get((p, q))):
                        own[p, q] = (cost, letter)
            out[symbol_of(role, fault)] = own
    return {s: joined(INSERTED, m) for s, m in out.items()}


class Grammar:
    """Rules (pair, symbol) in the order in which they are applied, and the matrices of all symbols."""

    def __init__(self):
        self.rules: list[tuple[str, str]] = []
        self.matrices = terminals()

    def add(self, pair: str) -> None:
        name = chr(0x100 + len(self.rules))
        self.rules.append((pair, name))
        self.matrices[name] = joined(self.matrices[pair[0]], self.matrices[pair[1]])

    def short(self, symbols: str) -> str:
        for pair, name in self.rules:
            symbols = symbols.replace(pair, name)
        return symbols

    def repair(self, symbols: str) -> tuple[int, str]:
        """Cost and initials of the cheapest edits of a sequence."""
        parts = [self.matrices[s] for s in self.short(symbols)]
        while len(parts) > 8:
            parts = [joined(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        state: Matrix = {(START, START): (0, "")}
        for m in [*parts, INSERTED]:
            state = joined(state, m)
        best = None
        for q in (START, ANSWERED):
            if (START, q) in state and less(state[START, q], best):
                best = state[START, q]
        return best[0], text_of(best[1])


def pairs_to_join(counts: list[tuple[str, int]], room: int) -> list[str]:
    """Frequent pairs that can be replaced side by side: no symbol ends one and begins another."""
    begin, end, out = set(), set(), []
    for pair, n in sorted(counts, key=lambda c: (-c[1], c[0])):
        x, y = pair
        if n < 2 or 16 * n < counts[0][1] or len(out) == room:
            continue
        if x in end or y in begin or x == y and (x in begin or y in end):
            continue
        begin.add(x)
        end.add(y)
        out.append(pair)
    return out


def grammar_of(sequences: DataFrame, most_rules: int = MOST_RULES, rounds: int = ROUNDS) -> Grammar:
    """Re-Pair over symbols, n: the pairs of each round are counted in Spark; there are at most as many as symbols squared."""
    grammar, spark = Grammar(), sequences.sparkSession

    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(grammar.rules)

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = Grammar.__new__(Grammar)
            own.rules = shared.value
            counts: Counter = Counter()
            for batch in batches:
                for symbols, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    s, last = own.short(symbols), -2
                    for i in range(len(s) - 1):
                        if s[i] == s[i + 1] and i == last + 1 and s[i] == s[i - 1]:
                            last = -2  # of three alike only one pair can be joined
                            continue
                        counts[s[i : i + 2]] += n
                        last = i
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["pair", "n"])

        totals = sequences.select("symbols", "n").mapInArrow(lean(count), "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1")
        found = [(r["pair"], r["n"]) for r in totals.orderBy(F.desc("n"), "pair").limit(4 * most_rules).collect()]
        new = pairs_to_join(found, most_rules - len(grammar.rules)) if found else []
        for pair in new:
            grammar.add(pair)
        if not new:
            break
    return grammar


def structured(rows: DataFrame) -> DataFrame:
    """_conv, symbols, gaps, blank, duplicate, truncated, illegal of rows (_conv, _present, _turn, _hash, _role, _fault), streamed in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in range(7)]
        now: list | None = None  # conversation, symbols, faults, illegal, role before, first turn, last turn, distinct turns

        def close() -> None:
            gaps = 0 if now[5] is None else now[6] - now[5] + 1 - now[7]
            for column, value in zip(out, (now[0], "".join(now[1]), gaps, *now[2][1:], now[3]), strict=True):
                column.append(value)

        def ready() -> pa.RecordBatch:
            arrays = [pa.array(out[0], kind), pa.array(out[1], pa.string()), *(pa.array(c, pa.int64()) for c in out[2:])]
            return pa.RecordBatch.from_arrays(arrays, names=["_conv", "symbols", "gaps", "blank", "duplicate", "truncated", "illegal"])

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, present, turn, role, fault in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if now is None or conv != now[0]:
                    if now is not None:
                        close()
                    now = [conv, [], [0, 0, 0, 0], 0, None, None, None, 0]
                if not present:
                    continue
                now[1].append(symbol_of(role, fault))
                now[2][fault] += 1
                now[3] += now[4] is not None and (now[4], role) not in LEGAL
                now[4] = role
                if turn is not None:
                    now[7] += now[6] != turn
                    now[5], now[6] = turn if now[5] is None else now[5], turn
            if len(out[0]) >= 4096:
                yield ready()
                out = [[] for _ in range(7)]
        if now is not None:
            close()
            yield ready()

    ordered = rows.repartition("_conv").sortWithinPartitions("_conv", F.asc_nulls_first("_turn"), "_hash")
    kind = rows.schema["_conv"].dataType.simpleString()
    shape = f"_conv {kind}, symbols string, gaps long, blank long, duplicate long, truncated long, illegal long"
    return ordered.select("_conv", "_present", "_turn", "_role", "_fault").mapInArrow(lean(run), shape)


def judged(found: DataFrame, grammar: Grammar) -> DataFrame:
    """found with cost and audit in place of symbols."""
    shared = found.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, str]] = {}
        for batch in batches:
            costs, audits = [], []
            for s in batch.column(1).to_pylist():
                if s not in known:
                    if len(known) >= 1 << 14:
                        known.clear()
                    known[s] = shared.value.repair(s)
                costs.append(known[s][0])
                audits.append(known[s][1])
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(costs, pa.int64()), pa.array(audits, pa.string())], names=["_conv", *batch.schema.names[2:], "cost", "audit"])

    kind = found.schema["_conv"].dataType.simpleString()
    return found.select("_conv", "symbols", "gaps", "blank", "duplicate", "truncated", "illegal").mapInArrow(lean(run), f"_conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def edited(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """_conv, place, role, text of the repaired turns, in order within each partition. rows: _conv, _turn, _hash, role, text; audits: _conv,
    audit. A conversation's edits come first in the sorted stream, then its rows."""
    first = audits.select("_conv", F.lit(0).alias("_kind"), F.lit(None).cast(rows.schema["_turn"].dataType).alias("_turn"), F.lit(None).cast("binary").alias("_hash"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"))
    both = first.unionByName(rows.select("_conv", F.lit(1).alias("_kind"), "_turn", "_hash", "role", "text"))
    of_role = {"s": SYSTEM_ROLE, "u": USER_ROLE, "a": ASSISTANT_ROLE}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, state, conv, place = "", 0, START, None, 0
        out: list[list] = [[], [], [], []]

        def put(role: str, text: str) -> None:
            nonlocal place
            for column, value in zip(out, (conv, place, role, text), strict=True):
                column.append(value)
            place += 1

        def insert() -> None:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                state, at = MADE[state], at + 1
                put(NAMES[state], "")

        def ready(kind: pa.DataType) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(out[0], kind), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())], names=["_conv", "place", "role", "text"])

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for own, header, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if header == 0:
                    insert()
                    audit, at, state, conv, place = text, 0, START, own, 0
                    continue
                insert()
                letter, at = audit[at], at + 1
                if letter == "K":
                    state = KEPT[of_role.get(role[:1], OTHER_ROLE)][state]
                    put(role, text)
                elif letter == "R":
                    state = MADE[state]
                    put(NAMES[state], text)
            yield ready(kind)
            out = [[], [], [], []]
        insert()
        if kind is not None:
            yield ready(kind)

    ordered = both.repartition("_conv").sortWithinPartitions("_conv", "_kind", F.asc_nulls_first("_turn"), "_hash")
    return ordered.select("_conv", "_kind", "role", "text").mapInArrow(lean(run), f"_conv {rows.schema['_conv'].dataType.simpleString()}, place long, role string, text string")


def digests(turns: DataFrame) -> DataFrame:
    """_conv, repaired_sha256 of edited(): `role:text` lines, hashed as they stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list] = ([], [])
        conv, kind, hashed = None, None, None
        for batch in batches:
            kind = batch.schema.field(0).type
            for own, place, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if place == 0:
                    if hashed is not None:
                        out[0].append(conv)
                        out[1].append(hashed.hexdigest())
                    conv, hashed = own, sha256()
                else:
                    hashed.update(b"\n")
                hashed.update(f"{role}:{text}".encode())
        if hashed is not None:
            out[0].append(conv)
            out[1].append(hashed.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], kind), pa.array(out[1], pa.string())], names=["_conv", "repaired_sha256"])

    return turns.mapInArrow(lean(run), f"_conv {turns.schema['_conv'].dataType.simpleString()}, repaired_sha256 string")


def repair_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Two tables: for each conversation gaps, blank, duplicate, truncated, illegal, cost and audit, and its repaired turns (conv, place,
    role, text).

    Rows where present_col is not true only name their conversation. Defined cases: rows go by turn, nulls first, and rows of one turn by
    the hash of role and text; null roles and texts are one space, so blank; of rows given twice the second is a duplicate; a conversation
    without rows has zeros and an empty audit; rows of null conversations are one conversation; an empty table gives empty results; other
    columns are not looked at. A task holds one symbol for each row of a conversation, and streams the texts.
    """
    scratch = Scratch(df.sparkSession, "turns")
    role, text = F.coalesce(F.col(role_col), F.lit(" ")), F.coalesce(F.col(text_col), F.lit(" "))
    present = F.lit(True) if present_col is None else F.coalesce(F.col(present_col), F.lit(False))
    rows = df.select(F.col(conv_col).alias("_conv"), F.col(turn_col).alias("_turn"), present.alias("_present"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("_hash", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)))
    shown = F.rtrim(F.col("text"), F.lit(BLANKS))
    plain = F.when(shown == "", BLANK).when(F.right(shown, F.lit(1)).isin(".", "!", "?"), NONE).otherwise(TRUNCATED)
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", SYSTEM_ROLE).when(initial == "u", USER_ROLE).when(initial == "a", ASSISTANT_ROLE).otherwise(OTHER_ROLE)
    small = rows.select("_conv", "_present", "_turn", "_hash", kind.alias("_role"), plain.alias("_plain"))
    earlier = F.expr("row_number() OVER (PARTITION BY _conv, _hash, _present ORDER BY _turn ASC NULLS FIRST)") > 1
    faulty = small.withColumn("_fault", F.when((F.col("_plain") != BLANK) & earlier, DUPLICATE).otherwise(F.col("_plain")))
    found = scratch.write(structured(faulty), "symbols")
    sequences = scratch.write(found.where("length(symbols) > 1").groupBy("symbols").agg(F.count(F.lit(1)).alias("n")), "sequences")
    grammar = grammar_of(sequences)
    scratch.drop(sequences)
    audits = scratch.write(judged(found, grammar), "audits")
    scratch.drop(found)
    return audits.withColumnRenamed("_conv", conv_col), edited(rows.where("_present"), audits.select("_conv", "audit")).withColumnRenamed("_conv", conv_col)


def damaged(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, present: the rows as the hash of conversation and turn damages them; a dropped one is not present."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(h == 1, "").when(h == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(h == 4, "user").otherwise(space("role"))
    copies = F.array_repeat(h != 0, F.when(h == 3, 2).otherwise(1))
    return df.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("present"))


def op12_turn_repair(spark, sf_dir):
    audits, turns = repair_conversations(damaged(table(spark, sf_dir, "conversations")), present_col="present")
    hashed = digests(turns.withColumnRenamed("conv_id", "_conv"))
    none = F.lit(sha256(b"").hexdigest())
    joined_ = audits.join(hashed, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return joined_.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("repaired_sha256", none).alias("repaired_sha256"))
