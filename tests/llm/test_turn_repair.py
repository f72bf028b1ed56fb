import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from sparsegrove.llm.turn_repair import Grammar, grammar_of, op12_turn_repair, pairs_to_join, repair_conversations, symbol_of, text_of

SHAPE = "conv_id long, turn long, role string, text string"
GOOD = re.compile(r"(s?(ua)+)?")
BEGINS = re.compile(r"(s?(ua)*u?)?")
BLANKS = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """All edits of rows (initial, fault) by search; faults 0 none, 1 and 2 to delete, 3 truncated: cost, initials, and what becomes of it."""
    best = None

    def go(i, made, cost, audit, picks):
        nonlocal best
        if not BEGINS.fullmatch(made) or best is not None and cost > best[0]:
            return
        if i == len(rows) and GOOD.fullmatch(made) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, picks)
        if len(audit) - len(audit.rstrip("I")) < 2:
            for role in "ua":
                go(i, made + role, cost + 5, audit + "I", [*picks, (None, role)])
        if i == len(rows):
            return
        role, fault = rows[i]
        go(i + 1, made, cost + 2, audit + "D", picks)
        if fault in (0, 3):
            more = 5 if fault == 3 else 0
            if role in "sua":
                go(i + 1, made + role, cost + more, audit + "K", [*picks, (i, None)])
            for new in "ua":
                go(i + 1, made + new, cost + 1 + more, audit + "R", [*picks, (i, new)])

    go(0, "", 0, "", [])
    return best


def symbols(rows):
    return "".join(symbol_of("suax".index(r if r in "sua" else "x"), f) for r, f in rows)


def test_cheapest_edits_of_all_short_sequences():
    kinds = [("s", 0), ("u", 0), ("a", 0), ("x", 0), ("u", 1), ("a", 3), ("s", 3)]
    plain = Grammar()
    ruled = Grammar()
    for pair in [symbols([a, b]) for a in kinds[:4] for b in kinds[4:]]:
        ruled.add(pair)
    for n in range(4):
        for rows in itertools.product(kinds, repeat=n):
            want = cheapest(list(rows))[:2]
            assert plain.repair(symbols(rows)) == ruled.repair(symbols(rows)) == want, rows
    rng = random.Random(1)
    for _ in range(60):
        rows = [rng.choice(kinds) for _ in range(rng.randint(4, 6))]
        assert ruled.repair(symbols(rows)) == cheapest(rows)[:2]


def test_long_sequences_by_any_grammar():
    rng = random.Random(2)
    for n in (40, 300, 3000):
        s = "".join(rng.choice("0123456785634") for _ in range(n))
        a, b = Grammar(), Grammar()
        for pair in ("56", "35", "63"):
            b.add(pair)
        b.add("Āā")
        assert a.repair(s) == b.repair(s) and len(a.repair(s)[1].replace("I", "")) == n


def test_pairs_of_a_round_do_not_overlap():
    counts = sorted(Counter({"ab": 9, "bc": 8, "aa": 7, "db": 6, "cd": 5, "xx": 5}).items(), key=lambda c: -c[1])
    assert pairs_to_join(counts, 9) == ["ab", "cd", "xx"] or "bc" not in pairs_to_join(counts, 9)
    assert text_of((("a", "b"), ("c", ("d", "")))) == "abcd"


def test_grammar_in_rounds(spark):
    rows = [("3535353563", 5), ("35635", 2), ("555555", 3), ("35", 1)]
    g = grammar_of(spark.createDataFrame(rows, "symbols string, n long"))
    assert g.rules and all(len(g.short(s)) < len(s) for s, _ in rows) and all(g.repair(s) == Grammar().repair(s) for s, _ in rows)
    assert grammar_of(spark.createDataFrame([], "symbols string, n long")).rules == []


def whole(rows):
    """What the query returns, in plain Python; rows of one turn must be alike."""
    convs = {}
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        own = convs.setdefault(c, [])
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        own += [(t, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    out = []
    for c, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, marked, counts = set(), [], Counter()
        for t, role, text in own:
            shown = text.strip(BLANKS)
            fault = 1 if not shown else 2 if (role, text) in seen else 3 if shown[-1] not in ".!?" else 0
            seen.add((role, text))
            counts[fault] += 1
            marked.append((role[:1] if role[:1] in ("s", "u", "a") else "x", fault))
        turns = [t for t, *_ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in itertools.pairwise(marked))
        cost, audit, picks = cheapest(marked)
        full = {"u": "user", "a": "assistant"}
        lines = [f"{full[new] if new else own[i][1]}:{'' if i is None else own[i][2]}" for i, new in picks]
        out.append((c, gaps, counts[1], counts[2], counts[3], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def test_the_whole_query_against_plain_python(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = op12_turn_repair(spark, d)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == whole(rows)


def test_nulls_batches_and_clashing_columns(spark, small_batches, tmp_path):
    rng = random.Random(4)
    roles = ["user", "assistant", "system", "tool", "", None, "u", "é"]
    texts = ["Fine.", "Cut", " ", None, "", "Why?\n", "Fine.", "x. ", "!"]
    rows = [(c, t, rng.choice(roles), rng.choice(texts)) for c in [None, *range(40)] for t in rng.sample([None, *range(9)], rng.randint(1, 5))]
    spark.createDataFrame(rows, SHAPE).withColumn("cost", F.lit("x")).withColumn("_conv", F.lit(1)).withColumn("present", F.lit(0)).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(tuple, op12_turn_repair(spark, str(tmp_path)).collect()), key=str)
    assert got == whole(rows) and {r[0] for r in got} == {r[0] for r in rows}


def test_empty_tables_and_repaired_turns(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Hello."), (1, 2, "assistant", "Yes."), (2, 0, "assistant", "So.")], SHAPE)
    audits, turns = repair_conversations(df)
    assert {r["conv_id"]: (r["cost"], r["audit"]) for r in audits.collect()} == {1: (2, "DKK"), 2: (2, "D")}
    assert [tuple(r) for r in turns.orderBy("conv_id", "place").collect()] == [(1, 0, "user", "Hello."), (1, 1, "assistant", "Yes.")]
    audits, turns = repair_conversations(df.where("false"))
    assert audits.count() == 0 and turns.count() == 0
