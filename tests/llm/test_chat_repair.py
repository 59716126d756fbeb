import random
from itertools import product

from pyspark.sql import functions as F

from cohortkit.llm import chat_repair as C

DDL = "conv_id long, turn int, role string, text string"


def cheapest(codes):
    """Cost of the best repair over every choice of states, with the automaton written out."""
    legal = {0: "su", 1: "u", 2: "a", 3: "u"}
    number = {"s": 1, "u": 2, "a": 3}

    def insert_cost(s, t):
        todo, seen = [(s, 0)], {s}
        while todo:
            x, n = todo.pop(0)
            if x == t:
                return 3 * n
            for r in legal[x]:
                if number[r] not in seen:
                    seen.add(number[r])
                    todo.append((number[r], n + 1))
        return 10**9
    best = {0: 0}
    for c in codes:
        new = {}
        for s, cost in best.items():
            for m in range(4):
                base = cost + insert_cost(s, m)
                for r in legal[m]:
                    t = number[r]
                    new[t] = min(new.get(t, 10**9), base + (0 if t == c else 2 if c else 1))
                if m:
                    new[m] = min(new.get(m, 10**9), base + (1 if m == c else 3))
        best = new
    return min(cost + insert_cost(s, 3) for s, cost in best.items())


def check_legal(rows, codes):
    """Fragments of one chat in order: a legal sequence, all turns in order, at the cheapest cost."""
    state, cost, n = 0, 0, 0
    for r in rows:
        if r["action"] == "end":
            assert state == 3 and r is rows[-1]
            continue
        role = C.ROLES.index(r["role"]) + 1
        if r["action"] == "merge":
            assert role == state
            cost += 1 if codes[n] == state else 3
        else:
            assert role in C.NEXT[state]
            cost += {"keep": 0, "insert": 3}.get(r["action"], 2 if r["action"] != "insert" and n < len(codes) and codes[n] else 1)
            if r["action"] == "keep":
                assert codes[n] == role
        n += r["action"] != "insert"
        state = role
    assert n == len(codes) and rows[-1]["action"] == "end"
    assert cost == cheapest(codes)


def collect(df):
    out = {}
    rows = df.collect()
    for r in sorted(rows, key=lambda r: (r["conv_id"] is None, r["conv_id"] or 0, *[r[k] for k in C.KEY[1:]], r["nth"])):
        out.setdefault(r["conv_id"], []).append(r)
    return out


NAMES = ["tool", "system", "user", "assistant"]


def test_every_short_chat(spark):
    chats = [c for n in (1, 2, 3, 4) for c in product(range(4), repeat=n)]
    rows = [(i, t, NAMES[c], f"{i}.{t}") for i, chat in enumerate(chats) for t, c in enumerate(chat)]
    got = collect(C.repair(spark.createDataFrame(rows, DDL)))
    for i, chat in enumerate(chats):
        check_legal(got[i], chat)
        assert [r["turn"] for r in got[i] if r["turn"] is not None] == list(range(len(chat)))


def test_long_chats_in_blocks_and_crowded_turns(spark):
    rng = random.Random(3)
    rows, codes = [], {}
    for conv in (1, 2):
        codes[conv] = [rng.randrange(4) for _ in range(300)]
        rows += [(conv, t, NAMES[c], "x") for t, c in enumerate(codes[conv])]
    rows += [(3, 7, "user", f"u{i}") for i in range(200)] + [(3, None, "assistant", f"a{i}") for i in range(100)]
    got = collect(C.repair(spark.createDataFrame(rows, DDL), block_turns=8, group=3))
    for conv in (1, 2):
        check_legal(got[conv], codes[conv])
    assert len({(r["part_turn"], r["part_hash"]) for r in got[3]}) > 10
    check_legal(got[3], [2] * 200 + [3] * 100)


def test_edge_rows_and_rendering(spark):
    rows = [(1, 0, " USER ", "hi"), (1, 1, "Assistant", None), (None, 0, "user", "lost"), (2, 0, None, ""), (3, 0, "user", "twin"),
            (3, 0, "user", "twin"), (4, None, "assistant", "late"), (4, 5, "user", "z" * 200_000)]
    df = spark.createDataFrame(rows, DDL).withColumn("block", F.lit("clash"))
    text = {r["conv_id"]: r["text"] for r in C.render(C.repair(df)).collect()}
    close = C.CLOSE
    assert text[1] == f"<|user|>\nhi{close}<|assistant|>\n{close}"
    assert text[None] == f"<|user|>\nlost{close}<|assistant|>\n{close}"
    assert text[2] == f"<|user|>\n{close}<|assistant|>\n{close}"
    assert text[3] == f"<|user|>\ntwin{close}<|assistant|>\n{close}"
    assert text[4] == f"<|user|>\n{'z' * 200_000}{close}<|assistant|>\nlate{close}"
    assert C.repair(df.limit(0)).collect() == []


def test_registered_query_is_legal_and_cheapest(spark):
    path = "/root/testdata/sf0.01"
    codes = {}
    for r in sorted(spark.read.parquet(f"{path}/conversations.parquet").collect(), key=lambda r: (r["conv_id"], r["turn"])):
        codes.setdefault(r["conv_id"], []).append(C.role_code(r["role"]))
    got = collect(C.op4_chat_repair(spark, path))
    assert set(got) == set(codes)
    for conv, c in codes.items():
        check_legal(got[conv], c)
