import hashlib
import itertools
import random
import re
import zlib
from functools import cache

import duckdb
import pytest

from cohortkit.llm import structure_repair as R
from cohortkit.llm.common import sql_bits, sql_crc32

SPACE = " \t\n\x0b\x0c\r"
DDL = "conv_id long, turn long, role string, text string"
NAMES = {"u": "user", "a": "assistant"}


def sort_key(r):
    return r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()


def plain(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, hash) of rows (turn, role, text)."""
    rows = sorted(rows, key=sort_key)
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))

    @cache
    def best(i, last, inserts):
        """Cheapest (cost, edits, rows) from row i on, after a row with the initial ``last``."""
        after = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        ways = [(0, "", ())] if i == len(rows) and last in ("", "a") else []
        for c in set(after) & {"u", "a"} if inserts else ():
            k, a, t = best(i, c, inserts - 1)
            ways.append((k + 2, "I" + a, ((NAMES[c], ""), *t)))
        if i < len(rows):
            _, role, text = rows[i]
            k, a, t = best(i + 1, last, 3)
            ways.append((k + 3, "D" + a, t))
            if faults[i] not in ("blank", "duplicate"):
                extra = faults[i] == "truncated"
                if role and role[0] in after:
                    k, a, t = best(i + 1, role[0], 3)
                    ways.append((k + extra, "K" + a, ((role, text), *t)))
                for c in set(after) & {"u", "a"}:
                    k, a, t = best(i + 1, c, 3)
                    ways.append((k + extra + 2, "R" + a, ((NAMES[c], text), *t)))
        return min(ways, default=(10**9, "", ()))
    cost, audit, repaired = best(0, "", 3) if rows else (0, "", ())
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    text = "\n".join(f"{a}:{b}" for a, b in repaired)
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
            hashlib.sha256(text.encode()).hexdigest())


def every_audit(rows):
    """The cheapest, then least string over all strings of edits with up to two inserts in a place."""
    initial = [r[1][:1] for r in rows]
    found = []
    for edits in itertools.product("DKR", repeat=len(rows)):
        for ins in itertools.product(range(3), repeat=len(rows) + 1):
            for fill in itertools.product("ua", repeat=sum(ins) + edits.count("R")):
                fill, out, audit, cost = list(fill), "", "", 0
                for i in range(len(rows) + 1):
                    for _ in range(ins[i]):
                        out, audit, cost = out + fill.pop(), audit + "I", cost + 2
                    if i < len(rows):
                        audit += edits[i]
                        if edits[i] == "D":
                            cost += 3
                        else:
                            out += initial[i] if edits[i] == "K" else fill.pop()
                            cost += (edits[i] == "R") * 2 + (rows[i][2][-1] not in ".!?")
                if re.fullmatch("(s?(ua)+)?", out):
                    found.append((cost, audit))
    return min(found)


def result(docs, **sizes):
    return {r["conv_id"]: tuple(r)[1:] for r in R.summaries(R.repair(docs, **sizes)).collect()}


def random_rows(rng, n):
    return [(rng.choice([None, *range(n)]), rng.choice(["system", "user", "assistant", "tool", "", " ", "ué", "Assistant"][:rng.choice([3, 8])]),
             rng.choice(["", " \n", "ok.", "ok", "so! ", "why?\n", "cut", "é\U0001f600.", "end.x"])) for _ in range(n)]


def test_random_conversations_match_a_plain_version_in_any_blocks(spark):
    rng = random.Random(4)
    chats = {i: random_rows(rng, rng.randrange(1, 13)) for i in range(400)}
    rows = [(i, *r) for i, c in chats.items() for r in c]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, DDL).repartition(5)
    want = {i: plain(c) for i, c in chats.items()}
    assert result(docs) == want
    assert result(docs, block_rows=3) == want
    assert result(docs, block_bytes=1) == want


def test_the_plain_version_is_the_least_of_all_strings():
    rng = random.Random(8)
    for _ in range(60):
        n = rng.randrange(0, 4)
        rows = [(i, rng.choice(["system", "user", "assistant", "tool"]), f"{i}" + rng.choice(".x")) for i in range(n)]
        assert every_audit(rows) == plain(rows)[5:7]


def test_long_walks_match_the_plain_version():
    rng = random.Random(6)
    for n in (1, 2, 50, 100, 150):
        rows = [(i, rng.choice(["system", "user", "assistant", "x"]), f"{i}" + rng.choice(".x")) for i in range(n)]
        block = R.record([(*r, 1, True, False, r[2][-1] == "x") for r in rows])
        *edits, last = R.tight_edits(block["codes"], R.closing(), 0)
        audit = "".join(e[0] for e in edits) + "".join("I" for _ in R.inserts_at(R.closing(), last[1]))
        assert (R.before_rows(block["codes"], R.closing())[0], audit) == plain(rows)[5:7]
        assert R.through(block["matrix"], R.closing()) == R.before_rows(block["codes"], R.closing())


def test_edge_rows(spark):
    docs = spark.createDataFrame([
        (None, 1, "user", "hi."), (None, None, None, None), (None, 2, "assistant", "yes."),
        (1, None, None, "x."), (1, None, None, "x."), (2, 5, "user", "a."), (2, 9, "assistant", "b."), (2, 9, "assistant", "b."),
        (3, 0, "user", " "), (4, 1, "system", "s.")], DDL).selectExpr("*", "text AS audit", "turn AS block")
    fill = lambda *r: (r[0], *[" " if x is None else x for x in r[1:]])
    chats = {}
    for r in docs.collect():
        chats.setdefault(r["conv_id"], []).append(fill(r["turn"], r["role"], r["text"]))
    assert result(docs) == {k: plain(v) for k, v in chats.items()}
    assert result(docs.limit(0)) == {}
    turns = R.repaired_turns(docs.filter("conv_id = 2")).orderBy("part", "block", "nth").collect()
    assert [(r["role"], r["text"]) for r in turns] == [("user", "a."), ("assistant", "b.")]


def test_a_hot_conversation_is_spread_over_blocks(spark):
    n = 30_000
    docs = spark.range(n).selectExpr("7L AS conv_id", "id AS turn", "if(id % 3 = 0, 'user', 'assistant') AS role",
                                     "concat('t', id % 20000, if(id % 5 = 0, '', '.')) AS text")
    copies = spark.range(5000).selectExpr("7L AS conv_id", "3L AS turn", "'user' AS role", "'t3.' AS text")
    got = result(docs.unionAll(copies), block_rows=512)[7]
    rows = [(i, "assistant" if i % 3 else "user", f"t{i % 20000}" + ("" if i % 5 == 0 else ".")) for i in range(n)] + [(3, "user", "t3.")] * 5000
    rows.sort(key=sort_key)
    seen, members = set(), []
    for r in rows:
        members.append((*r, 1, (r[1], r[2]) not in seen, False, r[2][-1] != "."))
        seen.add((r[1], r[2]))
    whole = R.record(members)
    cost = R.before_rows(whole["codes"], R.closing())[0]
    audit = "".join(e[0] for e in R.tight_edits(whole["codes"], R.closing(), 0) if e[0])
    assert got[0] == 0 and got[1:5] == (0, whole["duplicate"], whole["truncated"], whole["illegal"])
    assert got[5] == cost and got[6].startswith(audit)


@pytest.mark.parametrize("text", ["", "a", "12:3", " : ", "-5:7", "naïve €"])
def test_sql_checksum(text):
    assert duckdb.connect().execute(f"SELECT {sql_crc32(sql_bits(chr(39) + text + chr(39)))}").fetchone()[0] == zlib.crc32(text.encode())


def test_registered_query_matches_its_sql_and_the_plain_version(spark):
    path = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{path}/conversations.parquet'")
    want = con.execute(R.OP12_SQL)
    names = [d[0] for d in want.description]
    got = R.op12_structure_repair(spark, path)
    assert got.columns == names
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(want.fetchall())
    chats = {}
    for conv, turn, role, text in con.execute("select * from conversations").fetchall():
        h = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        chats.setdefault(conv, [])
        if h:
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            chats[conv] += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    assert rows == sorted((conv, *plain(c)) for conv, c in chats.items())
