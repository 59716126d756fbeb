"""Repair of conversation structure at the lowest cost, by a dynamic program with checkpoints.

A repaired conversation has the role initials ``(s?(ua)+)?``.  Rows are kept (K, 0),
given the role user or assistant (R, 2), or deleted (D, 3); empty rows may be
inserted anywhere (I, 2).  Blank rows and rows whose role and text came earlier must
go; a truncated row that stays costs 1 more.  Of the cheapest ways the one with the
ASCII-least string of edits is taken.

The automaton has four states, and the cost of what is still to come is a vector over
them.  Vectors are stored at checkpoints only:

1. Equal rows become one with a number of copies, and the rows that are not the first
   of their role and text are marked, by two grouped counts.
2. The rows are sorted by conversation and place with range partitions, so a large
   conversation is spread over many, and cut into blocks of at most ``BLOCK_ROWS`` rows
   and ``BLOCK_BYTES`` bytes.  A block's (min, +) matrix takes the vector behind it to
   the one before it.
3. One pass over each conversation's matrices from the back gives the vector behind
   every block: the checkpoints.  With it a block says to which state each state leads
   by the least tight edits, and one pass from the front gives the state it starts in.
   Both passes stream: they hold one vector or state, and see a few numbers a block.
4. Every block walks forward alone.  Inside it, vectors are kept at every
   sqrt(rows)-th row and recomputed between two of them, and at each row the
   ASCII-least edit that keeps the cost tight is emitted.

So one conversation of any length is repaired by many tasks.  ``repaired_turns`` gives
the rows of the result, ``summaries`` one row a conversation; the latter's hash and
string of edits need a conversation's blocks in order, so they stream through one task
each, block by block, with the hash's state and the edits in memory.

Defined cases: rows go by turn, NULL first, then role, then SHA-256 of the text; a
NULL role or text counts as one space; a NULL ``conv_id`` is a conversation of its own;
equal rows are adjacent and all but the first are duplicates (or blank); a role may be
any string, its first character counts; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from itertools import groupby
from math import isqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, read_table, sql_bits, sql_crc32, written

# States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
KEEP_TO = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FILL_TO = (2, 2, 3, 2)                       # state after an inserted or relabelled row
FILL_ROLE = ("user", "user", "assistant", "user")
ACCEPT = (0, None, None, 0)
LEGAL_PAIRS = ("su", "ua", "au")
# Costs of the edits
DELETE, INSERT, RELABEL, TRUNCATED = 3, 2, 2, 1
NEVER = 10**15
BLOCK_ROWS = 4096
BLOCK_BYTES = 8 << 20
# A row's code: 3 * place of its initial in INITIALS (3: another) + kind
INITIALS = "sua"
SOUND, CUT, FORCED = 0, 1, 2                 # kinds: nothing wrong, truncated, must be deleted


def with_inserts(v: list[int]) -> list[int]:
    """The vector before any number of inserted rows, from the vector behind them."""
    v = list(v)
    for _ in range(2):                       # two inserts reach every state that inserts can reach
        v = [min(v[s], INSERT + v[FILL_TO[s]]) for s in range(4)]
    return v


def closing() -> list[int]:
    return with_inserts([NEVER if a is None else a for a in ACCEPT])


def row_options(code: int) -> list[list[tuple]]:
    """For each state the edits of one row as (letter, cost, next state), in ASCII order."""
    initial, kind = divmod(code, 3)
    initial = (INITIALS + " ")[initial]
    out = []
    for s in range(4):
        ways = [("D", DELETE, s)]
        if kind != FORCED:
            extra = TRUNCATED if kind == CUT else 0
            if (s, initial) in KEEP_TO:
                ways.append(("K", extra, KEEP_TO[s, initial]))
            ways.append(("R", RELABEL + extra, FILL_TO[s]))
        out.append(ways)
    return out


OPTIONS = [row_options(c) for c in range(12)]


def before_row(code: int, behind: list[int]) -> list[int]:
    """The vector before a row (and the inserts in front of it) from the one behind it."""
    return with_inserts([min(cost + behind[t] for _, cost, t in ways) for ways in OPTIONS[code]])


def before_rows(codes: bytes, behind: list[int]) -> list[int]:
    for c in reversed(codes):
        behind = before_row(c, behind)
    return behind


def matrix(codes: bytes) -> list[int]:
    """Row by row: cheapest cost from state to state over the rows."""
    ends = [before_rows(codes, [0 if s == t else NEVER for s in range(4)]) for t in range(4)]
    return [min(NEVER, ends[t][s]) for s in range(4) for t in range(4)]


def through(m: list[int], behind: list[int]) -> list[int]:
    return [min(NEVER, *(m[4 * s + t] + behind[t] for t in range(4))) for s in range(4)]


def inserts_at(v: list[int], s: int):
    """The tight inserted rows in a place whose vector is ``v``: yields the states they start in."""
    while v[s] == INSERT + v[FILL_TO[s]]:
        yield s
        s = FILL_TO[s]


def tight_edits(codes: bytes, behind: list[int], s: int):
    """The ASCII-least tight edits as (letter, state before, row number), then (None, last state, None).

    Vectors are kept at checkpoints every sqrt(rows) rows; those of one stretch are
    recomputed when the walk comes to it.
    """
    step = max(1, isqrt(len(codes)))
    marks, v = {}, behind
    for i in range(len(codes), -1, -1):
        if i % step == 0 or i == len(codes):
            marks[i] = v
        if i:
            v = before_row(codes[i - 1], v)
    for a in range(0, len(codes), step):
        b = min(a + step, len(codes))
        vectors = [marks[b]]
        for c in reversed(codes[a:b]):
            vectors.append(before_row(c, vectors[-1]))
        vectors.reverse()
        for i in range(a, b):
            now, after = vectors[i - a], vectors[i - a + 1]
            while True:
                ways = [("I", INSERT, FILL_TO[s], now)] + [(x, cost, t, after) for x, cost, t in OPTIONS[codes[i]][s]]
                letter, _, t, _ = min(w for w in ways if w[1] + w[3][w[2]] == now[s])
                yield letter, s, i
                s = t
                if letter != "I":
                    break
    yield None, s, None


def placed(turns: DataFrame) -> DataFrame:
    """Different rows with their copies: (conv_id, turn, role, mark, text, n, first, blank, cut)."""
    rows = turns.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    rows = rows.withColumn("mark", F.unhex(F.sha2("text", 256)))
    key = ["conv_id", "role", "mark"]
    rows = written(rows.groupBy("conv_id", "turn", "role", "mark", "text").agg(F.count(F.lit(1)).alias("n")), "structure-rows")
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = rows.groupBy(*key).agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    same = F.lit(True)
    for c in key:
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"g.{c}"))
    return rows.alias("r").join(again.alias("g"), same, "left").select(
        "r.*", (F.col("first").isNull() | F.col("first.turn").eqNullSafe(F.col("r.turn"))).alias("first"),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        (~F.col("text").rlike(rf"[.!?]{SPACE_CLASS}*\z")).alias("cut"))


BLOCK_FIELDS = ("part int, block long, codes binary, matrix array<long>, copies array<long>, roles array<string>, texts array<string>, "
                "blank long, duplicate long, truncated long, illegal long, head string, tail string, "
                "low long, high long, n_turns long, first_turn long, last_turn long")


def record(rows: list[tuple]) -> dict:
    """One block of sorted rows (turn, role, text, n, first, blank, cut)."""
    codes, counts = bytearray(), {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    before = None
    for _, role, _, n, first, blank, cut in rows:
        initial = role[:1]
        kind = FORCED if blank or not first else CUT if cut else SOUND
        codes.append(3 * (INITIALS.index(initial) if initial and initial in INITIALS else 3) + kind)
        counts["blank"] += n if blank else 0
        counts["duplicate"] += 0 if blank else n - 1 if first else n
        counts["truncated"] += kind == CUT
        counts["illegal"] += (n - 1) + (before is not None and before + initial not in LEGAL_PAIRS)
        before = initial
    turns = [r[0] for r in rows if r[0] is not None]
    return {"codes": bytes(codes), "matrix": matrix(codes), "copies": [r[3] for r in rows], "roles": [r[1] for r in rows],
            "texts": [r[2] for r in rows], **counts, "head": rows[0][1][:1], "tail": before, "low": min(turns, default=None),
            "high": max(turns, default=None), "n_turns": len(set(turns)), "first_turn": rows[0][0], "last_turn": rows[-1][0]}


def batched(rows, schema, size: int = 256):
    """Record batches of dicts; ``schema`` is made in the task."""
    import pyarrow as pa
    held, weight = [], 0
    for r in rows:
        held.append(r)
        weight += sum(len(t) for t in r.get("texts") or ())
        if len(held) >= size or weight > BLOCK_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def mapped(df: DataFrame, fn, ddl: str) -> DataFrame:
    """``fn`` from an iterator of row dicts to one, over every partition."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    return df.mapInArrow(lambda batches: batched(fn(r for b in batches for r in b.to_pylist()), schema), ddl)


def kind_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def blocks_of(rows: DataFrame, block_rows: int, block_bytes: int) -> DataFrame:
    """The sorted rows of each conversation in blocks, numbered by range partition and place in it."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "mark"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("mark")

    def cut(members):
        from pyspark import TaskContext
        part, number = TaskContext.get().partitionId(), 0
        for conv, group in groupby(members, key=lambda r: r["conv_id"]):
            held, weight = [], 0
            for r in group:
                if held and (len(held) >= block_rows or weight + len(r["text"]) > block_bytes):
                    yield {"conv_id": conv, "part": part, "block": number, **record(held)}
                    held, weight, number = [], 0, number + 1
                held.append((r["turn"], r["role"], r["text"], r["n"], r["first"], r["blank"], r["cut"]))
                weight += len(r["text"])
            yield {"conv_id": conv, "part": part, "block": number, **record(held)}
            number += 1
    return written(mapped(dealt, cut, f"conv_id {kind_of(rows, 'conv_id')}, {BLOCK_FIELDS}"), "structure-blocks")


def along(df: DataFrame, fn, ddl: str, down: bool = False) -> DataFrame:
    """``fn(rows)`` over each conversation's blocks in order, or from the back; streamed."""
    order = [F.col(c).desc() if down else F.col(c).asc() for c in ("part", "block")]
    dealt = df.repartition("conv_id").sortWithinPartitions("conv_id", *order)
    return mapped(dealt, lambda rows: (out for _, g in groupby(rows, key=lambda r: r["conv_id"]) for out in fn(g)), ddl)


def checkpoints(blocks: DataFrame) -> DataFrame:
    """(part, block, behind, start, final): the vector behind each block and the state it starts in."""
    kind = kind_of(blocks, "conv_id")

    def backward(members):
        v, final = closing(), True
        for r in members:
            yield {"conv_id": r["conv_id"], "part": r["part"], "block": r["block"], "behind": v, "final": final}
            v, final = through(r["matrix"], v), False
    behind = written(along(blocks.select("conv_id", "part", "block", "matrix"), backward,
                           f"conv_id {kind}, part int, block long, behind array<long>, final boolean", down=True), "structure-behind")

    def leads(rows):
        for r in rows:
            codes = r.pop("codes")
            # the state at the end for each state at the start
            r["to"] = [list(tight_edits(codes, r["behind"], s))[-1][1] if not r["alone"] else s for s in range(4)]
            yield r
    alone = behind.groupBy("conv_id").agg((F.count(F.lit(1)) == 1).alias("alone"))
    known = behind.alias("b").join(alone.alias("a"), F.col("a.conv_id").eqNullSafe(F.col("b.conv_id"))).select("b.*", "alone")
    functions = mapped(known.join(blocks.select("part", "block", "codes"), ["part", "block"]).select(
        "conv_id", "part", "block", "behind", "final", "alone", "codes"), leads,
        f"conv_id {kind}, part int, block long, behind array<long>, final boolean, to array<int>")

    def forward(members):
        s = 0
        for r in members:
            yield {k: r[k] for k in ("part", "block", "behind", "final")} | {"start": s}
            s = r["to"][s]
    return written(along(functions, forward, "part int, block long, behind array<long>, final boolean, start int"), "structure-starts")


def repair(turns: DataFrame, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The repaired conversations in blocks: (conv_id, part, block, audit, cost, roles, texts, and what the
    block held before); ``audit`` has the edits' letters, ``cost`` their cost, ``roles`` and ``texts`` the
    repaired rows."""
    blocks = blocks_of(placed(turns), block_rows, block_bytes)
    starts = checkpoints(blocks)
    carried = ["blank", "duplicate", "truncated", "illegal", "head", "tail", "low", "high", "n_turns", "first_turn", "last_turn"]

    def walk(rows):
        for r in rows:
            audit, roles, texts, s, cost = [], [], [], r["start"], 0

            def fill(state):
                audit.append("I")
                roles.append(FILL_ROLE[state])
                texts.append("")
            for letter, state, i in tight_edits(r["codes"], r["behind"], r["start"]):
                if letter is None:
                    s = state
                elif letter == "I":
                    fill(state)
                    cost += INSERT
                else:
                    again = r["copies"][i] - 1
                    audit.append(letter + "D" * again)
                    cost += {x: c for x, c, _ in OPTIONS[r["codes"][i]][state]}[letter] + DELETE * again
                    if letter != "D":
                        roles.append(r["roles"][i] if letter == "K" else FILL_ROLE[state])
                        texts.append(r["texts"][i])
            if r["final"]:
                for state in inserts_at(closing(), s):
                    fill(state)
                    cost += INSERT
            yield {"audit": "".join(audit), "cost": cost, "roles": roles, "texts": texts} | {
                k: r[k] for k in ("conv_id", "part", "block", *carried)}
    types = dict(f.split(" ") for f in BLOCK_FIELDS.split(", "))
    ddl = (f"conv_id {kind_of(blocks, 'conv_id')}, part int, block long, audit string, cost long, roles array<string>, texts array<string>, "
           + ", ".join(f"{c} {types[c]}" for c in carried))
    return mapped(blocks.drop("matrix").join(starts, ["part", "block"]), walk, ddl)


def repaired_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, part, block, nth, role, text): the repaired rows; order by part, block and nth."""
    return repair(turns).select("conv_id", "part", "block", F.posexplode(F.arrays_zip("roles", "texts")).alias("nth", "row")).select(
        "conv_id", "part", "block", "nth", F.col("row.roles").alias("role"), F.col("row.texts").alias("text"))


SUMMARY = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def summaries(repaired: DataFrame) -> DataFrame:
    """One row a conversation: faults, cost, edits and the hash of the repaired rows."""
    def whole(members):
        total = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
        audit, digest, empty, last, turns, low, high, conv = [], hashlib.sha256(), True, None, 0, None, None, None
        for r in members:
            conv = r["conv_id"]
            for k in total:
                total[k] += r[k]
            if last:
                total["illegal"] += last["tail"] + r["head"] not in LEGAL_PAIRS
                turns -= last["last_turn"] is not None and last["last_turn"] == r["first_turn"]
            turns += r["n_turns"]
            low = r["low"] if low is None else low if r["low"] is None else min(low, r["low"])
            high = r["high"] if high is None else high if r["high"] is None else max(high, r["high"])
            audit.append(r["audit"])
            for role, text in zip(r["roles"], r["texts"]):
                digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                empty = False
            last = {k: r[k] for k in ("tail", "last_turn")}
        yield {"conv_id": conv, "gaps": 0 if low is None else high - low + 1 - turns, **total, "audit": "".join(audit),
               "repaired_sha256": digest.hexdigest()}
    return along(repaired, whole, f"conv_id {kind_of(repaired, 'conv_id')}, {SUMMARY}")


def damaged(turns: DataFrame) -> DataFrame:
    """The rows with the faults that the contract plants by a checksum of conversation and turn."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    text = F.coalesce(F.col("text"), F.lit(" "))
    rows = turns.select("conv_id", "turn", F.col("role"), text.alias("text"), h.alias("h")).filter("h <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("h") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations")
    done = written(summaries(repair(damaged(turns))), "structure-summaries")
    ids = turns.select("conv_id").distinct()
    return ids.alias("i").join(done.alias("d"), F.col("i.conv_id").eqNullSafe(F.col("d.conv_id")), "left").select(
        "i.conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _sql() -> str:
    """The same in SQL: the best (cost, edits, rows) of each state, row by row from the back."""
    way = lambda c, a, t: f"{{'c': ({c})::BIGINT, 'a': {a}, 't': {t}}}"
    best = lambda ways: f"list_sort([{', '.join(ways)}])[1]"
    line = lambda role, text: f"chr(10) || {role} || ':' || {text}"
    at = lambda s: f"v[{s + 1}]"

    def inserted(source):
        cells = [best([at(s), way(f"{at(FILL_TO[s])}.c + {INSERT}", f"'I' || {at(FILL_TO[s])}.a",
                                  line(f"'{FILL_ROLE[s]}'", "''") + f" || {at(FILL_TO[s])}.t")]) for s in range(4)]
        return f"SELECT conv_id, pos, [{', '.join(cells)}] AS v FROM ({source})"

    def edited(s):
        # a way that a row does not have costs more than any other
        ways = [way(f"{at(s)}.c + {DELETE}", f"'D' || {at(s)}.a", f"{at(s)}.t"),
                way(f"{at(FILL_TO[s])}.c + {RELABEL} + extra + ban", f"'R' || {at(FILL_TO[s])}.a",
                    line(f"'{FILL_ROLE[s]}'", "text") + f" || {at(FILL_TO[s])}.t")]
        for (a, initial), t in KEEP_TO.items():
            if a == s:
                ways.append(way(f"{at(t)}.c + extra + ban + CASE WHEN left(role, 1) = '{initial}' THEN 0 ELSE {NEVER} END",
                                f"'K' || {at(t)}.a", line("role", "text") + f" || {at(t)}.t"))
        return best(ways)
    ends = ", ".join(way(NEVER if a is None else a, "''", "''") for a in ACCEPT)
    first = f"SELECT conv_id, max(pos) AS pos, [{ends}] AS v FROM judged GROUP BY conv_id"
    back = f"""SELECT s.conv_id, s.pos - 1 AS pos, [{', '.join(edited(s) for s in range(4))}] AS v
      FROM step AS s JOIN judged AS j ON s.conv_id IS NOT DISTINCT FROM j.conv_id AND s.pos = j.pos"""
    key = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
    return f"""
WITH RECURSIVE hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {sql_crc32(sql_bits(key))} % 20 AS h
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
         CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed WHERE h <> 0),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos FROM damaged),
faults AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?]{SPACE_CLASS}*\\z') THEN 'truncated' ELSE 'none' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) AS pair
  FROM numbered),
judged AS (
  SELECT *, CASE WHEN fault = 'truncated' THEN {TRUNCATED} ELSE 0 END AS extra,
         CASE WHEN fault IN ('blank', 'duplicate') THEN {NEVER} ELSE 0 END AS ban FROM faults),
step AS (
  {inserted(inserted(first))}
  UNION ALL
  {inserted(inserted(back))}),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id),
done AS (
  SELECT c.*, s.v[1].c AS cost, s.v[1].a AS audit, sha256(substr(s.v[1].t, 2)) AS repaired_sha256
  FROM counts AS c JOIN step AS s ON s.conv_id IS NOT DISTINCT FROM c.conv_id AND s.pos = 0)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
       coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS i LEFT JOIN done AS d ON i.conv_id IS NOT DISTINCT FROM d.conv_id"""


OP12_SQL = _sql()
