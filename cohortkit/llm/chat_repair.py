"""Minimum-cost repair of chat roles, and rendering of the repaired turns.

A legal chat is an optional system turn, then user and assistant turns in
alternation, the assistant last.  The states of that automaton are the role of
the last turn.  A turn is kept, relabelled, or merged into the turn before it;
empty turns may be inserted before it and at the end.  Dynamic programming picks
the cheapest way (``COSTS``).

Each turn is a 4 x 4 matrix of the cheapest way from state to state, so a stretch
of turns is the (min, +) product of its matrices.  A conversation is cut into
blocks of ``BLOCK_TURNS`` turn numbers: every block gives its matrix, 1024 blocks
give theirs, those of a conversation are scanned, and the states at the ends come
back down the same way.  Every block then finds its own path between its two
states.  So a conversation of any length is repaired by many tasks, and the result
is the optimum of the whole.

The rendering is a sequence of fragments, one or more a turn, in the order
(conv_id, block, part_turn, part_hash, nth); ``fragment`` concatenated in that
order is the rendered conversation.  ``render`` does so for conversations that
fit in a row.

Defined cases: turns go by number, NULL last, equal numbers by a hash of role and
text; rows equal in all four columns are one turn; roles are compared trimmed and
in lower case, others (NULL included) must be relabelled or merged; a NULL text is
empty and a NULL ``conv_id`` is a conversation of its own; very many turns of one
number are cut into parts by the hash; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, written

ROLES = ("system", "user", "assistant")
# States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
START, END = 0, 3
COSTS = {"keep": 0, "merge_same": 1, "relabel_unknown": 1, "relabel": 2, "merge_other": 3, "insert": 3}
OPEN, CLOSE = "<|{}|>\n", "\n<|end|>\n"
BLOCK_TURNS = 256
BLOCK_GROUP = 1024
LAST_BLOCK = 2**62
NEVER = 10**15
KEY = ["conv_id", "block", "part_turn", "part_hash"]
KEY_DDL = "conv_id long, block long, part_turn long, part_hash long"


def inserts() -> dict:
    """(from, to) -> the roles of the shortest run of empty turns between two states."""
    found = {(s, s): () for s in NEXT}
    edge = list(found)
    while edge:
        s, t = edge.pop(0)
        for r in NEXT[t]:
            if (s, r) not in found:
                found[s, r] = (*found[s, t], r)
                edge.append((s, r))
    return found


INSERTS = inserts()


def turn_options(role: int, costs: dict = COSTS) -> dict:
    """(from, to) -> (cost, inserted roles, action) of one turn; ``role`` 0 is unknown."""
    best: dict = {}
    for (s, t), extra in INSERTS.items():
        base = costs["insert"] * len(extra)
        ways = [(base + (costs["keep"] if r == role else costs["relabel" if role else "relabel_unknown"]), r,
                 "keep" if r == role else "relabel") for r in NEXT[t]]
        if t != START:
            ways.append((base + costs["merge_same" if t == role else "merge_other"], t, "merge"))
        for cost, to, action in ways:
            way = (cost, len(extra), ("keep", "merge", "relabel").index(action), extra, action)
            if (s, to) not in best or way < best[s, to]:
                best[s, to] = way
    return {k: (cost, extra, action) for k, (cost, _, _, extra, action) in best.items()}


OPTIONS = [turn_options(r) for r in range(4)]
MATRICES = [[OPTIONS[r].get((s, t), (NEVER,))[0] for s in range(4) for t in range(4)] for r in range(4)]
CLOSING = [COSTS["insert"] * len(INSERTS[s, END]) for s in range(4)]


def times(a: list[int], b: list[int]) -> list[int]:
    """The (min, +) product of two matrices, row by row."""
    return [min(NEVER, *(a[4 * s + m] + b[4 * m + t] for m in range(4))) for s in range(4) for t in range(4)]


def path(matrices: list[list[int]], first: int, last: int) -> list[int]:
    """States before, between and after the matrices on the cheapest way; ties to the smaller state."""
    cost, back = [NEVER] * 4, []
    cost[first] = 0
    for m in matrices:
        new, come = [NEVER] * 4, [0] * 4
        for t in range(4):
            for s in range(4):
                if cost[s] + m[4 * s + t] < new[t]:
                    new[t], come[t] = cost[s] + m[4 * s + t], s
        cost = new
        back.append(come)
    states = [last]
    for come in reversed(back):
        states.append(come[states[-1]])
    return states[::-1]


def role_code(role: str | None) -> int:
    role = (role or "").strip().lower()
    return ROLES.index(role) + 1 if role in ROLES else 0


def runs(batches, width: int):
    """(key, rows) of sorted batches whose first ``width`` columns are the key; runs may span batches."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    return groupby(rows, key=lambda r: r[:width])


def emit(rows, ddl: str, size: int = 5000):
    """Record batches of tuples under a simple DDL."""
    import pyarrow as pa
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    fields = [f.split(" ") for f in ddl.split(", ")]
    held = []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*held), fields)],
                                          names=[n for n, _ in fields])
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield batch()
            held = []
    if held:
        yield batch()


def sorted_runs(df: DataFrame, key: list[str], order: list, fn, ddl: str) -> DataFrame:
    """``fn`` over the runs of equal ``key``; every run is one stretch of one partition."""
    dealt = df.repartition(*key).sortWithinPartitions(*key, *order)
    width = len(key)
    return dealt.mapInArrow(lambda batches: emit(
        (out for k, rows in runs(batches, width) for out in fn(k, rows)), ddl), ddl)


def same_key(a: str, b: str, columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def placed_turns(turns: DataFrame, block_turns: int) -> DataFrame:
    """Different turns with their block; crowded blocks are cut into parts by turn and hash."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.col("role").cast("string").alias("role"),
                        F.coalesce(F.col("text"), F.lit("")).alias("text")).dropDuplicates()
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(LAST_BLOCK)).cast("long")
                           ).withColumn("tie", F.xxhash64("role", "text"))
    rows = written(rows, "chat-turns")
    crowded = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 2 * block_turns)
    crowded = written(crowded, "chat-crowded")
    hot = F.col("c.n").isNotNull()
    cut = F.expr(f"shiftright(tie, 64 - least(cast(ceil(log2(n / {block_turns})) as int), 40))")
    return rows.alias("r").join(crowded.alias("c"), same_key("r", "c", ["conv_id", "block"]), "left").select(
        "r.*", F.when(hot, F.coalesce("turn", F.lit(0))).otherwise(0).cast("long").alias("part_turn"),
        F.when(hot, cut).otherwise(0).cast("long").alias("part_hash"))


def repair(turns: DataFrame, block_turns: int = BLOCK_TURNS, group: int = BLOCK_GROUP) -> DataFrame:
    """(conv_id, block, part_turn, part_hash, nth, turn, action, role, fragment) of the repaired chats.

    ``action`` is keep, relabel, merge or insert (``turn`` is NULL then); ``role`` is
    the role that the fragment has in the result.
    """
    rows = placed_turns(turns, block_turns)
    order = [F.col("turn").asc_nulls_last(), "tie", "role", "text"]
    code = F.lower(F.trim("role"))
    known = F.coalesce(F.when(code == "system", 1).when(code == "user", 2).when(code == "assistant", 3), F.lit(0))

    def block_matrix(key, members):
        total = None
        for m in members:
            m = MATRICES[m[-1]]
            total = m if total is None else times(total, m)
        yield (*key, total)
    # the texts of equal ties need no order here: equal roles give equal matrices
    blocks = sorted_runs(rows.select(*KEY, "turn", "tie", "role", known.alias("code")), KEY, order[:3], block_matrix,
                         KEY_DDL + ", matrix array<long>")
    blocks = written(blocks.withColumn("part_group", F.floor(F.col("block") / group).cast("long")), "chat-blocks")

    def group_matrix(key, members):
        total = None
        for m in members:
            total = m[-1] if total is None else times(total, m[-1])
        yield (*key, total)
    inner = ["block", "part_turn", "part_hash"]
    groups = sorted_runs(blocks.select("conv_id", "part_group", *inner, "matrix"), ["conv_id", "part_group"], inner,
                         group_matrix, "conv_id long, part_group long, matrix array<long>")
    groups = written(groups, "chat-groups")

    def whole(key, members):
        members = list(members)
        total = members[0][-1]
        for m in members[1:]:
            total = times(total, m[-1])
        last = min(range(4), key=lambda s: (total[s] + CLOSING[s], s))
        states = path([m[-1] for m in members], START, last)
        for i, m in enumerate(members):
            yield (*m[:2], states[i], states[i + 1], i == len(members) - 1)
    ends = "first long, last long, final boolean"
    group_ends = sorted_runs(groups, ["conv_id"], ["part_group"], whole, "conv_id long, part_group long, " + ends)
    down = blocks.alias("b").join(group_ends.alias("g"), same_key("b", "g", ["conv_id", "part_group"])).select(
        "b.conv_id", "b.part_group", *inner, "matrix", "first", "last", "final")

    def within(key, members):
        members = list(members)
        first, last, final = members[0][6:9]
        states = path([m[5] for m in members], first, last)
        for i, m in enumerate(members):
            yield (m[0], *m[2:5], states[i], states[i + 1], final and i == len(members) - 1)
    block_ends = written(sorted_runs(down, ["conv_id", "part_group"], inner, within, KEY_DDL + ", " + ends), "chat-ends")
    joined = rows.alias("r").join(block_ends.alias("e"), same_key("r", "e", KEY)).select(
        *[f"r.{c}" for c in KEY], "turn", "tie", "role", "text", "first", "last", "final")

    def fragments(key, members):
        members = list(members)
        codes = [role_code(m[6]) for m in members]
        first, last, final = members[0][8:11]
        states = path([MATRICES[c] for c in codes], first, last)
        nth, before = 0, first

        def put(turn, action, role, body):
            nonlocal nth, before
            head = "\n" if action == "merge" else (CLOSE if before != START else "") + OPEN.format(ROLES[role - 1])
            nth, before = nth + 1, role
            return (*key, nth, turn, action, ROLES[role - 1], head + body)
        for m, c, s, t in zip(members, codes, states, states[1:]):
            _, extra, action = OPTIONS[c][s, t]
            for r in extra:
                yield put(None, "insert", r, "")
            yield put(m[4], action, t, m[7])
        if final:
            for r in INSERTS[last, END]:
                yield put(None, "insert", r, "")
            yield (*key, nth + 1, None, "end", ROLES[END - 1], CLOSE)
    return sorted_runs(joined, KEY, order, fragments, KEY_DDL + ", nth long, turn long, action string, role string, fragment string")


def render(repaired: DataFrame) -> DataFrame:
    """(conv_id, text) for conversations whose rendering fits in a row."""
    parts = F.sort_array(F.collect_list(F.struct(*KEY[1:], "nth", "fragment")))
    return repaired.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["fragment"]), "").alias("text"))


def op4_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(read_table(spark, sf_dir, "conversations"))
