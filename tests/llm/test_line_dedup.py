import random
import re

import pytest
from pyspark.sql import functions as F

from cohortkit.llm import line_dedup as L

from .test_simhash import brute


def shingle_set(line, chars=9):
    return {line[i:i + chars] for i in range(max(1, len(line) - chars + 1))}


def brute_kept(rows):
    """{(doc_id, text): kept line numbers}, comparing every pair of different lines."""
    seen = {}
    for d, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        for i, line in enumerate((t or "").split("\n")):
            if re.search("[^\x20\x09-\x0D]", line):
                seen.setdefault(line, []).append((d, t, i))
    lines = sorted(seen)
    sets = [shingle_set(x) for x in lines]
    links = []
    by_shingle = {}
    for i, s in enumerate(sets):
        near = {j for x in s for j in by_shingle.get(x, ())}
        links += [(j, i) for j in near if 10 * len(s & sets[j]) >= 8 * len(s | sets[j])]
        for x in s:
            by_shingle.setdefault(x, []).append(i)
    roots = brute(links)
    order = lambda at: (at[0] is None, at[0] or 0, at[2])
    best = {}
    for i, line in enumerate(lines):
        r = roots.get(i, i)
        best[r] = min(best.get(r, seen[line][0]), *seen[line], key=order)
    out = {(d, t): [] for d, t in rows}
    for d, t, i in best.values():
        out[d, t].append(i)
    return {k: sorted(v) for k, v in out.items()}


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("k1", F.lit("clash")).withColumn("rid", F.lit(0))
    text = {}
    for r in L.deduplicated(df).collect():
        assert r["k1"] == "clash" and r["rid"] == 0
        text.setdefault(r["doc_id"], []).append(r["text"])
    return text


def test_small_cases(spark):
    base = "the quick brown fox jumps over the lazy dog near the river bank today again and again while many others only look on and wonder"
    near = base.replace("lazy", "lame")
    rows = [(2, f"{base}\n\nonly here {2}"), (1, f"first line of one\n{near}\n \n{near}"), (3, base), (4, None), (5, ""),
            (6, " \n\t\n"), (None, "no id line\nfirst line of one"), (7, "x"), (8, "x\r\nx"), (9, "日本語のとても長い一行の文章です"),
            (10, "日本語のとても長い一行の文章です。"), (11, "twin\nrow"), (11, "twin\nrow")]
    got = run(spark, rows)
    assert got[1] == [f"first line of one\n{near}\n "]
    assert got[2] == ["\nonly here 2"] and got[3] == [""]
    assert got[4] == [None] and got[5] == [""] and got[6] == [" \n\t\n"] and got[None] == ["no id line"]
    assert got[7] == ["x"] and got[8] == ["x\r"] and got[9] == [rows[9][1]] and got[10] == [""]
    assert got[11] == ["twin\nrow"] * 2
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert L.deduplicated(empty).collect() == [] and L.kept_lines(empty).collect() == []


def test_hot_line_and_near_copies_match_brute_force(spark):
    rng = random.Random(2)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    hot, base = line(12), [rng.choice(vocab) for _ in range(40)]
    rows = []
    for d in range(120):
        copy = base.copy()
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(40)] = rng.choice(vocab)
        rows.append((d, "\n".join([hot, line(15), " ".join(copy), line(3)])))
    got = {r["doc_id"]: r["kept"] for r in L.kept_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: k for (d, _), k in brute_kept(rows).items()}


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_registered_query_matches_brute_force(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    want = {d: k for (d, _), k in brute_kept(rows).items()}
    got = {r["doc_id"]: r["kept"] for r in L.op10_line_dedup(spark, path).collect()}
    assert got == want


def test_hubs_meet_only_lines_that_may_be_similar(spark):
    """Lines with half their shingles in common share bands, but are not paired; similar ones all are."""
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    head = some(80)
    far = [head + some(60) for _ in range(60)]
    near = [far[0][:-1] + c for c in "QRS"]
    docs = spark.createDataFrame([(1, "\n".join(far + near))], "doc_id long, text string")
    lines = L.candidates(docs)
    text = {r["k1"]: r["line"] for r in lines.collect()}
    assert len(text) > 40
    pairs = L.hub_pairs(L.members_of(lines), 0, 1000, L.THRESHOLD).collect()
    found = {frozenset((text[r["a"]], text[r["b"]])) for r in pairs}
    similar = {frozenset((a, b)) for a in [far[0], *near] for b in [far[0], *near] if a != b}
    assert similar <= found and len(found) < len(similar) + 20


def test_lines_of_a_large_group_just_under_the_threshold_are_not_paired(spark):
    """Long near copies with similarities from 0.6 to 0.8: few pairs are left, and no similar one is missing."""
    rng = random.Random(8)
    letters = "abcdefghijklmnop"
    base = [rng.choice(letters) for _ in range(540)]
    group = []
    for _ in range(60):
        copy = base.copy()
        for at in rng.sample(range(0, 540, 20), 6):
            copy[at] = rng.choice("QRSTUVWXYZ")
        group.append("".join(copy))
    lines = L.candidates(spark.createDataFrame([(1, "\n".join(group))], "doc_id long, text string"))
    text = {r["k1"]: r["line"] for r in lines.collect()}
    assert len(text) > 40
    found = {frozenset((text[r["a"]], text[r["b"]])) for r in L.hub_pairs(L.members_of(lines), 0, 1000, L.THRESHOLD).collect()}
    sets = {x: shingle_set(x) for x in text.values()}
    alike = lambda p, least: (lambda a, b: len(a & b) >= least * len(a | b))(*(sets[x] for x in p))
    pairs = [frozenset((a, b)) for a in sets for b in sets if a < b]
    assert sum(not alike(p, 0.75) for p in pairs) > 500
    assert all(alike(p, 0.75) for p in found)


def test_sketches_never_deny_similar_lines(spark):
    """Lines of many lengths, around the lengths where a sketch doubles: folded sketches bound the shared shingles too."""
    rng = random.Random(9)
    some = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz é😀") for _ in range(n))
    pairs = []
    for n in (1, 9, 30, 130, 136, 140, 260, 264, 270, 520, 530, 1030, 2050, 4200):
        for _ in range(6):
            a = some(n)
            cut = rng.randrange(n + 1)
            pairs.append((a, a[:cut] + some(rng.randrange(n // 5 + 2)) + a[cut:]))
        pairs += [(a, a + some(n // 4)), (a, some(n)), ("ab" * n, "ab" * (n + 9))]
    keyed = [(i, i, x) for i, x in enumerate(x for p in pairs for x in p)]
    own = L.sketches(spark.createDataFrame(keyed, "k1 long, k2 long, line string")).collect()
    sketch = {r["k1"]: r["sketch"] for r in own}
    assert len({len(x) for x in sketch.values()}) == 5 and max(map(len, sketch.values())) == L.BLOCK * L.SKETCH_BLOCKS
    rows = [(i, sketch[2 * i], sketch[2 * i + 1], len(shingle_set(a)), len(shingle_set(b))) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "i int, a array<long>, b array<long>, n int, m int")
    denied = 0
    for r in df.select("i", L.sketches_allow("a", "b", "n", "m", 0.8).alias("may"), L.sketches_allow("b", "a", "m", "n", 0.8).alias("turned")).collect():
        a, b = map(shingle_set, pairs[r["i"]])
        assert r["may"] == r["turned"] and (r["may"] or 10 * len(a & b) < 8 * len(a | b)), pairs[r["i"]]
        denied += not r["may"]
    assert denied >= 20
