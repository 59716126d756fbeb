import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from cohortkit.llm import components as C
from cohortkit.llm import simhash as S

DDL = "doc_id long, text string"


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def plain_fingerprint(text):
    import re
    words = [w for w in re.split("[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    sh = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint_is_the_plain_one_and_sparks_hash(spark):
    texts = [None, "", " \n\t", "One", "two WORDS", "a b c d", "a b c d e f a b c d", "Äß Éa b c\x0bd\x0ce\rf  g É",
             "x " * 5000 + "end"]
    assert [S.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]
    one = spark.range(1).select(F.xxhash64(F.lit("a b c d")).alias("h")).first()["h"]
    assert S.fingerprint("A b C d") == one % 2**64


def test_components_match_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(320)] + [(1000 + i, 1001 + i) for i in range(60)]
    edges += [(2000, 2001 + i) for i in range(300)] + [(7, 7)]
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in C.components(df).collect()}
    want = brute([e for e in edges if e[0] != e[1]])
    assert got == want
    assert C.components(df.limit(0)).count() == 0


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n, dtype=np.uint64)
    out = list(base)
    for b in base[: n // 2]:
        for flips in (1, 3, 4, 5, 6):
            x = int(b)
            for bit in rng.choice(64, flips, replace=False):
                x ^= 1 << int(bit)
            out.append(np.uint64(x))
    return sorted({int(x) for x in out})


def links_brute(fps, bits):
    a = np.array(fps, np.uint64)
    out = []
    for i, x in enumerate(a):
        for j in np.flatnonzero(np.bitwise_count(a ^ x) <= bits):
            if j > i:
                out.append((i, int(j)))
    return out


def check_links(spark, fps, bits, pieces, code_bits):
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = [(signed.index(r["a"]), signed.index(r["b"])) for r in S.near_links(df, bits, pieces, code_bits).collect()]
    assert brute(got) == brute(links_brute(fps, bits))


def test_links_match_brute_force(spark):
    fps = clustered(60, 3)
    check_links(spark, fps, 4, 3, 15)
    check_links(spark, fps, 3, 2, 7)


def test_links_with_crowded_anchors_on_a_grid(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_HOMES", 5)
    monkeypatch.setattr(S, "PAIRS_AT_ONCE", 50)
    rng = np.random.default_rng(5)
    near = {int(np.uint64(0xABCDEF0123456789) ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)))
            for a, b in rng.integers(0, 64, (200, 2))}
    check_links(spark, sorted(near), 4, 3, 15)


def test_cover_reaches_every_pair():
    cover = S.Cover(21, 15, 2)
    rng = np.random.default_rng(0)
    v = rng.integers(0, 2**21, 500).astype(np.uint64)
    s = cover.syndromes(v)
    for x, k in zip(v, s):
        m = cover.masks[k]
        spots = set((x ^ m).tolist())
        assert (cover.syndromes(x ^ m) == 0).all() and np.bitwise_count(m[0]) <= 1
        for bit in range(21):
            y = x ^ np.uint64(1 << bit)
            home = int(y ^ cover.masks[int(cover.syndromes(np.array([y]))[0])][0])
            assert home in spots


def test_near_duplicates_edge_rows(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(300)]
    long = [rng.choice(vocab) for _ in range(3000)]
    near = long.copy()
    near[5] = "other"
    rows = [(5, " ".join(long)), (3, " ".join(near).upper()), (9, None), (8, ""), (None, " \n"), (None, "alone " * 9),
            (12, "same same"), (12, "same same"), (11, "same same")]
    df = spark.createDataFrame(rows, DDL).withColumn("fp", F.lit("clash")).withColumn("root", F.lit(1))
    out = [tuple(r) for r in S.near_duplicates(df).collect()]
    assert len(out) == len(rows)
    comp = {}
    for d, fp, c in out:
        comp.setdefault(d, set()).add(c)
        assert len(fp) == 16
    assert comp[5] == comp[3] == {3}
    assert comp[9] == comp[8] == {8} and comp[12] == comp[11] == {11}
    assert comp[None] == {8, None}
    assert S.near_duplicates(df.limit(0)).collect() == []


def test_registered_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = {r["doc_id"]: r for r in S.op8_simhash(spark, sf).collect()}
    fps = {d: plain_fingerprint(t) for d, t in docs}
    assert {d: r["fingerprint"] for d, r in out.items()} == {d: f"{f:016x}" for d, f in fps.items()}
    ids = sorted(fps)
    links = links_brute([fps[d] for d in ids], 4)
    roots = brute([(ids[a], ids[b]) for a, b in links])
    assert {d: r["component_id"] for d, r in out.items()} == {d: roots.get(d, d) for d in ids}
