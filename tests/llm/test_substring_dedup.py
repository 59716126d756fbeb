import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortkit.llm import substring_dedup as S
from cohortkit.llm.fm_index import FMIndex


def brute_statistics(tokens, query, cap):
    out = []
    for i in range(len(query)):
        best = 0
        for j in range(len(tokens)):
            n = 0
            while n < cap and i + n < len(query) and j + n < len(tokens) and query[i + n] == tokens[j + n] > 0:
                n += 1
            best = max(best, n)
        out.append(best)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=50), st.lists(st.lists(st.integers(0, 3), max_size=20), max_size=3),
       st.integers(1, 9))
def test_matching_statistics(tokens, queries, cap):
    tokens = np.array([*tokens, 0])
    index = FMIndex(tokens, 4, cap)
    flat = np.array([x for q in queries for x in q], np.int64)
    ends = np.cumsum([len(q) for q in queries], dtype=np.int64)
    starts = ends - np.array([len(q) for q in queries], np.int64)
    got, lo, hi = index.matching_statistics(flat, starts, ends)
    assert got.tolist() == [x for q in queries for x in brute_statistics(tokens, q, cap)]
    for i, n in enumerate(got):
        if n:
            same = [j for j in range(len(tokens)) if tokens[j:j + n].tolist() == flat[i:i + n].tolist()]
            assert sorted(index.order[lo[i]:hi[i]].tolist()) == same


def brute(rows, window=50):
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        if d is not None:
            for i in range(len(w) - window + 1):
                k = b" ".join(w[i:i + window])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and first[b" ".join(w[i:i + window])] < d:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def collect(df):
    out = []
    for r in df.collect():
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]
        out.append((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("tag", F.lit(1))


def corpus(seed=0):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["é", "日本", "x y"]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage, base = text(70), text(200)
    rows = []
    for d in range(60):
        w = text(rng.randint(0, 120))
        if d % 2:
            at = rng.randint(0, len(w))
            w[at:at] = passage[rng.randint(0, 25):rng.randint(45, 70)]
        if d % 5 == 0:
            w = base.copy()
            w[rng.randrange(200)] = rng.choice(vocab)
        rows.append((d * 3, rng.choice([" ", "\n", "\t \x0b"]).join(w)))
    return rows


def test_matches_brute_force(spark):
    rows = corpus()
    assert collect(S.without_repeats(frame(spark, rows))) == brute(rows)
    assert any(r[2] for r in brute(rows))


def test_crowded_anchors_and_many_shards(spark):
    rows = corpus(1)
    assert collect(S.without_repeats(frame(spark, rows), crowded=2, shard_bytes=2000)) == brute(rows)
    assert collect(S.without_repeats(frame(spark, rows), window=12, anchor=5, crowded=3)) == brute(rows, 12)


def test_edge_rows(spark):
    same = " ".join(f"p{i}" for i in range(80))
    loop = "again " * 400
    rows = [(5, same), (2, same), (9, None), (8, ""), (None, same), (None, None), (4, " \n\t"), (7, "one two"), (5, same),
            (11, same + " tail"), (11, "head " + same), (20, loop), (21, loop), (30, "x " * 60_000 + same)]
    assert collect(S.without_repeats(frame(spark, rows))) == brute(rows)
    assert S.without_repeats(frame(spark, rows).limit(0)).collect() == []


def test_registered_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in S.op3_substring_dedup(spark, sf).collect()), key=str)
    assert got == brute(rows)
