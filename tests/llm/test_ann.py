import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortkit.llm import ann as A


def brute(ids, vecs, k=20, every=20):
    out = {}
    for i, q in zip(ids, vecs):
        if i % every == 0:
            s = A.products(q, vecs)
            own = [(-s[j], ids[j]) for j in range(len(ids)) if ids[j] != i]
            out[i] = [(b, -a) for a, b in sorted(own)[:k]]
    return out


def collect(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def test_tree_assigns_every_point_and_visits_every_leaf():
    rng = np.random.default_rng(0)
    pts = np.r_[rng.normal(size=(900, 8)), np.ones((300, 8))]
    tree = A.fit(pts, leaf_points=50)
    leaf = A.assign(tree, pts)
    assert tree.leaves > 10 and leaf.min() >= 0 and len(set(leaf[900:])) == 1
    order = list(A.best_bins(tree, tree.centers @ pts[0]))
    assert sorted(order) == list(range(tree.leaves))


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, [None, 1.0]), (8, [1.0, 1.0, 1.0]), (None, [9.0, 9.0]), (20, [0.0, 2.0]), (20, [0.0, 2.0]), (40, []), (9, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("leaf", F.lit("clash"))
    got = collect(A.search(df))
    assert got[0] == [(1, 0.5), (2, 0.5), (20, 0.0), (20, 0.0), (9, -1.0)]
    assert got[20] == [(1, 1.0), (2, 1.0), (0, 0.0), (9, 0.0)] and set(got) == {0, 20}
    assert A.search(df.limit(0)).collect() == []


def test_hot_vector_in_blocks(spark):
    rng = np.random.default_rng(1)
    vecs = np.r_[np.tile(rng.normal(size=(1, 6)), (300, 1)), rng.normal(size=(300, 6))].astype(np.float32)
    ids = rng.permutation(600)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vecs)], "vec_id long, embedding array<float>")
    got = collect(A.search(df, target=1.0, row_block=64, query_block=3))
    want = brute(ids.tolist(), vecs.astype(float))
    hits = sum(len(set(got[q]) & set(w)) for q, w in want.items())
    assert set(got) == set(want) and hits >= 0.97 * sum(map(len, want.values()))
    exact = [q for q in want if {v for v, _ in got[q]} == {v for v, _ in want[q]}]
    assert all(got[q] == want[q] for q in exact) and exact


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_against_brute_force(spark, sf):
    path = f"/root/testdata/{sf}"
    data = spark.read.parquet(f"{path}/embeddings.parquet").collect()
    want = brute([r["vec_id"] for r in data], np.array([r["embedding"] for r in data], float))
    got = collect(A.op5_ann(spark, path))
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in w}) for q, w in want.items())
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert hits >= 0.9 * sum(map(len, want.values())), hits / sum(map(len, want.values()))


def test_double_vectors_keep_their_precision(spark):
    rng = np.random.default_rng(4)
    vecs = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id long, embedding array<double>")
    assert collect(A.search(df, target=1.0)) == brute(list(range(60)), vecs)


def test_many_rows_of_the_querys_own_id_do_not_crowd_out_others(spark):
    rng = np.random.default_rng(6)
    near = rng.normal(size=8)
    rows = [(0, (near + 1e-3 * rng.normal(size=8)).tolist()) for _ in range(900)]
    rows += [(i, rng.normal(size=8).tolist()) for i in range(1, 200) if i % 20]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collect(A.search(df, target=0.01, row_block=100, calibration=1))
    assert len(got[0]) == 20 and all(v != 0 for v, _ in got[0])


def test_equal_rows_do_not_exceed_the_sample(spark):
    df = spark.range(0, 5000, 1, 4).selectExpr("20L AS vec_id", "array(1.0D, 2.0D) AS embedding").unionAll(
        spark.range(5000, 6000).selectExpr("id AS vec_id", "array(cos(id), sin(id)) AS embedding"))
    seen = []
    keep, A.fit = A.fit, lambda points, *a, **k: seen.append(len(points)) or keep(points, *a, **k)
    try:
        got = collect(A.search(df, sample=300))
    finally:
        A.fit = keep
    assert 200 <= seen[0] <= 300 and len(got[20]) == 20
