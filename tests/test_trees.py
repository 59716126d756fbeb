"""Node tables, collapsing, prefixes and table growing against plain top-down learners."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortkit.operators import trees as T


def made(n=220, seed=3, noise=0.15):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 9, n) / 2, rng.normal(size=n).round(1), rng.integers(0, 2, n), np.full(n, 4.0), rng.integers(0, 40, n)], 1)
    y = ((x[:, 0] + x[:, 1] > 2) ^ (rng.random(n) < noise)).astype(float)
    return x, y, rng.integers(0, 2**62, n).astype(np.uint64)


def best_split(x, y, w, features, edges, min_leaf):
    """(gain, feature, bin) by trying every cut point."""
    best = (0.0, 0, 0)
    for f in features:
        for b, cut in enumerate(edges[f]):
            left = x[:, f] <= cut
            wl, wr = w[left].sum(), w[~left].sum()
            if wl < max(min_leaf, 1e-9) or wr < max(min_leaf, 1e-9):
                continue
            sse = lambda m: (w[m] * y[m] ** 2).sum() - (w[m] * y[m]).sum() ** 2 / w[m].sum()
            gain = round(sse(np.full(len(y), True)) - sse(left) - sse(~left), 7)
            if gain > best[0]:
                best = (gain, f, b)
    return best


def plain_tree(x, y, w, edges, max_depth, min_leaf=1, min_split=2, features=None, depth=0):
    """Nested (n, value, feature, bin, left, right), top-down."""
    n = w.sum()
    value = (w * y).sum() / n
    pure = (w * (y - value) ** 2).sum() < 1e-12
    if depth == max_depth or n < max(min_split, 2 * min_leaf) or pure:
        return (n, value)
    gain, f, b = best_split(x, y, w, features or range(x.shape[1]), edges, min_leaf)
    if gain <= 0:
        return (n, value)
    left = x[:, f] <= edges[f][b]
    side = lambda m: plain_tree(x[m], y[m], w[m], edges, max_depth, min_leaf, min_split, features, depth + 1)
    return (n, value, f, b, side(left & (w > 0) | left), side(~left))


def nested(nodes, i, max_depth=99, min_split=0):
    head = (nodes.n[i], nodes.value[i])
    if nodes.feature[i] < 0 or nodes.depth[i] >= max_depth or nodes.n[i] < min_split:
        return head
    return (*head, int(nodes.feature[i]), int(nodes.bin[i]), nested(nodes, nodes.left[i], max_depth, min_split),
            nested(nodes, nodes.right[i], max_depth, min_split))


def same(a, b):
    return len(a) == len(b) and a[2:4] == b[2:4] and a[:2] == pytest.approx(b[:2]) and all(same(p, q) for p, q in zip(a[4:], b[4:]))


@pytest.mark.parametrize("min_leaf,min_split,depth", [(1, 2, 30), (4, 2, 4), (1, 10, 6), (2, 5, 0)])
def test_grown_trees_equal_a_plain_learner(min_leaf, min_split, depth):
    x, y, keys = made()
    edges = T.bin_edges(x)
    codes = T.binned(x, edges)
    weight = np.stack([np.ones(len(y)), T.bootstrap_weights(1, np.arange(1), keys)[0]])
    nodes, leaf = T.grow(codes, np.stack([y, y]), weight, np.arange(2), depth, min_leaf, min_split)
    for t in range(2):
        on = weight[t] > 0
        want = plain_tree(x[on], y[on], weight[t][on], edges, depth, min_leaf, min_split)
        assert same(nested(nodes, t), want)
        assert (leaf[t] == T.leaves(nodes, codes)[t]).all()


def test_quantile_bins_and_bounds():
    x = np.stack([np.arange(1000.0), np.repeat([0.0, 1.0], 500)], 1)
    edges = T.bin_edges(x, 16)
    assert len(edges[0]) == 15 and list(edges[1]) == [0.5]
    counts = np.bincount(T.binned(x, edges)[:, 0])
    assert counts.min() > 50 and counts.max() < 75
    assert [len(e) for e in T.bin_edges(np.zeros((5, 2)))] == [0, 0]


def test_one_deep_forest_holds_the_whole_grid():
    """Cut at a depth, collapsed by rows of a node, and its first trees: each equals a refit."""
    x, y, keys = made()
    codes = T.binned(x, T.bin_edges(x))
    deep = T.grow_forest(codes, y, keys, 12, 7, "sqrt", 1, T.MAX_DEPTH)
    for depth in (2, 5, 30):
        for split in (2, 5, 20):
            prefix = T.forest_prefixes(deep, codes, [4, 12], depth, split)
            for k in (4, 12):
                refit = T.grow_forest(codes, y, keys, k, 7, "sqrt", 1, depth, split)
                assert np.allclose(prefix[k], T.forest_prefixes(refit, codes, [k], 99, 0)[k])
                for t in range(k):
                    assert same(nested(deep, np.flatnonzero(deep.parent < 0)[t], depth, split), nested(refit, np.flatnonzero(refit.parent < 0)[t]))


def test_trees_of_a_forest_do_not_depend_on_the_batches(monkeypatch):
    x, y, keys = made()
    codes = T.binned(x, T.bin_edges(x))
    whole = T.forest_prefixes(T.grow_forest(codes, y, keys, 6, 1, "log2"), codes, [6], 30, 2)[6]
    monkeypatch.setattr(T, "ENTRIES", 300)
    assert np.allclose(whole, T.forest_prefixes(T.grow_forest(codes, y, keys, 6, 1, "log2"), codes, [6], 30, 2)[6])
    later = T.grow_forest(codes, y, keys, range(3, 6), 1, "log2")
    assert sorted(set(later.tree)) == [3, 4, 5]


SETTINGS = [{"stepSize": 0.3, "minSamplesSplit": 2, "subsamplingRate": 1.0}, {"stepSize": 0.1, "minSamplesSplit": 30, "subsamplingRate": 0.7}]


def test_boosting_prefixes_and_side_by_side_settings_equal_refits():
    x, y, keys = made()
    codes = T.binned(x, T.bin_edges(x))
    _, _, together = T.boost(codes, y, keys, SETTINGS, 8, 3, 5, codes, (4, 8))
    for i, s in enumerate(SETTINGS):
        for rounds in (4, 8):
            first, nodes, alone = T.boost(codes, y, keys, [s], rounds, 3, 5, codes, (rounds,))
            assert np.allclose(alone[0, rounds], together[i, rounds])
            z = first + s["stepSize"] * nodes.value[T.leaves(nodes, codes)].sum(0)
            assert np.allclose(T.sigmoid(z), alone[0, rounds])


def test_rounded_residuals_give_the_same_boosting(monkeypatch):
    x, y, keys = made(700)
    codes = T.binned(x, T.bin_edges(x))
    plain = T.boost(codes, y, keys, SETTINGS, 8, 3, 5, codes, (8,))
    monkeypatch.setattr(T, "EXACT_ROWS", 0)
    rounded = T.boost(codes, y, keys, SETTINGS, 8, 3, 5, codes, (8,))
    assert (plain[1].feature == rounded[1].feature).all() and (plain[1].bin == rounded[1].bin).all()
    assert all(np.allclose(plain[2][i, 8], rounded[2][i, 8], atol=1e-9) for i in (0, 1))


@pytest.mark.parametrize("exact_rows", [0, 10_000])
def test_boostings_are_one_until_a_node_is_too_small(monkeypatch, exact_rows):
    monkeypatch.setattr(T, "EXACT_ROWS", exact_rows)
    x, y, keys = made(900)
    codes = T.binned(x, T.bin_edges(x))
    settings = [{"stepSize": 0.2, "minSamplesSplit": m, "subsamplingRate": 0.8} for m in (60, 2, 9)]
    _, nodes, together = T.boost(codes, y, keys, settings, 6, 4, 5, codes, (3, 6))
    for i, s in enumerate(settings):
        _, want, alone = T.boost(codes, y, keys, [s], 6, 4, 5, codes, (3, 6))
        got = T.one_boosting(nodes, i, 6)
        assert all((alone[0, k] == together[i, k]).all() for k in (3, 6))
        assert all((getattr(got, c) == getattr(want, c)).all() for c in T.Nodes.__dataclass_fields__)
    assert (together[0, 6] != together[1, 6]).any()


def test_trees_do_not_depend_on_how_histograms_are_added_up(monkeypatch):
    """Joint columns, siblings and nodes in parts give the trees of one histogram a node."""
    x, y, keys = made(500)
    codes, weight = T.binned(x, T.bin_edges(x)), T.bootstrap_weights(1, np.arange(3), keys)
    args = codes, np.stack([y] * 3), weight, np.arange(3), 8
    grown = []
    for few, joint, cells in ((1 << 12, 1, 1 << 20), (0, 1, 1 << 20), (0, 40, 1 << 20), (0, 1 << 12, 1 << 20), (0, 1 << 12, 50)):
        monkeypatch.setattr(T, "FEW", few)
        monkeypatch.setattr(T, "JOINT", joint)
        monkeypatch.setattr(T, "CELLS", cells)
        grown += [T.grow(*args, exact=exact)[0] for exact in (False, True)]
    pick = T.feature_picker(3, codes.shape[1], "sqrt")
    picked = []
    for cells in (1 << 20, 50):
        monkeypatch.setattr(T, "CELLS", cells)
        picked.append(T.grow(*args, pick=pick, led=False)[0])
    for c in T.Nodes.__dataclass_fields__:
        assert all((getattr(g, c) == getattr(grown[0], c)).all() for g in grown) and (getattr(picked[0], c) == getattr(picked[1], c)).all()


def test_one_way_down_scores_every_cut():
    x, y, keys = made(400)
    codes = T.binned(x, T.bin_edges(x))
    nodes, cuts = T.grow_forest(codes[:250], y[:250], keys[:250], 9, 7), [(d, m) for d in (0, 2, 30) for m in (2, 12)]
    got = T.forest_scores([nodes], codes[250:], [4, 9], cuts)
    for d, m in cuts:
        for k, want in T.forest_prefixes(nodes, codes[250:], [4, 9], d, m).items():
            assert np.allclose(got[k, d, m], want)


def test_first_boosting_round_equals_a_plain_learner():
    x, y, keys = made()
    edges = T.bin_edges(x)
    codes = T.binned(x, edges)
    first, nodes, _ = T.boost(codes, y, keys, SETTINGS[:1], 1, 3, 5)
    p = y.mean()
    assert first == pytest.approx(np.log(p / (1 - p)))
    want = plain_tree(x, y - p, np.ones(len(y)), edges, 3)
    shape = lambda t: (t[0], *t[2:4], *map(shape, t[4:]))
    assert shape(nested(nodes, 0)) == shape(want)
    leaf = T.leaves(nodes, codes)[0]
    for i in set(leaf):
        m = leaf == i
        assert nodes.value[i] == pytest.approx((y[m] - p).sum() / (m.sum() * p * (1 - p)))


def test_area_under_roc_counts_pairs():
    rng = np.random.default_rng(1)
    y, s = rng.integers(0, 2, 80).astype(float), rng.integers(0, 12, 80) / 12
    pairs = [(a > b) + (a == b) / 2 for a in s[y == 1] for b in s[y == 0]]
    assert T.area_under_roc(y, s) == pytest.approx(np.mean(pairs))
    assert T.area_under_roc(np.ones(4), s[:4]) == 0.5


NAMES = ["f0", "f1", "f2", "f3", "f4"]


def frame(spark, x, y):
    rows = [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "key long, " + ", ".join(f"{f} double" for f in NAMES) + ", label double").repartition(3)


def test_collapsed_node_table_equals_a_bounded_tree(spark):
    x, y, keys = made()
    edges = T.bin_edges(x)
    codes = T.binned(x, edges)
    deep = T.TreeModel("forest", NAMES, T.node_frame(T.grow_forest(codes, y, keys, 5, 7, "sqrt"), NAMES, edges)).table(spark)
    want = T.TreeModel("forest", NAMES, T.node_frame(T.grow_forest(codes, y, keys, 3, 7, "sqrt", 1, 4, 12), NAMES, edges)).table(spark)
    shape = ["tree", "depth", "feature", "threshold", "bin", F.round("n", 6).alias("n"), F.round("value", 9).alias("v"), F.round("gain", 6).alias("g")]
    got = T.collapse(deep, 4, 12, 3)
    assert sorted(map(str, got.select(*shape).collect())) == sorted(map(str, want.select(*shape).collect()))


@pytest.mark.parametrize("kind", ["forest", "boosting"])
def test_a_model_scores_tables_as_its_nodes_do(spark, kind):
    x, y, keys = made()
    edges = T.bin_edges(x)
    codes = T.binned(x, edges)
    if kind == "forest":
        nodes, first = T.grow_forest(codes, y, keys, 5, 7), 0.0
        want = nodes.value[T.leaves(nodes, codes)].mean(0)
    else:
        first, nodes, _ = T.boost(codes, y, keys, SETTINGS[:1], 5, 3, 5)
        want = T.sigmoid(first + 0.3 * nodes.value[T.leaves(nodes, codes)].sum(0))
    model = T.TreeModel(kind, NAMES, T.node_frame(nodes, NAMES, edges), first, 0.3)
    got = model.transform(frame(spark, x, y)).orderBy("key").collect()
    assert np.allclose([r["probability"][1] for r in got], want)
    assert [r["prediction"] for r in got] == [float(p > 0.5) for p in want]
    shares = {r["feature"]: r["importance"] for r in T.importances(model.table(spark), NAMES, kind == "forest").collect()}
    per = np.zeros((nodes.tree.max() + 1, len(NAMES)))
    np.add.at(per, (nodes.tree, nodes.feature), np.where(nodes.feature >= 0, nodes.gain, 0))
    per = (per / per.sum(1, keepdims=True)).mean(0) if kind == "forest" else per.sum(0) / per.sum()
    assert np.allclose([shares[f] for f in NAMES], per) and shares["f3"] == 0


def test_table_growing_equals_growing_in_memory(spark):
    x, y, keys = made()
    edges = T.bin_edges(x)
    codes = T.binned(x, edges)
    df = frame(spark, x, y)
    rows = df.select("key", "label", T.bin_codes(df, dict(zip(NAMES, edges))).alias("codes"))
    for depth, min_leaf, min_split in ((0, 1, 2), (3, 1, 2), (4, 6, 30)):
        found, placed = T.grow_table(rows.withColumn("target", F.col("label")), depth, min_leaf, min_split)
        nodes, leaf = T.grow(codes, y[None], np.ones((1, len(y))), np.arange(1), depth, min_leaf, min_split)

        def check(i, place):
            n, value, gain, f, b, is_leaf = found[place]
            assert (n, value) == pytest.approx((nodes.n[i], nodes.value[i])) and is_leaf == (nodes.feature[i] < 0)
            if not is_leaf:
                assert (f, b) == (nodes.feature[i], nodes.bin[i]) and gain == pytest.approx(nodes.gain[i], abs=1e-6)
                check(nodes.left[i], 2 * place)
                check(nodes.right[i], 2 * place + 1)
        check(0, 1)
        at = [r["node"] for r in placed.orderBy("key").collect()]
        assert len(set(zip(at, leaf[0]))) == len(set(at)) == len(set(leaf[0]))
    first, trees, scored = T.boost_table(rows, 3, 2, 0.3)
    _, _, want = T.boost(codes, y, keys, [SETTINGS[0]], 3, 2, 5, codes, (3,))
    assert len(trees) == 3
    assert np.allclose([T.sigmoid(r["z"]) for r in scored.orderBy("key").collect()], want[0, 3])


def test_logistic_regression_finds_the_optimum_of_every_fit(spark):
    from cohortkit.operators import logistic as L
    x, y, keys = made(400, 8, 0.2)
    fold = np.arange(400) % 3
    rows = [(i, *map(float, r), float(t), int(k)) for i, (r, t, k) in enumerate(zip(x, y, fold))]
    df = spark.createDataFrame(rows, "key long, " + ", ".join(f"{f} double" for f in NAMES) + ", label double, fold int").repartition(4)
    fits = [(c, k) for c in (0.01, 10.0, 1e6) for k in (0, 1, 2, None)]
    for (c, k), m in zip(fits, L.fit_many(df, NAMES, "label", fits)):
        on = np.full(400, True) if k is None else fold != k
        spread = x[on].std(0)
        a = (x[on] - x[on].mean(0)) / np.where(spread > 0, spread, 1)
        p = T.sigmoid(a @ np.array(m.coefficients) + m.intercept)
        assert np.abs(c * a.T @ (p - y[on]) + m.coefficients).max() < 1e-4 * c * on.sum() and abs((p - y[on]).sum()) < 1e-3
        assert m.coefficients[3] == 0
    scored = L.fold_scores(df, {("a", k): m for (c, k), m in zip(fits, L.fit_many(df, NAMES, "label", fits)) if c == 10.0 and k is not None}, "label", "key")
    assert scored.count() == 400


def test_logistic_regression_agrees_with_the_library(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    from cohortkit.operators import logistic as L
    x, y, keys = made(300, 4, 0.2)
    x[:, 3] = np.random.default_rng(2).normal(size=300)
    x = (x - x.mean(0)) / x.std(0)
    df = frame(spark, x, y)
    data = VectorAssembler(inputCols=NAMES, outputCol="v").transform(df)
    want = LogisticRegression(featuresCol="v", labelCol="label", regParam=1 / (0.5 * 300), standardization=False, maxIter=500, tol=1e-10).fit(data)
    got, = L.fit_many(df.withColumn("fold", F.lit(0)), NAMES, "label", [(0.5, None)])
    assert np.allclose(got.coefficients, want.coefficients.toArray(), atol=1e-4) and got.intercept == pytest.approx(want.intercept, abs=1e-4)
