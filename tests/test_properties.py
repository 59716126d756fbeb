"""Property tests: the distributed order statistics against brute force."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cohortkit.functions.stats import exact_median, running_sums
from cohortkit.operators import evaluation as E

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))

values = st.lists(st.integers(min_value=-50, max_value=50), min_size=1, max_size=60)


@SETTINGS
@given(values, st.integers(min_value=1, max_value=9))
def test_median_property(spark, xs, buckets):
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    assert exact_median(df, "x", buckets=buckets).first()["median"] == float(np.median(xs))


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 30), st.integers(0, 4)), min_size=1, max_size=60),
       st.integers(min_value=1, max_value=7))
def test_running_sum_property(spark, rows, buckets):
    # one row per (group, order value), as the operator requires
    uniq = {}
    for g, k, v in rows:
        uniq[(g, k)] = uniq.get((g, k), 0) + v
    data = [(g, float(k), v) for (g, k), v in uniq.items()]
    df = spark.createDataFrame(data, "g string, k double, v long")
    for r in running_sums(df, "k", ["v"], partition_cols=["g"], buckets=buckets).collect():
        assert r.v_before == sum(v for g, k, v in data if g == r.g and k < r.k)
        assert r.v_total == sum(v for g, k, v in data if g == r.g)


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 10)), min_size=2, max_size=80))
def test_auc_property(spark, pairs):
    labels = [y for y, _ in pairs]
    if len(set(labels)) < 2:
        return
    rows = [("m", i, y, s / 10.0, int(s > 5)) for i, (y, s) in enumerate(pairs)]
    preds = spark.createDataFrame(rows, "model string, key long, label int, score double, prediction int")
    pos = [s for y, s in pairs if y == 1]
    neg = [s for y, s in pairs if y == 0]
    brute = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(E.roc_auc(preds, buckets=3).first().roc_auc - brute) < 1e-12
