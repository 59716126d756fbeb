import numpy as np
import pytest

from cohortkit.operators import evaluation as E


def _preds(spark, labels, scores, model="m"):
    rows = [(model, i, int(y), float(s), int(s > 0.5)) for i, (y, s) in enumerate(zip(labels, scores))]
    return spark.createDataFrame(rows, "model string, key long, label int, score double, prediction int")


def _brute_auc(labels, scores):
    pos = [s for y, s in zip(labels, scores) if y == 1]
    neg = [s for y, s in zip(labels, scores) if y == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_auc_matches_pairwise_count_with_ties(spark):
    rng = np.random.default_rng(3)
    labels = rng.integers(0, 2, 300)
    scores = np.round(rng.random(300) * 0.5 + labels * 0.3, 2)     # many ties
    preds = _preds(spark, labels, scores)
    auc = E.roc_auc(preds, buckets=5).first().roc_auc
    assert auc == pytest.approx(_brute_auc(labels, scores), abs=1e-12)


def test_auc_matches_spark_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.linalg import Vectors
    rng = np.random.default_rng(11)
    labels = rng.integers(0, 2, 200)
    scores = rng.random(200) * 0.6 + labels * 0.2
    preds = _preds(spark, labels, scores)
    ours = E.roc_auc(preds).first().roc_auc
    df = spark.createDataFrame([(Vectors.dense([1 - s, s]), float(y)) for y, s in zip(labels, scores)],
                               ["rawPrediction", "label"])
    theirs = BinaryClassificationEvaluator(metricName="areaUnderROC").evaluate(df)
    assert ours == pytest.approx(theirs, abs=1e-9)


def test_metrics_and_report(spark):
    labels = [1, 1, 1, 0, 0, 0, 0, 1]
    scores = [0.9, 0.8, 0.3, 0.6, 0.2, 0.1, 0.4, 0.7]
    preds = _preds(spark, labels, scores)
    m = E.eval_metrics(preds).first()
    # tp=3 (0.9,0.8,0.7), fn=1 (0.3), fp=1 (0.6), tn=3
    assert (m.n, m.accuracy, m.precision, m.recall) == (8, 0.75, 0.75, 0.75)
    assert m.f1_score == pytest.approx(0.75)
    rep = {r.class_label: r for r in E.classification_report(preds).collect()}
    assert rep["0"].support == 4 and rep["1"].support == 4 and rep["macro avg"].precision == pytest.approx(0.75)
    cm = E.confusion_matrix(preds).first()
    assert (cm.tn, cm.fp, cm.fn, cm.tp) == (3, 1, 1, 3) and cm.tp_pct == 37.5


def test_roc_and_pr_points(spark):
    labels = [1, 0, 1, 0]
    scores = [0.9, 0.9, 0.4, 0.1]
    preds = _preds(spark, labels, scores)
    roc = {r.threshold: r for r in E.roc_points(preds).collect()}
    assert (roc[0.9].tp, roc[0.9].fp) == (1, 1)
    assert (roc[0.1].tpr, roc[0.1].fpr) == (1.0, 1.0)
    pr = {r.threshold: r for r in E.pr_points(preds).collect()}
    assert pr[0.4].precision == pytest.approx(2 / 3) and pr[0.4].recall == 1.0


def test_best_and_comparison(spark):
    preds = _preds(spark, [1, 0, 1, 0], [0.9, 0.1, 0.8, 0.2], "a").unionByName(
        _preds(spark, [1, 0, 1, 0], [0.4, 0.6, 0.8, 0.2], "b"))
    metrics = E.eval_metrics(preds)
    assert E.best_model(metrics).first().model == "a"
    assert [r.model for r in E.model_comparison(metrics).collect()] == ["a", "b"]


def test_auc_null_when_single_class(spark):
    assert E.roc_auc(_preds(spark, [1, 1], [0.2, 0.3])).first().roc_auc is None


def test_model_without_auc_never_wins_and_no_model_is_an_error(spark):
    ddl = "model string, roc_auc double"
    some = spark.createDataFrame([("a", 0.9), ("b", None), ("c", float("nan")), ("d", 0.9)], ddl)
    assert tuple(E.best_model(some).first()) == ("a", 0.9)
    for rows in ([], [("b", None)]):
        with pytest.raises(Exception, match="no model has a roc_auc"):
            E.best_model(spark.createDataFrame(rows, ddl)).collect()


def test_curves_have_their_end_points(spark):
    preds = _preds(spark, [1, 0, 1, 0], [0.9, 0.9, 0.4, 0.1])
    start = [r for r in E.roc_points(preds).collect() if r.threshold is None]
    assert [(r.tpr, r.fpr, r.tp, r.fp) for r in start] == [(0.0, 0.0, 0, 0)]
    end = [r for r in E.pr_points(preds).collect() if r.threshold is None]
    assert [(r.precision, r.recall) for r in end] == [(1.0, 0.0)]
