"""Model evaluation over (model, label, score, prediction) rows.

All metrics come from counts: the confusion cells are ``count_if``
aggregates per model, and ROC AUC / ROC / PR curves come from per-score
positive and negative counts with distributed running sums
(``functions.stats.running_sums``).  AUC is an exact integer ratio:

    AUC = sum_s pos_s * (2 * neg_below_s + neg_s) / (2 * P * N)

which equals the Mann-Whitney statistic with ties counted one half.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import safe_div
from ..functions.stats import running_sums
from ..session import checkpointed
from . import logistic, trees


def long_predictions(df: DataFrame, scores: dict[str, Column], label: str,
                     key: str = "student_id", threshold: float = 0.5) -> DataFrame:
    """The long (model, key, label, score, prediction) form of one or more models'
    scores, from one pass over ``df``; the class is 1 when score > threshold."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), s.cast("double").alias("score"))
                               for m, s in scores.items()])).alias("_m")
    return df.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"), each).select(
        "_m.model", "key", "label", "_m.score", (F.col("_m.score") > F.lit(threshold)).cast("int").alias("prediction"))


def outcome_counts(preds: DataFrame, by=("model",)) -> DataFrame:
    """Per (model, score, prediction): positive and negative counts.

    The one pass over the predictions; everything else is derived from it.  A hot
    score is one row, and the result is checkpointed because several branches read it."""
    return checkpointed(preds.groupBy(*by, "score", "prediction").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")))


def _confusion(counts: DataFrame, by=("model",)) -> DataFrame:
    def cell(predicted, count):
        return F.sum(F.when(F.col("prediction") == predicted, F.col(count)).otherwise(0)).cast("long")
    return counts.groupBy(*by).agg(cell(0, "neg").alias("tn"), cell(1, "neg").alias("fp"),
                                   cell(0, "pos").alias("fn"), cell(1, "pos").alias("tp"))


def confusion_counts(preds: DataFrame, by=("model",)) -> DataFrame:
    """Per model (or any ``by`` key): tn, fp, fn, tp (one aggregation)."""
    y, p = F.col("label"), F.col("prediction")
    return preds.groupBy(*by).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"))


def _curves(counts: DataFrame, buckets: int | None, by=("model",)) -> DataFrame:
    per_score = counts.groupBy(*by, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return running_sums(per_score, "score", ["pos", "neg"], partition_cols=list(by), buckets=buckets)


def _auc(curves: DataFrame, by=("model",)) -> DataFrame:
    return curves.groupBy(*by).agg(
        F.try_divide(
            F.sum(F.col("pos") * (F.lit(2) * F.col("neg_before") + F.col("neg"))).cast("double"),
            F.lit(2.0) * F.max("pos_total").cast("double") * F.max("neg_total").cast("double"),
        ).alias("roc_auc"))


def roc_auc(preds: DataFrame, buckets: int | None = None, by=("model",)) -> DataFrame:
    """Per model (or ``by`` key) ROC AUC (NULL when a class is absent)."""
    return _auc(_curves(outcome_counts(preds, by), buckets, by), by)


def eval_metrics(preds: DataFrame, buckets: int | None = None, by=("model",)) -> DataFrame:
    """Per model (or ``by`` key, e.g. model and split) n, accuracy, ROC AUC,
    and class-1 precision, recall, F1."""
    counts = outcome_counts(preds, by)
    cm = _confusion(counts, by)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision = safe_div(tp, tp + fp)
    recall = safe_div(tp, tp + fn)
    out = cm.select(
        *by, (tp + fp + fn + tn).alias("n"),
        safe_div(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        precision.alias("precision"), recall.alias("recall"),
        safe_div(F.lit(2) * tp, F.lit(2) * tp + fp + fn).alias("f1_score"))
    return out.join(_auc(_curves(counts, buckets, by), by), list(by), "left")


def model_comparison(metrics: DataFrame) -> DataFrame:
    """The comparison table, best AUC first."""
    return (metrics.select("model", "roc_auc", "accuracy", "f1_score", "precision", "recall")
            .orderBy(F.desc_nulls_last("roc_auc"), "model"))


def best_by(table: DataFrame, metric: str) -> DataFrame:
    """(model, metric) of the highest known metric (ties: smallest name).  A model
    whose metric is NULL or NaN never wins; a table without any is an error when
    the result is read."""
    known = table.filter(F.col(metric).isNotNull() & ~F.isnan(F.col(metric).cast("double")))
    best = known.agg(F.min(F.struct((-F.col(metric)).alias("neg"), F.col("model").alias("model"))).alias("_b"))
    error = F.raise_error(F.lit(f"no model has a {metric}")).cast("string")
    return best.select(F.when(F.col("_b").isNull(), error).otherwise(F.col("_b.model")).alias("model"),
                       (-F.col("_b.neg")).alias(metric))


def best_model(metrics: DataFrame, metric: str = "roc_auc") -> DataFrame:
    """The model with the highest metric."""
    return best_by(metrics, metric)


def classification_report(preds: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support for class 0, class 1, the macro
    and the support-weighted averages."""
    cm = confusion_counts(preds)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    per = cm.select(
        "model",
        safe_div(tn, tn + fn).alias("p0"), safe_div(tn, tn + fp).alias("r0"),
        safe_div(F.lit(2) * tn, F.lit(2) * tn + fp + fn).alias("f0"), (tn + fp).alias("s0"),
        safe_div(tp, tp + fp).alias("p1"), safe_div(tp, tp + fn).alias("r1"),
        safe_div(F.lit(2) * tp, F.lit(2) * tp + fp + fn).alias("f1"), (tp + fn).alias("s1"))
    n = F.col("s0") + F.col("s1")

    def wavg(a, b):
        return safe_div(F.col(a) * F.col("s0") + F.col(b) * F.col("s1"), n)
    rows = [
        ("0", F.col("p0"), F.col("r0"), F.col("f0"), F.col("s0")),
        ("1", F.col("p1"), F.col("r1"), F.col("f1"), F.col("s1")),
        ("macro avg", (F.col("p0") + F.col("p1")) / F.lit(2.0), (F.col("r0") + F.col("r1")) / F.lit(2.0),
         (F.col("f0") + F.col("f1")) / F.lit(2.0), n),
        ("weighted avg", wavg("p0", "p1"), wavg("r0", "r1"), wavg("f0", "f1"), n),
    ]
    stacked = F.array(*[F.struct(F.lit(c).alias("class_label"), p.alias("precision"), r.alias("recall"),
                                 f.alias("f1_score"), s.cast("long").alias("support"))
                        for c, p, r, f, s in rows])
    return per.select("model", F.inline(stacked))


def confusion_matrix(preds: DataFrame) -> DataFrame:
    """E5: tn, fp, fn, tp and each as a percent of the total."""
    cm = confusion_counts(preds)
    total = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    return cm.select("model", "tn", "fp", "fn", "tp",
                     *[(safe_div(c, total) * F.lit(100)).alias(f"{c}_pct") for c in ("tn", "fp", "fn", "tp")])


def roc_points(preds: DataFrame, buckets: int | None = None) -> DataFrame:
    """The ROC curve: one point per distinct score (predicting 1 for score >=
    threshold), and the start (0, 0), whose threshold is NULL."""
    c = _curves(outcome_counts(preds), buckets)
    start = c.groupBy("model").agg(F.max("pos_total").alias("pos_total"), F.max("neg_total").alias("neg_total")).select(
        "model", F.lit(None).cast("double").alias("threshold"), F.lit(0).cast("long").alias("tp"),
        F.lit(0).cast("long").alias("fp"), "pos_total", "neg_total")
    tp = F.col("pos_total") - F.col("pos_before")
    fp = F.col("neg_total") - F.col("neg_before")
    points = c.select("model", F.col("score").alias("threshold"), tp.alias("tp"), fp.alias("fp"), "pos_total", "neg_total")
    return points.unionByName(start).select(
        "model", "threshold", "tp", "fp", F.try_divide(F.col("tp").cast("double"), F.col("pos_total")).alias("tpr"),
        F.try_divide(F.col("fp").cast("double"), F.col("neg_total")).alias("fpr"))


def pr_points(preds: DataFrame, buckets: int | None = None) -> DataFrame:
    """Precision and recall per distinct score threshold, and the end of the
    curve (precision 1, recall 0), whose threshold is NULL."""
    c = _curves(outcome_counts(preds), buckets)
    tp = F.col("pos_total") - F.col("pos_before")
    fp = F.col("neg_total") - F.col("neg_before")
    points = c.select("model", F.col("score").alias("threshold"),
                      F.try_divide(tp.cast("double"), tp + fp).alias("precision"),
                      F.try_divide(tp.cast("double"), F.col("pos_total")).alias("recall"))
    end = c.select("model").distinct().select("model", F.lit(None).cast("double").alias("threshold"),
                                              F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return points.unionByName(end)


def tree_importance(spark, model, feature_names: list[str], model_name: str,
                    top_n: int | None = None) -> DataFrame | None:
    """A fitted tree ensemble's importances by feature, largest first;
    None when the model has no importances."""
    if not isinstance(model, trees.TreeModel):
        return None
    df = trees.importances(model.table(spark), feature_names, per_tree=model.kind == "forest").select(
        F.lit(model_name).alias("model"), "feature", "importance")
    df = df.orderBy(F.desc("importance"), "feature")
    return df.limit(top_n) if top_n else df


def linear_importance(spark, model, feature_names: list[str], model_name: str,
                      top_n: int | None = None) -> DataFrame | None:
    """A fitted linear model's coefficients and absolute values, largest first."""
    if not isinstance(model, logistic.LinearModel):
        return None
    rows = [(model_name, f, float(v), abs(float(v))) for f, v in zip(feature_names, model.coefficients)]
    df = spark.createDataFrame(rows, "model string, feature string, coefficient double, abs_coefficient double")
    df = df.orderBy(F.desc("abs_coefficient"), "feature")
    return df.limit(top_n) if top_n else df


def append_metrics(metrics: DataFrame, path: str, run_id: str) -> str:
    """Keep each run's metrics in a Parquet table (append)."""
    (metrics.withColumn("run_id", F.lit(run_id))
     .withColumn("recorded_at", F.current_timestamp())
     .write.mode("append").parquet(path))
    return path
