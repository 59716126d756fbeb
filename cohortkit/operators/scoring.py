"""Batch scoring: probabilities, risk tiers, confidence, recommendations and
explanations (P1-P13).

The reference scores one dictionary at a time; here every rule is a column
expression over a scored DataFrame, so one ``transform`` scores any number
of students on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.expr import nan_to_null, round_half_up
from .features import as_class_map


def _tier_chain(p: Column, tiers, value) -> Column:
    """``when(p >= t1, v1).when(p >= t2, v2)...otherwise(last)``."""
    expr = None
    for t in tiers:
        threshold, v = t[0], value(t)
        if threshold is None:
            return expr.otherwise(v) if expr is not None else v
        expr = F.when(p >= F.lit(threshold), v) if expr is None else expr.when(p >= F.lit(threshold), v)
    return expr


def heuristic_score(df: DataFrame, gpa_col: str = "gpa", out: str = "success_probability") -> DataFrame:
    """The dashboard's demo score p = min(gpa / 4 + 0.1, 1) and its tier
    (< .6 High, < .8 Medium, else Low)."""
    p = F.least(F.col(gpa_col) / F.lit(4.0) + F.lit(fixed.HEURISTIC_OFFSET), F.lit(1.0))
    df = df.withColumn(out, p)
    tier = None
    for threshold, name in fixed.HEURISTIC_TIERS:
        if threshold is None:
            tier = tier.otherwise(name)
        else:
            cond = F.col(out) < F.lit(threshold)
            tier = F.when(cond, name) if tier is None else tier.when(cond, name)
    return df.withColumn("heuristic_risk", tier)


def risk_columns(p: Column) -> dict[str, Column]:
    """Risk level, icon, confidence score and confidence label."""
    conf = F.greatest(p, F.lit(1.0) - p)
    confidence = None
    for threshold, name in fixed.CONFIDENCE_LEVELS:
        if threshold is None:
            confidence = confidence.otherwise(name)
        else:
            cond = conf > F.lit(threshold)
            confidence = F.when(cond, name) if confidence is None else confidence.when(cond, name)
    return {
        "risk_level": _tier_chain(p, fixed.RISK_TIERS, lambda t: F.lit(t[1])),
        "risk_icon": _tier_chain(p, fixed.RISK_TIERS, lambda t: F.lit(t[2])),
        "confidence_score": conf,
        "confidence": confidence,
    }


def recommendations_column(p: Column, drop_rate: Column | None, gpa: Column | None) -> Column:
    """The tier's list, with the high-drop note and then the low-gpa note
    put in front.  A missing drop rate counts as 0, a missing gpa as 4.0."""
    tier_list = _tier_chain(p, fixed.RISK_TIERS, lambda t: F.array(*[F.lit(x) for x in t[3]]))
    empty = F.array().cast("array<string>")
    drop = F.coalesce(nan_to_null(drop_rate), F.lit(0.0)) if drop_rate is not None else F.lit(0.0)
    g = F.coalesce(nan_to_null(gpa), F.lit(4.0)) if gpa is not None else F.lit(4.0)
    drop_note = F.when(drop > F.lit(fixed.HIGH_DROP_RATE), F.array(F.lit(fixed.HIGH_DROP_TEXT))).otherwise(empty)
    gpa_note = F.when(g < F.lit(fixed.LOW_GPA), F.array(F.lit(fixed.LOW_GPA_TEXT))).otherwise(empty)
    return F.concat(gpa_note, drop_note, tier_list)


def assess_risk(df: DataFrame, prob_col: str = "success_probability",
                drop_col: str | None = "drop_rate", gpa_col: str | None = "gpa") -> DataFrame:
    """P5-P7 on any frame with a success probability."""
    p = F.col(prob_col)
    cols = risk_columns(p)
    drop = F.col(drop_col) if drop_col and drop_col in df.columns else None
    gpa = F.col(gpa_col) if gpa_col and gpa_col in df.columns else None
    cols["recommendations"] = recommendations_column(p, drop, gpa)
    return df.withColumns(cols)


def percent_text(p: Column) -> Column:
    """Probability as a percent with one decimal, e.g. '78.3%'."""
    return F.format_string("%.1f%%", round_half_up(p * F.lit(100.0), 1))


def interpretation_column(p: Column) -> Column:
    """The sentence for the probability's tier."""
    text = percent_text(p)

    def sentence(t):
        head, tail = t[1].split("{p}")
        return F.concat(F.lit(head), text, F.lit(tail))
    return _tier_chain(p, fixed.INTERPRETATIONS, sentence)


def explain(df: DataFrame, prob_col: str = "success_probability", features=None, top: int = 10) -> DataFrame:
    """``key_features`` maps the first ``top`` features of the list to
    {value, description} (absent features count 0), plus the interpretation."""
    names = list(features or fixed.FEATURE_COLUMNS)[:top]
    entries = []
    for name in names:
        value = F.col(name).cast("double") if name in df.columns else F.lit(0.0)
        desc = fixed.FEATURE_DESCRIPTIONS.get(name, "No description")
        entries += [F.lit(name), F.struct(F.coalesce(value, F.lit(0.0)).alias("value"),
                                          F.lit(desc).alias("description"))]
    return df.withColumns({
        "key_features": F.create_map(*entries),
        "interpretation": interpretation_column(F.col(prob_col)),
    })


def align_features(df: DataFrame, feature_names: list[str], major_classes: DataFrame | None = None,
                   key: str = "student_id") -> DataFrame:
    """One double column per model feature, in order.  Absent features
    are 0, NULL / NaN values 0.  ``major_encoded`` comes from ``major`` and the
    fitted class table; an unseen (or absent) major gets the number of classes, like
    a 'keep' indexer.  Without the class table only a frame that is encoded already
    can be aligned."""
    if "major_encoded" in feature_names and ("major_encoded" not in df.columns or major_classes is not None):
        if major_classes is None:
            raise ValueError("major_encoded needs the class table that was fitted with the models")
        if "major" not in df.columns:
            df = df.withColumn("major", F.lit(None).cast("string"))
        one = as_class_map(major_classes).withColumnRenamed("classes", "_classes")
        code = F.coalesce(F.try_element_at("_classes", F.col("major")), F.size("_classes"))
        df = df.crossJoin(F.broadcast(one)).withColumn("major_encoded", code).drop("_classes")
    cols = []
    for name in feature_names:
        if name in df.columns:
            v = nan_to_null(F.col(name).cast("double"))
            cols.append(F.coalesce(v, F.lit(0.0)).alias(name))
        else:
            cols.append(F.lit(0.0).alias(name))
    keep = [key] if key in df.columns else []
    return df.select(*keep, *cols)


def linear_probability(df: DataFrame, coefficients: dict[str, float], intercept: float,
                       out: str = "success_probability") -> DataFrame:
    """P3 for a linear model given by its numbers: 1 / (1 + exp(-(b + sum c x)))."""
    z = F.lit(float(intercept))
    for name, c in coefficients.items():
        z = z + F.lit(float(c)) * F.col(name)
    return df.withColumn(out, F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))


def probability_columns(scored: DataFrame, prob_col: str = "probability") -> DataFrame:
    """Class-1 and class-0 probabilities from an ML probability vector."""
    from pyspark.ml.functions import vector_to_array
    arr = vector_to_array(F.col(prob_col))
    return scored.withColumns({"success_probability": arr[1], "failure_probability": arr[0]})


def score(model, features: DataFrame, model_name: str, metrics: dict | None = None,
          key: str = "student_id", context: DataFrame | None = None) -> DataFrame:
    """Score aligned feature rows with a fitted
    ``PipelineModel`` and attach tiers, confidence, recommendations and the
    model's stored performance.

    ``features`` is the output of ``align_features``; ``context`` (optional,
    keyed like ``features``) supplies the raw gpa / drop rate the rules read.
    """
    scored = probability_columns(model.transform(features))
    scored = scored.withColumn("predicted_success", F.col("prediction") > F.lit(0.5))
    m = metrics or {}
    scored = scored.withColumns({
        "model_used": F.lit(model_name),
        "model_performance": F.struct(
            F.lit(m.get("roc_auc")).cast("double").alias("roc_auc"),
            F.lit(m.get("accuracy")).cast("double").alias("accuracy")),
    })
    rules_src = scored
    if context is not None:
        extra = [c for c in ("gpa", "drop_rate") if c in context.columns]
        rules_src = scored.drop(*extra).join(context.select(key, *extra), key, "left")
    out = assess_risk(rules_src)
    id_col = (F.coalesce(F.col(key).cast("string"), F.lit("Unknown")) if key in out.columns
              else F.lit("Unknown"))
    return out.select(
        id_col.alias("student_id"), "predicted_success", "success_probability", "failure_probability",
        "risk_level", "risk_icon", "confidence", "recommendations", "model_used", "model_performance")
