import pytest
from pyspark.sql import functions as F

from cohortkit.functions import fixed
from cohortkit.operators import scoring as S


def _assess(spark, rows, ddl="success_probability double, drop_rate double, gpa double"):
    return S.assess_risk(spark.createDataFrame(rows, ddl)).collect()


@pytest.mark.parametrize("p,tier", [(0.0, "Critical"), (0.39, "Critical"), (0.4, "High"), (0.6, "Medium"),
                                    (0.79, "Medium"), (0.8, "Low"), (1.0, "Low")])
def test_risk_tier_boundaries(spark, p, tier):
    r = _assess(spark, [(p, 0.0, 3.0)])[0]
    assert r.risk_level == tier
    assert r.risk_icon == {t[1]: t[2] for t in fixed.RISK_TIERS}[tier]


@pytest.mark.parametrize("p,conf", [(0.5, "Low"), (0.6, "Low"), (0.4, "Low"), (0.65, "Medium"),
                                    (0.7, "Medium"), (0.3, "Medium"), (0.75, "High"), (0.85, "High"),
                                    (0.86, "Very High"), (0.0, "Very High")])
def test_confidence_edges_are_strict(spark, p, conf):
    assert _assess(spark, [(p, 0.0, 3.0)])[0].confidence == conf


def test_recommendation_order_and_thresholds(spark):
    rows = [(0.9, 15.0, 2.0), (0.9, 15.5, 3.0), (0.9, 20.0, 1.5), (0.3, None, None)]
    out = _assess(spark, rows)
    low = fixed.RISK_TIERS[0][3]
    assert out[0].recommendations == low                                  # 15 and 2.0 are not past the edge
    assert out[1].recommendations == [fixed.HIGH_DROP_TEXT] + low
    assert out[2].recommendations == [fixed.LOW_GPA_TEXT, fixed.HIGH_DROP_TEXT] + low
    assert out[3].recommendations == fixed.RISK_TIERS[3][3]               # missing -> drop 0, gpa 4.0


def test_rules_without_context_columns(spark):
    df = spark.createDataFrame([(0.5,)], "success_probability double")
    r = S.assess_risk(df).first()
    assert r.risk_level == "High" and len(r.recommendations) == 6


def test_heuristic_score(spark):
    df = spark.createDataFrame([(4.0,), (2.0,), (1.0,), (2.8,)], "gpa double")
    got = [(r.success_probability, r.heuristic_risk) for r in S.heuristic_score(df).collect()]
    assert got[0] == (1.0, "Low")
    assert got[1] == (pytest.approx(0.6), "Medium")
    assert got[2] == (pytest.approx(0.35), "High")
    assert got[3][1] == "Medium"      # 2.8 / 4 + 0.1 is 0.7999.. in doubles, as in the reference


def test_explanation(spark):
    df = spark.createDataFrame([(0.783, 3.2, 10)], "success_probability double, gpa double, total_enrollments long")
    r = S.explain(df).first()
    assert set(r.key_features) == set(fixed.FEATURE_COLUMNS[:10])
    assert r.key_features["gpa"].value == 3.2 and r.key_features["poor_grades"].value == 0.0
    assert r.key_features["gpa"].description == fixed.FEATURE_DESCRIPTIONS["gpa"]
    assert "78.3%" in r.interpretation and r.interpretation.startswith("This student has a 78.3%")


def test_align_features_defaults_and_unseen(spark):
    classes = spark.createDataFrame([("Art", 0), ("Math", 1)], "major string, major_encoded int")
    df = spark.createDataFrame([(1, "Math", 3.0), (2, "Music", float("nan"))],
                               "student_id long, major string, gpa double")
    got = {r.student_id: r for r in S.align_features(df, ["gpa", "drop_rate", "major_encoded"], classes).collect()}
    assert (got[1].gpa, got[1].drop_rate, got[1].major_encoded) == (3.0, 0.0, 1.0)
    assert (got[2].gpa, got[2].major_encoded) == (0.0, 2.0)       # NaN -> 0, unseen -> number of classes
