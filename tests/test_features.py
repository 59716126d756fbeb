import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortkit.functions import fixed
from cohortkit.operators import features as X

BASE_DDL = ("student_id long, gpa double, year_level int, major string, total_enrollments long, "
            "completed_courses long, dropped_courses long, current_enrollments long, excellent_grades long, "
            "good_grades long, average_grades long, poor_grades long, avg_course_credits double, "
            "total_credits_attempted long, days_enrolled double")

# Hand-checkable rows: gpa, total, completed, dropped, bands e/g/a/p.
ROWS = [
    (1, 3.5, 10, 8, 1, (5, 2, 1, 0)),
    (2, 2.8, 12, 8, 2, (2, 4, 2, 2)),
    (3, 3.9, 15, 14, 0, (10, 3, 1, 0)),
    (4, 2.2, 8, 4, 3, (1, 2, 1, 1)),
    (5, 3.1, 11, 9, 1, (4, 3, 2, 1)),
]
EXPECTED = {  # completion, success, drop, high_performer, at_risk, engagement
    1: (80.0, 1, 10.0, 1, 0, 0.89),
    2: (66.667, 0, 16.667, 0, 0, 0.87667),
    3: (93.333, 1, 0.0, 1, 0, 1.12333),
    4: (50.0, 0, 37.5, 0, 1, 0.6275),
    5: (81.818, 1, 9.091, 0, 0, 0.93),
}


def _base(spark, rows):
    data = [(sid, gpa, 2, "Math", t, c, d, 0, *bands, 3.0, 3 * t, 240.0) for sid, gpa, t, c, d, bands in rows]
    return spark.createDataFrame(data, BASE_DDL)


def test_hand_checkable_rows(spark):
    out = X.engineer_features(X.add_target(_base(spark, ROWS))).collect()
    got = {r.student_id: r for r in out}
    for sid, (comp, succ, drop, hp, risk, eng) in EXPECTED.items():
        r = got[sid]
        assert r.completion_rate == pytest.approx(comp, abs=1e-3)
        assert r.is_successful == succ
        assert r.drop_rate == pytest.approx(drop, abs=1e-3)
        assert r.high_performer == hp
        assert r.at_risk == risk
        assert r.engagement_score == pytest.approx(eng, abs=1e-4)


def test_grade_diversity_is_sample_std(spark):
    r = X.engineer_features(X.add_target(_base(spark, ROWS[:1]))).first()
    assert r.grade_diversity == pytest.approx(float(np.std([5, 2, 1, 0], ddof=1)))


def test_zero_enrollments_give_zero_rates(spark):
    r = X.engineer_features(X.add_target(_base(spark, [(9, 3.2, 0, 0, 0, (0, 0, 0, 0))]))).first()
    assert r.completion_rate == 0.0 and r.drop_rate == 0.0 and r.is_successful == 0
    assert r.engagement_score == pytest.approx(0.3)
    assert r.courses_per_semester == 0.0


@pytest.mark.parametrize("gpa", [None, float("nan"), float("inf"), float("-inf")])
def test_missing_gpa_never_passes_and_fills_zero(spark, gpa):
    rows = [(7, gpa, 10, 9, 3, (1, 1, 1, 1))]
    r = X.engineer_features(X.add_target(_base(spark, rows))).first()
    assert r.is_successful == 0          # unknown gpa fails the label
    assert r.at_risk == 1                # drop rate 30 > 20 decides alone
    assert r.high_performer == 0
    assert r.gpa == 0.0                  # filled after the predicates


def test_gpa_thresholds_are_inclusive(spark):
    rows = [(1, 3.0, 10, 7, 0, (0, 0, 0, 0)), (2, 2.5, 10, 7, 0, (0, 0, 0, 0)),
            (3, 3.5, 10, 7, 0, (3, 0, 0, 0))]
    got = {r.student_id: r for r in X.engineer_features(X.add_target(_base(spark, rows))).collect()}
    assert got[1].is_successful == 1      # gpa 3.0 and completion 70 both inclusive
    assert got[2].at_risk == 0            # gpa 2.5 is not < 2.5
    assert got[3].high_performer == 1     # 3.5 and excellence 30 inclusive


def test_drop_rate_20_is_not_at_risk(spark):
    r = X.engineer_features(X.add_target(_base(spark, [(1, 3.0, 10, 5, 2, (0, 0, 0, 0))]))).first()
    assert r.drop_rate == 20.0 and r.at_risk == 0


def test_base_features_from_tables(spark, tiny):
    students, courses, enrollments = tiny
    base = X.student_features_base(students, enrollments, courses, as_of="2024-01-11 00:00:00")
    got = {r.student_id: r for r in base.collect()}
    assert set(got) == {1, 2, 3}          # inactive 4 and enrollment-less 5 are absent
    r1 = got[1]
    assert (r1.total_enrollments, r1.completed_courses, r1.dropped_courses) == (3, 2, 1)
    assert (r1.excellent_grades, r1.good_grades) == (2, 1)
    assert r1.avg_course_credits == pytest.approx((4 + 2 + 2) / 3)
    assert r1.total_credits_attempted == 8
    assert r1.days_enrolled == pytest.approx(10.0)
    assert got[2].current_enrollments == 1 and got[2].poor_grades == 1


def test_feature_table_encodes_sorted_majors(spark, tiny):
    students, courses, enrollments = tiny
    ft = X.feature_table(students, enrollments, courses)
    codes = {r.major: r.major_encoded for r in ft.select("major", "major_encoded").distinct().collect()}
    assert codes == {"Art": 0, "Math": 1, fixed.UNDECLARED_MAJOR: 2}
    assert X.feature_columns(ft) == fixed.FEATURE_COLUMNS
    m = X.feature_matrix(ft)
    assert m.columns == ["student_id", *fixed.FEATURE_COLUMNS, "is_successful"]
    for row in m.collect():
        assert all(v is not None and not math.isnan(v) for v in row[1:-1])


def test_serving_features_keep_zero_total(spark, tiny):
    students, courses, enrollments = tiny
    got = {r.student_id: r for r in X.serving_features(students, enrollments).collect()}
    assert got[5].total_enrollments == 0 and got[5].completion_rate == 0.0   # total stays 0
    assert got[3].gpa == 0.0 and got[3].year_level == 1                       # serving defaults
    keys = students.filter(F.col("student_id") == 1)
    assert [r.student_id for r in X.serving_features(students, enrollments, keys).collect()] == [1]


def test_target_summary(spark):
    df = spark.createDataFrame([(1,), (0,), (1,), (1,)], "is_successful int")
    r = X.target_summary(df).first()
    assert (r.success_rate, r.successes, r.failures) == (0.75, 3, 1)


def test_feature_dictionary(spark):
    d = {r.feature: r for r in X.feature_dictionary(spark).collect()}
    assert len(d) == 26 and d["gpa"].category == "basic" and d["at_risk"].category is None


def test_missing_features_warned_and_left_out(spark):
    df = spark.createDataFrame([(1, 3.0)], "student_id long, gpa double")
    with pytest.warns(UserWarning):
        assert X.feature_columns(df) == ["gpa"]


def test_days_since_ignores_session_time_zone(spark):
    df = spark.sql("select TIMESTAMP_NTZ'2024-07-01 00:00:00' as ts")
    prev = spark.conf.get("spark.sql.session.timeZone")
    try:
        got = []
        for tz in ("UTC", "America/New_York"):          # a summer date, a winter reference date
            spark.conf.set("spark.sql.session.timeZone", tz)
            got.append(df.select(X.days_since("ts", "2025-01-01 12:00:00").alias("d")).first().d)
        assert got == [184.5, 184.5]
    finally:
        spark.conf.set("spark.sql.session.timeZone", prev)
