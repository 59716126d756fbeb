from datetime import datetime

from pyspark.sql import functions as F

from cohortkit.operators import browse as B
from cohortkit.operators import quality as Q


def test_validate_rows(spark):
    df = spark.createDataFrame([(1, "A", "B", "e", 2, 3.0), (2, None, "B", None, 5, -1.0), (3, "C", "D", "f", None, None)],
                               "student_id long, first_name string, last_name string, email string, "
                               "year_level int, gpa double")
    got = {r.student_id: r for r in Q.validate_rows(df).collect()}
    assert got[1].is_valid and got[1].reject_reason is None
    assert got[3].is_valid                                   # optional fields may be NULL
    assert got[2].reject_reason == ("first_name is required; email is required; year_level must be between 1 and 4; "
                                    "gpa must be between 0.0 and 4.0")
    valid, rejected = Q.split_valid(df)
    assert valid.count() == 2 and rejected.count() == 1 and "is_valid" not in valid.columns


def test_append_new_keys(spark):
    target = spark.createDataFrame([(1, "old")], "student_id long, name string")
    batch = spark.createDataFrame([(1, "again"), (2, "b2"), (2, "a2"), (3, "c")], "student_id long, name string")
    new, refused = Q.append_new_keys(target, batch, "student_id", inserted_at="2025-01-01 00:00:00",
                                     order=["name"])
    got = {r.student_id: r for r in new.collect()}
    assert set(got) == {2, 3} and got[2].name == "a2"        # first row of the batch by name wins
    assert got[2].inserted_at == datetime(2025, 1, 1)
    assert [r.student_id for r in refused.collect()] == [1]


def test_dedupe_pairs_first_by_id_nulls_first(spark, tiny):
    _, _, enrollments = tiny
    d = {(r.student_id, r.course_id): r.enrollment_id for r in Q.dedupe_pairs(enrollments).collect()}
    assert d[(1, 11)] == "E2" and len(d) == 8
    df = spark.createDataFrame([(1, 1, "x", None), (1, 1, "x", "b")], "s long, c long, id string, g string")
    assert Q.first_per_key(df, ["s", "c"], ["id"]).first().g is None


def test_duplicates_and_orphans(spark, tiny):
    students, courses, enrollments = tiny
    assert [(r.enrollment_id, r.occurrences) for r in Q.duplicate_keys(enrollments, "enrollment_id").collect()] \
        == [("E7", 2)]
    assert [r.enrollment_id for r in Q.orphan_rows(enrollments, students, "student_id").collect()] == ["E9"]
    rep = {r.foreign_key: r for r in Q.orphan_report(enrollments, {"student_id": students,
                                                                   "course_id": courses}).collect()}
    assert rep["student_id"].orphan_rows == 1 and rep["course_id"].orphan_rows == 1
    assert rep["course_id"].checked_rows == 9


def test_table_counts(spark, tiny):
    s, c, e = tiny
    got = {r.table_name: r.row_count for r in Q.table_counts({"s": s, "c": c, "e": e}).collect()}
    assert got == {"s": 5, "c": 3, "e": 9}


def test_browse_filters_and_pages(spark, tiny):
    students, courses, enrollments = tiny
    page = B.students_filtered(students, major="Art", skip=0, limit=10).collect()
    assert [r.student_id for r in page] == [3, 4]
    page2 = B.students_filtered(students, skip=1, limit=2).collect()
    assert [r.student_id for r in page2] == [2, 3]
    assert [r.student_id for r in B.students_filtered(students, min_gpa=3.6).collect()] == [1, 5]
    assert [r.course_id for r in B.courses_filtered(courses, semester="Spring").collect()] == [11]
    assert B.enrollments_filtered(enrollments, status="Dropped").count() == 2


def test_lookup_and_student_enrollments(spark, tiny):
    students, _, enrollments = tiny
    keys = spark.createDataFrame([(1,), (7,), (1,)], "student_id long")
    got = {r.student_id: r.found for r in B.lookup_keys(students, keys, "student_id").collect()}
    assert got == {1: True, 7: False}
    ids = {r.enrollment_id for r in B.student_enrollments(students, enrollments, keys).collect()}
    assert ids == {"E1", "E2", "E3"}


def test_at_risk_lists(spark, tiny):
    students, _, _ = tiny
    r = B.at_risk(students).collect()
    assert [(x.student_id, x.name) for x in r] == [(2, "Bob Ray")]
    a = B.at_risk_active(students, 3.7).collect()
    assert [x.student_id for x in a] == [2, 1]
    sql = B.sql_at_risk_active(spark, students, 3.7).collect()
    assert [x.student_id for x in sql] == [2, 1]


def test_sort_table_allow_list(spark, tiny):
    import pytest
    _, courses, enrollments = tiny
    from cohortkit.operators import rollups as A
    roll = A.course_rollup(courses, enrollments)
    assert [r.course_id for r in B.sort_table(roll, "average_grade_point", ascending=True).collect()][-1] == 12
    with pytest.raises(ValueError):
        B.sort_table(roll, "credits; drop table")
    assert [r.course_id for r in B.top_n(roll, "total_enrollments", 2).collect()] == [10, 11]


def test_single_key_lookups(spark, tiny):
    import pytest
    students, _, enrollments = tiny
    assert B.get_by_key(students, "student_id", 2).first().first_name == "Bob"
    with pytest.raises(KeyError):
        B.get_by_key(students, "student_id", 42)
    assert {r.enrollment_id for r in B.enrollments_of(students, enrollments, 2).collect()} == {"E4", "E5"}
    with pytest.raises(KeyError):
        B.enrollments_of(students, enrollments, 9)        # enrollments exist, the student does not
