import pytest
from pyspark.sql import functions as F

from cohortkit.functions import fixed
from cohortkit.operators import evaluation as E
from cohortkit.operators import features as X
from cohortkit.operators import rollups as A
from cohortkit.sources import sinks
from cohortkit.sources.tables import read_entity


def test_create_tables_and_overwrite(spark, tiny, tmp_path):
    students, _, _ = tiny
    names = sinks.create_tables(spark, str(tmp_path / "wh"), database="cohort_test")
    assert names == ["cohort_test.students", "cohort_test.courses", "cohort_test.enrollments"]
    assert spark.table("cohort_test.students").count() == 0
    assert spark.table("cohort_test.students").columns[0] == "student_id"
    sinks.create_tables(spark, str(tmp_path / "wh"), database="cohort_test")      # IF NOT EXISTS
    path = str(tmp_path / "students")
    sinks.overwrite_table(students, path)
    sinks.overwrite_table(students.limit(2), path)                                # replaces
    assert read_entity(spark, path, "students").count() == 2
    sinks.append_rows(students.limit(1), path)
    assert read_entity(spark, path, "students").count() == 3


def test_append_metrics_keeps_runs(spark, tmp_path):
    m = spark.createDataFrame([("a", 0.9)], "model string, roc_auc double")
    path = str(tmp_path / "metrics")
    E.append_metrics(m, path, "run1")
    E.append_metrics(m, path, "run2")
    runs = {r.run_id for r in spark.read.parquet(path).collect()}
    assert runs == {"run1", "run2"}


def test_feature_comments(spark):
    df = spark.createDataFrame([(3.0, 1)], "gpa double, other int")
    out = X.with_feature_comments(df)
    assert out.schema["gpa"].metadata["comment"] == fixed.FEATURE_DESCRIPTIONS["gpa"]
    assert out.schema["other"].metadata == {}


def test_map_form(spark, tiny):
    students, _, _ = tiny
    m = A.as_map(A.students_by_major(students), "major").first()["major_map"]
    assert m == {"Math": 2, "Art": 2}
    with pytest.raises(Exception, match="more than 1 values"):
        A.as_map(A.students_by_major(students), "major", most=1).collect()


def test_score_unknown_model_is_an_error(spark):
    from cohortkit.plans import jobs
    res = jobs.JobResult(features=[], trained={}, best="x", metrics=None, path="", n_rows=0, success_rate=0.0,
                         test_success_rate=0.0, as_of="", classes=None)
    with pytest.raises(ValueError):
        jobs.score_students(spark, "/root/testdata/sf0.001", res, model_name="nope")


def test_sorted_layout_has_more_files_for_more_rows(spark, tmp_path, monkeypatch):
    """A task sorts a bounded number of rows: the files grow with the table, whatever number is asked for."""
    from cohortkit.sources import pages as P
    monkeypatch.setattr(P, "FILE_ROWS", 50)
    path = P.write_sorted(spark.range(1000).selectExpr("1000 - id as k"), str(tmp_path / "t"), ["k"], 2)
    files = spark.read.parquet(f"{path}/directory").collect()
    assert len(files) > 10 and sum(r["n"] for r in files) == 1000 and max(r["n"] for r in files) < 200
    assert [r["k"] for r in P.page_at(spark, path, ["k"], 480, 5).collect()] == [481, 482, 483, 484, 485]
