from cohortkit.operators import features as X
from cohortkit.sources.sinks import save_bucketed


def test_bucketed_tables_remove_the_shuffles(spark, tiny, tmp_path):
    students, courses, enrollments = tiny
    save_bucketed(students, "bk_students", "student_id", 4, str(tmp_path / "s"))
    save_bucketed(enrollments, "bk_enrollments", "student_id", 4, str(tmp_path / "e"))
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")     # force the sort-merge path
    try:
        s, e = spark.table("bk_students"), spark.table("bk_enrollments")
        per_student = e.groupBy("student_id").count().join(s, "student_id")
        plan = per_student._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        base = X.student_features_base(s, e, courses)
        assert sorted(map(tuple, base.collect())) == \
            sorted(map(tuple, X.student_features_base(students, enrollments, courses).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)


def test_materialize_roles(spark):
    from cohortkit.plans import jobs
    from cohortkit.sources import roles
    names = jobs.materialize_roles(spark, "/root/testdata/sf0.001", database="cohort_t", buckets=4)
    s, c, e = roles.role_views(spark, "/root/testdata/sf0.001")
    assert spark.table(names["enrollments"]).count() == e.count()
    assert spark.table(names["students"]).count() == s.count()
    assert spark.table(names["courses"]).count() == c.count()
