"""A key holding a third of all rows: results stay whole and correct, and the
sort-merge join path gets its hot partition split (AQE) or salted."""

from datetime import datetime

from pyspark.sql import functions as F

from cohortkit.operators import features as X
from cohortkit.operators import quality as Q


def _skewed(spark, n=30000):
    ids = spark.range(n)
    hot = F.col("id") % 3 == 0                       # one course and one student take a third of the rows
    enrollments = ids.select(
        F.concat(F.lit("E"), F.col("id").cast("string")).alias("enrollment_id"),
        F.when(hot, F.lit(7)).otherwise(F.col("id") % 500).cast("long").alias("student_id"),
        F.when(hot, F.lit(3)).otherwise(F.col("id") % 200).cast("long").alias("course_id"),
        F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz").alias("enrollment_date"),
        F.when(F.col("id") % 11 == 0, None).otherwise(F.lit("B")).alias("grade"),
        F.when(F.col("id") % 2 == 0, "Completed").otherwise("Dropped").alias("status"))
    students = spark.range(500).select(
        F.col("id").alias("student_id"), F.lit("n").alias("first_name"), F.lit("x").alias("last_name"),
        F.lit("Math").alias("major"), F.lit(1).alias("year_level"), F.lit(3.0).alias("gpa"),
        F.lit(datetime(2023, 1, 1)).cast("timestamp_ntz").alias("enrollment_date"), F.lit(True).alias("is_active"))
    courses = spark.range(200).select(F.col("id").alias("course_id"), (F.col("id") % 4 + 1).cast("int").alias("credits"))
    return students, courses, enrollments


def test_hot_keys_give_whole_results(spark):
    students, courses, enrollments = _skewed(spark)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k"}
    prev = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        plain = X.student_features_base(students, enrollments, courses)
        rows = {r.student_id: r for r in plain.collect()}
        hot_student_rows = sum(1 for i in range(30000) if i % 3 == 0 or i % 500 == 7)
        assert rows[7].total_enrollments == hot_student_rows                    # a third of the fact and more
        assert sum(r.total_enrollments for r in rows.values()) == 30000          # nothing dropped
        salted = X.student_features_base(students, enrollments, courses, salts=8)
        assert sorted(map(tuple, salted.collect())) == sorted(map(tuple, plain.collect()))

        joined = enrollments.join(courses, "course_id", "left")
        assert len(joined.collect()) == 30000                                     # runs this plan
        final_plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "isFinalPlan=true" in final_plan
        assert "skew=true" in final_plan                                          # AQE split the hot partition

        first = Q.dedupe_pairs(enrollments)
        assert first.filter((F.col("student_id") == 7) & (F.col("course_id") == 3)).first().enrollment_id == "E0"
        assert first.count() == enrollments.select("student_id", "course_id").distinct().count()
    finally:
        for k, v in prev.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
