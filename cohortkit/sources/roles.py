"""Role views: students, courses and enrollments over the driver tables.

The driver supplies TPC-H-like tables.  Each entity is a projection of one
of them (students <- customer, courses <- part) and the activity fact is
``lineitem`` joined to ``orders``.  Every view is a lazy DataFrame, so
Catalyst prunes the unused columns and pushes filters into the Parquet scan.

A few values are set to NULL by a rule on the key so that the null rules of
the operators (``Undeclared`` / ``Unknown`` labels, dropped null keys,
null-safe predicates) meet real cases; no row is removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import GRADES
from .tables import read_table

# Role binding constants (shared with the SQL oracle text in plans/oracle.py).
BASE_DATE = "2020-08-15 00:00:00"
DATE_SPREAD_DAYS = 1461
NULL_MAJOR_MOD, NULL_MAJOR_REM = 50, 0
NULL_GPA_MOD, NULL_GPA_REM = 100, 7
NULL_YEAR_MOD, NULL_YEAR_REM = 75, 5
NULL_DEPT_MOD, NULL_DEPT_REM = 50, 0
NULL_EMAIL_MOD, NULL_EMAIL_REM = 60, 11
EMAIL_DOMAIN = "@students.example"
GRADE_CYCLE = 11  # ten letter grades and one NULL
COMPLETION_BASE, COMPLETION_SPREAD = 45, 55


def students(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return c.select(
        key.alias("student_id"),
        F.col("c_name").alias("first_name"),
        F.lit("X").alias("last_name"),
        F.concat(F.lower(F.col("c_name")), F.lit(EMAIL_DOMAIN)).alias("email"),
        F.when(key % NULL_MAJOR_MOD != NULL_MAJOR_REM, F.col("c_mktsegment")).alias("major"),
        F.when(key % NULL_YEAR_MOD != NULL_YEAR_REM,
               (F.col("c_nationkey") % 4 + 1).cast("int")).alias("year_level"),
        F.when(key % NULL_GPA_MOD != NULL_GPA_REM,
               (F.col("c_acctbal") + F.lit(1000.0)) / F.lit(2750.0)).alias("gpa"),
        F.expr(f"TIMESTAMP_NTZ'{BASE_DATE}' + "
               f"make_dt_interval(cast(c_custkey % {DATE_SPREAD_DAYS} as int))").alias("enrollment_date"),
        (key % 4 != 3).alias("is_active"),
    )


def courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part")
    size = F.col("p_size")
    return p.select(
        F.col("p_partkey").alias("course_id"),
        F.col("p_name").alias("course_name"),
        F.when(F.col("p_partkey") % NULL_DEPT_MOD != NULL_DEPT_REM, F.col("p_brand")).alias("department"),
        (size % 4 + 1).cast("int").alias("credits"),
        F.col("p_type").alias("course_type"),
        (size + 15).cast("int").alias("max_enrollment"),
        F.when(size % 3 == 0, "Fall").when(size % 3 == 1, "Spring").otherwise("Summer").alias("semester"),
        (size % 3 + 2023).cast("int").alias("year"),
    )


def enrollments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem JOIN orders on the order key: the one large join of the views.

    At scale both sides are big; Spark plans a sort-merge join shuffled on
    the order key (or co-located if both tables are bucketed on it).
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
    g = (F.col("l_partkey") + F.col("l_linenumber") + F.col("o_custkey")) % GRADE_CYCLE
    grade = None
    for i, letter in enumerate(GRADES):
        grade = F.when(g == i, letter) if grade is None else grade.when(g == i, letter)
    completed = ((F.col("l_partkey") * 7 + F.col("l_linenumber") * 13) % 100
                 < F.col("o_custkey") % COMPLETION_SPREAD + COMPLETION_BASE)
    status = (F.when(completed, "Completed")
              .when(F.col("l_returnflag") == "R", "Dropped")
              .when(F.col("l_returnflag") == "A", "Enrolled")
              .otherwise("Withdrawn"))
    return j.select(
        F.concat(F.lit("ENR"), F.col("l_orderkey").cast("string"), F.lit("-"),
                 F.col("l_linenumber").cast("string")).alias("enrollment_id"),
        F.col("o_custkey").alias("student_id"),
        F.col("l_partkey").alias("course_id"),
        F.col("o_orderdate").alias("enrollment_date"),
        grade.alias("grade"),
        status.alias("status"),
    )


def role_views(spark: SparkSession, sf_dir: str):
    return students(spark, sf_dir), courses(spark, sf_dir), enrollments(spark, sf_dir)


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """Register the three role views as temp views for SQL-text queries."""
    s, c, e = role_views(spark, sf_dir)
    s.createOrReplaceTempView("students")
    c.createOrReplaceTempView("courses")
    e.createOrReplaceTempView("enrollments")


def prediction_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caller-supplied feature rows derived from ``customer``, unchecked: gpa,
    year level, counts and rates break the declared ranges or are missing for
    some keys."""
    key = F.col("c_custkey")
    count = (key % 12).cast("long")
    return read_table(spark, sf_dir, "customer").select(
        key.alias("student_id"), F.col("c_mktsegment").alias("major"),
        F.when(key % 31 != 3, F.col("c_acctbal") / F.lit(2000.0)).alias("gpa"),
        (F.col("c_nationkey") % 6).cast("int").alias("year_level"),
        (count - F.lit(1)).alias("total_enrollments"),
        F.when(key % 37 != 5, F.floor(count / 2).cast("long")).alias("completed_courses"),
        F.floor(count / 4).cast("long").alias("dropped_courses"),
        F.when(key % 41 == 1, F.lit(-2)).otherwise(key % 3).cast("long").alias("current_enrollments"),
        ((key % 27) * F.lit(4.0)).alias("completion_rate"),
        F.when(key % 5 != 0, (key % 22) * F.lit(5.0)).alias("drop_rate"),
    )


def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming student registrations derived from ``customer``: the batch
    that validation (S7) and insert-new-keys (S8) work on.  Its year level
    (0..5) and gpa (balance / 2500, may be negative) break the declared
    ranges for some rows, as unchecked input does."""
    c = read_table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("student_id"),
        F.col("c_name").alias("first_name"),
        F.lit("X").alias("last_name"),
        F.when(F.col("c_custkey") % NULL_EMAIL_MOD != NULL_EMAIL_REM,
               F.concat(F.lower(F.col("c_name")), F.lit(EMAIL_DOMAIN))).alias("email"),
        F.col("c_mktsegment").alias("major"),
        (F.col("c_nationkey") % 6).cast("int").alias("year_level"),
        (F.col("c_acctbal") / F.lit(2500.0)).alias("gpa"),
        F.lit(True).alias("is_active"),
    )
