"""Roll-ups and key indicators.

Pattern used throughout: aggregate the activity fact per catalog / member key
first (partial + final hash aggregation absorbs hot keys map-side), then join
the one-row-per-key result to the dimension.  Scalar indicators are single
``agg`` passes; a percent of a total joins a one-row frame (a proven size
bound, so it is broadcast).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.joins import dimension_join
from ..functions.expr import grade_point_tenths, null_label, percent, round_half_up, safe_div


def _one_row(df: DataFrame) -> DataFrame:
    return F.broadcast(df)


# --- A1-A3: the SQL-text examples --------------------------------------------

def students_by_major_active(students: DataFrame, top: int | None = None) -> DataFrame:
    """A1: active students by major: count and mean gpa, by count descending."""
    out = (students.filter(F.col("is_active"))
           .groupBy("major")
           .agg(F.count(F.lit(1)).alias("student_count"), F.avg("gpa").alias("avg_gpa")))
    out = out.orderBy(F.desc("student_count"), F.asc_nulls_last("major"))
    return out.limit(top) if top else out


def course_enrollment_counts(enrollments: DataFrame) -> DataFrame:
    """Per course: enrollments, completed, dropped, known-grade count and
    grade-point sum in integer tenths (one partial+final aggregation)."""
    gp = grade_point_tenths("grade")
    return (enrollments.select("course_id", "enrollment_id", "status", "grade")
            .groupBy("course_id")
            .agg(F.count("enrollment_id").alias("total_enrollments"),
                 F.count_if(F.col("status") == "Completed").alias("completed"),
                 F.count_if(F.col("status") == "Dropped").alias("dropped"),
                 F.count(gp).alias("graded"),
                 F.sum(gp).alias("grade_tenths")))


def dept_enrollment(courses: DataFrame, enrollments: DataFrame, top: int | None = None) -> DataFrame:
    """Per department, enrollments and completed; courses without
    enrollments count 0 (courses LEFT JOIN the per-course aggregate)."""
    per_course = course_enrollment_counts(enrollments).select("course_id", "total_enrollments", "completed")
    out = (courses.select("course_id", "department")
           .join(per_course, "course_id", "left")
           .groupBy("department")
           .agg(F.coalesce(F.sum("total_enrollments"), F.lit(0)).cast("long").alias("total_enrollments"),
                F.coalesce(F.sum("completed"), F.lit(0)).cast("long").alias("completed")))
    out = out.orderBy(F.desc("total_enrollments"), F.asc_nulls_last("department"))
    return out.limit(top) if top else out


def grade_distribution(enrollments: DataFrame) -> DataFrame:
    """A3: count per non-null grade and its percent of all graded rows (1 decimal)."""
    counts = (enrollments.select("grade").filter(F.col("grade").isNotNull())
              .groupBy("grade").agg(F.count(F.lit(1)).alias("count")))
    total = counts.agg(F.sum("count").alias("_total"))
    return (counts.crossJoin(_one_row(total))
            .select("grade", "count",
                    round_half_up(F.col("count") * F.lit(100.0) / F.col("_total"), 1).alias("percentage"))
            .orderBy(F.desc("count"), "grade"))


# --- A4-A6: overview and student analytics ----------------------------------

def overview(students: DataFrame, courses: DataFrame, enrollments: DataFrame) -> DataFrame:
    """A4: one row of scalars, one aggregation pass per table."""
    s = students.agg(F.count(F.lit(1)).alias("total_students"),
                     F.count_if(F.col("is_active")).alias("active_students"),
                     F.coalesce(F.avg("gpa"), F.lit(0.0)).alias("average_gpa"))
    c = courses.agg(F.count(F.lit(1)).alias("total_courses"))
    e = enrollments.agg(F.count(F.lit(1)).alias("total_enrollments"))
    return s.crossJoin(_one_row(c)).crossJoin(_one_row(e))


def students_by_year(students: DataFrame) -> DataFrame:
    """A5: counts by year level; NULL and 0 keys dropped."""
    return (students.filter(F.col("year_level").isNotNull() & (F.col("year_level") != 0))
            .groupBy("year_level").agg(F.count("student_id").alias("count")))


def students_by_major(students: DataFrame) -> DataFrame:
    """A5: counts by major; NULL and '' keys dropped."""
    return (students.filter(F.col("major").isNotNull() & (F.col("major") != ""))
            .groupBy("major").agg(F.count("student_id").alias("count")))


def as_map(df: DataFrame, key: str, value: str = "count", most: int = 10_000) -> DataFrame:
    """One-row map form of a small grouped result (key -> value); more than ``most``
    keys are an error when the result is read, and never reach the one row."""
    entries = df.limit(most + 1).agg(F.collect_list(F.struct(key, value)).alias("e"))
    error = F.raise_error(F.lit(f"more than {most} values of {key}")).cast(entries.schema["e"].dataType)
    return entries.select(F.map_from_entries(
        F.when(F.size("e") > most, error).otherwise(F.col("e"))).alias(f"{key}_map"))


def student_analytics_major(students: DataFrame) -> DataFrame:
    """Counts by major, NULL / '' labelled 'Undeclared'."""
    return (students.select(null_label("major", fixed.UNDECLARED_MAJOR).alias("major"), "student_id")
            .groupBy("major").agg(F.count("student_id").alias("count")))


def student_analytics_year(students: DataFrame) -> DataFrame:
    """Counts by year, NULL / 0 labelled 0."""
    return (students.select(F.coalesce(F.col("year_level"), F.lit(0)).alias("year"), "student_id")
            .groupBy("year").agg(F.count("student_id").alias("count")))


def student_analytics_summary(students: DataFrame) -> DataFrame:
    """Total, active and mean gpa rounded to 2 decimals (0 when no gpa)."""
    return students.agg(
        F.count(F.lit(1)).alias("total_students"),
        F.count_if(F.col("is_active")).alias("active_students"),
        round_half_up(F.coalesce(F.avg("gpa"), F.lit(0.0)), 2).alias("average_gpa"))


# --- A7-A9: course analytics -------------------------------------------------

def course_rollup(courses: DataFrame, enrollments: DataFrame, department: str | None = None) -> DataFrame:
    """Per course totals, completion rate (1 decimal, 0 if none) and
    mean grade point (2 decimals, NULL when no known grade).

    One join of the catalog to the per-course aggregate replaces the
    reference's query-per-course loop.
    """
    per_course = course_enrollment_counts(enrollments)
    c = courses.select("course_id", "course_name",
                       null_label("department", fixed.UNKNOWN_LABEL).alias("department"), "credits")
    if department is not None:
        c = c.filter(F.col("department") == department)
    j = c.join(per_course, "course_id", "left")
    total = F.coalesce(F.col("total_enrollments"), F.lit(0)).cast("long")
    return j.select(
        "course_id", "course_name", "department", "credits",
        total.alias("total_enrollments"),
        F.coalesce(F.col("completed"), F.lit(0)).cast("long").alias("completed"),
        F.coalesce(F.col("dropped"), F.lit(0)).cast("long").alias("dropped"),
        round_half_up(percent(F.col("completed"), total), 1).alias("completion_rate"),
        round_half_up(F.try_divide(F.col("grade_tenths").cast("double"), F.col("graded") * F.lit(10)), 2)
        .alias("average_grade_point"),
    )


def course_summary(courses: DataFrame, rollup: DataFrame) -> DataFrame:
    """Total courses, mean credits (1 decimal), mean enrollments per course (1 decimal)."""
    c = courses.agg(F.count(F.lit(1)).alias("total_courses"),
                    F.coalesce(F.avg("credits"), F.lit(0.0)).alias("_avg_credits"))
    r = rollup.agg(F.sum("total_enrollments").alias("_enrolled"))
    return (c.crossJoin(_one_row(r))
            .select("total_courses",
                    round_half_up("_avg_credits", 1).alias("average_credits"),
                    round_half_up(safe_div("_enrolled", "total_courses"), 1).alias("average_enrollment")))


def courses_by_department(courses: DataFrame) -> DataFrame:
    """Courses per department, NULL labelled 'Unknown'."""
    return (courses.select(null_label("department", fixed.UNKNOWN_LABEL).alias("department"))
            .groupBy("department").agg(F.count(F.lit(1)).alias("count")))


def courses_by_semester(courses: DataFrame) -> DataFrame:
    """Courses per semester, NULL labelled 'Unknown'."""
    return (courses.select(null_label("semester", fixed.UNKNOWN_LABEL).alias("semester"))
            .groupBy("semester").agg(F.count(F.lit(1)).alias("count")))


# --- A12-A16: notebook and dashboard aggregates ------------------------------

def top_courses_by_count(courses: DataFrame, enrollments: DataFrame, n: int = 10) -> DataFrame:
    """Courses INNER JOIN enrollments, non-null student ids per
    course, top n by count (ties by course id).  The count is taken on the
    fact first, so the join sees one row per course."""
    per_course = (enrollments.filter(F.col("student_id").isNotNull())
                  .groupBy("course_id").agg(F.count("student_id").alias("enrollment_count")))
    j = per_course.join(courses.select("course_id", "course_name", "department"), "course_id", "inner")
    return j.orderBy(F.desc("enrollment_count"), F.asc("course_id")).limit(n)


def at_risk_by_major(students: DataFrame, gpa_threshold: float = fixed.DEFAULT_GPA_THRESHOLD) -> DataFrame:
    """At-risk students (gpa < t) per major; NULL majors dropped."""
    return (students.filter((F.col("gpa") < F.lit(gpa_threshold)) & F.col("major").isNotNull())
            .groupBy("major").agg(F.count(F.lit(1)).alias("count")))


def kpi_row(students: DataFrame, gpa_threshold: float = fixed.DEFAULT_GPA_THRESHOLD) -> DataFrame:
    """Total, active, mean gpa, at-risk count and retention rate in one pass."""
    total = F.count(F.lit(1))
    active = F.count_if(F.col("is_active"))
    return students.agg(
        total.alias("total_students"),
        active.alias("active_students"),
        F.coalesce(F.avg("gpa"), F.lit(0.0)).alias("average_gpa"),
        F.count_if(F.col("gpa") < F.lit(gpa_threshold)).alias("at_risk_count"),
        percent(active, total).alias("retention_rate"),
    )


def major_share(students: DataFrame) -> DataFrame:
    """Share of students by major (NULL labelled 'Undeclared'), in percent."""
    counts = student_analytics_major(students)
    total = counts.agg(F.sum("count").alias("_total"))
    return (counts.crossJoin(_one_row(total))
            .select("major", "count", percent("count", "_total").alias("share_pct")))


def gpa_histogram(students: DataFrame, bins: int = fixed.GPA_HISTOGRAM_BINS,
                  lo: float = fixed.GPA_RANGE[0], hi: float = fixed.GPA_RANGE[1]) -> DataFrame:
    """Fixed-width gpa histogram of active students; empty bins are 0."""
    spark = students.sparkSession
    width = (hi - lo) / bins
    b = F.least(F.greatest(F.floor((F.col("gpa") - F.lit(lo)) / F.lit(width)), F.lit(0)),
                F.lit(bins - 1)).cast("int")
    counts = (students.filter(F.col("is_active") & F.col("gpa").isNotNull())
              .select(b.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("count")))
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (F.broadcast(grid).join(counts, "bin", "left")
            .select("bin",
                    (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_lo"),
                    (F.lit(lo) + (F.col("bin") + F.lit(1)) * F.lit(width)).alias("bin_hi"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count")))


# --- A17-A20: second-level dashboard aggregates ------------------------------

def _mean_of_rounded(c: str, digits: int):
    """Mean of values already rounded to ``digits`` decimals, summed as
    integers (exact in any order) and divided once; NULL when no value."""
    scale = 10 ** digits
    units = F.round(F.col(c) * F.lit(scale)).cast("long")
    return F.try_divide(F.sum(units).cast("double"), (F.count(units) * F.lit(scale)).cast("double"))


def course_metrics(rollup: DataFrame, department: str | None = None) -> DataFrame:
    """Over the course roll-up (optionally one department): course count,
    mean completion rate, mean of non-null grade points (0 if none), total
    enrollments.  The rates are rounded to 0.1 and the grade points to 0.01
    in the roll-up, so their means are taken over integer tenths and
    hundredths: exact whatever the summation order."""
    r = rollup if department is None else rollup.filter(F.col("department") == department)
    return r.agg(F.count(F.lit(1)).alias("total_courses"),
                 _mean_of_rounded("completion_rate", 1).alias("avg_completion_rate"),
                 F.coalesce(_mean_of_rounded("average_grade_point", 2), F.lit(0.0)).alias("avg_grade_point"),
                 F.coalesce(F.sum("total_enrollments"), F.lit(0)).cast("long").alias("total_enrollments"))


def dept_completion(rollup: DataFrame) -> DataFrame:
    """Per department, unweighted mean of course completion rates and
    total enrollments."""
    return (rollup.groupBy("department")
            .agg(_mean_of_rounded("completion_rate", 1).alias("completion_rate"),
                 F.sum("total_enrollments").cast("long").alias("total_enrollments")))


def gpa_median_mean(students: DataFrame, exact: bool = True) -> DataFrame:
    """Median and mean gpa of active students with a gpa.

    ``exact=True`` uses the distributed exact median (no group is collected);
    ``exact=False`` uses ``percentile_approx`` (one pass, bounded memory).
    """
    from ..functions.stats import exact_median
    vals = students.filter(F.col("is_active") & F.col("gpa").isNotNull()).select("gpa")
    mean = vals.agg(F.avg("gpa").alias("mean_gpa"), F.count(F.lit(1)).alias("n_students"))
    if exact:
        med = exact_median(vals, "gpa").withColumnRenamed("median", "median_gpa")
    else:
        med = vals.agg(F.percentile_approx("gpa", 0.5, 10000).alias("median_gpa"))
    return mean.crossJoin(_one_row(med)).select("median_gpa", "mean_gpa", "n_students")


# Rank error of the sketches' default size, as a share of the rows (about 1.3 % at 99 % confidence,
# with room for a merge).
SKETCH_RANK_ERROR = 0.027


def gpa_sketches(students: DataFrame, by: list[str]) -> DataFrame:
    """A19 upkeep: a mergeable quantile sketch of the gpa of active students for each ``by`` group, of bounded
    size whatever the rows."""
    vals = students.filter(F.col("is_active") & F.col("gpa").isNotNull())
    return vals.groupBy(*by).agg(F.kll_sketch_agg_double("gpa").alias("sketch"), F.count(F.lit(1)).alias("n_students"))


def sketched_medians(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Medians of coarser groups from stored sketches, without reading the students again."""
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("s"), F.sum("n_students").alias("n_students"))
    return merged.select(*by, "n_students", F.kll_sketch_get_quantile_double("s", F.lit(0.5)).alias("median_gpa"))


def insights(students: DataFrame, gpa_threshold: float = fixed.DEFAULT_GPA_THRESHOLD) -> DataFrame:
    """Percent of active students at risk and the major with the most
    at-risk active students (ties go to the smallest major name).

    The mode is one aggregation: the minimum of (-count, major) over the
    per-major counts, so no sort and no group is collected.
    """
    active = students.filter(F.col("is_active"))
    k = active.agg(F.count(F.lit(1)).alias("active_students"),
                   F.count_if(F.col("gpa") < F.lit(gpa_threshold)).alias("at_risk_count"))
    best = (at_risk_by_major(active, gpa_threshold)
            .agg(F.min(F.struct((-F.col("count")).alias("neg_count"), F.col("major").alias("major")))
                 .alias("_m")))
    return (k.crossJoin(_one_row(best))
            .select("active_students", "at_risk_count",
                    percent("at_risk_count", "active_students").alias("at_risk_pct"),
                    F.col("_m.major").alias("top_risk_major"),
                    (-F.col("_m.neg_count")).alias("top_risk_count")))


# --- J7: navigation ----------------------------------------------------------

def enrollment_navigation(students: DataFrame, enrollments: DataFrame, courses: DataFrame,
                          salts: int | None = None) -> DataFrame:
    """Student -> enrollments -> course navigation as one flat equi-join.

    The reference navigates lazily object by object; the distributed form is
    the joined table (grouping it into per-student lists would put a hot
    student's whole history into one task).  Both joins are fact-to-dimension
    joins; ``salts`` > 1 salts them against hot students / courses."""
    s = students.select("student_id", "first_name", "last_name", "major")
    c = courses.select("course_id", "course_name", "department", "credits")
    e = enrollments.select("enrollment_id", "student_id", "course_id", "status", "grade")
    return dimension_join(dimension_join(e, s, "student_id", "inner", salts), c, "course_id", "inner", salts)
