"""Per-member feature table with a success label.

The table is built fact-first: the activity fact is aggregated per member
(partial + final hash aggregation, so a hot member collapses map-side before
the shuffle), and only the one-row-per-member result is joined to the
member dimension.  Catalog attributes needed per activity row (credits) are
joined before the aggregation; Spark broadcasts the catalog when its
estimated size is under ``spark.sql.autoBroadcastJoinThreshold`` and falls
back to a sort-merge join (AQE splits skewed partitions) otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions.joins import dimension_join
from ..functions.expr import (clean_number, flag, nan_to_null, null_label, null_zero,
                              percent, sample_std)

DEFAULT_AS_OF = "2025-01-01 12:00:00"
MAX_CLASSES = 10_000     # bound of a categorical column; more values are an error

BASE_KEYS = ["student_id", "gpa", "year_level", "major", "is_active", "enrollment_date"]

COUNT_COLUMNS = [
    "total_enrollments", "completed_courses", "dropped_courses", "current_enrollments",
    "excellent_grades", "good_grades", "average_grades", "poor_grades",
]


def _as_of(as_of: str) -> Column:
    return F.expr(f"TIMESTAMP_NTZ'{as_of}'")


def days_since(ts, as_of: str) -> Column:
    """Fractional days from ``ts`` to ``as_of`` (microsecond precision)."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", ts, _as_of(as_of)) / F.lit(8.64e10)


def activity_counts(status_col: str = "status", grade_col: str = "grade",
                    id_col: str = "enrollment_id") -> list[Column]:
    """The eight per-member counters: total, by status, by grade band."""
    s, g = F.col(status_col), F.col(grade_col)
    bands = fixed.GRADE_BANDS
    return [
        F.count(id_col).alias("total_enrollments"),
        F.count_if(s == "Completed").alias("completed_courses"),
        F.count_if(s == "Dropped").alias("dropped_courses"),
        F.count_if(s == "Enrolled").alias("current_enrollments"),
        F.count_if(g.isin(bands["excellent"])).alias("excellent_grades"),
        F.count_if(g.isin(bands["good"])).alias("good_grades"),
        F.count_if(g.isin(bands["average"])).alias("average_grades"),
        F.count_if(g.isin(bands["poor"])).alias("poor_grades"),
    ]


def student_features_base(students: DataFrame, enrollments: DataFrame, courses: DataFrame,
                          as_of: str = DEFAULT_AS_OF, active_only: bool = True,
                          salts: int | None = None, with_activity: bool = True) -> DataFrame:
    """A10: one row per (active) student with at least one enrollment.

    Same result as ``students LEFT JOIN enrollments LEFT JOIN courses ...
    GROUP BY student HAVING COUNT(enrollment_id) > 0``: the HAVING removes
    the unmatched students, so the member join is an inner join.  With
    ``with_activity=False`` students without enrollments stay, with counts of 0.
    ``salts`` > 1 salts the fact-to-catalog join (see ``functions.joins``).
    """
    credits = courses.select("course_id", "credits")
    facts = enrollments.select("student_id", "course_id", "enrollment_id", "status", "grade")
    per_student = (
        dimension_join(facts, credits, "course_id", "left", salts)
        .groupBy("student_id")
        .agg(*activity_counts(),
             F.avg("credits").alias("avg_course_credits"),
             F.sum("credits").alias("total_credits_attempted"))
        .filter(F.col("total_enrollments") > 0)
    )
    members = students.select(*BASE_KEYS)
    if active_only:
        members = members.filter(F.col("is_active"))
    if with_activity:
        joined = members.join(per_student, "student_id", "inner")
    else:
        joined = members.join(per_student, "student_id", "left").withColumns(
            {c: null_zero(c).cast("long") for c in COUNT_COLUMNS})
    return joined.withColumn("days_enrolled", days_since("enrollment_date", as_of))


def add_target(df: DataFrame, min_gpa: float = fixed.SUCCESS_MIN_GPA,
               min_completion: float = fixed.SUCCESS_MIN_COMPLETION) -> DataFrame:
    """completion_rate and the 0/1 success label (null-safe)."""
    df = df.withColumn("gpa", nan_to_null("gpa"))
    df = df.withColumn("completion_rate", percent("completed_courses", "total_enrollments"))
    return df.withColumn("is_successful", flag(
        (F.col("gpa") >= F.lit(min_gpa)) & (F.col("completion_rate") >= F.lit(min_completion))))


def engineer_features(df: DataFrame) -> DataFrame:
    """Rates, load, indicators, diversity, engagement, final fill.

    Predicates read the raw values (a NULL gpa never passes a comparison);
    the fill to 0 happens last, as in the reference.
    """
    total = "total_enrollments"
    w_total, w_completion, w_drop = fixed.ENGAGEMENT_WEIGHTS
    df = df.withColumn("gpa", nan_to_null("gpa"))
    df = df.withColumns({
        "drop_rate": percent("dropped_courses", total),
        "excellence_rate": percent("excellent_grades", total),
        "good_grade_rate": percent("good_grades", total),
        "struggle_rate": percent("poor_grades", total),
        "semesters_enrolled": F.col("days_enrolled") / F.lit(fixed.DAYS_PER_SEMESTER),
    })
    df = df.withColumns({
        "courses_per_semester": F.col(total) / (F.col("semesters_enrolled") + F.lit(1)),
        "credits_per_semester": F.col("total_credits_attempted") / (F.col("semesters_enrolled") + F.lit(1)),
        "high_performer": flag((F.col("gpa") >= F.lit(fixed.HIGH_PERFORMER_MIN_GPA))
                               & (F.col("excellence_rate") >= F.lit(fixed.HIGH_PERFORMER_MIN_EXCELLENCE))),
        "at_risk": flag((F.col("gpa") < F.lit(fixed.AT_RISK_MAX_GPA))
                        | (F.col("drop_rate") > F.lit(fixed.AT_RISK_MIN_DROP_RATE))),
        "grade_diversity": sample_std("excellent_grades", "good_grades", "average_grades", "poor_grades"),
        "engagement_score": (F.col(total) / F.lit(10) * F.lit(w_total)
                             + F.col("completion_rate") / F.lit(100) * F.lit(w_completion)
                             + (F.lit(100) - F.col("drop_rate")) / F.lit(100) * F.lit(w_drop)),
    })
    return fill_numbers(df)


def fill_numbers(df: DataFrame) -> DataFrame:
    """NULL / NaN / +-inf -> 0 on numeric columns; NULL major -> 'Undeclared'."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out[f.name] = clean_number(f.name).cast(f.dataType)
        elif isinstance(f.dataType, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
            out[f.name] = null_zero(f.name).cast(f.dataType)
        elif f.name == "major":
            out[f.name] = null_label("major", fixed.UNDECLARED_MAJOR)
    return df.withColumns(out)


def class_map(df: DataFrame, col: str = "major") -> DataFrame:
    """One row, ``classes``: the sorted distinct values of a categorical column -> 0..k-1.

    At most ``MAX_CLASSES`` values reach the one row (checked before they are
    gathered); a column with more is an error when the result is read.
    """
    few = df.select(col).filter(F.col(col).isNotNull()).distinct().limit(MAX_CLASSES + 1)
    values = F.sort_array(F.collect_list(col))
    error = F.raise_error(F.lit(f"{col} has more than {MAX_CLASSES} values")).cast("array<string>")
    one = few.agg(values.alias("v")).select(F.when(F.size("v") > MAX_CLASSES, error).otherwise(F.col("v")).alias("v"))
    codes = F.transform("v", lambda x, i: F.struct(x, i))
    return one.select(F.map_from_entries(codes).alias("classes"))


def as_class_map(classes: DataFrame, col: str = "major") -> DataFrame:
    """The one-row form of a fitted class table (col, col_encoded)."""
    return classes.limit(MAX_CLASSES).agg(
        F.map_from_entries(F.collect_list(F.struct(col, F.col(f"{col}_encoded").cast("int")))).alias("classes"))


def major_classes(df: DataFrame, col: str = "major") -> DataFrame:
    """The fitted class table: (col, col_encoded)."""
    return class_map(df, col).select(F.explode("classes").alias(col, f"{col}_encoded"))


def encode_major(df: DataFrame, col: str = "major", classes: DataFrame | None = None) -> DataFrame:
    """Major -> integer code by ascending class order.

    ``classes`` is a fitted class table; without one the classes are those of
    ``df``.  They reach the rows as one broadcast row of bounded size, so the rows
    themselves are never shuffled.  A value outside the classes gets NULL.
    """
    one = class_map(df, col) if classes is None else as_class_map(classes, col)
    return (df.crossJoin(F.broadcast(one.withColumnRenamed("classes", "_classes")))
            .withColumn(f"{col}_encoded", F.try_element_at("_classes", F.col(col))).drop("_classes"))


def engineered_table(students: DataFrame, enrollments: DataFrame, courses: DataFrame,
                     as_of: str = DEFAULT_AS_OF, salts: int | None = None, everyone: bool = False) -> DataFrame:
    """Load -> target -> features, not encoded: a lazy plan, so a report that reads
    three columns scans three.  ``everyone`` keeps inactive students and those
    without enrollments."""
    base = student_features_base(students, enrollments, courses, as_of, active_only=not everyone, salts=salts,
                                 with_activity=not everyone)
    return engineer_features(add_target(base))


def feature_table(students: DataFrame, enrollments: DataFrame, courses: DataFrame,
                  as_of: str = DEFAULT_AS_OF, salts: int | None = None) -> DataFrame:
    """Load -> target -> features -> encode, as one lazy plan.

    The class table is fitted from the narrow (student, major) projection of the
    same plan; ``train_job`` checkpoints the result, single reports don't.
    """
    return encode_major(engineered_table(students, enrollments, courses, as_of, salts))


def feature_columns(df: DataFrame, features=None, exclude=()) -> list[str]:
    """The ordered feature list, restricted to columns present in ``df``."""
    wanted = list(features or fixed.FEATURE_COLUMNS)
    present = set(df.columns)
    missing = [c for c in wanted if c not in present]
    if missing:
        import warnings
        warnings.warn(f"Missing features left out: {missing}", stacklevel=2)
    return [c for c in wanted if c in present and c not in set(exclude)]


def feature_matrix(df: DataFrame, features=None, label: str = "is_successful",
                   key: str = "student_id", exclude=()) -> DataFrame:
    """Key, the features in list order (as double) and the label."""
    cols = feature_columns(df, features, exclude)
    return df.select(key, *[F.col(c).cast("double").alias(c) for c in cols], F.col(label))


def feature_dictionary(spark: SparkSession) -> DataFrame:
    """X11: feature name, position, description and category (a fixed small table)."""
    category = {f: cat for cat, fs in fixed.FEATURE_CATEGORIES.items() for f in fs}
    rows = [(i, name, fixed.FEATURE_DESCRIPTIONS.get(name, "No description"), category.get(name))
            for i, name in enumerate(fixed.FEATURE_COLUMNS)]
    return spark.createDataFrame(
        rows, "position int, feature string, description string, category string")


def feature_profile(spark: SparkSession, df: DataFrame) -> DataFrame:
    """X11 over data: the dictionary rows of the features present in ``df``
    with how many rows hold a value and how many a non-zero value (one
    aggregation pass over the table, then an unpivot of one row)."""
    cols = feature_columns(df)
    aggs = []
    for c in cols:
        aggs += [F.count(c).alias(f"{c}__nn"), F.count_if(F.col(c) != 0).alias(f"{c}__nz")]
    wide = df.agg(*aggs)
    long = wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"{c}__nn").alias("non_null_rows"),
                 F.col(f"{c}__nz").alias("non_zero_rows")) for c in cols])).alias("s")).select("s.*")
    return feature_dictionary(spark).join(F.broadcast(long), "feature", "inner")


def with_feature_comments(df: DataFrame) -> DataFrame:
    """Attach each feature's description as column metadata."""
    return df.withColumns({
        c: F.col(c).alias(c, metadata={"comment": fixed.FEATURE_DESCRIPTIONS[c]})
        for c in df.columns if c in fixed.FEATURE_DESCRIPTIONS
    })


def target_summary(df: DataFrame, label: str = "is_successful") -> DataFrame:
    """Success rate, successes and failures."""
    y = F.col(label)
    return df.agg(F.avg(y).alias("success_rate"),
                  F.sum(y).cast("long").alias("successes"),
                  (F.count(y) - F.sum(y)).cast("long").alias("failures"))


def serving_features(students: DataFrame, enrollments: DataFrame,
                     keys: DataFrame | None = None) -> DataFrame:
    """The serving-side counters and rates for stored students.

    Every stored student gets a row (no active / HAVING filter); missing
    counts are 0, a NULL gpa is 0.0, a NULL year is 1.  A total of 0 stays 0
    and its rates are 0.  ``keys`` (a frame of student ids) restricts the
    students through a semi-join.
    """
    members = students.select("student_id", "gpa", "year_level")
    facts = enrollments.select("student_id", "enrollment_id", "status", "grade")
    if keys is not None:
        members = members.join(keys.select("student_id"), "student_id", "left_semi")
        facts = facts.join(keys.select("student_id"), "student_id", "left_semi")
    counts = facts.groupBy("student_id").agg(*activity_counts())
    out = members.join(counts, "student_id", "left")
    out = out.select(
        "student_id",
        F.coalesce(nan_to_null("gpa"), F.lit(0.0)).alias("gpa"),
        F.coalesce(F.col("year_level"), F.lit(1)).alias("year_level"),
        *[null_zero(c).cast("long").alias(c) for c in COUNT_COLUMNS],
    )
    return out.withColumns({
        "completion_rate": percent("completed_courses", "total_enrollments"),
        "drop_rate": percent("dropped_courses", "total_enrollments"),
        "excellence_rate": percent("excellent_grades", "total_enrollments"),
        "struggle_rate": percent("poor_grades", "total_enrollments"),
    })


__all__ = [
    "DEFAULT_AS_OF", "activity_counts", "student_features_base", "add_target",
    "engineer_features", "fill_numbers", "major_classes", "encode_major", "class_map",
    "engineered_table", "feature_table", "feature_columns", "feature_matrix", "feature_dictionary",
    "with_feature_comments", "target_summary", "serving_features", "days_since",
]
