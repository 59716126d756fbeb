"""Browsing: optional filters, lookups, pages and sorts.

A page is ``orderBy(key).offset(skip).limit(n)``: an ordering is always
added (the reference pages without one, so its pages are not stable).
Spark plans it as a per-partition top-(skip+n) followed by a merge, so the
cost is bounded by the page depth, not the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed
from ..functions.joins import salted_semi_join

STUDENT_COLUMNS = ["student_id", "first_name", "last_name", "email", "major", "year_level",
                   "gpa", "is_active", "enrollment_date"]
COURSE_COLUMNS = ["course_id", "course_name", "department", "credits", "course_type",
                  "semester", "year"]
ENROLLMENT_COLUMNS = ["enrollment_id", "student_id", "course_id", "enrollment_date",
                      "grade", "status"]


def _conjunction(preds: list[Column]) -> Column | None:
    out = None
    for p in preds:
        out = p if out is None else out & p
    return out


def apply_filters(df: DataFrame, equals: dict | None = None, at_least: dict | None = None) -> DataFrame:
    """Chained optional filters: ``None`` means "no filter" (an empty string
    is a real value here, unlike the reference's truthiness test)."""
    preds = [F.col(c) == F.lit(v) for c, v in (equals or {}).items() if v is not None]
    preds += [F.col(c) >= F.lit(v) for c, v in (at_least or {}).items() if v is not None]
    cond = _conjunction(preds)
    return df if cond is None else df.filter(cond)


def page(df: DataFrame, order: list, skip: int = 0, limit: int = 10) -> DataFrame:
    """O1: a stable page: total order, then offset and limit."""
    out = df.orderBy(*order)
    if skip:
        out = out.offset(skip)
    return out.limit(limit)


def students_filtered(students: DataFrame, major: str | None = None, year_level: int | None = None,
                      min_gpa: float | None = None, skip: int = 0, limit: int = 10) -> DataFrame:
    """students by optional major, year and minimum gpa; one page by id."""
    df = apply_filters(students.select(*STUDENT_COLUMNS),
                       equals={"major": major, "year_level": year_level},
                       at_least={"gpa": min_gpa})
    return page(df, ["student_id"], skip, limit)


def courses_filtered(courses: DataFrame, department: str | None = None, semester: str | None = None,
                     skip: int = 0, limit: int = 10) -> DataFrame:
    """courses by optional department and semester; one page by id."""
    df = apply_filters(courses.select(*COURSE_COLUMNS),
                       equals={"department": department, "semester": semester})
    return page(df, ["course_id"], skip, limit)


def enrollments_filtered(enrollments: DataFrame, status: str | None = None,
                         skip: int = 0, limit: int = 10) -> DataFrame:
    """enrollments by optional status; one page.  ``enrollment_id`` may
    repeat, so the page order uses every column (a total order)."""
    df = apply_filters(enrollments.select(*ENROLLMENT_COLUMNS), equals={"status": status})
    order = [F.asc_nulls_first(c) for c in ENROLLMENT_COLUMNS]
    return page(df, order, skip, limit)


def lookup_keys(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """F4 batch form: each requested key with its row, ``found`` false when
    absent (the reference answers 404).  Keys are de-duplicated first."""
    k = keys.select(F.col(key)).distinct()
    t = table.withColumn("_found", F.lit(True))
    return (k.join(t, key, "left")
            .withColumn("found", F.coalesce(F.col("_found"), F.lit(False))).drop("_found"))


def get_by_key(table: DataFrame, key: str, value) -> DataFrame:
    """F4 single-key form: the row(s) with ``key == value``; an absent key is
    an error (the reference answers 404).  The filter reaches the scan."""
    rows = table.filter(F.col(key) == F.lit(value))
    if rows.isEmpty():
        raise KeyError(f"{key} {value!r} not found")
    return rows


def enrollments_of(students: DataFrame, enrollments: DataFrame, student_id) -> DataFrame:
    """F5 single-key form: enrollments of one student, an error if the student
    does not exist."""
    get_by_key(students.select("student_id"), "student_id", student_id)
    return enrollments.select(*ENROLLMENT_COLUMNS).filter(F.col("student_id") == F.lit(student_id))


def student_enrollments(students: DataFrame, enrollments: DataFrame, keys: DataFrame, salts: int = 8) -> DataFrame:
    """Enrollments of the requested students that exist (semi-joins).

    A student with very many enrollments is dealt over ``salts`` tasks."""
    existing = keys.select("student_id").join(students.select("student_id"), "student_id", "left_semi")
    return salted_semi_join(enrollments.select(*ENROLLMENT_COLUMNS), existing, "student_id", salts).select(*ENROLLMENT_COLUMNS)


def at_risk(students: DataFrame, gpa_threshold: float = fixed.DEFAULT_GPA_THRESHOLD) -> DataFrame:
    """Students with gpa < t: id, full name, gpa, major, year; by gpa."""
    return (students.filter(F.col("gpa") < F.lit(gpa_threshold))
            .select("student_id",
                    F.concat_ws(" ", "first_name", "last_name").alias("name"),
                    "gpa", "major", "year_level")
            .orderBy("gpa", "student_id"))


def at_risk_active(students: DataFrame, gpa_threshold: float = fixed.DEFAULT_GPA_THRESHOLD) -> DataFrame:
    """Active students below the threshold, projected and sorted."""
    return (students.filter((F.col("gpa") < F.lit(gpa_threshold)) & F.col("is_active"))
            .select("student_id", "first_name", "last_name", "major", "gpa", "is_active")
            .orderBy("gpa", "student_id"))


AT_RISK_ACTIVE_SQL = """
SELECT student_id, first_name, last_name, major, gpa, is_active
FROM {students}
WHERE gpa < {threshold} AND is_active
ORDER BY gpa, student_id
"""


def sql_at_risk_active(spark, students: DataFrame,
                       gpa_threshold: float = fixed.DEFAULT_GPA_THRESHOLD) -> DataFrame:
    """The same query as SQL text over a temp view (Catalyst plans both
    forms identically)."""
    name = "cohortkit_students_v"
    students.createOrReplaceTempView(name)
    return spark.sql(AT_RISK_ACTIVE_SQL.format(students=name, threshold=float(gpa_threshold)))


def run_sql(spark, text: str, tables: dict[str, DataFrame], params: dict | None = None) -> DataFrame:
    """The caller's SQL text over frames, named in it as ``{table}``, with its values as named parameters
    (``:name``; a list becomes an array).  Values never become part of the text."""
    values = {k: F.array(*[F.lit(x) for x in v]) if isinstance(v, (list, tuple)) else v for k, v in (params or {}).items()}
    return spark.sql(text, args=values, **tables)


def ranked(df: DataFrame, order: list, n: int | None) -> DataFrame:
    """The rows by ``order`` with their place, from 1, as ``position``: the first ``n`` of a table, or all rows of
    a roll-up (``n`` None), which has as many rows as groups.

    The limit comes first (a bounded top-n), so the numbering of a table sees n rows."""
    top = df if n is None else df.orderBy(*order).limit(n)
    return top.withColumn("position", F.row_number().over(Window.orderBy(*order)))


SORTABLE = ("total_enrollments", "completion_rate", "average_grade_point", "course_name")


def top_n(df: DataFrame, by: str, n: int = 10, tie: str = "course_id") -> DataFrame:
    """The n largest rows by ``by`` (ties by ``tie``): a bounded top-k."""
    return df.orderBy(F.desc_nulls_last(by), F.asc(tie)).limit(n)


def sort_table(df: DataFrame, by: str, ascending: bool = False, allowed=SORTABLE,
               tie: str = "course_id") -> DataFrame:
    """Caller-chosen sort column from an allow-list; NULLs last both ways."""
    if by not in allowed:
        raise ValueError(f"cannot sort by {by!r}; allowed: {list(allowed)}")
    key = F.asc_nulls_last(by) if ascending else F.desc_nulls_last(by)
    return df.orderBy(key, F.asc(tie))
