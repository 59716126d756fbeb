"""Per-student activity as mergeable states (A10, A11): upkeep without reading the fact again.

A state holds only sums: the eight counters, the credits seen and their number.  A batch
of new enrollments has a state, rows that are taken back have the negative one, and states
add up.  So the stored states and a delta give the features of the whole fact; the delta
is read once, the fact never again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import null_zero
from ..functions.joins import dimension_join
from .features import BASE_KEYS, COUNT_COLUMNS, DEFAULT_AS_OF, activity_counts, days_since

SUMS = [*COUNT_COLUMNS, "credit_rows", "credit_sum"]


def activity_states(enrollments: DataFrame, courses: DataFrame, taken_back: bool = False) -> DataFrame:
    """One state a student of a batch of enrollments; of opposite sign if the rows are taken back."""
    facts = enrollments.select("student_id", "course_id", "enrollment_id", "status", "grade").filter(F.col("student_id").isNotNull())
    sums = dimension_join(facts, courses.select("course_id", "credits"), "course_id", "left", None).groupBy("student_id").agg(
        *activity_counts(), F.count("credits").alias("credit_rows"), F.coalesce(F.sum("credits"), F.lit(0)).alias("credit_sum"))
    sign = -1 if taken_back else 1
    return sums.select("student_id", *[(F.lit(sign) * F.col(c)).cast("long").alias(c) for c in SUMS])


def merged_states(*states: DataFrame) -> DataFrame:
    """The sum of states; students whose rows were all taken back leave."""
    both = states[0]
    for s in states[1:]:
        both = both.unionByName(s)
    return both.groupBy("student_id").agg(*[F.sum(c).alias(c) for c in SUMS]).filter(F.col("total_enrollments") > 0)


def features_of_states(students: DataFrame, states: DataFrame, as_of: str = DEFAULT_AS_OF, active_only: bool = True) -> DataFrame:
    """A10 from states: the columns of ``features.student_features_base``."""
    members = students.select(*BASE_KEYS)
    if active_only:
        members = members.filter(F.col("is_active"))
    credits = [F.try_divide("credit_sum", "credit_rows").alias("avg_course_credits"),
               F.when(F.col("credit_rows") > 0, F.col("credit_sum")).alias("total_credits_attempted")]
    joined = members.join(states.select("student_id", *COUNT_COLUMNS, *credits), "student_id", "inner")
    return joined.withColumn("days_enrolled", days_since("enrollment_date", as_of))


def serving_counts(students: DataFrame, states: DataFrame) -> DataFrame:
    """A11's counters from states, one row a stored student."""
    out = students.select("student_id").join(states, "student_id", "left")
    return out.select("student_id", *[null_zero(c).cast("long").alias(c) for c in COUNT_COLUMNS])
