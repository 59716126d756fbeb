"""DuckDB SQL oracles: an independent statement of each registered query.

Every statement starts from the same role views as ``sources/roles.py``,
written in SQL over the driver's tables (pre-registered as views).
"""

from __future__ import annotations

from ..functions import fixed
from ..operators.features import DEFAULT_AS_OF
from ..sources import roles as R


def _grade_case(col: str) -> str:
    arms = " ".join(f"when {i} then '{g}'" for i, g in enumerate(fixed.GRADES))
    return f"case {col} {arms} end"


ROLES = f"""
students as (
  select c_custkey as student_id, c_name as first_name, 'X' as last_name,
         concat(lower(c_name), '{R.EMAIL_DOMAIN}') as email,
         case when c_custkey % {R.NULL_MAJOR_MOD} <> {R.NULL_MAJOR_REM} then c_mktsegment end as major,
         case when c_custkey % {R.NULL_YEAR_MOD} <> {R.NULL_YEAR_REM}
              then cast(c_nationkey % 4 + 1 as integer) end as year_level,
         case when c_custkey % {R.NULL_GPA_MOD} <> {R.NULL_GPA_REM}
              then (c_acctbal + cast(1000 as double)) / cast(2750 as double) end as gpa,
         timestamp '{R.BASE_DATE}' + (c_custkey % {R.DATE_SPREAD_DAYS}) * interval '1' day as enrollment_date,
         c_custkey % 4 <> 3 as is_active
  from customer),
courses as (
  select p_partkey as course_id, p_name as course_name,
         case when p_partkey % {R.NULL_DEPT_MOD} <> {R.NULL_DEPT_REM} then p_brand end as department,
         cast(p_size % 4 + 1 as integer) as credits, p_type as course_type,
         cast(p_size + 15 as integer) as max_enrollment,
         case p_size % 3 when 0 then 'Fall' when 1 then 'Spring' else 'Summer' end as semester,
         cast(p_size % 3 + 2023 as integer) as year
  from part),
enrollments as (
  select concat('ENR', cast(l_orderkey as varchar), '-', cast(l_linenumber as varchar)) as enrollment_id,
         o_custkey as student_id, l_partkey as course_id, o_orderdate as enrollment_date,
         {_grade_case(f"(l_partkey + l_linenumber + o_custkey) % {R.GRADE_CYCLE}")} as grade,
         case when (l_partkey * 7 + l_linenumber * 13) % 100
                   < o_custkey % {R.COMPLETION_SPREAD} + {R.COMPLETION_BASE} then 'Completed'
              when l_returnflag = 'R' then 'Dropped'
              when l_returnflag = 'A' then 'Enrolled' else 'Withdrawn' end as status
  from lineitem join orders on l_orderkey = o_orderkey)
"""


def with_roles(*ctes: str, body: str) -> str:
    """``WITH <roles>, <ctes...> <body>``."""
    parts = [ROLES.strip()] + [c.strip() for c in ctes]
    return "with " + ",\n".join(parts) + "\n" + body.strip()


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


B = fixed.GRADE_BANDS
AS_OF = DEFAULT_AS_OF

def _counters(p: str = "") -> str:
    """The eight per-student counters, over columns with prefix ``p``."""
    parts = [f"count({p}enrollment_id) as total_enrollments"]
    parts += [f"count(case when {p}status = '{status}' then 1 end) as {name}" for status, name in (
        ("Completed", "completed_courses"), ("Dropped", "dropped_courses"), ("Enrolled", "current_enrollments"))]
    parts += [f"count(case when {p}grade in {_in(grades)} then 1 end) as {band}_grades" for band, grades in B.items()]
    return ",\n         ".join(parts)


# A10: per-student base features (fact-first is an implementation choice;
# the SQL states the reference's LEFT JOIN / GROUP BY / HAVING form).
FEATURES_BASE = f"""
features_base as (
  select s.student_id, s.gpa, s.year_level, s.major, s.is_active, s.enrollment_date,
         {_counters('e.')},
         avg(c.credits) as avg_course_credits,
         cast(sum(c.credits) as bigint) as total_credits_attempted,
         date_diff('microsecond', s.enrollment_date, timestamp '{AS_OF}') / 8.64e10 as days_enrolled
  from students s
  left join enrollments e on s.student_id = e.student_id
  left join courses c on e.course_id = c.course_id
  where s.is_active
  group by s.student_id, s.gpa, s.year_level, s.major, s.is_active, s.enrollment_date
  having count(e.enrollment_id) > 0)
"""


def pct(num: str, den: str) -> str:
    return f"coalesce(cast({num} as double) / nullif({den}, 0), 0) * 100"


def flag(pred: str) -> str:
    return f"cast(coalesce({pred}, false) as integer)"


def clean(expr: str) -> str:
    return f"(case when isnan({expr}) or isinf({expr}) then 0 else coalesce({expr}, 0) end)"


W_T, W_C, W_D = fixed.ENGAGEMENT_WEIGHTS

FEATURES_TARGET = f"""
features_target as (
  select *, {pct('completed_courses', 'total_enrollments')} as completion_rate
  from features_base),
features_labeled as (
  select *, {flag(f'gpa >= {fixed.SUCCESS_MIN_GPA} and completion_rate >= {fixed.SUCCESS_MIN_COMPLETION}')} as is_successful
  from features_target)
"""

FEATURES_ENGINEERED = f"""
features_rates as (
  select *,
         {pct('dropped_courses', 'total_enrollments')} as drop_rate,
         {pct('excellent_grades', 'total_enrollments')} as excellence_rate,
         {pct('good_grades', 'total_enrollments')} as good_grade_rate,
         {pct('poor_grades', 'total_enrollments')} as struggle_rate,
         days_enrolled / cast(120 as double) as semesters_enrolled,
         (excellent_grades + good_grades + average_grades + poor_grades) / cast(4 as double) as band_mean
  from features_labeled),
features_raw as (
  select *,
         total_enrollments / (semesters_enrolled + 1) as courses_per_semester,
         total_credits_attempted / (semesters_enrolled + 1) as credits_per_semester,
         {flag(f'gpa >= {fixed.HIGH_PERFORMER_MIN_GPA} and excellence_rate >= {fixed.HIGH_PERFORMER_MIN_EXCELLENCE}')} as high_performer,
         {flag(f'gpa < {fixed.AT_RISK_MAX_GPA} or drop_rate > {fixed.AT_RISK_MIN_DROP_RATE}')} as at_risk,
         sqrt(((excellent_grades - band_mean) * (excellent_grades - band_mean)
             + (good_grades - band_mean) * (good_grades - band_mean)
             + (average_grades - band_mean) * (average_grades - band_mean)
             + (poor_grades - band_mean) * (poor_grades - band_mean)) / cast(3 as double)) as grade_diversity,
         total_enrollments / 10 * cast({W_T} as double)
           + completion_rate / 100 * cast({W_C} as double)
           + (100 - drop_rate) / 100 * cast({W_D} as double) as engagement_score
  from features_rates),
features as (
  select student_id, {clean('gpa')} as gpa, coalesce(year_level, 0) as year_level,
         coalesce(nullif(major, ''), '{fixed.UNDECLARED_MAJOR}') as major, is_active, enrollment_date,
         total_enrollments, completed_courses, dropped_courses, current_enrollments,
         excellent_grades, good_grades, average_grades, poor_grades,
         {clean('avg_course_credits')} as avg_course_credits,
         coalesce(total_credits_attempted, 0) as total_credits_attempted,
         {clean('days_enrolled')} as days_enrolled,
         {clean('completion_rate')} as completion_rate, is_successful,
         {clean('drop_rate')} as drop_rate, {clean('excellence_rate')} as excellence_rate,
         {clean('good_grade_rate')} as good_grade_rate, {clean('struggle_rate')} as struggle_rate,
         {clean('semesters_enrolled')} as semesters_enrolled,
         {clean('courses_per_semester')} as courses_per_semester,
         {clean('credits_per_semester')} as credits_per_semester,
         high_performer, at_risk,
         {clean('grade_diversity')} as grade_diversity,
         {clean('engagement_score')} as engagement_score
  from features_raw),
major_classes as (
  select major, cast(row_number() over (order by major) - 1 as integer) as major_encoded
  from (select distinct major from features)),
features_encoded as (
  select f.*, m.major_encoded from features f left join major_classes m on f.major = m.major)
"""

FEATURE_CTES = (FEATURES_BASE, FEATURES_TARGET, FEATURES_ENGINEERED)


REGISTRATIONS = f"""
registrations as (
  select c_custkey as student_id, c_name as first_name, 'X' as last_name,
         case when c_custkey % {R.NULL_EMAIL_MOD} <> {R.NULL_EMAIL_REM}
              then concat(lower(c_name), '{R.EMAIL_DOMAIN}') end as email, c_mktsegment as major,
         cast(c_nationkey % 6 as integer) as year_level, c_acctbal / cast(2500 as double) as gpa,
         true as is_active
  from customer)
"""


REQUESTS = """
requests as (
  select c_custkey as student_id, c_mktsegment as major,
         case when c_custkey % 31 <> 3 then c_acctbal / cast(2000 as double) end as gpa,
         cast(c_nationkey % 6 as integer) as year_level, c_custkey % 12 - 1 as total_enrollments,
         case when c_custkey % 37 <> 5 then (c_custkey % 12) // 2 end as completed_courses,
         (c_custkey % 12) // 4 as dropped_courses,
         case when c_custkey % 41 = 1 then -2 else c_custkey % 3 end as current_enrollments,
         (c_custkey % 27) * cast(4 as double) as completion_rate,
         case when c_custkey % 5 <> 0 then (c_custkey % 22) * cast(5 as double) end as drop_rate
  from customer)
"""


def rhu(expr: str, digits: int) -> str:
    """floor(x * 10^d + 0.5) / 10^d, the shared rounding rule."""
    scale = f"cast({10 ** digits} as double)"
    return f"(floor(({expr}) * {scale} + 0.5) / {scale})"


def mean_of_rounded(col: str, digits: int) -> str:
    """Mean of values rounded to ``digits`` decimals, over integer units."""
    scale = 10 ** digits
    units = f"cast(round({col} * {scale}) as bigint)"
    return f"(cast(sum({units}) as double) / nullif(cast(count({units}) * {scale} as double), 0))"


def _grade_points_case(col: str) -> str:
    arms = " ".join(f"when '{g}' then {int(round(p * 10))}" for g, p in fixed.GRADE_POINTS.items())
    return f"case {col} {arms} end"


PER_COURSE = f"""
per_course as (
  select course_id, count(enrollment_id) as total_enrollments,
         count(case when status = 'Completed' then 1 end) as completed,
         count(case when status = 'Dropped' then 1 end) as dropped,
         count(gp) as graded, sum(gp) as grade_tenths
  from (select *, {_grade_points_case('grade')} as gp from enrollments)
  group by course_id)
"""

COURSE_ROLLUP = f"""
course_rollup as (
  select c.course_id, c.course_name, coalesce(nullif(c.department, ''), '{fixed.UNKNOWN_LABEL}') as department,
         c.credits,
         coalesce(p.total_enrollments, 0) as total_enrollments,
         coalesce(p.completed, 0) as completed,
         coalesce(p.dropped, 0) as dropped,
         {rhu(pct('p.completed', 'coalesce(p.total_enrollments, 0)'), 1)} as completion_rate,
         {rhu('cast(p.grade_tenths as double) / nullif(p.graded * 10, 0)', 2)} as average_grade_point
  from courses c left join per_course p on c.course_id = p.course_id)
"""


# Serving-side counters for every stored student.
SERVING_CTES = (f"""
counts as (
  select student_id, {_counters()}
  from enrollments group by student_id)""", """
serving as (
  select s.student_id, coalesce(case when isnan(s.gpa) or isinf(s.gpa) then null else s.gpa end, 0.0) as gpa,
         coalesce(s.year_level, 1) as year_level,
         coalesce(c.total_enrollments, 0) as total_enrollments,
         coalesce(c.completed_courses, 0) as completed_courses,
         coalesce(c.dropped_courses, 0) as dropped_courses,
         coalesce(c.current_enrollments, 0) as current_enrollments,
         coalesce(c.excellent_grades, 0) as excellent_grades,
         coalesce(c.good_grades, 0) as good_grades,
         coalesce(c.average_grades, 0) as average_grades,
         coalesce(c.poor_grades, 0) as poor_grades
  from students s left join counts c on s.student_id = c.student_id)""", f"""
serving_rates as (
  select *, {pct('completed_courses', 'total_enrollments')} as completion_rate,
         {pct('dropped_courses', 'total_enrollments')} as drop_rate,
         {pct('excellent_grades', 'total_enrollments')} as excellence_rate,
         {pct('poor_grades', 'total_enrollments')} as struggle_rate
  from serving)""")
