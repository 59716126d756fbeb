"""Registered queries: each reads the driver tables through the role views.

Each entry is ``fn(spark, sf_dir) -> DataFrame`` paired with the SQL oracle
that states the same result in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.expr import null_label
from ..operators import browse as B
from ..operators import evaluation as E
from ..operators import scoring as S
from ..operators import training as M
from . import jobs as J
from ..operators import features as X
from ..operators import quality as Q
from ..operators import rollups as A
from ..sources import roles
from . import oracle as O
from .registry import register

FEATURE_CTES = O.FEATURE_CTES


def _views(spark: SparkSession, sf_dir: str):
    return roles.role_views(spark, sf_dir)


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c, e = _views(spark, sf_dir)
    return X.feature_table(s, e, c)


def engineered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table without the encoded major: reports on it scan only what they read."""
    s, c, e = _views(spark, sf_dir)
    return X.engineered_table(s, e, c)


# --- A10, X1-X10: the feature table ------------------------------------------

@register("student_features_base", O.with_roles(O.FEATURES_BASE, body="select * from features_base"))
def q_student_features_base(spark, sf_dir):
    s, c, e = _views(spark, sf_dir)
    return X.student_features_base(s, e, c)


@register("student_target", O.with_roles(O.FEATURES_BASE, O.FEATURES_TARGET, body="""
select student_id, total_enrollments, completed_courses, completion_rate, is_successful
from features_labeled"""))
def q_student_target(spark, sf_dir):
    s, c, e = _views(spark, sf_dir)
    return (X.add_target(X.student_features_base(s, e, c))
            .select("student_id", "total_enrollments", "completed_courses",
                    "completion_rate", "is_successful"))


@register("student_features", O.with_roles(*FEATURE_CTES, body="select * from features_encoded"))
def q_student_features(spark, sf_dir):
    return feature_table(spark, sf_dir)


# --- A11, A21, X8, X9 --------------------------------------------------------

@register("student_features_serving", O.with_roles(*O.SERVING_CTES, body="select * from serving_rates"))
def q_student_features_serving(spark, sf_dir):
    s, c, e = _views(spark, sf_dir)
    return X.serving_features(s, e)


@register("target_summary", O.with_roles(*FEATURE_CTES, body="""
select avg(is_successful) as success_rate, cast(sum(is_successful) as bigint) as successes,
       cast(count(is_successful) - sum(is_successful) as bigint) as failures
from features_encoded"""))
def q_target_summary(spark, sf_dir):
    return X.target_summary(engineered(spark, sf_dir))


@register("major_encoded", O.with_roles(*FEATURE_CTES, body="""
select student_id, major, major_encoded from features_encoded"""))
def q_major_encoded(spark, sf_dir):
    return feature_table(spark, sf_dir).select("student_id", "major", "major_encoded")


def _matrix_sql() -> str:
    from ..functions.fixed import FEATURE_COLUMNS
    cols = ", ".join(f"cast({c} as double) as {c}" for c in FEATURE_COLUMNS)
    return O.with_roles(*FEATURE_CTES, body=f"select student_id, {cols}, is_successful from features_encoded")


@register("feature_matrix", _matrix_sql())
def q_feature_matrix(spark, sf_dir):
    return X.feature_matrix(feature_table(spark, sf_dir))


def _profile_sql() -> str:
    from ..functions.fixed import FEATURE_CATEGORIES, FEATURE_COLUMNS, FEATURE_DESCRIPTIONS
    category = {f: cat for cat, fs in FEATURE_CATEGORIES.items() for f in fs}
    parts = []
    for i, c in enumerate(FEATURE_COLUMNS):
        cat = f"'{category[c]}'" if c in category else "cast(null as varchar)"
        parts.append(f"select cast({i} as integer) as position, '{c}' as feature, "
                     f"'{FEATURE_DESCRIPTIONS[c]}' as description, {cat} as category, "
                     f"count({c}) as non_null_rows, count(case when {c} <> 0 then 1 end) as non_zero_rows "
                     f"from features_encoded")
    return O.with_roles(*FEATURE_CTES, body="\nunion all\n".join(parts))


@register("feature_dictionary", _profile_sql())
def q_feature_dictionary(spark, sf_dir):
    """X11: the feature dictionary with a value profile of each feature."""
    return X.feature_profile(spark, feature_table(spark, sf_dir))


# --- A1-A9: SQL examples, overview, student and course analytics -------------

@register("students_by_major_active", O.with_roles(body="""
select major, count(*) as student_count, avg(gpa) as avg_gpa
from students where is_active group by major"""))
def q_students_by_major_active(spark, sf_dir):
    return A.students_by_major_active(roles.students(spark, sf_dir))


@register("dept_enrollment", O.with_roles(body="""
select c.department, count(e.enrollment_id) as total_enrollments,
       count(case when e.status = 'Completed' then 1 end) as completed
from courses c left join enrollments e on c.course_id = e.course_id
group by c.department"""))
def q_dept_enrollment(spark, sf_dir):
    return A.dept_enrollment(roles.courses(spark, sf_dir), roles.enrollments(spark, sf_dir))


@register("grade_distribution", O.with_roles(body=f"""
select grade, count(*) as count,
       {O.rhu('cast(count(*) as double) * 100 / (select count(*) from enrollments where grade is not null)', 1)}
         as percentage
from enrollments where grade is not null group by grade"""))
def q_grade_distribution(spark, sf_dir):
    return A.grade_distribution(roles.enrollments(spark, sf_dir))


@register("overview", O.with_roles(body="""
select (select count(*) from students) as total_students,
       (select count(*) from students where is_active) as active_students,
       (select coalesce(avg(gpa), 0.0) from students) as average_gpa,
       (select count(*) from courses) as total_courses,
       (select count(*) from enrollments) as total_enrollments"""))
def q_overview(spark, sf_dir):
    s, c, e = _views(spark, sf_dir)
    return A.overview(s, c, e)


@register("students_by_year", O.with_roles(body="""
select year_level, count(student_id) as count from students
where year_level is not null and year_level <> 0 group by year_level"""))
def q_students_by_year(spark, sf_dir):
    return A.students_by_year(roles.students(spark, sf_dir))


@register("students_by_major", O.with_roles(body="""
select major, count(student_id) as count from students
where major is not null and major <> '' group by major"""))
def q_students_by_major(spark, sf_dir):
    return A.students_by_major(roles.students(spark, sf_dir))


@register("student_analytics_major", O.with_roles(body=f"""
select coalesce(nullif(major, ''), '{fixed.UNDECLARED_MAJOR}') as major, count(student_id) as count
from students group by 1"""))
def q_student_analytics_major(spark, sf_dir):
    return A.student_analytics_major(roles.students(spark, sf_dir))


@register("student_analytics_year", O.with_roles(body="""
select coalesce(year_level, 0) as year, count(student_id) as count from students group by 1"""))
def q_student_analytics_year(spark, sf_dir):
    return A.student_analytics_year(roles.students(spark, sf_dir))


@register("student_analytics_summary", O.with_roles(body=f"""
select count(*) as total_students, count(case when is_active then 1 end) as active_students,
       {O.rhu('coalesce(avg(gpa), 0.0)', 2)} as average_gpa
from students"""))
def q_student_analytics_summary(spark, sf_dir):
    return A.student_analytics_summary(roles.students(spark, sf_dir))


def course_rollup(spark, sf_dir):
    return A.course_rollup(roles.courses(spark, sf_dir), roles.enrollments(spark, sf_dir))


@register("course_rollup", O.with_roles(O.PER_COURSE, O.COURSE_ROLLUP, body="select * from course_rollup"))
def q_course_rollup(spark, sf_dir):
    return course_rollup(spark, sf_dir)


@register("course_summary", O.with_roles(O.PER_COURSE, O.COURSE_ROLLUP, body=f"""
select (select count(*) from courses) as total_courses,
       {O.rhu('(select coalesce(avg(credits), 0.0) from courses)', 1)} as average_credits,
       {O.rhu(O.pct('(select sum(total_enrollments) from course_rollup)', '(select count(*) from courses)') + ' / 100', 1)}
         as average_enrollment"""))
def q_course_summary(spark, sf_dir):
    return A.course_summary(roles.courses(spark, sf_dir), course_rollup(spark, sf_dir))


@register("courses_by_department", O.with_roles(body=f"""
select coalesce(nullif(department, ''), '{fixed.UNKNOWN_LABEL}') as department, count(*) as count
from courses group by 1"""))
def q_courses_by_department(spark, sf_dir):
    return A.courses_by_department(roles.courses(spark, sf_dir))


@register("courses_by_semester", O.with_roles(body=f"""
select coalesce(nullif(semester, ''), '{fixed.UNKNOWN_LABEL}') as semester, count(*) as count
from courses group by 1"""))
def q_courses_by_semester(spark, sf_dir):
    return A.courses_by_semester(roles.courses(spark, sf_dir))


# --- A12-A20, O4, O5 ---------------------------------------------------------

@register("top_courses_by_count", O.with_roles(body="""
select c.course_id, c.course_name, c.department, count(e.student_id) as enrollment_count
from courses c join enrollments e on c.course_id = e.course_id
group by c.course_id, c.course_name, c.department
order by enrollment_count desc, c.course_id limit 10"""))
def q_top_courses_by_count(spark, sf_dir):
    return A.top_courses_by_count(roles.courses(spark, sf_dir), roles.enrollments(spark, sf_dir), 10)


T = fixed.DEFAULT_GPA_THRESHOLD


@register("at_risk_by_major", O.with_roles(body=f"""
select major, count(*) as count from students
where gpa < {T} and major is not null group by major"""))
def q_at_risk_by_major(spark, sf_dir):
    return A.at_risk_by_major(roles.students(spark, sf_dir), T)


@register("kpi_row", O.with_roles(body=f"""
select count(*) as total_students, count(case when is_active then 1 end) as active_students,
       coalesce(avg(gpa), 0.0) as average_gpa, count(case when gpa < {T} then 1 end) as at_risk_count,
       {O.pct('count(case when is_active then 1 end)', 'count(*)')} as retention_rate
from students"""))
def q_kpi_row(spark, sf_dir):
    return A.kpi_row(roles.students(spark, sf_dir), T)


@register("major_share", O.with_roles(f"""
m as (select coalesce(nullif(major, ''), '{fixed.UNDECLARED_MAJOR}') as major, count(student_id) as count
      from students group by 1)""", body=f"""
select major, count, {O.pct('count', '(select sum(count) from m)')} as share_pct from m"""))
def q_major_share(spark, sf_dir):
    return A.major_share(roles.students(spark, sf_dir))


_BINS = fixed.GPA_HISTOGRAM_BINS
_LO, _HI = fixed.GPA_RANGE
_W = (_HI - _LO) / _BINS


@register("gpa_histogram", O.with_roles(f"""
b as (select cast(least(greatest(floor((gpa - cast({_LO!r} as double)) / cast({_W!r} as double)), 0), {_BINS - 1})
                  as integer) as bin
      from students where is_active and gpa is not null),
c as (select bin, count(*) as cnt from b group by bin),
g as (select cast(range as integer) as bin from range({_BINS}))""", body=f"""
select g.bin, cast({_LO!r} as double) + g.bin * cast({_W!r} as double) as bin_lo,
       cast({_LO!r} as double) + (g.bin + 1) * cast({_W!r} as double) as bin_hi,
       coalesce(c.cnt, 0) as count
from g left join c on g.bin = c.bin"""))
def q_gpa_histogram(spark, sf_dir):
    return A.gpa_histogram(roles.students(spark, sf_dir))


@register("course_metrics", O.with_roles(O.PER_COURSE, O.COURSE_ROLLUP, body=f"""
select count(*) as total_courses, {O.mean_of_rounded('completion_rate', 1)} as avg_completion_rate,
       coalesce({O.mean_of_rounded('average_grade_point', 2)}, 0.0) as avg_grade_point,
       cast(coalesce(sum(total_enrollments), 0) as bigint) as total_enrollments
from course_rollup"""))
def q_course_metrics(spark, sf_dir):
    return A.course_metrics(course_rollup(spark, sf_dir))


@register("dept_completion", O.with_roles(O.PER_COURSE, O.COURSE_ROLLUP, body=f"""
select department, {O.mean_of_rounded('completion_rate', 1)} as completion_rate,
       cast(sum(total_enrollments) as bigint) as total_enrollments
from course_rollup group by department"""))
def q_dept_completion(spark, sf_dir):
    return A.dept_completion(course_rollup(spark, sf_dir))


@register("top_courses", O.with_roles(O.PER_COURSE, O.COURSE_ROLLUP, body="""
select * from course_rollup order by total_enrollments desc, course_id limit 10"""))
def q_top_courses(spark, sf_dir):
    return B.top_n(course_rollup(spark, sf_dir), "total_enrollments", 10)


@register("course_table_sorted", O.with_roles(O.PER_COURSE, O.COURSE_ROLLUP, body="""
select * from course_rollup order by average_grade_point desc nulls last, course_id"""))
def q_course_table_sorted(spark, sf_dir):
    return B.sort_table(course_rollup(spark, sf_dir), "average_grade_point", ascending=False)


@register("gpa_median_mean", O.with_roles("""
vals as (select gpa as v from students where is_active and gpa is not null),
ranked as (select v, row_number() over (order by v) - 1 as rn, count(*) over () as n from vals)""", body="""
select (min(v) + max(v)) / 2.0 as median_gpa, (select avg(v) from vals) as mean_gpa,
       (select count(*) from vals) as n_students
from ranked where rn = floor((n - 1) / 2) or rn = ceil((n - 1) / 2)"""))
def q_gpa_median_mean(spark, sf_dir):
    return A.gpa_median_mean(roles.students(spark, sf_dir))


@register("insights", O.with_roles(f"""
active as (select * from students where is_active),
k as (select count(*) as active_students, count(case when gpa < {T} then 1 end) as at_risk_count from active),
m as (select major, count(*) as c from active where gpa < {T} and major is not null group by major),
best as (select major, c from m order by c desc, major limit 1)""", body=f"""
select k.active_students, k.at_risk_count, {O.pct('k.at_risk_count', 'k.active_students')} as at_risk_pct,
       best.major as top_risk_major, best.c as top_risk_count
from k left join best on true"""))
def q_insights(spark, sf_dir):
    return A.insights(roles.students(spark, sf_dir), T)


@register("enrollment_navigation", O.with_roles(body="""
select e.enrollment_id, e.student_id, e.course_id, e.status, e.grade,
       s.first_name, s.last_name, s.major, c.course_name, c.department, c.credits
from enrollments e join students s on e.student_id = s.student_id
join courses c on e.course_id = c.course_id"""))
def q_enrollment_navigation(spark, sf_dir):
    s, c, e = _views(spark, sf_dir)
    return A.enrollment_navigation(s, e, c)


# --- F1-F7, S2: browsing -----------------------------------------------------

@register("students_filtered", O.with_roles(body="""
select student_id, first_name, last_name, email, major, year_level, gpa, is_active, enrollment_date
from students where major = 'BUILDING' and gpa >= 2.0
order by student_id limit 1000 offset 10"""))
def q_students_filtered(spark, sf_dir):
    return B.students_filtered(roles.students(spark, sf_dir), major="BUILDING", min_gpa=2.0,
                               skip=10, limit=1000)


@register("courses_filtered", O.with_roles(body="""
select course_id, course_name, department, credits, course_type, semester, year
from courses where department = 'Brand#13' and semester = 'Fall'
order by course_id limit 100"""))
def q_courses_filtered(spark, sf_dir):
    return B.courses_filtered(roles.courses(spark, sf_dir), department="Brand#13", semester="Fall",
                              limit=100)


@register("enrollments_filtered", O.with_roles(body="""
select enrollment_id, student_id, course_id, enrollment_date, grade, status
from enrollments where status = 'Dropped'
order by enrollment_id nulls first, student_id nulls first, course_id nulls first,
         enrollment_date nulls first, grade nulls first, status nulls first
limit 100 offset 100"""))
def q_enrollments_filtered(spark, sf_dir):
    return B.enrollments_filtered(roles.enrollments(spark, sf_dir), status="Dropped", skip=100, limit=100)


@register("lookup_keys", O.with_roles("""
k as (select distinct o_custkey as student_id from orders where o_orderpriority = '1-URGENT')""", body="""
select k.student_id, s.first_name, s.last_name, s.email, s.major, s.year_level, s.gpa, s.enrollment_date,
       s.is_active, s.student_id is not null as found
from k left join students s on k.student_id = s.student_id"""))
def q_lookup_keys(spark, sf_dir):
    from ..sources.tables import read_table
    keys = (read_table(spark, sf_dir, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
            .select(F.col("o_custkey").alias("student_id")))
    return B.lookup_keys(roles.students(spark, sf_dir), keys, "student_id")


@register("student_enrollments", O.with_roles(body="""
select e.enrollment_id, e.student_id, e.course_id, e.enrollment_date, e.grade, e.status
from enrollments e where e.student_id in (select student_id from students where year_level = 1)"""))
def q_student_enrollments(spark, sf_dir):
    s, c, e = _views(spark, sf_dir)
    return B.student_enrollments(s, e, s.filter(F.col("year_level") == 1))


@register("at_risk", O.with_roles(body=f"""
select student_id, concat_ws(' ', first_name, last_name) as name, gpa, major, year_level
from students where gpa < {T}"""))
def q_at_risk(spark, sf_dir):
    return B.at_risk(roles.students(spark, sf_dir), T)


AT_RISK_ACTIVE_ORACLE = O.with_roles(body=f"""
select student_id, first_name, last_name, major, gpa, is_active
from students where gpa < {T} and is_active""")


@register("at_risk_active", AT_RISK_ACTIVE_ORACLE)
def q_at_risk_active(spark, sf_dir):
    return B.at_risk_active(roles.students(spark, sf_dir), T)


@register("sql_at_risk_active", AT_RISK_ACTIVE_ORACLE)
def q_sql_at_risk_active(spark, sf_dir):
    return B.sql_at_risk_active(spark, roles.students(spark, sf_dir), T)


# --- S4, S6-S10: sources, sinks and data quality -----------------------------

@register("overwrite_roundtrip", O.with_roles(body="select * from students"))
def q_overwrite_roundtrip(spark, sf_dir):
    from ..session import shared_path
    from ..sources.sinks import overwrite_table
    from ..sources.tables import read_entity
    path = shared_path(spark, "tables", "students", unique=True)
    overwrite_table(roles.students(spark, sf_dir), path)
    return read_entity(spark, path, "students")


@register("table_counts", O.with_roles(body="""
select 'students' as table_name, count(*) as row_count from students
union all select 'courses', count(*) from courses
union all select 'enrollments', count(*) from enrollments"""))
def q_table_counts(spark, sf_dir):
    s, c, e = _views(spark, sf_dir)
    return Q.table_counts({"students": s, "courses": c, "enrollments": e})


def _student_rule_sql() -> list[tuple[str, str]]:
    ylo, yhi = fixed.YEAR_LEVEL_RANGE
    glo, ghi = fixed.GPA_BOUNDS
    return [
        ("student_id is not null", "student_id is required"),
        ("first_name is not null", "first_name is required"),
        ("last_name is not null", "last_name is required"),
        ("email is not null", "email is required"),
        (f"year_level is null or (year_level >= {ylo} and year_level <= {yhi})",
         f"year_level must be between {ylo} and {yhi}"),
        (f"gpa is null or (gpa >= {glo} and gpa <= {ghi})", f"gpa must be between {glo} and {ghi}"),
    ]


def _request_rule_sql() -> list[tuple[str, str]]:
    glo, ghi = fixed.GPA_BOUNDS
    ylo, yhi = fixed.YEAR_LEVEL_RANGE
    rlo, rhi = fixed.RATE_BOUNDS
    counts = ("total_enrollments", "completed_courses", "dropped_courses")
    return [
        (f"gpa >= {glo} and gpa <= {ghi}", f"gpa must be between {glo} and {ghi}"),
        (f"year_level >= {ylo} and year_level <= {yhi}", f"year_level must be between {ylo} and {yhi}"),
        *[(f"{c} >= 0", f"{c} must be >= 0") for c in counts],
        ("current_enrollments is null or current_enrollments >= 0", "current_enrollments must be >= 0"),
        (f"completion_rate >= {rlo} and completion_rate <= {rhi}", f"completion_rate must be between {rlo} and {rhi}"),
        (f"drop_rate is null or (drop_rate >= {rlo} and drop_rate <= {rhi})",
         f"drop_rate must be between {rlo} and {rhi}"),
    ]


def _reason_sql(rules=None) -> str:
    arms = ", ".join(f"case when not coalesce({ok}, false) then '{msg}' end" for ok, msg in rules or _student_rule_sql())
    return f"nullif(concat_ws('; ', {arms}), '')"


@register("validate_rows", O.with_roles(O.REGISTRATIONS, f"""
checked as (select *, {_reason_sql()} as reject_reason from registrations)""", body="""
select student_id, first_name, last_name, email, major, year_level, gpa, is_active,
       reject_reason is null as is_valid, reject_reason
from checked"""))
def q_validate_rows(spark, sf_dir):
    return Q.validate_rows(roles.registrations(spark, sf_dir))


CUTOFF = "2022-01-01 00:00:00"


@register("append_new_keys", O.with_roles(O.REGISTRATIONS, f"""
valid as (select * from registrations where {_reason_sql()} is null),
target as (select student_id from students where enrollment_date < timestamp '{CUTOFF}')""", body=f"""
select v.student_id, v.first_name, v.last_name, v.email, v.major, v.year_level, v.gpa, v.is_active,
       case when t.student_id is null then timestamp '{O.AS_OF}' end as inserted_at,
       case when t.student_id is null then 'inserted' else 'refused' end as outcome
from valid v left join target t on v.student_id = t.student_id"""))
def q_append_new_keys(spark, sf_dir):
    valid, _ = Q.split_valid(roles.registrations(spark, sf_dir))
    target = roles.students(spark, sf_dir).filter(F.col("enrollment_date") < F.expr(f"TIMESTAMP_NTZ'{CUTOFF}'"))
    return Q.mark_new_keys(target, valid, "student_id", inserted_at=O.AS_OF)


@register("dedupe_pairs", O.with_roles(body="""
select enrollment_id, student_id, course_id, enrollment_date, grade, status from enrollments
qualify row_number() over (partition by student_id, course_id
                           order by enrollment_id nulls first, enrollment_date nulls first,
                                    grade nulls first, status nulls first) = 1"""))
def q_dedupe_pairs(spark, sf_dir):
    return Q.dedupe_pairs(roles.enrollments(spark, sf_dir))


@register("duplicate_keys", O.with_roles(body="""
select enrollment_id, count(*) as occurrences from enrollments group by enrollment_id having count(*) > 1"""))
def q_duplicate_keys(spark, sf_dir):
    return Q.duplicate_keys(roles.enrollments(spark, sf_dir), "enrollment_id")


@register("orphan_rows", O.with_roles(body="""
select 'student_id' as foreign_key, count(*) as checked_rows,
       count(case when e.student_id is not null and s.student_id is null then 1 end) as orphan_rows
from enrollments e left join (select distinct student_id from students) s on e.student_id = s.student_id
union all
select 'course_id', count(*),
       count(case when e.course_id is not null and c.course_id is null then 1 end)
from enrollments e left join (select distinct course_id from courses) c on e.course_id = c.course_id"""))
def q_orphan_rows(spark, sf_dir):
    s, c, e = _views(spark, sf_dir)
    return Q.orphan_report(e, {"student_id": s, "course_id": c})


# --- P2, P5-P9: scoring rules on the heuristic score -------------------------

def heuristic_frame(spark, sf_dir):
    return S.heuristic_score(engineered(spark, sf_dir))


H_OFF = fixed.HEURISTIC_OFFSET
HEURISTIC_CTE = f"""
heuristic as (
  select *, least(gpa / cast(4 as double) + cast({H_OFF!r} as double), cast(1 as double)) as success_probability
  from features_encoded)
"""


def _when_chain_sql(expr: str, tiers, op: str, value) -> str:
    arms, last = [], None
    for t in tiers:
        if t[0] is None:
            last = value(t)
        else:
            arms.append(f"when {expr} {op} {t[0]!r} then {value(t)}")
    return f"case {' '.join(arms)} else {last} end"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


RISK_SQL = {
    "risk_level": _when_chain_sql("success_probability", fixed.RISK_TIERS, ">=", lambda t: _q(t[1])),
    "risk_icon": _when_chain_sql("success_probability", fixed.RISK_TIERS, ">=", lambda t: _q(t[2])),
    "confidence": _when_chain_sql("greatest(success_probability, 1 - success_probability)",
                                  fixed.CONFIDENCE_LEVELS, ">", lambda t: _q(t[1])),
}


@register("heuristic_score", O.with_roles(*FEATURE_CTES, HEURISTIC_CTE, body=f"""
select student_id, gpa, success_probability,
       {_when_chain_sql('success_probability', fixed.HEURISTIC_TIERS, '<', lambda t: _q(t[1]))} as heuristic_risk
from heuristic"""))
def q_heuristic_score(spark, sf_dir):
    return heuristic_frame(spark, sf_dir).select("student_id", "gpa", "success_probability", "heuristic_risk")


@register("risk_tiers", O.with_roles(*FEATURE_CTES, HEURISTIC_CTE, body=f"""
select student_id, success_probability, {RISK_SQL['risk_level']} as risk_level,
       {RISK_SQL['risk_icon']} as risk_icon, {RISK_SQL['confidence']} as confidence,
       greatest(success_probability, 1 - success_probability) as confidence_score
from heuristic"""))
def q_risk_tiers(spark, sf_dir):
    return (S.assess_risk(heuristic_frame(spark, sf_dir))
            .select("student_id", "success_probability", "risk_level", "risk_icon", "confidence",
                    "confidence_score"))


def _tier_size_sql() -> str:
    return _when_chain_sql("success_probability", fixed.RISK_TIERS, ">=", lambda t: str(len(t[3])))


def _tier_first_sql() -> str:
    return _when_chain_sql("success_probability", fixed.RISK_TIERS, ">=", lambda t: _q(t[3][0]))


@register("recommendations", O.with_roles(*FEATURE_CTES, HEURISTIC_CTE, f"""
flags as (
  select *, coalesce(drop_rate, 0) > {fixed.HIGH_DROP_RATE!r} as drop_note,
            coalesce(gpa, 4.0) < {fixed.LOW_GPA!r} as gpa_note
  from heuristic)""", body=f"""
select student_id, {RISK_SQL['risk_level']} as risk_level,
       cast({_tier_size_sql()} + cast(drop_note as integer) + cast(gpa_note as integer) as integer)
         as n_recommendations,
       case when gpa_note then {_q(fixed.LOW_GPA_TEXT)} when drop_note then {_q(fixed.HIGH_DROP_TEXT)}
            else {_tier_first_sql()} end as first_recommendation
from flags"""))
def q_recommendations(spark, sf_dir):
    r = S.assess_risk(heuristic_frame(spark, sf_dir))
    return r.select("student_id", "risk_level",
                    F.size("recommendations").alias("n_recommendations"),
                    F.col("recommendations")[0].alias("first_recommendation"))


def _interpretation_sql() -> str:
    text = f"printf('%.1f%%', {O.rhu('success_probability * cast(100 as double)', 1)})"

    def sentence(t):
        head, tail = t[1].split("{p}")
        return f"concat({_q(head)}, {text}, {_q(tail)})"
    return _when_chain_sql("success_probability", fixed.INTERPRETATIONS, ">=", sentence)


@register("explanations", O.with_roles(*FEATURE_CTES, HEURISTIC_CTE, body=f"""
select student_id, success_probability, {_interpretation_sql()} as interpretation,
       10 as n_key_features, cast(gpa as double) as gpa_value,
       cast(total_enrollments as double) as total_enrollments_value
from heuristic"""))
def q_explanations(spark, sf_dir):
    e = S.explain(heuristic_frame(spark, sf_dir))
    return e.select("student_id", "success_probability", "interpretation",
                    F.size("key_features").alias("n_key_features"),
                    F.col("key_features")["gpa"]["value"].alias("gpa_value"),
                    F.col("key_features")["total_enrollments"]["value"].alias("total_enrollments_value"))


SERVING_COLUMNS = ["gpa", "year_level", "total_enrollments", "completed_courses", "dropped_courses",
                   "current_enrollments", "excellent_grades", "good_grades", "average_grades", "poor_grades",
                   "completion_rate", "drop_rate", "excellence_rate", "struggle_rate"]


def _aligned_sql() -> str:
    present = set(SERVING_COLUMNS) | {"major_encoded"}
    cols = ", ".join(
        (f"coalesce(cast(a.{c} as double), cast(0 as double)) as {c}" if c in present
         else f"cast(0 as double) as {c}")
        for c in fixed.FEATURE_COLUMNS)
    return O.with_roles(*FEATURE_CTES, *O.SERVING_CTES, body=f"""
select a.student_id, {cols}
from (select sv.*, coalesce(mc.major_encoded, (select count(*) from major_classes)) as major_encoded
      from serving_rates sv
      join (select student_id, coalesce(nullif(major, ''), '{fixed.UNDECLARED_MAJOR}') as major from students) sm
        on sv.student_id = sm.student_id
      left join major_classes mc on sm.major = mc.major) a""")


@register("aligned_features", _aligned_sql())
def q_aligned_features(spark, sf_dir):
    s, c, e = _views(spark, sf_dir)
    classes = X.major_classes(engineered(spark, sf_dir))
    serving = X.serving_features(s, e).join(
        s.select("student_id", null_label("major", fixed.UNDECLARED_MAJOR).alias("major")), "student_id")
    return S.align_features(serving, fixed.FEATURE_COLUMNS, classes)


# --- E1-E7: evaluation of (label, score) pairs --------------------------------

def heuristic_predictions(spark, sf_dir):
    """Both heuristics' predictions from one pass over the students."""
    scores = {"gpa_heuristic": F.col("success_probability"),
              "completion_heuristic": F.col("completion_rate") / F.lit(100)}
    return E.long_predictions(heuristic_frame(spark, sf_dir), scores, "is_successful")


PREDS_CTES = (*FEATURE_CTES, HEURISTIC_CTE, """
preds as (
  select 'gpa_heuristic' as model, student_id as key, is_successful as label,
         success_probability as score, cast(success_probability > 0.5 as integer) as prediction
  from heuristic
  union all
  select 'completion_heuristic', student_id, is_successful, completion_rate / 100,
         cast(completion_rate / 100 > 0.5 as integer)
  from heuristic)""", """
cm as (
  select model,
         count(case when label = 0 and prediction = 0 then 1 end) as tn,
         count(case when label = 0 and prediction = 1 then 1 end) as fp,
         count(case when label = 1 and prediction = 0 then 1 end) as fn,
         count(case when label = 1 and prediction = 1 then 1 end) as tp
  from preds group by model)""", """
g as (
  select model, score, count(case when label = 1 then 1 end) as pos,
         count(case when label = 0 then 1 end) as neg
  from preds group by model, score)""", """
r as (
  select *,
    cast(coalesce(sum(pos) over (partition by model order by score rows between unbounded preceding and 1 preceding), 0) as bigint) as pos_before,
    cast(coalesce(sum(neg) over (partition by model order by score rows between unbounded preceding and 1 preceding), 0) as bigint) as neg_before,
    cast(sum(pos) over (partition by model) as bigint) as pos_total,
    cast(sum(neg) over (partition by model) as bigint) as neg_total
  from g)""", """
auc as (
  select model, cast(sum(pos * (2 * neg_before + neg)) as double)
                / nullif(cast(2 as double) * cast(max(pos_total) as double) * cast(max(neg_total) as double), 0)
                as roc_auc
  from r group by model)""")


def _sdiv(a: str, b: str) -> str:
    return f"coalesce(cast({a} as double) / nullif({b}, 0), 0)"


METRICS_CTE = f"""
metrics as (
  select cm.model, tp + fp + fn + tn as n, {_sdiv('tp + tn', 'tp + fp + fn + tn')} as accuracy,
         {_sdiv('tp', 'tp + fp')} as precision, {_sdiv('tp', 'tp + fn')} as recall,
         {_sdiv('2 * tp', '2 * tp + fp + fn')} as f1_score, auc.roc_auc
  from cm left join auc on cm.model = auc.model)
"""


@register("eval_metrics", O.with_roles(*PREDS_CTES, METRICS_CTE, body="select * from metrics"))
def q_eval_metrics(spark, sf_dir):
    return E.eval_metrics(heuristic_predictions(spark, sf_dir))


@register("model_comparison", O.with_roles(*PREDS_CTES, METRICS_CTE, body="""
select model, roc_auc, accuracy, f1_score, precision, recall from metrics"""))
def q_model_comparison(spark, sf_dir):
    return E.model_comparison(E.eval_metrics(heuristic_predictions(spark, sf_dir)))


BEST_MODEL_SQL = O.with_roles(*PREDS_CTES, METRICS_CTE, body="""
select model, roc_auc from metrics where roc_auc is not null order by roc_auc desc, model limit 1""")


@register("best_model", BEST_MODEL_SQL)
def q_best_model(spark, sf_dir):
    return E.best_model(E.eval_metrics(heuristic_predictions(spark, sf_dir)))


@register("best_model_single_class", BEST_MODEL_SQL)
def q_best_model_single_class(spark, sf_dir):
    """E3 with a model that only saw one class: it has no AUC and cannot win."""
    preds = heuristic_predictions(spark, sf_dir)
    one = preds.filter((F.col("label") == 1) & (F.col("model") == "gpa_heuristic")).withColumn("model", F.lit("a_one_class"))
    return E.best_model(E.eval_metrics(preds.unionByName(one)))


@register("model_comparison_ranked", O.with_roles(*PREDS_CTES, METRICS_CTE, body="""
select row_number() over (order by roc_auc desc nulls last, model) as position, model, roc_auc from metrics"""))
def q_model_comparison_ranked(spark, sf_dir):
    """E2 with its order as a column."""
    table = E.model_comparison(E.eval_metrics(heuristic_predictions(spark, sf_dir))).select("model", "roc_auc")
    return B.ranked(table, [F.desc_nulls_last("roc_auc"), F.col("model")], None)


@register("classification_report", O.with_roles(*PREDS_CTES, f"""
per as (
  select model,
         {_sdiv('tn', 'tn + fn')} as p0, {_sdiv('tn', 'tn + fp')} as r0,
         {_sdiv('2 * tn', '2 * tn + fp + fn')} as f0, tn + fp as s0,
         {_sdiv('tp', 'tp + fp')} as p1, {_sdiv('tp', 'tp + fn')} as r1,
         {_sdiv('2 * tp', '2 * tp + fp + fn')} as f1, tp + fn as s1
  from cm)""", body=f"""
select model, '0' as class_label, p0 as precision, r0 as recall, f0 as f1_score, s0 as support from per
union all select model, '1', p1, r1, f1, s1 from per
union all select model, 'macro avg', (p0 + p1) / 2.0, (r0 + r1) / 2.0, (f0 + f1) / 2.0, s0 + s1 from per
union all select model, 'weighted avg', {_sdiv('p0 * s0 + p1 * s1', 's0 + s1')},
       {_sdiv('r0 * s0 + r1 * s1', 's0 + s1')}, {_sdiv('f0 * s0 + f1 * s1', 's0 + s1')}, s0 + s1 from per"""))
def q_classification_report(spark, sf_dir):
    return E.classification_report(heuristic_predictions(spark, sf_dir))


@register("confusion_matrix", O.with_roles(*PREDS_CTES, body=f"""
select model, tn, fp, fn, tp,
       {_sdiv('tn', 'tn + fp + fn + tp')} * 100 as tn_pct, {_sdiv('fp', 'tn + fp + fn + tp')} * 100 as fp_pct,
       {_sdiv('fn', 'tn + fp + fn + tp')} * 100 as fn_pct, {_sdiv('tp', 'tn + fp + fn + tp')} * 100 as tp_pct
from cm"""))
def q_confusion_matrix(spark, sf_dir):
    return E.confusion_matrix(heuristic_predictions(spark, sf_dir))


@register("roc_points", O.with_roles(*PREDS_CTES, body="""
select model, score as threshold, pos_total - pos_before as tp, neg_total - neg_before as fp,
       cast(pos_total - pos_before as double) / nullif(pos_total, 0) as tpr,
       cast(neg_total - neg_before as double) / nullif(neg_total, 0) as fpr
from r
union all
select model, null, 0, 0, cast(0 as double) / nullif(max(pos_total), 0), cast(0 as double) / nullif(max(neg_total), 0)
from r group by model"""))
def q_roc_points(spark, sf_dir):
    return E.roc_points(heuristic_predictions(spark, sf_dir))


@register("pr_points", O.with_roles(*PREDS_CTES, body="""
select model, score as threshold,
       cast(pos_total - pos_before as double) / nullif(pos_total - pos_before + neg_total - neg_before, 0)
         as precision,
       cast(pos_total - pos_before as double) / nullif(pos_total, 0) as recall
from r
union all select distinct model, null, cast(1 as double), cast(0 as double) from r"""))
def q_pr_points(spark, sf_dir):
    return E.pr_points(heuristic_predictions(spark, sf_dir))


# --- M1, A22: split ----------------------------------------------------------

_VAL_CUT = M.validation_cut(fixed.DEFAULT_TEST_SIZE, fixed.DEFAULT_VAL_SIZE)


SPLIT_CTES = (*FEATURE_CTES, """
hb as (select *, cast(('0x' || substr(md5(cast(student_id as varchar)), 1, 8)) as bigint) % 10000 as bucket
       from features_encoded)""", """
bc as (select is_successful, bucket, count(*) as c from hb group by 1, 2)""", """
cut as (
  select is_successful, bucket,
         (cast(coalesce(sum(c) over (partition by is_successful order by bucket
                                     rows between unbounded preceding and 1 preceding), 0) as double)
          + cast(c as double) / 2.0) / cast(sum(c) over (partition by is_successful) as double) as frac
  from bc)""", f"""
sp as (
  select hb.is_successful,
         case when cut.frac < cast('{fixed.DEFAULT_TEST_SIZE!r}' as double) then 'test'
              when cut.frac < cast('{_VAL_CUT!r}' as double) then 'validation' else 'train' end as split
  from hb join cut on hb.is_successful = cut.is_successful and hb.bucket = cut.bucket)""")


@register("split_summary", O.with_roles(*SPLIT_CTES, body="""
select split, count(*) as rows, cast(count(*) as double) / (select count(*) from sp) as share,
       avg(is_successful) as positive_rate
from sp group by split"""))
def q_split_summary(spark, sf_dir):
    members = engineered(spark, sf_dir).select("student_id", "is_successful")
    return M.split_summary(M.stratified_split(members))


# --- options and orders of the roll-ups and lists ------------------------------

@register("students_by_major_top5", O.with_roles(body="""
select row_number() over (order by student_count desc, major asc nulls last) as position, *
from (select major, count(*) as student_count, avg(gpa) as avg_gpa from students where is_active group by major)
qualify position <= 5"""))
def q_students_by_major_top5(spark, sf_dir):
    """A1 / O2 / O3: the first five majors by count, in order."""
    top = A.students_by_major_active(roles.students(spark, sf_dir), top=5)
    return B.ranked(top, [F.desc("student_count"), F.asc_nulls_last("major")], 5)


@register("dept_enrollment_ranked", O.with_roles(body="""
select row_number() over (order by total_enrollments desc, department asc nulls last) as position, *
from (select c.department, count(e.enrollment_id) as total_enrollments
      from courses c left join enrollments e on c.course_id = e.course_id group by c.department)"""))
def q_dept_enrollment_ranked(spark, sf_dir):
    """A2 / O2 with its order as a column."""
    table = A.dept_enrollment(roles.courses(spark, sf_dir), roles.enrollments(spark, sf_dir)).drop("completed")
    return B.ranked(table, [F.desc("total_enrollments"), F.asc_nulls_last("department")], None)


@register("grade_distribution_ranked", O.with_roles(body="""
select row_number() over (order by count desc, grade) as position, *
from (select grade, count(*) as count from enrollments where grade is not null group by grade)"""))
def q_grade_distribution_ranked(spark, sf_dir):
    """A3 with its order as a column."""
    return B.ranked(A.grade_distribution(roles.enrollments(spark, sf_dir)).drop("percentage"), [F.desc("count"), "grade"], None)


@register("at_risk_page", O.with_roles(body=f"""
select row_number() over (order by gpa, student_id) as position, student_id, gpa
from students where gpa < {T} qualify position <= 100"""))
def q_at_risk_page(spark, sf_dir):
    """The first hundred at-risk students in order."""
    return B.ranked(B.at_risk(roles.students(spark, sf_dir), T).select("student_id", "gpa"), ["gpa", "student_id"], 100)


@register("at_risk_active_page", O.with_roles(body=f"""
select row_number() over (order by gpa, student_id) as position, student_id, gpa
from students where gpa < {T} and is_active qualify position <= 100"""))
def q_at_risk_active_page(spark, sf_dir):
    """the first hundred active at-risk students in order."""
    return B.ranked(B.at_risk_active(roles.students(spark, sf_dir), T).select("student_id", "gpa"), ["gpa", "student_id"], 100)


@register("course_table_page", O.with_roles(O.PER_COURSE, O.COURSE_ROLLUP, body="""
select row_number() over (order by average_grade_point asc nulls last, course_id) as position, course_id, average_grade_point
from course_rollup qualify position <= 100"""))
def q_course_table_page(spark, sf_dir):
    """The first hundred rows of the table in the chosen order."""
    table = B.sort_table(course_rollup(spark, sf_dir), "average_grade_point", ascending=True)
    return B.ranked(table.select("course_id", "average_grade_point"), [F.asc_nulls_last("average_grade_point"), "course_id"], 100)


@register("course_metrics_department", O.with_roles(O.PER_COURSE, O.COURSE_ROLLUP, body=f"""
select count(*) as total_courses, {O.mean_of_rounded('completion_rate', 1)} as avg_completion_rate,
       coalesce({O.mean_of_rounded('average_grade_point', 2)}, 0.0) as avg_grade_point,
       cast(coalesce(sum(total_enrollments), 0) as bigint) as total_enrollments
from course_rollup where department = 'Brand#13'"""))
def q_course_metrics_department(spark, sf_dir):
    """The indicators of one department."""
    return A.course_metrics(course_rollup(spark, sf_dir), department="Brand#13")


@register("table_listing", O.with_roles(body="""
select 'students' as table_name, count(*) as row_count from students
union all select 'courses', count(*) from courses
union all select 'enrollments', count(*) from enrollments"""))
def q_table_listing(spark, sf_dir):
    """What the catalog lists, with counts."""
    roles.register_views(spark, sf_dir)
    return Q.listed_tables(spark, only=["students", "courses", "enrollments"])


@register("request_validation", O.with_roles(O.REQUESTS, body=f"""
select *, {_reason_sql(_request_rule_sql())} is null as is_valid, {_reason_sql(_request_rule_sql())} as reject_reason
from requests"""))
def q_request_validation(spark, sf_dir):
    """Which scoring requests are refused, and why."""
    requests = roles.prediction_requests(spark, sf_dir)
    return Q.validate_rows(requests, Q.prediction_request_rules(requests.columns))


LINEAR = {"gpa": 0.9, "completion_rate": 0.03, "drop_rate": -0.05}
LINEAR_INTERCEPT = -4.5
_Z = " + ".join([f"cast({LINEAR_INTERCEPT} as double)", *[f"cast({c} as double) * {n}" for n, c in LINEAR.items()]])


@register("scored_linear", O.with_roles(*FEATURE_CTES, f"""
scored as (select student_id, 1 / (1 + exp(-({_Z}))) as success_probability from features)""", body=f"""
select student_id, round(success_probability, 9) as success_probability, {RISK_SQL['risk_level']} as risk_level
from scored"""))
def q_scored_linear(spark, sf_dir):
    """P3 / P5 with a linear model given by its coefficients."""
    scored = S.assess_risk(S.linear_probability(engineered(spark, sf_dir), LINEAR, LINEAR_INTERCEPT))
    return scored.select("student_id", F.round("success_probability", 9).alias("success_probability"), "risk_level")


# --- M2-M11, E8-E10, P1-P13: trained models ------------------------------------
# The reports below hold fitted numbers, so SQL can only count their rows.  Each has
# a ``*_checks`` query beside it that states what SQL can: keys, sizes, sums, and the
# agreement of every derived column with the probability it came from.

def _job(spark, sf_dir):
    """The one run that the reports share: the full grids, 5 folds."""
    return J.train_job(spark, sf_dir)


def _grid_size(axes: dict) -> int:
    n = 1
    for values in axes.values():
        n *= len(values)
    return n


@register("cv_table")
def q_cv_table(spark, sf_dir):
    return M.cv_table(spark, _job(spark, sf_dir).trained)


@register("cv_checks", "\nunion all\n".join(
    f"select '{name}' as model, {_grid_size(axes)} as grid_size, {M.REFERENCE_GRID_SIZES[name]} as reference_grid_size, "
    f"true as mean_in_range, true as params_from_grid" for name, axes in M.FULL_GRIDS.items()))
def q_cv_checks(spark, sf_dir):
    trained = _job(spark, sf_dir).trained
    chosen = {n: all(v in M.FULL_GRIDS[n][axis] for axis, v in t.best_params.items()) for n, t in trained.items()}
    params = F.coalesce(*[F.when(F.col("model") == n, F.lit(ok)) for n, ok in chosen.items()])
    return M.cv_table(spark, trained).select(
        "model", "grid_size", "reference_grid_size", F.col("cv_mean").between(0.0, 1.0).alias("mean_in_range"),
        params.alias("params_from_grid"))


@register("grid_points")
def q_grid_points(spark, sf_dir):
    """M5: every point of the three grids with its mean area under ROC over the folds."""
    return _job(spark, sf_dir).grid


@register("training_summary")
def q_training_summary(spark, sf_dir):
    return M.training_summary(spark, _job(spark, sf_dir).trained)


@register("model_test_metrics")
def q_model_test_metrics(spark, sf_dir):
    """E1 / E2 on the held-out splits of the trained models."""
    return _job(spark, sf_dir).metrics


_MODELS_SQL = ", ".join(f"('{m}')" for m in M.FULL_GRIDS)


@register("model_metrics_checks", O.with_roles(*SPLIT_CTES, body=f"""
select m.model, split, count(*) as n, true as in_range
from sp, (values {_MODELS_SQL}) as m(model) where split <> 'train' group by m.model, split"""))
def q_model_metrics_checks(spark, sf_dir):
    inside = F.lit(True)
    for c in ("accuracy", "precision", "recall", "f1_score", "roc_auc"):
        inside = inside & F.coalesce(F.col(c).between(0.0, 1.0), F.lit(True))
    return _job(spark, sf_dir).metrics.select("model", "split", "n", inside.alias("in_range"))


@register("tree_importance")
def q_tree_importance(spark, sf_dir):
    return (_job(spark, sf_dir).importance.filter(F.col("kind") == "importance").drop("kind"))


@register("linear_importance")
def q_linear_importance(spark, sf_dir):
    rows = _job(spark, sf_dir).importance.filter(F.col("kind") == "coefficient")
    return rows.select("model", "feature", F.col("importance").alias("coefficient"),
                       F.abs("importance").alias("abs_coefficient"))


_FEATURES_SQL = ", ".join(f"('{f}')" for f in fixed.FEATURE_COLUMNS)


@register("importance_checks", f"""
select m.model, case when m.model = 'logistic_regression' then 'coefficient' else 'importance' end as kind,
       f.feature, true as sums_to_one
from (values {_MODELS_SQL}) as m(model), (values {_FEATURES_SQL}) as f(feature)""")
def q_importance_checks(spark, sf_dir):
    """Every model lists every feature; tree importances sum to 1."""
    rows = _job(spark, sf_dir).importance
    total = rows.groupBy("model", "kind").agg(F.sum("importance").alias("s")).select(
        F.col("model").alias("m"), ((F.col("kind") == "coefficient") | (F.abs(F.col("s") - 1) < 1e-6)).alias("sums_to_one"))
    return rows.join(total, F.col("model") == F.col("m")).select("model", "kind", "feature", "sums_to_one")


@register("run_summary")
def q_run_summary(spark, sf_dir):
    """Per model CV and test metrics, its report and matrix on the test split, the
    chosen model, dataset size, the test success rate, and the chosen model's top-5
    features."""
    res = _job(spark, sf_dir)
    test = res.metrics.filter(F.col("split") == "test").drop("split")
    cv = M.cv_table(spark, res.trained).select("model", "cv_mean", "cv_std")
    held = res.predictions.filter(F.col("split") == "test")
    report = E.classification_report(held).groupBy("model").agg(F.sort_array(F.collect_list(
        F.struct("class_label", "precision", "recall", "f1_score", "support"))).alias("report"))
    matrix = E.confusion_matrix(held).select("model", F.struct("tn", "fp", "fn", "tp").alias("matrix"))
    top5 = (res.importance.filter(F.col("model") == res.best)
            .orderBy(F.desc(F.abs("importance")), "feature").limit(5)
            .agg(F.array_sort(F.collect_list("feature")).alias("top_features")))
    return (cv.join(test, "model", "left").join(report, "model", "left").join(matrix, "model", "left")
            .withColumn("is_best", F.col("model") == F.lit(res.best))
            .withColumn("dataset_rows", F.lit(res.n_rows))
            .withColumn("success_rate", F.lit(res.test_success_rate))
            .crossJoin(F.broadcast(top5)))


@register("run_summary_checks", O.with_roles(*SPLIT_CTES, body=f"""
select m.model, (select count(*) from sp) as dataset_rows, count(*) as n,
       round(avg(is_successful), 9) as success_rate, 4 as report_rows, true as matrix_adds_up, 5 as top_features
from sp, (values {_MODELS_SQL}) as m(model) where split = 'test' group by m.model"""))
def q_run_summary_checks(spark, sf_dir):
    cells = F.col("matrix.tn") + F.col("matrix.fp") + F.col("matrix.fn") + F.col("matrix.tp")
    return q_run_summary(spark, sf_dir).select(
        "model", "dataset_rows", "n", F.round("success_rate", 9).alias("success_rate"),
        F.size("report").alias("report_rows"), (cells == F.col("n")).alias("matrix_adds_up"),
        F.size("top_features").alias("top_features"))


def _score_checks(scored: DataFrame) -> DataFrame:
    """Per student: do the derived columns agree with the stored probability?"""
    p = F.col("success_probability")
    tier = S.risk_columns(p)
    size = F.size("recommendations")
    least = F.coalesce(*[F.when(F.col("risk_level") == t[1], F.lit(len(t[3]))) for t in fixed.RISK_TIERS])
    return scored.select(
        F.col("student_id").cast("long").alias("student_id"),
        (F.abs(p + F.col("failure_probability") - 1) < 1e-9).alias("sums_to_one"),
        (F.col("predicted_success") == (p > 0.5)).alias("class_agrees"),
        ((F.col("risk_level") == tier["risk_level"]) & (F.col("confidence") == tier["confidence"])).alias("tier_agrees"),
        size.between(least, least + 2).alias("list_agrees"))


@register("scored")
def q_scored(spark, sf_dir):
    """P10: every stored student, scored."""
    return J.score_students(spark, sf_dir, _job(spark, sf_dir))


@register("scored_coverage", O.with_roles(body="""
select student_id, true as sums_to_one, true as class_agrees, true as tier_agrees, true as list_agrees from students"""))
def q_scored_coverage(spark, sf_dir):
    """P10: one row per stored student, whose columns agree with its probability."""
    return _score_checks(q_scored(spark, sf_dir))


@register("scored_external")
def q_scored_external(spark, sf_dir):
    """The accepted scoring requests, scored (``request_validation`` has the refused)."""
    return J.score_requests(spark, roles.prediction_requests(spark, sf_dir), _job(spark, sf_dir))[0]


@register("scored_external_checks", O.with_roles(O.REQUESTS, body=f"""
select student_id, true as sums_to_one, true as class_agrees, true as tier_agrees, true as list_agrees
from requests where {_reason_sql(_request_rule_sql())} is null"""))
def q_scored_external_checks(spark, sf_dir):
    return _score_checks(q_scored_external(spark, sf_dir))


from . import extended  # noqa: E402,F401  (registers its queries)
