"""Registered queries over stored layouts, states and models: versioned tables (S4, S8), deep
pages (O1), chunked child lists (J7), upkeep of features (A10, A11), SQL text with parameters
(S2), sketched medians (A19) and boosted trees of all rows (M4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import browse as B
from ..operators import features as X
from ..operators import nesting as N
from ..operators import rollups as A
from ..operators import trees as T
from ..operators import upkeep as U
from ..session import shared_path
from ..sources import pages as P
from ..sources import roles
from ..sources.versions import VersionedTable
from . import oracle as O
from .registry import register

FEATURE_CTES = O.FEATURE_CTES
STUDENT = "student_id, first_name, last_name, email, major, year_level, gpa, enrollment_date, is_active"


def _table(spark, name: str) -> VersionedTable:
    return VersionedTable(spark, shared_path(spark, "tables", name, unique=True))


# --- S4, S8: versioned tables ---------------------------------------------------

@register("overwrite_from_itself", O.with_roles(body=f"""
select student_id, first_name, last_name, email, coalesce(major, 'Undeclared') as major, year_level, gpa, enrollment_date,
       is_active and coalesce(gpa >= 1.0, true) as is_active
from students where student_id % 9 <> 4"""))
def q_overwrite_from_itself(spark, sf_dir):
    """A table replaced by rows computed from it, twice."""
    table = _table(spark, "students")
    table.overwrite(roles.students(spark, sf_dir))
    table.overwrite(table.read().filter(F.col("student_id") % 9 != 4))
    table.overwrite(table.read().withColumns({
        "major": F.coalesce("major", F.lit("Undeclared")),
        "is_active": F.col("is_active") & F.coalesce(F.col("gpa") >= 1.0, F.lit(True))}))
    return table.read()


INSERT_BATCHES = {"b1": "student_id % 3 = 0 or student_id % 5 = 1", "b2": "student_id % 2 = 0", "b3": "student_id % 7 = 3"}


@register("insert_once", O.with_roles(f"""
b1 as (select * from students where student_id % 3 = 1),
b2 as (select * from students where ({INSERT_BATCHES['b1']}) and student_id not in (select student_id from b1)),
b3 as (select * from students where ({INSERT_BATCHES['b2']}) and student_id not in (select student_id from b1)
       and student_id not in (select student_id from b2))""", body=f"""
select {STUDENT}, '' as origin from b1
union all select {STUDENT}, 'b1' as origin from b2
union all select {STUDENT}, 'b2' as origin from b3"""))
def q_insert_once(spark, sf_dir):
    """Overlapping batches, one of them given twice and one retried after its rows were staged; every
    key is inserted once, by the first batch that holds it."""
    students = roles.students(spark, sf_dir)
    table = _table(spark, "students")
    table.overwrite(students.filter("student_id % 3 = 1").withColumn("origin", F.lit("")))
    batch = lambda name: students.filter(INSERT_BATCHES[name]).withColumn("origin", F.lit(name))
    table.insert_once(batch("b1"), "student_id", "b1")
    table.insert_once(batch("b1"), "student_id", "b1")
    table._write(batch("b2"), None)                          # a try that was lost before it was published
    table.insert_once(batch("b2"), "student_id", "b2")
    table.insert_once(batch("b3"), "student_id", "b1")       # another batch under a known name: nothing
    table.prune(keep=1)
    return table.read()


# --- O1: deep pages -------------------------------------------------------------

PAGE_ORDER = ["grade", "student_id", "enrollment_id", "course_id"]
DEEP_SKIP, PAGE_ROWS = 4000, 150


@register("enrollments_deep_pages", O.with_roles(f"""
ordered as (
  select grade, student_id, enrollment_id, course_id, status,
         row_number() over (order by grade nulls first, student_id nulls first, enrollment_id, course_id) as position
  from enrollments)""", body=f"""
select case when position <= {DEEP_SKIP + PAGE_ROWS} then 1 else 2 end as page, grade, student_id, enrollment_id, course_id, status
from ordered where position > {DEEP_SKIP} and position <= {DEEP_SKIP + 2 * PAGE_ROWS}"""))
def q_enrollments_deep_pages(spark, sf_dir):
    """O1: a page deep in the sorted enrollments by its offset, and the next one by the last key seen."""
    columns = [*PAGE_ORDER, "status"]
    path = P.write_sorted(roles.enrollments(spark, sf_dir).select(*columns), shared_path(spark, "tables", "pages", unique=True),
                          PAGE_ORDER, int(spark.conf.get("spark.sql.shuffle.partitions")))
    first = P.page_at(spark, path, PAGE_ORDER, DEEP_SKIP, PAGE_ROWS)
    last = first.orderBy(*[F.desc_nulls_last(c) for c in PAGE_ORDER]).select(*PAGE_ORDER).first()
    both = first.select(F.lit(1).alias("page"), *columns)
    if last is None:
        return both
    return both.unionAll(P.page_after(spark, path, PAGE_ORDER, last.asDict(), PAGE_ROWS).select(F.lit(2).alias("page"), *columns))


# --- J7: child lists ------------------------------------------------------------

LIST_ITEMS = ["enrollment_id", "course_id", "status"]
LIST_MAX = 25


def _lists_sql(key: str) -> str:
    text = "concat_ws('|', enrollment_id, coalesce(course_id::varchar, '~'), coalesce(status, '~'))"
    return O.with_roles(f"""
kept as (select {key}, {', '.join(LIST_ITEMS)}, count(*) over (partition by {key}) as n from enrollments where {key} is not null),
parts as (
  select *, case when n <= {LIST_MAX} then 0
                 else ('0x' || substr(md5({text}), 1, 8))::bigint % ceil(2.0 * n / {LIST_MAX})::bigint end as part from kept),
placed as (
  select *, (row_number() over (partition by {key}, part order by {', '.join(LIST_ITEMS)}) - 1) // {LIST_MAX} as chunk from parts)""", body=f"""
select {key}, part, chunk::bigint as chunk, count(*) as n_items,
       string_agg(enrollment_id || '/' || course_id || '/' || status, ',' order by {', '.join(LIST_ITEMS)}) as items
from placed group by {key}, part, chunk""")


def _lists(spark, sf_dir, key):
    lists = N.chunked_lists(roles.enrollments(spark, sf_dir), key, LIST_ITEMS, LIST_MAX)
    return lists.withColumn("items", F.array_join(F.transform(
        "items", lambda i: F.concat_ws("/", *[i[c].cast("string") for c in LIST_ITEMS])), ","))


@register("student_enrollment_lists", _lists_sql("student_id"))
def q_student_enrollment_lists(spark, sf_dir):
    """The enrollments of each student as lists of bounded length."""
    return _lists(spark, sf_dir, "student_id")


@register("course_enrollment_lists", _lists_sql("course_id"))
def q_course_enrollment_lists(spark, sf_dir):
    """The enrollments of each course as lists of bounded length."""
    return _lists(spark, sf_dir, "course_id")


@register("enrollment_lists_flattened", O.with_roles(body="select student_id, enrollment_id, course_id, status from enrollments where student_id is not null"))
def q_enrollment_lists_flattened(spark, sf_dir):
    """The lists hold every enrollment once."""
    return N.flattened(N.chunked_lists(roles.enrollments(spark, sf_dir), "student_id", LIST_ITEMS, LIST_MAX), "student_id")


# --- A10, A11: upkeep -----------------------------------------------------------

UPKEEP_CUT = "TIMESTAMP_NTZ'1995-01-01 00:00:00'"


def _states(spark, sf_dir):
    """Stored states of a first part of the enrollments, some rows of it recorded with a wrong status and
    grade, merged with a delta: later rows, the wrong rows taken back, the right ones added."""
    s, c, e = roles.role_views(spark, sf_dir)
    old, wrong = F.col("enrollment_date") < F.expr(UPKEEP_CUT), F.col("course_id") % 11 == 5
    mistaken = e.filter(old & wrong).withColumns({"status": F.lit("Dropped"), "grade": F.lit(None).cast("string")})
    path = shared_path(spark, "states", unique=True)
    U.activity_states(e.filter(old & ~wrong).unionByName(mistaken), c).write.parquet(path)
    stored = spark.read.parquet(path)
    return s, U.merged_states(stored, U.activity_states(e.filter(~old), c), U.activity_states(mistaken, c, taken_back=True),
                              U.activity_states(e.filter(old & wrong), c))


@register("student_features_upkeep", O.with_roles(O.FEATURES_BASE, body="select * from features_base"))
def q_student_features_upkeep(spark, sf_dir):
    """A10: stored states and a delta with retractions equal the features of the whole fact."""
    s, states = _states(spark, sf_dir)
    return U.features_of_states(s, states)


@register("serving_counts_upkeep", O.with_roles(*O.SERVING_CTES, body=f"""
select student_id, {', '.join(X.COUNT_COLUMNS)} from serving_rates"""))
def q_serving_counts_upkeep(spark, sf_dir):
    """The serving counters from the same states."""
    return U.serving_counts(*_states(spark, sf_dir))


# --- S2: SQL text with parameters -------------------------------------------------

STATUS_SQL = """
SELECT s.major, e.grade, count(*) AS enrollments, count(DISTINCT e.student_id) AS students
FROM {enrollments} e JOIN {students} s ON e.student_id = s.student_id
WHERE e.status = :status AND s.gpa BETWEEN :low AND :high AND array_contains(:years, s.year_level)
GROUP BY s.major, e.grade HAVING count(*) >= :least
"""


@register("sql_parameters", O.with_roles(body="""
select s.major, e.grade, count(*) as enrollments, count(distinct e.student_id) as students
from enrollments e join students s on e.student_id = s.student_id
where e.status = 'Completed' and s.gpa between 1.0 and 3.0 and s.year_level in (1, 3)
group by s.major, e.grade having count(*) >= 2"""))
def q_sql_parameters(spark, sf_dir):
    """caller's SQL text over frames, its values as parameters."""
    return B.run_sql(spark, STATUS_SQL, {"enrollments": roles.enrollments(spark, sf_dir), "students": roles.students(spark, sf_dir)},
                     {"status": "Completed", "low": 1.0, "high": 3.0, "years": [1, 3], "least": 2})


# --- A19: medians from stored sketches --------------------------------------------

@register("gpa_median_sketches", O.with_roles("""
vals as (select major, year_level, gpa as v from students where is_active and gpa is not null),
ranked as (select *, row_number() over (partition by major order by v) - 1 as rn, count(*) over (partition by major) as n from vals)""", body="""
select major, max(n) as n_students, true as rank_within_bound from ranked group by major"""))
def q_gpa_median_sketches(spark, sf_dir):
    """The median by major from quantile sketches stored by major and year, held against the exact ranks."""
    students = roles.students(spark, sf_dir)
    path = shared_path(spark, "sketches", unique=True)
    A.gpa_sketches(students, ["major", "year_level"]).write.parquet(path)
    medians = A.sketched_medians(spark.read.parquet(path), ["major"])
    s = students.filter(F.col("is_active") & F.col("gpa").isNotNull()).alias("s")
    ranks = s.join(medians.alias("m"), F.col("s.major").eqNullSafe(F.col("m.major"))).groupBy("m.major", "m.n_students", "m.median_gpa").agg(
        F.count_if(F.col("gpa") < F.col("median_gpa")).alias("below"), F.count_if(F.col("gpa") <= F.col("median_gpa")).alias("upto"))
    slack = A.SKETCH_RANK_ERROR * F.col("n_students") + 1
    return ranks.select("major", "n_students", ((F.col("below") <= F.col("n_students") / 2 + slack)
                                                & (F.col("upto") >= F.col("n_students") / 2 - slack)).alias("rank_within_bound"))


# --- M4: boosting over all rows, level by level ------------------------------------

BOOST_EDGES = {"gpa": [0.25 * i for i in range(1, 16)], "completion_rate": [5.0 * i + 2.5 for i in range(1, 19)],
               "drop_rate": [5.0 * i + 2.5 for i in range(0, 12)], "total_enrollments": [5.5 * i for i in range(1, 30)]}
BOOST_ROUNDS, BOOST_DEPTH, BOOST_RATE = 3, 2, 0.3


def _boost_sql() -> str:
    """Each round's tree in SQL: histograms of the open nodes, the best split of each, a step down, the leaves."""
    code = ", ".join(f"len(list_filter([{', '.join(f'{e!r}::double' for e in cuts)}], lambda e: e < {f}::double))" for f, cuts in BOOST_EDGES.items())
    ctes = ["base as (select student_id, is_successful::double as label, [" + code + "] as codes from features)",
            "prior as (select avg(label) as m from base)",
            "r0 as (select student_id, label, codes, ln(m / (1 - m)) as z from base, prior)"]
    for t in range(BOOST_ROUNDS):
        ctes.append(f"t{t}_0 as (select *, label - 1 / (1 + exp(-z)) as target, 1::bigint as node from r{t})")
        for d in range(BOOST_DEPTH + 1):
            rows = f"t{t}_{d}"
            ctes.append(f"""c{t}_{d} as (
  select node, f, b, count(*)::double as c, sum(target) as s
  from (select node, target, unnest(codes) as b, unnest(range(len(codes))) as f from {rows} where node >= {2 ** d}) group by all)""")
            ctes.append(f"""w{t}_{d} as (
  select *, sum(c) over u as wl, sum(s) over u as sl, sum(c) over p as wt, sum(s) over p as st from c{t}_{d}
  window u as (partition by node, f order by b), p as (partition by node, f))""")
            ctes.append(f"""g{t}_{d} as (
  select *, case when wl >= 1 and wt - wl >= 1 then round(sl * sl / wl + (st - sl) * (st - sl) / (wt - wl) - st * st / wt, 9) end as gain
  from w{t}_{d})""")
            ctes.append(f"""s{t}_{d} as (
  select g.node, max(wt) as n, max(case when g.f = 0 then st end) / max(wt) as value,
         max(way.gain) as gain, max(way.f) as f, max(way.b) as b
  from g{t}_{d} g left join (
    select node, gain, f, b from g{t}_{d} where gain > 0 qualify row_number() over (partition by node order by gain desc, f, b) = 1) way
    on g.node = way.node group by g.node)""")
            if d < BOOST_DEPTH:
                ctes.append(f"""t{t}_{d + 1} as (
  select r.* exclude (node), case when s.f is not null and s.n >= 2 then 2 * r.node + (codes[s.f + 1] > s.b)::bigint else r.node end as node
  from {rows} r left join s{t}_{d} s on r.node = s.node)""")
        last = f"t{t}_{BOOST_DEPTH}"
        ctes.append(f"""l{t} as (
  select node, case when sum((label - target) * (1 - label + target)) > 1e-150
                    then sum(target) / sum((label - target) * (1 - label + target)) else 0 end as step from {last} group by node)""")
        ctes.append(f"r{t + 1} as (select student_id, label, codes, z + {BOOST_RATE} * step as z from {last} join l{t} using (node))")
        names = "[" + ", ".join(f"'{f}'" for f in BOOST_EDGES) + "]"
        parts = [f"select {d} as depth, * from s{t}_{d}" for d in range(BOOST_DEPTH + 1)]
        ctes.append(f"""n{t} as (
  select {t} as tree, s.node, n::bigint as n, round(coalesce(step, value), 6) as value,
         case when step is null then round(gain, 6) end as gain, case when step is null then {names}[f + 1] end as feature,
         case when step is null then b end as bin
  from ({' union all '.join(parts)}) s left join l{t} on s.node = l{t}.node)""")
    return O.with_roles(*FEATURE_CTES, *ctes, body=" union all ".join(f"select * from n{t}" for t in range(BOOST_ROUNDS)))


@register("boosting_rounds", _boost_sql())
def q_boosting_rounds(spark, sf_dir):
    """M4: the trees of a boosting grown over all labelled rows by one grouped aggregate a level."""
    s, c, e = roles.role_views(spark, sf_dir)
    ft = X.engineered_table(s, e, c)
    rows = ft.select(F.col("student_id").alias("key"), F.col("is_successful").cast("double").alias("label"), T.bin_codes(ft, BOOST_EDGES).alias("codes"))
    _, trees, _ = T.boost_table(rows, BOOST_ROUNDS, BOOST_DEPTH, BOOST_RATE)
    names = list(BOOST_EDGES)
    out = [(t, n, int(k), round(v, 6), None if leaf else round(g, 6), None if leaf else names[f], None if leaf else b)
           for t, tree in enumerate(trees) for n, (k, v, g, f, b, leaf) in tree.items()]
    return spark.createDataFrame(out, "tree int, node long, n long, value double, gain double, feature string, bin long")
