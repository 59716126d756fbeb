import pytest
from pyspark.sql import functions as F

from cohortkit.operators import browse as B
from cohortkit.operators import features as X
from cohortkit.operators import nesting as N
from cohortkit.operators import rollups as A
from cohortkit.operators import upkeep as U
from cohortkit.sources import pages as P


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# --- deep pages ---

ORDER = ["a", "b", "id"]


@pytest.fixture(scope="module")
def layout(spark, tmp_path_factory):
    df = spark.range(40_000).select(F.when(F.col("id") % 7 != 0, F.col("id") % 50).alias("a"), F.when(F.col("id") % 11 != 3, F.concat(F.lit("s"), F.col("id") % 13)).alias("b"),
                                    "id", (F.col("id") * 2).alias("v"))
    path = P.write_sorted(df, str(tmp_path_factory.mktemp("pages")), ORDER, 16)
    return df.orderBy(*P.sort_keys(ORDER)).collect(), path


@pytest.mark.parametrize("skip,limit", [(0, 10), (3, 1), (20_000, 50), (39_980, 40), (40_000, 5), (12_345, 3000)])
def test_a_page_by_offset_reads_few_files(spark, layout, skip, limit):
    want, path = layout
    page = P.page_at(spark, path, ORDER, skip, limit)
    assert page.collect() == want[skip:skip + limit]
    assert len(page.inputFiles()) <= 2 + limit // 2000


@pytest.mark.parametrize("at", [0, 1, 4999, 5714, 5715, 20_000, 39_990, 39_999])
def test_the_next_page_by_its_cursor(spark, layout, at):
    want, path = layout
    page = P.page_after(spark, path, ORDER, {c: want[at][c] for c in ORDER}, 25)
    assert page.collect() == want[at + 1:at + 26]
    assert len(page.inputFiles()) <= 3


def test_cursors_between_rows_and_at_the_ends(spark, layout):
    want, path = layout
    assert P.page_after(spark, path, ORDER, None, 5).collect() == want[:5]
    key = {"a": 7, "b": "s3x", "id": -1}
    later = [r for r in want if r["a"] is not None and (r["a"] > 7 or r["a"] == 7 and r["b"] is not None and (r["b"], r["id"]) > ("s3x", -1))]
    assert P.page_after(spark, path, ORDER, key, 30).collect() == later[:30]
    assert P.page_after(spark, path, ORDER, {"a": 99, "b": None, "id": 0}, 5).collect() == []
    plan = P.page_after(spark, path, ORDER, key, 30)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(a" in plan


def test_pages_of_an_empty_table(spark, tmp_path):
    path = P.write_sorted(spark.createDataFrame([], "a int, b string, id long"), str(tmp_path), ORDER, 4)
    assert P.page_at(spark, path, ORDER, 0, 5).collect() == [] == P.page_after(spark, path, ORDER, {"a": 1, "b": "x", "id": 2}, 5).collect()


# --- child lists ---

def test_a_hot_parent_is_split_and_nothing_is_lost(spark):
    child = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 100 == 1, F.lit(None)).otherwise(F.col("id") % 40).alias("k"),
                                     F.col("id").alias("v"), (F.col("id") % 5).alias("w"))
    lists = N.chunked_lists(child, "k", ["v", "w"], 50)
    found = lists.collect()
    assert max(r["n_items"] for r in found) <= 50 and all(len(r["items"]) == r["n_items"] for r in found)
    assert all(r["items"] == sorted(r["items"]) for r in found)
    assert len({r["part"] for r in found if r["k"] == 1}) > 40
    assert rows(N.flattened(lists, "k")) == rows(child.filter("k IS NOT NULL"))
    assert len({(r["k"], r["part"], r["chunk"]) for r in found}) == len(found)
    assert N.chunked_lists(child.limit(0), "k", ["v"], 50).collect() == []


# --- upkeep ---

def test_states_with_retractions_equal_a_full_run(spark, tiny):
    students, courses, enrollments = tiny
    whole = X.student_features_base(students, enrollments, courses)
    first = enrollments.filter("enrollment_id IN ('E1', 'E2', 'E4', 'E6')")
    gone = spark.createDataFrame([("X1", 1, 10, None, "F", "Dropped"), ("X2", 5, 11, None, "A", "Completed")], enrollments.schema)
    stored = U.activity_states(first.unionAll(gone), courses)
    delta = U.activity_states(enrollments.subtract(first), courses)
    states = U.merged_states(stored, delta, U.activity_states(gone, courses, taken_back=True))
    got = U.features_of_states(students, states)
    assert got.columns == whole.columns and rows(got) == rows(whole)
    assert 5 not in [r["student_id"] for r in states.collect()]              # only rows that were taken back
    serving = X.serving_features(students, enrollments).select("student_id", *X.COUNT_COLUMNS)
    assert rows(U.serving_counts(students, states)) == rows(serving)


# --- SQL text with parameters ---

def test_values_are_parameters_and_never_text(spark, tiny):
    students, _, _ = tiny
    text = "SELECT student_id FROM {s} WHERE major = :major OR array_contains(:ids, student_id) ORDER BY student_id"
    got = B.run_sql(spark, text, {"s": students}, {"major": "Math' OR 'a' = 'a", "ids": [3, 5]})
    assert [r[0] for r in got.collect()] == [3, 5]
    assert B.run_sql(spark, "SELECT count(*) AS n FROM {t}", {"t": students}).first()["n"] == 5


# --- sketches ---

def test_sketched_medians_stay_within_the_rank_error(spark):
    students = spark.range(60_000).select(F.col("id").alias("student_id"), (F.col("id") % 4).alias("major"), (F.col("id") % 3).alias("year_level"),
                                          (F.sin(F.col("id") * 1.7) * 2 + 2).alias("gpa"), F.lit(True).alias("is_active"))
    sketches = A.gpa_sketches(students, ["major", "year_level"])
    assert sketches.count() == 12
    for r in A.sketched_medians(sketches, ["major"]).collect():
        below = students.filter((F.col("major") == r["major"]) & (F.col("gpa") <= r["median_gpa"])).count()
        assert r["n_students"] == 15_000 and abs(below / 15_000 - 0.5) <= A.SKETCH_RANK_ERROR


def test_ranked_numbers_a_whole_roll_up_or_the_first_rows(spark):
    df = spark.range(250).select(F.col("id").alias("v"))
    assert B.ranked(df, ["v"], None).count() == 250
    assert [tuple(r) for r in B.ranked(df, [F.desc("v")], 2).orderBy("position").collect()] == [(249, 1), (248, 2)]
