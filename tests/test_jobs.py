import pytest
from pyspark.sql import functions as F

from cohortkit import session
from cohortkit.operators import features as X
from cohortkit.operators import scoring as S
from cohortkit.plans import jobs
from cohortkit.sources import roles

SF = "/root/testdata/sf0.001"
GRIDS = {"logistic_regression": {"C": [1.0, 10.0]},
         "random_forest": {"numTrees": [3], "maxDepth": [2, 3], "minInstancesPerNode": [1], "featureSubsetStrategy": ["sqrt"]}}


@pytest.fixture(scope="module")
def result(spark):
    return jobs.train_job(spark, SF, jobs.JobConfig(grids=GRIDS, folds=2, partitions=2))


def test_default_search_is_the_full_one():
    cfg = jobs.JobConfig()
    sizes = {}
    for name, axes in cfg.grids.items():
        sizes[name] = 1
        for values in axes.values():
            sizes[name] *= len(values)
    assert sizes == {"logistic_regression": 4, "random_forest": 162, "gradient_boosting": 72} and cfg.folds == 5


def test_a_run_is_found_again_and_another_config_is_not(spark, result, monkeypatch):
    cfg = jobs.JobConfig(grids=GRIDS, folds=2, partitions=2)
    monkeypatch.setattr(jobs.M, "train_models", lambda *a, **k: pytest.fail("trained again"))
    again = jobs.train_job(spark, SF, cfg)
    assert again.path == result.path and again.best == result.best
    assert again.metrics.count() == 4 and again.importance.count() == 52
    assert jobs.run_id(spark, SF, jobs.JobConfig(grids=GRIDS, folds=3)) != jobs.run_id(spark, SF, cfg)


def test_a_published_run_whose_files_are_gone_is_passed_over(spark, result, tmp_path):
    listed = str(tmp_path / "published")
    assert jobs.found_run(spark, listed) is None
    spark.createDataFrame([(str(tmp_path / "gone"),)], "value string").write.text(listed)
    assert jobs.found_run(spark, listed) is None
    spark.createDataFrame([(result.path,)], "value string").write.mode("append").text(listed)
    assert jobs.found_run(spark, listed).path == result.path


def test_metrics_history_grows(spark, result):
    rows = spark.read.parquet(session.shared_path(spark, "metrics_history"))
    assert rows.select("run_id").distinct().count() >= 1
    assert rows.filter(F.col("run_id") == result.path.rsplit("/", 2)[-2]).count() == 4


def test_every_stored_student_is_scored(spark, result):
    students = roles.students(spark, SF)
    scored = jobs.score_students(spark, SF, result)
    assert scored.select("student_id").distinct().count() == scored.count() == students.count()
    idle = students.filter(~F.col("is_active")).select("student_id").limit(3)
    assert jobs.score_students(spark, SF, result, keys=idle).count() == 3


def test_a_cohort_without_one_major_keeps_the_codes(spark, result):
    codes = dict(map(tuple, result.classes.collect()))
    majors = sorted(codes)
    features = jobs.feature_frame(spark, SF, result.as_of, everyone=True)
    part = features.filter(F.col("major") != majors[0])
    got = {r.major: r.code for r in S.align_features(part, ["major_encoded"], result.classes).join(
        part.select("student_id", "major"), "student_id").select("major", F.col("major_encoded").alias("code")).distinct().collect()}
    assert got == {m: float(codes[m]) for m in majors[1:]}
    other = features.limit(1).withColumn("major", F.lit("Astrology"))
    assert S.align_features(other, ["major_encoded"], result.classes).first().major_encoded == len(codes)
    with pytest.raises(ValueError, match="class table"):
        S.align_features(part, ["major_encoded"])


def test_requests_are_validated_before_scoring(spark, result):
    requests = roles.prediction_requests(spark, SF)
    scored, rejected = jobs.score_requests(spark, requests, result)
    assert scored.count() + rejected.count() == requests.count()
    assert rejected.count() > 0 and rejected.filter(F.col("reject_reason").isNull()).count() == 0
    assert scored.filter(~F.col("success_probability").between(0, 1)).count() == 0


def test_requests_are_scored_with_a_model_of_every_training_row(spark, monkeypatch):
    """More members than the 10,000 rows that models were once fitted with."""
    members = X.engineered_table(*[roles.role_views(spark, SF)[i] for i in (0, 2, 1)], X.DEFAULT_AS_OF)
    times = 17_000 // members.count() + 1
    many = members.crossJoin(spark.range(times).withColumnRenamed("id", "_i")).withColumn(
        "student_id", F.col("student_id") + 1_000_000 * F.col("_i")).drop("_i")
    monkeypatch.setattr(jobs, "feature_frame", lambda *a, **k: many)
    grids = {"gradient_boosting": {"maxIter": [2], "stepSize": [0.1], "maxDepth": [2]}}
    res = jobs.train_job(spark, SF, jobs.JobConfig(grids=grids, folds=2))
    rows = spark.read.parquet(f"{res.path}/split").filter("split = 'train'").count()
    model = res.trained[res.best].model
    assert rows > 10_000 and (model.nodes.query("depth == 0").n == rows).all()
    scored, _ = jobs.score_requests(spark, roles.prediction_requests(spark, SF), res)
    assert scored.count() > 0 and scored.filter(~F.col("success_probability").between(0, 1)).count() == 0


def test_too_many_classes_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(X, "MAX_CLASSES", 3)
    df = spark.createDataFrame([(i, f"m{i}") for i in range(5)], "student_id long, major string")
    with pytest.raises(Exception, match="more than 3 values"):
        X.encode_major(df).collect()


def test_building_a_report_runs_no_job(spark):
    from cohortkit.plans import queries
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("build-only", "build-only")
    try:
        df = queries.q_heuristic_score(spark, SF)
        assert not tracker.getJobIdsForGroup("build-only")
        scans = [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "customer" in line]
        assert scans and all("c_name" not in line.split("ReadSchema")[-1] for line in scans)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_cluster_needs_a_shared_checkpoint_folder(monkeypatch):
    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_a_hot_student_is_dealt_over_tasks(spark):
    from cohortkit.functions.joins import salted_semi_join
    fact = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("v"))
    keys = spark.createDataFrame([(1,), (7,), (1,), (99,)], "k long")
    got = salted_semi_join(fact, keys, "k", 8)
    want = fact.filter(F.col("k").isin(1, 7))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    salts = fact.filter("k = 1").select(F.pmod(F.xxhash64("k", "v"), F.lit(8)).alias("s")).distinct().count()
    assert salts == 8
