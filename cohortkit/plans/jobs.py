"""End-to-end jobs: training (M11) and batch scoring.

Intermediate tables are written to the shared folder named by
``spark.checkpoint.dir`` and read back: that cuts the lineage, lets the
training, validation and test passes share one materialised split, and
means a lost executor re-reads files instead of recomputing the joins.

A finished run is found again by what it was made from: its folder is named by a
hash of the input files (path, length, modification time) and the configuration.
So several reports of one run train once, also across sessions, and changed files
or another configuration train anew.  A run writes to a folder of its own and is
published by one last file that names it, so two drivers that train the same run at
once never write, or read, each other's half.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import evaluation as E
from ..operators import features as X
from ..operators import quality as Q
from ..operators import scoring as S
from ..operators import training as M
from ..session import checkpointed, shared_path
from ..sources import roles

TABLES = ("customer", "part", "orders", "lineitem")


@dataclass
class JobConfig:
    grids: dict = field(default_factory=lambda: M.FULL_GRIDS)
    model_names: list | None = None
    folds: int = fixed.DEFAULT_CV_FOLDS
    partitions: int = M.PARTITIONS
    seed: int = fixed.DEFAULT_RANDOM_STATE
    test_size: float = fixed.DEFAULT_TEST_SIZE
    val_size: float = fixed.DEFAULT_VAL_SIZE
    select_on: str = "cv"          # "cv" (default), "validation" or "test"
    exclude: tuple = ()            # features to leave out (e.g. the label's inputs)
    as_of: str = X.DEFAULT_AS_OF


@dataclass
class JobResult:
    features: list
    trained: dict
    best: str
    metrics: DataFrame              # per (model, split) E1 metrics for validation and test
    path: str                       # the run's folder: split, predictions, metrics, importance, models
    n_rows: int
    success_rate: float             # over all rows
    test_success_rate: float        # over the test split
    as_of: str
    classes: DataFrame | None       # the fitted class table
    predictions: DataFrame | None = None    # held-out (model, key, label, score, prediction, split)
    importance: DataFrame | None = None     # (model, kind, feature, importance)
    grid: DataFrame | None = None           # every grid point with its CV mean


def feature_frame(spark: SparkSession, sf_dir: str, as_of: str = X.DEFAULT_AS_OF, everyone: bool = False) -> DataFrame:
    """The engineered, not yet encoded features of the members (or of every stored student)."""
    s, c, e = roles.role_views(spark, sf_dir)
    return X.engineered_table(s, e, c, as_of, everyone=everyone)


def run_id(spark: SparkSession, sf_dir: str, cfg: JobConfig) -> str:
    """Names a run by its input files and configuration; only file names and sizes are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(
        [f"{sf_dir}/{t}.parquet" for t in TABLES]).select(F.xxhash64("path", "length", "modificationTime").alias("h"))
    mark = files.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("h")).first()
    told = json.dumps([mark["n"], str(mark["h"]), asdict(cfg)], sort_keys=True, default=str)
    return hashlib.sha256(told.encode()).hexdigest()[:16]


def train_job(spark: SparkSession, sf_dir: str, cfg: JobConfig | None = None) -> JobResult:
    """Features -> split -> tune and fit -> evaluate -> importances -> save.

    Each new run's metrics are also appended to the history table (E11)."""
    cfg = cfg or JobConfig()
    run = run_id(spark, sf_dir, cfg)
    published = shared_path(spark, "published-runs", run)
    found = found_run(spark, published)
    if found is not None:
        return found
    path = shared_path(spark, "runs", run, unique=True)
    engineered = checkpointed(feature_frame(spark, sf_dir, cfg.as_of))
    classes = checkpointed(X.major_classes(engineered))
    ft = X.encode_major(engineered, classes=classes)
    feats = X.feature_columns(ft, exclude=cfg.exclude)
    split = M.stratified_split(X.feature_matrix(ft, feats), test_size=cfg.test_size, val_size=cfg.val_size)
    split.write.mode("overwrite").parquet(f"{path}/split")
    split = spark.read.parquet(f"{path}/split")
    in_test = F.when(F.col("split") == "test", F.col("is_successful"))
    stats = split.agg(F.count(F.lit(1)).alias("n"), F.avg("is_successful").alias("rate"),
                      F.avg(in_test).alias("test_rate")).first()

    trained = M.train_models(split.filter(F.col("split") == "train"), feats, grids=cfg.grids,
                             model_names=cfg.model_names, folds=cfg.folds, seed=cfg.seed,
                             partitions=cfg.partitions)
    held_out = split.filter(F.col("split").isin("validation", "test"))
    preds = None
    for name, t in trained.items():
        p = M.predictions(t.model, held_out, name, extra=["split"])
        preds = p if preds is None else preds.unionByName(p)
    preds.write.mode("overwrite").parquet(f"{path}/predictions")
    preds = spark.read.parquet(f"{path}/predictions")
    metrics = E.eval_metrics(preds, by=("model", "split"))      # one pass for both held-out parts
    metrics.write.mode("overwrite").parquet(f"{path}/metrics")
    metrics = spark.read.parquet(f"{path}/metrics")
    E.append_metrics(metrics, shared_path(spark, "metrics_history"), run)
    importance_rows(spark, trained, feats).write.mode("overwrite").parquet(f"{path}/importance")

    best = (M.best_by_cv(trained) if cfg.select_on == "cv" else
            E.best_model(metrics.filter(F.col("split") == cfg.select_on)).first()["model"])
    M.save_models(spark, trained, f"{path}/models", feats, metrics.filter(F.col("split") == "test"), classes, cfg.as_of)
    spark.createDataFrame(
        [(best, int(stats["n"]), float(stats["rate"] or 0.0), float(stats["test_rate"] or 0.0))],
        "best string, n_rows long, success_rate double, test_success_rate double"
    ).write.mode("overwrite").parquet(f"{path}/run")            # written last: it marks the run as finished
    spark.createDataFrame([(path,)], "value string").coalesce(1).write.mode("append").text(published)
    return load_run(spark, path)


def found_run(spark: SparkSession, published: str) -> JobResult | None:
    """The first published run whose files are still there."""
    try:
        paths = spark.read.text(published).orderBy("value").collect()        # one line a driver that trained it
    except AnalysisException:
        return None
    for r in paths:
        try:
            return load_run(spark, r["value"])
        except FileNotFoundError:
            continue
    return None


def importance_rows(spark: SparkSession, trained: dict, feats: list[str]) -> DataFrame:
    """E8 / E9 of every model: (model, kind, feature, importance); linear models give
    coefficients, trees importances."""
    out = spark.createDataFrame([], "model string, kind string, feature string, importance double")
    for name, t in trained.items():
        tree = E.tree_importance(spark, t.model, feats, name)
        if tree is not None:
            out = out.unionByName(tree.withColumn("kind", F.lit("importance")))
        linear = E.linear_importance(spark, t.model, feats, name)
        if linear is not None:
            out = out.unionByName(linear.select("model", "feature", F.lit("coefficient").alias("kind"),
                                                F.col("coefficient").alias("importance")))
    return out


def load_run(spark: SparkSession, path: str) -> JobResult:
    """A finished run from its folder; an absent or unfinished one is an error."""
    try:
        run = spark.read.parquet(f"{path}/run").first()
    except AnalysisException as ex:
        raise FileNotFoundError(f"No finished run at {path}") from ex
    saved = M.load_models(spark, f"{path}/models")
    rows = saved.table.collect()                                # a handful of models
    trained = {r["model"]: M.TrainedModel(
        name=r["model"], model=saved.models[r["model"]], cv_mean=r["cv_mean"], cv_std=r["cv_std"],
        best_params=json.loads(r["best_params"]), grid_size=r["grid_size"]) for r in rows}
    read = lambda part: spark.read.parquet(f"{path}/{part}")
    return JobResult(features=list(rows[0]["features"]), trained=trained, best=run["best"], metrics=read("metrics"),
                     path=path, n_rows=run["n_rows"], success_rate=run["success_rate"],
                     test_success_rate=run["test_success_rate"], as_of=saved.as_of, classes=saved.classes,
                     predictions=read("predictions"), importance=read("importance"), grid=saved.grid)


def _model_metrics(res: JobResult, name: str) -> dict:
    row = (res.metrics.filter((F.col("split") == "test") & (F.col("model") == name))
           .select("roc_auc", "accuracy").first())
    return {"roc_auc": row["roc_auc"], "accuracy": row["accuracy"]} if row else {}


def _chosen(res: JobResult, model_name: str | None) -> str:
    name = model_name or res.best
    if name not in res.trained:
        raise ValueError(f"Model '{name}' not found. Available: {sorted(res.trained)}")
    return name


def score_students(spark: SparkSession, sf_dir: str, res: JobResult, model_name: str | None = None,
                   keys: DataFrame | None = None) -> DataFrame:
    """Score every stored student (or those of ``keys``), inactive ones
    and those without enrollments included, with the chosen (or named) model.

    The features are the training ones, at the run's reference date; majors are
    encoded with the class table that was fitted with the models, never a new one.
    """
    name = _chosen(res, model_name)
    ft = feature_frame(spark, sf_dir, res.as_of, everyone=True)
    if keys is not None:
        ft = ft.join(keys.select("student_id").distinct(), "student_id", "left_semi")
    aligned = S.align_features(ft, res.features, res.classes)
    return S.score(res.trained[name].model, aligned, name, _model_metrics(res, name),
                   context=ft.select("student_id", "gpa", "drop_rate"))


def score_requests(spark: SparkSession, requests: DataFrame, res: JobResult, model_name: str | None = None):
    """Validate caller-supplied feature rows (S7), then align and score
    the valid ones; returns (scored, rejected with reasons)."""
    name = _chosen(res, model_name)
    valid, rejected = Q.split_valid(requests, Q.prediction_request_rules(requests.columns))
    aligned = S.align_features(valid, res.features, res.classes)
    ctx = valid.select("student_id", *[c for c in ("gpa", "drop_rate") if c in valid.columns])
    scored = S.score(res.trained[name].model, aligned, name, _model_metrics(res, name), context=ctx)
    return scored, rejected


def materialize_roles(spark: SparkSession, sf_dir: str, database: str = "cohort",
                      buckets: int = 64) -> dict:
    """Write the three role views once as tables: students and enrollments
    bucketed by ``student_id`` (so the per-student aggregation and the
    member join run without a shuffle), courses as a plain table.  The
    lineitem-orders join of the enrollments view runs once here instead of
    in every query.  Returns the table names by role."""
    from ..sources.sinks import save_bucketed

    root = shared_path(spark, "warehouse", database)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    s, c, e = roles.role_views(spark, sf_dir)
    names = {"students": f"{database}.students", "courses": f"{database}.courses",
             "enrollments": f"{database}.enrollments"}
    save_bucketed(s, names["students"], "student_id", buckets, f"{root}/students")
    save_bucketed(e, names["enrollments"], "student_id", buckets, f"{root}/enrollments")
    c.write.mode("overwrite").format("parquet").option("path", f"{root}/courses").saveAsTable(names["courses"])
    return names
