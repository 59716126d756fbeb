"""Session construction and shared-folder helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings we want on every session we build ourselves.  On a cluster the
# deployment supplies master, memory and partition counts; AQE re-plans the
# shuffles at runtime (coalescing small partitions, splitting skewed ones).
_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # delete checkpoint files once their DataFrame is garbage-collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "cohortkit", extra: dict | None = None,
                  driver_memory: str = "12g") -> SparkSession:
    # Python workers of a local session import this package too, whatever folder the driver was started in
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    os.environ["PYTHONPATH"] = os.pathsep.join([root, *(p for p in known if p != root)])
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master.startswith("local"):
        # local mode runs every task in the driver JVM; its heap is the only memory knob
        conf["spark.driver.memory"] = driver_memory
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the deployment must name a shared folder there.  Only a local
    session without one, as in tests, gets a folder of our own, which is deleted
    when the process ends.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="cohortkit-ckpt-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def shared_path(spark: SparkSession, *parts: str, unique: bool = False) -> str:
    """A path under the shared checkpoint folder for written tables and models."""
    own = ensure_checkpoint_dir(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or own
    path = os.path.join(root, "cohortkit", *parts)
    if unique:
        path = os.path.join(path, uuid.uuid4().hex)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a reliable ``checkpoint()``
    into the shared folder.

    The frame is persisted first, so that the checkpoint job writes the cached
    blocks instead of computing the plan again; later readers (and tasks re-run
    after an executor loss) read the checkpoint files.
    """
    ensure_checkpoint_dir(df.sparkSession)
    cached = df.persist()
    out = cached.checkpoint(eager=True)
    cached.unpersist(blocking=False)
    return out
