"""Indicators of an arriving student table (Structured Streaming).

New student rows arrive as files in a folder; the KPI row (A14) and the at-risk
counts per major (A13) are streaming aggregations whose state is one row, or one
row per major, however many rows arrive.  Every batch replaces a small Parquet
snapshot that reports read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.expr import percent
from ..sources.tables import STUDENT_SCHEMA

REFRESH_SECONDS = 300


def student_stream(spark: SparkSession, folder: str, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(STUDENT_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.parquet(folder)


def kpi_stream(students: DataFrame, gpa_threshold: float = fixed.DEFAULT_GPA_THRESHOLD) -> DataFrame:
    """A14 as a running aggregate over a student stream."""
    total, active = F.count(F.lit(1)), F.count_if(F.col("is_active"))
    return students.agg(
        total.alias("total_students"), active.alias("active_students"),
        F.avg("gpa").alias("average_gpa"),
        F.count_if(F.col("gpa") < F.lit(gpa_threshold)).alias("at_risk_count"),
        percent(active, total).alias("retention_rate"))


def at_risk_by_major_stream(students: DataFrame,
                            gpa_threshold: float = fixed.DEFAULT_GPA_THRESHOLD) -> DataFrame:
    """A13 as a running aggregate: at-risk students per (non-NULL) major."""
    return (students.filter((F.col("gpa") < F.lit(gpa_threshold)) & F.col("major").isNotNull())
            .groupBy("major").agg(F.count(F.lit(1)).alias("count")))


def start_refresh(df: DataFrame, snapshot: str, checkpoint_location: str, once: bool = False,
                  seconds: int = REFRESH_SECONDS):
    """Keep the indicators of a stream as a Parquet snapshot at ``snapshot``.

    ``checkpoint_location`` (under the shared checkpoint folder) keeps the
    aggregation state and source offsets, so a restarted query resumes
    where it stopped.  ``once`` processes what is available and stops.
    """
    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(snapshot)

    w = (df.writeStream.outputMode("complete").foreachBatch(replace)
         .option("checkpointLocation", checkpoint_location))
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime=f"{seconds} seconds")
    return w.start()
