"""Sinks: overwrite / append entity tables and create empty ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .tables import ENTITY_SCHEMAS


def overwrite_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Replace the table at ``path`` with ``df`` (Parquet, atomic per job).

    The write is a distributed job: each task writes its own files; a lost
    executor's tasks are re-run and the commit protocol discards partial
    output.
    """
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def append_rows(df: DataFrame, path: str) -> str:
    """Append rows to the Parquet table at ``path``."""
    df.write.mode("append").parquet(path)
    return path


def create_tables(spark: SparkSession, location: str, database: str | None = None) -> list[str]:
    """``CREATE TABLE IF NOT EXISTS ... USING parquet`` for each entity
    from its declared schema; returns the table names."""
    names = []
    prefix = f"{database}." if database else ""
    if database:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, schema in ENTITY_SCHEMAS.items():
        cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {prefix}{name} ({cols}) USING parquet "
                  f"LOCATION '{location.rstrip('/')}/{name}'")
        names.append(prefix + name)
    return names


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str,
                  mode: str = "overwrite") -> str:
    """Save ``df`` as a catalog table bucketed and sorted by ``key``.

    Two tables bucketed the same way on the join key are joined and grouped
    without a shuffle (the scan already delivers the hash partitioning).
    """
    (df.write.mode(mode).format("parquet").bucketBy(buckets, key).sortBy(key)
     .option("path", path).saveAsTable(table))
    return table
