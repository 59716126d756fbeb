"""Relational database as a source (S3).

A partitioned JDBC read: ``numPartitions`` tasks each read one range of
``column`` between ``lower`` and ``upper``; filters and projections on the
result are pushed into the database's SQL.  Not exercised by the tests:
no database runs in this environment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None,
              lower: int | None = None, upper: int | None = None, num_partitions: int = 8,
              properties: dict | None = None, fetch_size: int = 10000) -> DataFrame:
    reader = (spark.read.format("jdbc").option("url", url).option("dbtable", table)
              .option("fetchsize", str(fetch_size)))
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    if column is not None:
        if lower is None or upper is None:
            raise ValueError("a partitioned read needs lower and upper bounds")
        reader = (reader.option("partitionColumn", column).option("lowerBound", str(lower))
                  .option("upperBound", str(upper)).option("numPartitions", str(num_partitions)))
    return reader.load()
