"""Readers for the driver's Parquet tables and the three entity schemas."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

DRIVER_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

# Declared entity schemas (the role views produce exactly these columns).
STUDENT_SCHEMA = T.StructType([
    T.StructField("student_id", T.LongType(), False),
    T.StructField("first_name", T.StringType(), True),
    T.StructField("last_name", T.StringType(), True),
    T.StructField("email", T.StringType(), True),
    T.StructField("major", T.StringType(), True),
    T.StructField("year_level", T.IntegerType(), True),
    T.StructField("gpa", T.DoubleType(), True),
    T.StructField("enrollment_date", T.TimestampNTZType(), True),
    T.StructField("is_active", T.BooleanType(), True),
])

COURSE_SCHEMA = T.StructType([
    T.StructField("course_id", T.LongType(), False),
    T.StructField("course_name", T.StringType(), True),
    T.StructField("department", T.StringType(), True),
    T.StructField("credits", T.IntegerType(), True),
    T.StructField("course_type", T.StringType(), True),
    T.StructField("max_enrollment", T.IntegerType(), True),
    T.StructField("semester", T.StringType(), True),
    T.StructField("year", T.IntegerType(), True),
])

ENROLLMENT_SCHEMA = T.StructType([
    T.StructField("enrollment_id", T.StringType(), False),
    T.StructField("student_id", T.LongType(), True),
    T.StructField("course_id", T.LongType(), True),
    T.StructField("enrollment_date", T.TimestampNTZType(), True),
    T.StructField("grade", T.StringType(), True),
    T.StructField("status", T.StringType(), True),
])

ENTITY_SCHEMAS = {
    "students": STUDENT_SCHEMA,
    "courses": COURSE_SCHEMA,
    "enrollments": ENROLLMENT_SCHEMA,
}


# Declared schemas of the driver tables the role views read: no schema
# inference job per read, and a changed file layout fails loudly.
DRIVER_SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": ("p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
             "p_retailprice double"),
    "orders": ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
               "o_orderdate timestamp_ntz, o_orderpriority string"),
    "lineitem": ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                 "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                 "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"),
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, with its declared schema when it has one.  Column
    pruning and filter pushdown reach the scan through Catalyst, so callers
    just ``select`` / ``filter`` what they need."""
    reader = spark.read
    if name in DRIVER_SCHEMAS:
        reader = reader.schema(DRIVER_SCHEMAS[name])
    return reader.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def read_entity(spark: SparkSession, path: str, entity: str) -> DataFrame:
    """An entity table stored as Parquet, read with its declared schema (no inference)."""
    return spark.read.schema(ENTITY_SCHEMAS[entity]).parquet(path)
