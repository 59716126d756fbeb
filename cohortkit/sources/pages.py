"""Deep pages (O1) over a sorted layout.

``write_sorted`` lays a table out by a composite key (NULL first): range partitions,
sorted inside, one file each, and a directory with every file's first key, rows and
running offset.  A page then reads only the files it lies in, however deep it is:

* ``page_at`` finds the files by offset in the directory;
* ``page_after`` continues after a key (a cursor): a keyset predicate over the key's
  columns, which also reaches the scan, and the file where the key lies with as many
  after it as the page can need.

The key must be a total order (add an id), or rows of one key may change places between
pages.  The directory has one row a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..llm.common import freed, written

FILE_ROWS = 500_000      # rows of a file at most, about: a task sorts one


def sort_keys(order: list[str]) -> list[Column]:
    return [F.asc_nulls_first(c) for c in order]


def write_sorted(df: DataFrame, path: str, order: list[str], files: int) -> str:
    """Write ``df`` under ``path`` in about ``files`` sorted files, with their directory.

    There are more files if one would hold over ``FILE_ROWS`` rows, so the memory of a task that
    sorts one does not grow with the table.  The rows are written unsorted first: counting them and
    sampling their key reads files instead of computing ``df`` again."""
    spark = df.sparkSession
    rows = written(df, "unsorted-pages")
    files = max(files, -(-rows.count() // FILE_ROWS))
    rows.repartitionByRange(files, *sort_keys(order)).sortWithinPartitions(*sort_keys(order)).write.mode("overwrite").parquet(f"{path}/rows")
    freed(rows)
    # struct comparison puts NULL first, as the layout does
    found = (spark.read.schema(df.schema).parquet(f"{path}/rows").select(F.input_file_name().alias("file"), *order).groupBy("file")
             .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("first")))
    before = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)        # one row a file
    (found.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
     .coalesce(1).write.mode("overwrite").parquet(f"{path}/directory"))
    return path


def _files(spark: SparkSession, path: str, files: list[str]) -> DataFrame:
    schema = spark.read.parquet(f"{path}/rows").schema
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def page_at(spark: SparkSession, path: str, order: list[str], skip: int, limit: int) -> DataFrame:
    """Rows skip .. skip + limit of the layout."""
    at = (spark.read.parquet(f"{path}/directory").filter((F.col("start") < skip + limit) & (F.col("start") + F.col("n") > skip))
          .orderBy("start").select("file", "start").collect())         # the files that the page lies in
    rows = _files(spark, path, [r["file"] for r in at])
    return rows.orderBy(*sort_keys(order)).offset(skip - at[0]["start"] if at else 0).limit(limit)


def after(order: list[str], key: dict) -> Column:
    """Rows whose key comes after ``key`` (NULL first)."""
    out, same = F.lit(False), F.lit(True)
    for c in order:
        v = F.lit(key[c])
        greater = F.col(c).isNotNull() if key[c] is None else F.col(c) > v
        out = out | (same & greater)
        same = same & (F.col(c).isNull() if key[c] is None else F.col(c) == v)
    return F.coalesce(out, F.lit(False))


def page_after(spark: SparkSession, path: str, order: list[str], key: dict | None, limit: int) -> DataFrame:
    """The next ``limit`` rows after the row with ``key``; from the beginning if it is None."""
    if key is None:
        return page_at(spark, path, order, 0, limit)
    directory = spark.read.parquet(f"{path}/directory")
    place = F.struct(*[F.lit(key[c]).cast(directory.schema["first"].dataType[c].dataType).alias(c) for c in order])
    home = directory.filter(F.col("first") <= place).agg(F.max("start").alias("start")).first()["start"]
    if home is None:
        return page_at(spark, path, order, 0, limit)
    # the file with the key can hold no row after it, so as many rows as the page has come from later files
    own = directory.filter(F.col("start") == home).first()
    at = directory.filter((F.col("start") >= home) & (F.col("start") < home + own["n"] + limit)).orderBy("start").select("file").collect()
    rows = _files(spark, path, [r["file"] for r in at])
    rows = rows.filter(after(order, key))
    if key[order[0]] is not None:
        rows = rows.filter(F.col(order[0]) >= F.lit(key[order[0]]))      # implied, and pushed to the scan
    return rows.orderBy(*sort_keys(order)).limit(limit)
