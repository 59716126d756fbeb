"""Distributed order statistics: running sums over a sorted key and exact median.

A window ``ORDER BY`` without ``PARTITION BY`` runs in a single task, and a
window partitioned by a few groups (models, labels) runs in a few tasks.
Both would hold all rows of a group in one task.  ``running_sums`` splits
the order key into quantile buckets instead:

1. the rows are range-partitioned by the order key (Spark samples the bounds
   while the plan runs) and checkpointed with their partition as bucket;
2. per (group, bucket) totals -- at most groups x buckets rows -- and their
   running offsets with a small window;
3. a window inside each (group, bucket) for the within-bucket running sum,
   plus the bucket's offset.

The number of buckets is the caller's, or the session's number of shuffle
partitions, so it grows with the cluster.  Results are exact; only the load
balance depends on the sampled bounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpointed

def _in_buckets(df: DataFrame, order_col: str, buckets: int | None) -> DataFrame:
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, F.col(order_col)).withColumn("_rs_bucket", F.spark_partition_id())
    return checkpointed(placed)      # both passes below must see the same buckets


def running_sums(df: DataFrame, order_col: str, value_cols: list[str],
                 partition_cols: list[str] | tuple = (), buckets: int | None = None) -> DataFrame:
    """For each row, ``<v>_before`` = sum of ``v`` over rows of the same
    partition with a smaller ``order_col``, and ``<v>_total`` = partition sum.

    ``df`` must hold one row per (partition, order value) -- group first.
    Rows with a NULL order value are dropped.
    """
    pc = list(partition_cols)
    df = df.filter(F.col(order_col).isNotNull())
    b = _in_buckets(df, order_col, buckets)
    totals = b.groupBy(*pc, "_rs_bucket").agg(*[F.sum(v).alias(f"_rs_{v}_b") for v in value_cols])
    w_off = (Window.partitionBy(*pc).orderBy("_rs_bucket")
             .rowsBetween(Window.unboundedPreceding, -1))
    w_all = Window.partitionBy(*pc)
    offsets = totals.select(
        *pc, "_rs_bucket",
        *[F.coalesce(F.sum(f"_rs_{v}_b").over(w_off), F.lit(0)).alias(f"_rs_{v}_off") for v in value_cols],
        *[F.sum(f"_rs_{v}_b").over(w_all).alias(f"{v}_total") for v in value_cols],
    )
    w_in = (Window.partitionBy(*pc, "_rs_bucket").orderBy(order_col)
            .rowsBetween(Window.unboundedPreceding, -1))
    j = b.join(offsets, [*pc, "_rs_bucket"], "inner")
    out = j.withColumns({
        f"{v}_before": F.coalesce(F.sum(v).over(w_in), F.lit(0)) + F.col(f"_rs_{v}_off")
        for v in value_cols
    })
    return out.drop("_rs_bucket", *[f"_rs_{v}_off" for v in value_cols])


def exact_median(df: DataFrame, col: str, buckets: int | None = None) -> DataFrame:
    """One-row frame with the exact median of ``col`` (average of the two
    middle values for an even count; NULL for no values).

    Values are grouped first (a hot value becomes one row), then located by
    distributed running counts; no group of rows is collected.
    """
    vals = df.select(F.col(col).alias("_v")).filter(F.col("_v").isNotNull())
    counts = vals.groupBy("_v").agg(F.count(F.lit(1)).alias("_c"))
    rs = running_sums(counts, "_v", ["_c"], buckets=buckets)
    n = F.col("_c_total")
    lo = F.floor((n - F.lit(1)) / F.lit(2))
    hi = F.ceil((n - F.lit(1)) / F.lit(2))
    start, end = F.col("_c_before"), F.col("_c_before") + F.col("_c") - F.lit(1)
    hits = rs.select(
        F.when((start <= lo) & (lo <= end), F.col("_v")).alias("_lo_v"),
        F.when((start <= hi) & (hi <= end), F.col("_v")).alias("_hi_v"),
    )
    return hits.agg(((F.max("_lo_v") + F.max("_hi_v")) / F.lit(2.0)).alias("median"))
