"""Connected components of an edge table by alternating large and small stars.

Each round points every node at the smallest node it can see: the large star
does so for a node's larger neighbours, the small star for its smaller ones.
Both are a grouped minimum and a join on the node, so a node of very high degree
is summed map-side and its joined rows are split by the adaptive skew join.
Every round is written to the shared folder, and the one before it deleted; the
driver sees two numbers a round.  The edges end as stars around each component's smallest node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed, written


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; root is the component's smallest node.

    Rows with a NULL end and loops link nothing and are left out; nodes without
    an edge do not appear.
    """
    cur = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
                  .distinct(), name)
    seen = _mark(cur)
    while seen[0]:
        both = cur.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(
            cur.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (large.join(least, "hi")
                 .select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")),
                                           F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
                 .select("e.hi", "e.lo").filter("hi <> lo").distinct())
        before, cur = cur, written(small, name)
        freed(before)
        now = _mark(cur)
        if now == seen:
            break
        seen = now
    roots = cur.select(F.col("lo").alias("node")).distinct()
    out = cur.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionAll(
        roots.select("node", F.col("node").alias("root")))
    out.written_path = cur.written_path        # the files it reads, for ``freed``
    return out
