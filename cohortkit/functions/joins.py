"""Joins of a large, possibly skewed fact to a dimension.

By default the dimension join is left to Spark: broadcast when the
dimension's estimated size is under ``spark.sql.autoBroadcastJoinThreshold``,
else a sort-merge join whose hot partitions AQE splits at run time
(``spark.sql.adaptive.skewJoin.enabled``).  ``salted_join`` is the explicit
form for clusters that run without AQE, or when one key is known to hold a
large share of the fact: each fact row gets a salt in [0, salts) from a hash
of its own columns (deterministic, so a re-run task produces the same
salts), the dimension rows are replicated once per salt, and the join key
becomes (key, salt).  A hot key is then spread over ``salts`` tasks, at the
cost of ``salts`` copies of the (small) dimension.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salted_join(fact: DataFrame, dim: DataFrame, key: str, salts: int, how: str = "left",
                salt_from: list[str] | None = None) -> DataFrame:
    """``fact JOIN dim USING (key)`` with the key salted ``salts`` ways.

    ``salt_from`` names the fact columns hashed into the salt (default: all
    fact columns).  ``how`` is 'inner' or 'left' (the fact side is kept).
    """
    if how not in ("inner", "left"):
        raise ValueError("salted_join supports inner and left joins with the fact on the left")
    if salts <= 1:
        return fact.join(dim, key, how)
    cols = salt_from or fact.columns
    salted_fact = fact.withColumn("_salt", F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int"))
    salted_dim = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted_fact.join(salted_dim, [key, "_salt"], how).drop("_salt")


def salted_semi_join(fact: DataFrame, keys: DataFrame, key: str, salts: int) -> DataFrame:
    """The rows of ``fact`` whose ``key`` is in ``keys``, a hot key over ``salts`` tasks.

    The keys are de-duplicated and repeated once per salt.  The key and salt also
    give both sides an exchange of their own right below the join, which is what
    lets AQE split a partition that is skewed all the same.
    """
    wide = keys.select(key).distinct().withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(max(1, salts) - 1))))
    salted = fact.withColumn("_salt", F.pmod(F.xxhash64(*fact.columns), F.lit(max(1, salts))).cast("int"))
    return salted.join(wide, [key, "_salt"], "left_semi").drop("_salt")


def dimension_join(fact: DataFrame, dim: DataFrame, key: str, how: str = "left",
                   salts: int | None = None) -> DataFrame:
    """Join a dimension to the fact: Spark's choice (broadcast or AQE-split
    sort-merge) unless ``salts`` asks for an explicit salted join."""
    if salts and salts > 1:
        return salted_join(fact, dim, key, salts, how)
    return fact.join(dim, key, how)
