"""Child lists of a foreign key (J7) in chunks of bounded length.

A parent's children become lists of at most ``max_items`` rows.  Children of a parent with
more of them are dealt to parts by a hash of the row first, so no task ever holds more
than a part of a hot parent's history; inside a part the rows are sorted and cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ITEMS = 1000


def row_number_of(*columns: str) -> Column:
    """A number of 32 bits from the MD5 of the columns' texts; equal in every engine that has MD5."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def chunked_lists(child: DataFrame, key: str, items: list[str], max_items: int = MAX_ITEMS) -> DataFrame:
    """(key, part, chunk, n_items, items): lists of structs of ``items``, sorted by them; NULL keys are left out.

    A parent with n children has one part if n <= max_items, else ceil(2 n / max_items), of which each is
    expected to be half full; a part that exceeds ``max_items`` becomes several chunks.
    """
    child = child.filter(F.col(key).isNotNull()).select(key, *[c for c in items if c != key])
    many = (child.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_items)
            .select(F.col(key).alias("_key"), F.ceil(2 * F.col("_n") / max_items).cast("long").alias("_parts")))
    part = F.when(F.col("_parts").isNull(), F.lit(0)).otherwise(row_number_of(*items) % F.col("_parts")).cast("long")
    lists = (child.join(many, F.col(key) == F.col("_key"), "left").withColumn("part", part).groupBy(key, "part")
             .agg(F.sort_array(F.collect_list(F.struct(*items))).alias("_all")))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("_all") - 1) / max_items).cast("int")),
                      lambda i: F.slice("_all", i * max_items + 1, max_items))
    return lists.select(key, "part", F.posexplode(cut).alias("chunk", "items")).select(
        key, "part", F.col("chunk").cast("long").alias("chunk"), F.size("items").cast("long").alias("n_items"), "items")


def flattened(lists: DataFrame, key: str) -> DataFrame:
    """The rows of chunked lists again."""
    rows = lists.select(key, F.explode("items").alias("_i"))
    names = [f.name for f in rows.schema["_i"].dataType.fields if f.name != key]
    return rows.select(key, *[F.col(f"_i.{c}").alias(c) for c in names])
