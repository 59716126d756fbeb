"""The training-corpus pipeline: five stages from ``documents`` to packed sequences.

1. quality rules      documents that the rules reject go
2. line dedup         of near-equal lines one stays; the texts shrink
3. SimHash            of each group of near-duplicate documents one stays
4. mixing             whole texts are repeated, or cut to blocks, by source quotas
5. packing            the mixed texts become sequences of at most 1024 tokens

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``.  The first four return the
columns of ``documents``.  Defined cases: those of the operators; of the group
that the SimHash stage keeps one row of, it is the one with the smallest ``doc_id``
(NULL comes last; of one ``doc_id`` with several texts the smallest hash of both, of
equal rows one); a document whose lines all go stays with an empty text until mixing, where nothing
of it is left to take.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cohortkit.llm import line_dedup, mixing, packing, quality_rules, simhash  # noqa: E402
from cohortkit.llm.common import read_table, whole_row, written  # noqa: E402

TOKENIZER = "byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(docs, read_table(spark, sf_dir, "labels"))
    return judged.filter("kept").select("_row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group: smallest ``doc_id`` (NULL last), then smallest row key."""
    keyed = line_dedup.with_row_key(docs.select(whole_row(docs).alias("_row"), "doc_id", "text"))
    groups = simhash.near_duplicates(keyed.select(F.col("rid").alias("doc_id"), "text")).select(
        F.col("doc_id").alias("rid"), "component_id").distinct()
    named = groups.join(keyed.select("rid", "doc_id").distinct(), "rid")
    stay = written(named.groupBy("component_id").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("last"), "doc_id", "rid")).alias("at")).select(F.col("at.rid").alias("rid")), "simhash-stay")
    # of rows equal in doc_id and text, the one whose other columns have the smallest hash
    others = F.xxhash64(F.to_json(F.struct(F.lit(0), *[F.col("_row").getField(c).alias(f"c{i}") for i, c in enumerate(docs.columns)
                                                       if c not in ("doc_id", "text")])))
    one = keyed.join(stay, "rid", "left_semi").groupBy("rid").agg(F.min_by("_row", others).alias("_row"))
    return one.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality rules", quality), ("line dedup", lines), ("SimHash near-dedup", near_duplicates),
          ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, "pipeline")
    return docs


# Packing places pieces by first-fit over a tournament tree, which SQL cannot state;
# tests/llm/test_pipeline.py holds every stage against a plain version.
ORACLE_SQL = None
