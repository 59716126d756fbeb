"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path

# The white space that separates words, as a regex class and as characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """The column of exactly this name, dots and back-ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame, columns: list[str] | None = None) -> Column:
    """All columns (or ``columns``) as one struct: carried that way, no input column can
    clash with those an operator adds."""
    return F.struct(*[column(c).alias(c) for c in columns or df.columns])


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    An expression used inside a lambda is otherwise evaluated again for every
    element; binding it as a lambda variable keeps the per-row cost linear.
    """
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text (maximal runs without white space); NULL has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words, as a long."""
    return F.size(words(text)).cast("long")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts the lineage with files that every executor can read, so a lost
    executor costs a re-read; the file sizes also give the planner true
    statistics for its broadcast decisions.
    """
    spark = df.sparkSession
    path = shared_path(spark, "llm", name, unique=True)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def freed(*frames: DataFrame) -> None:
    """Delete the files of frames that ``written`` gave, once everything made from them is written too."""
    for df in frames:
        path = getattr(df, "written_path", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def sql_crc32(bits: str) -> str:
    """DuckDB SQL of the CRC-32 of a message given as a list of its bits, each byte's lowest bit first.
    Fixed value: the reversed polynomial 0xEDB88320."""
    step = f"xor(a >> 1, {0xEDB88320}::BIGINT * ((a + b) % 2))"
    return f"xor(list_reduce(list_prepend({2**32 - 1}::BIGINT, {bits}), lambda a, b: {step}), {2**32 - 1}::BIGINT)"


def sql_bits(text: str) -> str:
    """DuckDB SQL of the bits of the UTF-8 form of ``text``, in the order that ``sql_crc32`` takes."""
    digits = f"hex(encode({text}))"
    nibble = f"(strpos('0123456789ABCDEF', substr({digits}, (2 - (i // 4) % 2 + (i // 8) * 2)::INT, 1)) - 1)"
    return f"list_transform(range(length({digits}) * 4), lambda i: (({nibble} >> (i % 4)::INT) & 1)::BIGINT)"
