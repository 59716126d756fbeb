"""Data quality and table maintenance.

All checks are joins and aggregations: key uniqueness is a ``groupBy``
count, orphans are ``left_anti`` joins, refused inserts ``left_semi``.
De-duplication keeps the first row of each key by a total order with a
``min(struct(...))`` aggregate, which combines map-side, so a hot key
never has all its rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table with its row count (one union of counts)."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count"))
             .select(F.lit(name).alias("table_name"), "row_count")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _range_check(c: str, lo, hi, nullable: bool = True) -> tuple[Column, str]:
    x = F.col(c)
    ok = (x >= F.lit(lo)) & (x <= F.lit(hi))
    ok = (x.isNull() | ok) if nullable else (x.isNotNull() & ok)
    return ok, f"{c} must be between {lo} and {hi}"


def _required(c: str) -> tuple[Column, str]:
    return F.col(c).isNotNull(), f"{c} is required"


def _at_least(c: str, lo, nullable: bool = False) -> tuple[Column, str]:
    x = F.col(c)
    ok = x >= F.lit(lo)
    ok = (x.isNull() | ok) if nullable else (x.isNotNull() & ok)
    return ok, f"{c} must be >= {lo}"


def student_rules() -> list[tuple[Column, str]]:
    """Constraints of a student record: id, names and email required, year 1..4
    and gpa 0..4 when given."""
    return [
        _required("student_id"), _required("first_name"), _required("last_name"), _required("email"),
        _range_check("year_level", *fixed.YEAR_LEVEL_RANGE),
        _range_check("gpa", *fixed.GPA_BOUNDS),
    ]


def prediction_request_rules(columns: list[str] | None = None) -> list[tuple[Column, str]]:
    """Constraints of a caller-supplied feature row: gpa 0..4, year 1..4,
    counts >= 0, rates 0..100 (required: gpa, year, total, completed,
    dropped, completion rate).  Rules of optional columns that are not among
    ``columns`` are left out."""
    has = lambda c: columns is None or c in columns
    rules = [_range_check("gpa", *fixed.GPA_BOUNDS, nullable=False),
             _range_check("year_level", *fixed.YEAR_LEVEL_RANGE, nullable=False)]
    for c in ("total_enrollments", "completed_courses", "dropped_courses"):
        rules.append(_at_least(c, 0))
    for c in ("current_enrollments", "excellent_grades", "good_grades", "average_grades", "poor_grades"):
        if has(c):
            rules.append(_at_least(c, 0, nullable=True))
    rules.append(_range_check("completion_rate", *fixed.RATE_BOUNDS, nullable=False))
    for c in ("drop_rate", "excellence_rate", "struggle_rate"):
        if has(c):
            rules.append(_range_check(c, *fixed.RATE_BOUNDS))
    return rules


def validate_rows(df: DataFrame, rules: list[tuple[Column, str]] = None) -> DataFrame:
    """Each row with ``is_valid`` and ``reject_reason`` (the failed rule
    messages joined by '; ', NULL when valid)."""
    rules = rules if rules is not None else student_rules()
    fails = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(msg)) for ok, msg in rules]
    reasons = F.array_compact(F.array(*fails))
    return (df.withColumn("_reasons", reasons)
            .withColumn("is_valid", F.size("_reasons") == 0)
            .withColumn("reject_reason",
                        F.when(F.size("_reasons") > 0, F.array_join("_reasons", "; ")))
            .drop("_reasons"))


def split_valid(df: DataFrame, rules=None) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with reasons)."""
    v = validate_rows(df, rules)
    return (v.filter("is_valid").drop("is_valid", "reject_reason"),
            v.filter(~F.col("is_valid")))


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first by ``order`` then every other column.

    ``min(struct(order..., rest...))`` is an ordinary aggregate: partial
    aggregation keeps one candidate per key per task before the shuffle.
    Struct comparison puts NULL fields first.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    fields = order + rest
    best = F.min(F.struct(*[F.col(c).alias(c) for c in fields])).alias("_first")
    return (df.groupBy(*keys).agg(best)
            .select(*keys, *[F.col(f"_first.{c}").alias(c) for c in fields])
            .select(*df.columns))


def dedupe_pairs(enrollments: DataFrame, keys=("student_id", "course_id"),
                 order=("enrollment_id",)) -> DataFrame:
    """One enrollment per (student, course) pair, the first by id."""
    return first_per_key(enrollments, list(keys), list(order))


def mark_new_keys(target: DataFrame, batch: DataFrame, key: str, inserted_at: str | None = None,
                  order: list[str] | None = None) -> DataFrame:
    """S8 in one pass: the batch's first row per key (by ``order``) with ``outcome``
    'inserted' or 'refused' and, if asked for, ``inserted_at`` of the inserted ones.

    The batch is aggregated once and the target's keys are read once: one left
    join with a flag decides both outcomes.
    """
    b = first_per_key(batch, [key], [c for c in (order or []) if c != key])
    existing = target.select(F.col(key).alias("_key")).distinct().withColumn("_old", F.lit(True))
    out = (b.join(existing, F.col(key) == F.col("_key"), "left")
           .withColumn("outcome", F.when(F.col("_old"), "refused").otherwise("inserted")).drop("_key", "_old"))
    if inserted_at is not None:
        stamp = F.expr(f"TIMESTAMP_NTZ'{inserted_at}'")
        out = out.withColumn("inserted_at", F.when(F.col("outcome") == "inserted", stamp))
    return out


def append_new_keys(target: DataFrame, batch: DataFrame, key: str, inserted_at: str | None = None,
                    order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, refused rows), the two parts of ``mark_new_keys``."""
    marked = mark_new_keys(target, batch, key, inserted_at, order)
    new = marked.filter(F.col("outcome") == "inserted").drop("outcome")
    refused = marked.filter(F.col("outcome") == "refused").drop("outcome", "inserted_at")
    return new, refused


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias("occurrences"))
            .filter(F.col("occurrences") > 1))


def orphan_rows(child: DataFrame, parent: DataFrame, fk: str, pk: str | None = None) -> DataFrame:
    """Child rows whose foreign key has no parent row (NULL keys are not orphans)."""
    pk = pk or fk
    p = parent.select(F.col(pk).alias(fk))
    return child.filter(F.col(fk).isNotNull()).join(p, fk, "left_anti")


def orphan_report(child: DataFrame, parents: dict[str, DataFrame]) -> DataFrame:
    """Per foreign key, rows checked and orphan rows.

    The child is read once: its keys are counted per (foreign key, value) before
    anything is joined, so a hot key is one row, and the distinct values then meet
    the parents' keys in one anti-join.  Keys are compared as text when their types
    differ between the foreign keys.
    """
    names = list(parents)
    kinds = {child.schema[n].dataType.simpleString() for n in names}
    kind = kinds.pop() if len(kinds) == 1 else "string"
    entries = F.explode(F.array(*[F.struct(F.lit(n).alias("foreign_key"), F.col(n).cast(kind).alias("value")) for n in names]))
    counted = (child.select(entries.alias("e")).select("e.*")
               .groupBy("foreign_key", "value").agg(F.count(F.lit(1)).alias("n")))
    keys = None
    for n in names:
        k = parents[n].select(F.lit(n).alias("foreign_key"), F.col(n).cast(kind).alias("value"))
        keys = k if keys is None else keys.unionAll(k)
    lost = (counted.filter(F.col("value").isNotNull()).join(keys, ["foreign_key", "value"], "left_anti")
            .select("foreign_key", F.lit(0).cast("long").alias("n"), F.col("n").alias("lost")))
    every = child.sparkSession.createDataFrame([(n, 0, 0) for n in names], "foreign_key string, n long, lost long")
    return (counted.select("foreign_key", "n", F.lit(0).cast("long").alias("lost")).unionAll(lost).unionAll(every)
            .groupBy("foreign_key").agg(F.sum("n").alias("checked_rows"), F.sum("lost").alias("orphan_rows")))


def listed_tables(spark, database: str | None = None, only: list[str] | None = None) -> DataFrame:
    """The tables and views that the catalog lists, with their row counts."""
    found = {t.name: spark.table(f"{database}.{t.name}" if database and not t.isTemporary else t.name)
             for t in (spark.catalog.listTables(database) if database else spark.catalog.listTables())
             if only is None or t.name in only}
    if not found:
        return spark.createDataFrame([], "table_name string, row_count long")
    return table_counts(found)
