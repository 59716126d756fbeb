"""Reusable column expressions (all JVM-side, no Python UDFs)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import GRADE_POINTS


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num, den) -> Column:
    """num / den as double; 0.0 when den is 0 or either side is null.

    ANSI mode raises on division by zero, so ``try_divide`` guards it.
    """
    return F.coalesce(F.try_divide(col(num).cast("double"), col(den)), F.lit(0.0))


def percent(num, den) -> Column:
    """num / den * 100, 0.0 when the denominator is 0 (guarded rate)."""
    return safe_div(num, den) * F.lit(100)


def nan_to_null(c) -> Column:
    """NaN and +/-inf become NULL so that comparisons follow SQL rules.

    Spark orders NaN above every number (NaN >= 70 is true); turning it into
    NULL first makes ``coalesce(pred, false)`` treat it as unknown.
    """
    c = col(c)
    return F.when(F.isnan(c) | (c == F.lit(float("inf"))) | (c == F.lit(float("-inf"))),
                  F.lit(None).cast("double")).otherwise(c)


def clean_number(c) -> Column:
    """NULL, NaN and +/-inf become 0 (the feature table's final fill)."""
    c = col(c)
    if_bad = F.isnan(c) | (c == F.lit(float("inf"))) | (c == F.lit(float("-inf")))
    return F.when(if_bad, F.lit(0)).otherwise(F.coalesce(c, F.lit(0)))


def flag(pred: Column) -> Column:
    """Null-safe predicate as 0/1 integer (unknown counts as false)."""
    return F.coalesce(pred, F.lit(False)).cast("int")


def round_half_up(c, digits: int) -> Column:
    """floor(x * 10^d + 0.5) / 10^d: one rounding rule for Spark and SQL oracles."""
    scale = float(10 ** digits)
    return F.floor(col(c) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def sample_std(*cols) -> Column:
    """Row-wise sample standard deviation (ddof=1) over a fixed set of columns."""
    cs = [col(c).cast("double") for c in cols]
    n = len(cs)
    mean = reduce(lambda a, b: a + b, cs) / F.lit(float(n))
    sq = [(c - mean) * (c - mean) for c in cs]
    return F.sqrt(reduce(lambda a, b: a + b, sq) / F.lit(float(n - 1)))


def grade_point_tenths(grade) -> Column:
    """Grade points in integer tenths (A -> 40, A- -> 37, ...); NULL if unknown.

    Summing integers and dividing once gives the same average in every
    engine, whatever the row order; summing doubles does not.
    """
    g = col(grade)
    expr = None
    for letter, pts in GRADE_POINTS.items():
        tenths = int(round(pts * 10))
        expr = (F.when(g == letter, F.lit(tenths)) if expr is None
                else expr.when(g == letter, F.lit(tenths)))
    return expr


def null_label(c, default: str) -> Column:
    """Python-style ``x or default`` for strings: NULL and '' become default."""
    return F.coalesce(F.nullif(col(c), F.lit("")), F.lit(default))


def null_zero(c) -> Column:
    """Python-style ``x or 0`` for numbers: NULL becomes 0."""
    return F.coalesce(col(c), F.lit(0))
