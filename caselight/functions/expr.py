"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def number(col: str | Column, default: float | None = None) -> Column:
    """Numeric coercion: what is no number becomes NULL, then the default."""
    c = F.col(col) if isinstance(col, str) else col
    c = c.try_cast("double")
    c = F.when(~F.isnan(c), c)
    return c if default is None else F.coalesce(c, F.lit(float(default)))


def flag(col: str | Column) -> Column:
    """Boolean as 0/1 with NULL as 0."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("int"), F.lit(0))


def ladder(value: Column, steps) -> Column:
    """First label whose bound the value reaches, NULL below all of them."""
    out = None
    for bound, label in steps:
        cond = value >= F.lit(bound)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 for an empty denominator."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def whole_days(later: Column, earlier: Column) -> Column:
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86_400_000_000))


def same(left: list[Column], right: list[Column]) -> Column:
    """Null-safe equality of two key lists."""
    cond = F.lit(True)
    for a, b in zip(left, right):
        cond = cond & a.eqNullSafe(b)
    return cond
