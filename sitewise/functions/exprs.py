"""Null-safe numeric and flag expressions."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def finite(value: Column | str) -> Column:
    """Double with NaN and infinities turned into null; -0.0 folds into 0.0."""
    number = as_column(value).try_cast("double")
    bad = F.isnan(number) | (F.abs(number) == F.lit(float("inf")))
    return F.when(~bad, number + F.lit(0.0))


def numeric(df: DataFrame, name: str, default: float | None = None) -> Column:
    """Numeric column by name; the default fills nulls and stands in for a missing column."""
    if name not in df.columns:
        return F.lit(default).cast("double")
    number = F.col(name).try_cast("double")
    return number if default is None else F.coalesce(number, F.lit(float(default)))


def col_or_default(df: DataFrame, name: str, default: Column) -> Column:
    return F.coalesce(F.col(name), default) if name in df.columns else default


def safe_divide(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient, null where the denominator is not positive or the result is not finite."""
    top, bottom = finite(numerator), finite(denominator)
    return finite(F.when(bottom > 0, top / bottom))


def pct(numerator: Column | str, denominator: Column | str) -> Column:
    return safe_divide(numerator, denominator) * F.lit(100.0)


def row_sum(df: DataFrame, columns: Sequence[str]) -> Column:
    """Horizontal sum. Null when a listed column is absent, or when every value is null."""
    if not columns or any(name not in df.columns for name in columns):
        return F.lit(None).cast("double")
    values = [F.col(name).try_cast("double") for name in columns]
    total = reduce(add, [F.coalesce(v, F.lit(0.0)) for v in values])
    return F.when(F.coalesce(*values).isNotNull(), total)


def row_mean(columns: Sequence[Column | str]) -> Column:
    """Horizontal mean over the non-null values."""
    values = [as_column(c) for c in columns]
    total = reduce(add, [F.coalesce(v, F.lit(0.0)) for v in values])
    present = reduce(add, [v.isNotNull().cast("int") for v in values])
    return F.when(present > 0, total / present)


def row_max(columns: Sequence[Column | str]) -> Column:
    """Horizontal maximum skipping nulls."""
    values = [as_column(c) for c in columns]
    return F.greatest(*values) if len(values) > 1 else values[0]


def clip(value: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """Bound a value; null stays null (``greatest``/``least`` would replace it)."""
    value = as_column(value)
    bounded = value
    if low is not None:
        bounded = F.greatest(bounded, F.lit(float(low)))
    if high is not None:
        bounded = F.least(bounded, F.lit(float(high)))
    return F.when(value.isNotNull(), bounded)


def clip01(value: Column | str) -> Column:
    return clip(value, 0.0, 1.0)


def saturate(value: Column | str, scale: float) -> Column:
    """x / (x + scale) on the non-negative part, nulls as 0."""
    x = F.greatest(F.coalesce(as_column(value).cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.lit(1.0) if scale <= 0 else x / (x + F.lit(float(scale)))


def share(numerator: Column | str, denominator: Column | str) -> Column:
    """Clipped quotient with zero/null denominators giving 0."""
    bottom = as_column(denominator).cast("double")
    return clip01(F.coalesce(finite(F.when(bottom != 0, as_column(numerator).cast("double") / bottom)), F.lit(0.0)))


# Everything that counts as white space in a cell: controls, no-break and typographic spaces.
WHITE_SPACE = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(value: Column | str) -> Column:
    """Text without white space of any kind at its ends."""
    return F.btrim(as_column(value).cast("string"), F.lit(WHITE_SPACE))


def boolish(value: Column | str) -> Column:
    """Text spelling of truth -> boolean; anything else, null included, is false."""
    text = F.lower(strip(value))
    return F.coalesce(text.isin("true", "1", "yes", "y", "t"), F.lit(False))


def first_nonblank(*values: Column | str) -> Column:
    """First value that is not null and not blank, otherwise null."""
    return F.coalesce(*[F.when(strip(v) != "", as_column(v)) for v in values])


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
