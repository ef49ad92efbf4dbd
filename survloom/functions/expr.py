"""Small column expressions with the null and zero rules of the toolkit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add, mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clip(value: Column, low: float, high: float) -> Column:
    """Limit to [low, high]; null stays null (greatest and least would skip it)."""
    return F.when(value < low, F.lit(low)).when(value > high, F.lit(high)).otherwise(value)


def clamp_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Negative codes (unknown, missing) become 0."""
    named = {c: F.when(F.col(c) < 0, 0).otherwise(F.col(c)) for c in columns}
    return df.withColumns(named)


def signed_time(time: Column, event: Column) -> Column:
    """Time with the sign of its event: negative when censored, null without event flag."""
    return F.when(event == 0, -time).when(event.isNotNull(), time)


def unsigned_time(signed: Column) -> tuple[Column, Column]:
    """(time, event) of a signed time."""
    return F.abs(signed), (signed > 0).cast("int")


def columns_with_prefix(df: DataFrame, prefix: str) -> list[str]:
    """Column names that start with ``prefix``, sorted."""
    return sorted(c for c in df.columns if c.startswith(prefix))


def sum_of(columns: Sequence[str]) -> Column:
    """Row sum in which null counts as 0."""
    return reduce(add, [F.coalesce(F.col(c), F.lit(0)) for c in columns])


def product_of(columns: Sequence[str]) -> Column:
    """Row product; one null makes it null."""
    return reduce(mul, [F.col(c) for c in columns])


def joined_text(columns: Sequence[str], separator: str) -> Column:
    """Text of the columns with separators; one null makes it null (unlike concat_ws)."""
    parts = [p for c in columns for p in (F.lit(separator), F.col(c).cast("string"))]
    return F.concat(*parts[1:])


def crossed_text(columns: Sequence[str]) -> Column:
    """Text of the columns without separator, null written as ``NULL``."""
    return F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in columns])


def mean_of(columns: Sequence[str]) -> Column:
    """Mean across columns of one row; null if any is null."""
    return reduce(add, [F.col(c) for c in columns]) / F.lit(float(len(columns)))


def weighted_mean(weights: Mapping[str, float]) -> Column:
    """Weighted mean across columns of one row."""
    total = float(sum(weights.values()))
    return reduce(add, [F.col(c) * F.lit(float(w)) for c, w in weights.items()]) / F.lit(total)


def nonconstant_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """The columns that hold at least two distinct non-null values.

    Comparing the extremes decides this in one pass without keeping the values.
    """
    row = df.agg(*[(F.min(c) < F.max(c)).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]
