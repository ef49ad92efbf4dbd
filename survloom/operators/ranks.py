"""Exact ranks, quantiles and rank statistics from distinct values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from survloom.operators.prefix import (
    key_column,
    key_fields,
    running_sums,
    with_range,
)
from survloom.settings import keep


def value_ranks(df: DataFrame, value: str, *, keys: Sequence[str] = ()) -> DataFrame:
    """One row per (keys, value): ``ties``, ``below`` (smaller rows), ``below_total``, ``avg_rank``."""
    present = df.filter(F.col(value).isNotNull())
    counted = present.groupBy(*keys, F.col(value)).agg(F.count(F.lit(1)).alias("ties"))
    ranked = running_sums(counted, [value], {"below": F.col("ties")}, keys=keys, totals=True)
    return ranked.withColumn("avg_rank", F.col("below") + (F.col("ties") + 1) / F.lit(2.0))


def normalized_rank(df: DataFrame, value: str, out: str, *, keys: Sequence[str] = ()) -> DataFrame:
    """Average rank scaled to [0, 1] within ``keys``; null values stay null.

    The top value's own rank is ``n - (ties - 1) / 2``: ties at the top make the
    denominator smaller, and they map to 1.
    """
    ranks = keep(value_ranks(df, value, keys=keys))
    top = ranks.groupBy(key_column(keys).alias("_k")).agg(F.max("avg_rank").alias("_top"))
    scaled = (
        ranks.withColumn("_k", key_column(keys))
        .join(top, "_k")
        .select(
            "_k",
            F.col(value).alias("_value"),
            F.try_divide(F.col("avg_rank") - 1, F.col("_top") - 1).alias(out),
        )
    )
    rows = df.withColumn("_k", key_column(keys))
    same = (rows["_k"] == scaled["_k"]) & (rows[value] == scaled["_value"])
    return rows.join(scaled, same, "left").select(*df.columns, out)


def roc_auc(df: DataFrame, event: str, pred: str, *, keys: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve per ``keys`` (ties count one half).

    Null when one class is missing. Rows without event or prediction are left out.
    """
    present = df.filter(F.col(event).isNotNull() & F.col(pred).isNotNull())
    counted = present.groupBy(*keys, F.col(pred).cast("double").alias("_p")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.when(F.col(event) == 1, 1).otherwise(0)).alias("_pos"),
    )
    ranked = running_sums(counted, ["_p"], {"_below": F.col("_n")}, keys=keys)
    stats = ranked.groupBy(key_column(keys).alias("_k")).agg(
        F.sum(F.col("_pos") * (F.col("_below") + (F.col("_n") + 1) / F.lit(2.0))).alias("_r"),
        F.sum("_pos").cast("double").alias("_p"),
        F.sum(F.col("_n") - F.col("_pos")).cast("double").alias("_q"),
    )
    auc = F.try_divide(
        F.col("_r") - F.col("_p") * (F.col("_p") + 1) / 2, F.col("_p") * F.col("_q")
    )
    return stats.select(*key_fields(keys), auc.alias("auc"))


def quantiles(
    df: DataFrame, value: str, probs: Sequence[float], *, keys: Sequence[str] = ()
) -> DataFrame:
    """Exact linearly interpolated quantiles: (keys, prob, quantile).

    Position ``prob * (n - 1)`` of the sorted non-null values. The sort is a
    running count over distinct values, so a key of any size stays distributed.
    """
    ranked = value_ranks(df, value, keys=keys).withColumn("_k", key_column(keys))
    first, last = F.col("below"), F.col("below") + F.col("ties") - 1

    def position(p: Column) -> Column:
        return p * (F.col("below_total") - 1)

    # A distinct value covers positions first..last; it answers the probabilities
    # whose lower or upper neighbouring position falls inside. Few values answer
    # any: the others are dropped by comparing how many probabilities lie below
    # the two ends, taken a little too wide.
    spread = F.greatest(F.col("below_total") - 1, F.lit(1))
    ranked = ranked.withColumns({"_from": (first - 1.5) / spread, "_to": (last + 1.5) / spread})
    cuts = sorted({float(p) for p in probs})
    ranked = with_range(with_range(ranked, "_from", cuts, "_below"), "_to", cuts, "_upto")
    ranked = ranked.filter(F.col("_below") < F.col("_upto"))
    answered = F.filter(
        F.array(*[F.lit(float(p)) for p in probs]),
        lambda p: F.floor(position(p)).between(first, last)
        | F.ceil(position(p)).between(first, last),
    )
    number = F.col(value).cast("double")
    at = position(F.col("_p"))
    hits = (
        ranked.select("_k", value, "below_total", F.explode(answered).alias("_p"))
        .groupBy("_k", "_p")
        .agg(
            F.min(number).alias("_lo"),
            F.max(number).alias("_hi"),
            F.max(at - F.floor(at)).alias("_frac"),
        )
    )
    interpolated = F.col("_lo") + F.col("_frac") * (F.col("_hi") - F.col("_lo"))
    return hits.select(*key_fields(keys), F.col("_p").alias("prob"), interpolated.alias("quantile"))


def mean_squared_error(
    df: DataFrame, target: str, pred: str, *, keys: Sequence[str] = ()
) -> DataFrame:
    """Average squared difference per ``keys``."""
    gap = F.col(target) - F.col(pred)
    return df.groupBy(*keys).agg(F.avg(gap * gap).alias("mse"))
