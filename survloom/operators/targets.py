"""Row weights and regression targets made from (time, event)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from survloom.functions.expr import clip


def _statistics(df: DataFrame, **stats: Column) -> Column:
    """Aggregates over ``df`` as one struct, usable as a value in other frames.

    A scalar subquery: one row whatever the input, and no job of its own.
    """
    return df.agg(F.struct(*[c.alias(k) for k, c in stats.items()]).alias("s")).scalar()


def event_time_weight(
    df: DataFrame,
    time: str,
    event: str,
    *,
    censored: tuple[float, float] = (0.01, 0.5),
    observed: tuple[float, float] = (1.0, 1.5),
    out: str = "weight",
) -> DataFrame:
    """Weight by event class and time within the class.

    Censored rows fall from the upper to the lower limit as time grows, rows
    with an event rise from the lower to the upper one. Equal limits give a
    constant. A null event gives a null weight.
    """
    t, e = F.col(time), F.col(event)
    is_event = e != 0
    stats = _statistics(
        df,
        lo0=F.min(F.when(e == 0, t)),
        hi0=F.max(F.when(e == 0, t)),
        lo1=F.min(F.when(is_event, t)),
        hi1=F.max(F.when(is_event, t)),
    )

    def ranged(limits: tuple[float, float], share: Column) -> Column:
        low, high = limits
        return F.lit(float(low)) if low == high else share * F.lit(high - low) + F.lit(low)

    def share(lo: str, hi: str) -> Column:
        low, high = F.col(f"_s.{lo}"), F.col(f"_s.{hi}")
        return F.try_divide(t - low, high - low)

    weight = F.when(e == 0, ranged(censored, 1 - share("lo0", "hi0"))).when(
        is_event, ranged(observed, share("lo1", "hi1"))
    )
    return df.select("*", stats.alias("_s")).withColumn(out, weight).drop("_s")


def _shifted(prob: Column, base: Column, least_log: Column, least_base: Column) -> Column:
    """ln p / f + base with f = least_log / (0 - least_base).

    Where f is undefined or zero (the base reaches 0, or every p is 1) the base
    is left as it is; p = 0 or null gives null.
    """
    log_p = F.when(prob > 0, F.log(prob))
    factor = F.try_divide(least_log, -least_base)
    added = F.when(factor.isNull() | (factor == 0), 0.0 * log_p).otherwise(
        F.try_divide(log_p, factor)
    )
    return added + base


def scale_target(df: DataFrame, base: str, prob: str, *, out: str | None = None) -> DataFrame:
    """Shift a survival target by the log event probability, one factor for all rows."""
    p, t = F.col(prob), F.col(base)
    stats = _statistics(df, lp=F.min(F.when(p > 0, F.log(p))), lt=F.min(t))
    shifted = _shifted(p, t, F.col("_s.lp"), F.col("_s.lt"))
    return (
        df.select("*", stats.alias("_s"))
        .withColumn(out or f"{base}_event_scaled", shifted)
        .drop("_s")
    )


def scale_target_by_event(
    df: DataFrame,
    base: str,
    prob: str,
    event: str,
    *,
    prob_clip: tuple[float, float] | None = None,
    exponential: bool = True,
    out: str | None = None,
) -> DataFrame:
    """As :func:`scale_target` on the doubled probability, with a factor per event class.

    ``prob_clip`` limits the doubled probability; ``exponential`` returns exp of
    the shifted target. Rows with a null event get null.
    """
    p = F.col(prob) * 2
    if prob_clip:
        p = clip(p, *prob_clip)
    t, e = F.col(base), F.col(event)
    log_p = F.when(p > 0, F.log(p))
    stats = _statistics(
        df,
        lp1=F.min(F.when(e == 1, log_p)),
        lt1=F.min(F.when(e == 1, t)),
        lp0=F.min(F.when(e == 0, log_p)),
        lt0=F.min(F.when(e == 0, t)),
    )
    shifted = F.when(e == 1, _shifted(p, t, F.col("_s.lp1"), F.col("_s.lt1"))).when(
        e.isNotNull(), _shifted(p, t, F.col("_s.lp0"), F.col("_s.lt0"))
    )
    return (
        df.select("*", stats.alias("_s"))
        .withColumn(out or f"{base}_event_scaled2", F.exp(shifted) if exponential else shifted)
        .drop("_s")
    )


def normalize_by_max(df: DataFrame, column: str, *, out: str) -> DataFrame:
    """Divide by the largest value of the column."""
    stats = _statistics(df, top=F.max(column))
    return (
        df.select("*", stats.alias("_s"))
        .withColumn(out, F.try_divide(F.col(column), F.col("_s.top")))
        .drop("_s")
    )
