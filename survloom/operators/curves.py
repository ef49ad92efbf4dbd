"""Survival curves as tables of steps, and their values at each row's own time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from survloom.operators.prefix import carry_last, key_column, running_sums
from survloom.operators.ranges import Ranges, fit_ranges
from survloom.settings import keep

_LOOP = 64


def _harmonic_tail(m: Column) -> Column:
    """The part of the harmonic number H(m) beyond ln m and Euler's constant (m >= 32)."""
    inv2 = 1 / (m * m)
    return 1 / (2 * m) - inv2 / 12 * (1 - inv2 / 10 * (1 - inv2 * 10 / 21))


def tied_hazard(deaths: Column, at_risk: Column) -> Column:
    """Sum of 1 / (at_risk - i) for i < deaths: deaths at one time, one after the other.

    Short sums are added up; long ones use the expansion of harmonic numbers, so
    a time with billions of deaths costs the same as any other.
    """
    n, d = at_risk.cast("double"), deaths.cast("double")
    left = n - d

    def added(count: Column, top: Column) -> Column:
        steps = F.sequence(F.lit(0), count.cast("int") - 1)
        return F.when(count < 1, 0.0).otherwise(
            F.aggregate(steps, F.lit(0.0), lambda acc, i: acc + 1 / (top - i))
        )

    # The expansion needs 32 or more: it stops above that, the rest is added singly.
    single = F.ceil(F.greatest(32 - left, F.lit(0.0)))
    low = left + single
    expanded = _harmonic_tail(n) - _harmonic_tail(low) - F.log1p(-(n - low) / n)
    return F.when(d <= _LOOP, added(F.least(d, F.lit(float(_LOOP))), n)).otherwise(
        expanded + added(single, low)
    )


def life_table(df: DataFrame, time: str, event: str, *, keys: Sequence[str] = ()) -> DataFrame:
    """Per keys and distinct time: ``deaths``, ``leaving`` rows and rows ``at_risk``.

    Rows with a null time or event are left out, as they carry no information
    on when anything happened.
    """
    return _ranged_life_table(df, time, event, keys)[0]


def _ranged_life_table(df: DataFrame, time: str, event: str, keys: Sequence[str]) -> tuple[DataFrame, Ranges]:
    """The life table, and the ranges of its times."""
    known = df.filter(F.col(time).isNotNull() & F.col(event).isNotNull())
    times = known.groupBy(*keys, F.col(time).cast("double").alias(time)).agg(
        F.sum(F.when(F.col(event) == 1, 1).otherwise(0)).alias("deaths"),
        F.count(F.lit(1)).alias("leaving"),
    )
    times = keep(times)
    cuts = fit_ranges(times, time)
    # Counted from the latest time: those still there after it, plus its own rows.
    later = running_sums(
        times, [time], {"_later": F.col("leaving")}, keys=keys, cuts=cuts, descending=True
    )
    return later.withColumn("at_risk", F.col("_later") + F.col("leaving")).drop("_later"), cuts


def survival_curve(
    df: DataFrame, time: str, event: str, *, keys: Sequence[str] = (), tied_deaths: bool = True
) -> DataFrame:
    """Kaplan-Meier (``km``), Nelson-Aalen (``na``) and exp(-na) (``bfh``) per distinct time.

    ``tied_deaths``: deaths at one time add 1/n + 1/(n-1) + ... to the hazard;
    otherwise d/n.
    """
    table, cuts = _ranged_life_table(df, time, event, keys)
    d, n = F.col("deaths"), F.col("at_risk")
    # ln 0 is null in Spark: the time at which everybody dies is a flag instead.
    factor = F.when(d < n, F.log1p(-d / n)).otherwise(0.0)
    hazard = tied_hazard(d, n) if tied_deaths else d / n
    # Kept: the second running sum reads it twice, and it is one row per time.
    terms = keep(
        table.select(
            "*",
            factor.alias("_ln"),
            F.when(d == n, 1).otherwise(0).alias("_end"),
            hazard.alias("_h"),
        )
    )
    summed = running_sums(
        terms,
        [time],
        {"_ln_sum": F.col("_ln"), "_ends": F.col("_end"), "_h_sum": F.col("_h")},
        keys=keys,
        cuts=cuts,
    )
    na = F.col("_h_sum") + F.col("_h")
    ended = F.col("_ends") + F.col("_end") > 0
    km = F.when(ended, 0.0).otherwise(F.exp(F.col("_ln_sum") + F.col("_ln")))
    return summed.select(
        *keys, time, "at_risk", "deaths", km.alias("km"), na.alias("na"), F.exp(-na).alias("bfh")
    )


def at_own_time(
    df: DataFrame, curve: DataFrame, time: str, values: Sequence[str], *, keys: Sequence[str] = ()
) -> DataFrame:
    """Join curve values to rows whose time occurs on the curve: an equi join.

    The curve has one row per distinct time. AQE broadcasts it when its size at
    run time is small and otherwise splits the tasks of heavy times.
    """
    steps = curve.select(
        key_column(keys).alias("_ck"), F.col(time).alias("_ct"), *values
    )
    rows = df.withColumn("_k", key_column(keys))
    same = (rows["_k"] == steps["_ck"]) & (rows[time].cast("double") == steps["_ct"])
    return rows.join(steps, same, "left").select(*df.columns, *values)


def at_or_before(
    df: DataFrame,
    curve: DataFrame,
    time: str,
    values: Sequence[str],
    *,
    keys: Sequence[str] = (),
    default: float | None = None,
) -> DataFrame:
    """As-of lookup: curve values at the last curve time not after the row's time.

    Only distinct times are looked up along the order; rows then equi-join them.
    ``default`` replaces the null of rows before the first step.
    """
    asked = df.filter(F.col(time).isNotNull()).select(*keys, time)
    steps = keep(curve.select(*keys, time, *values))
    found = carry_last(steps, asked, time, values, keys=keys)
    out = at_own_time(df, found, time, values, keys=keys)
    return out.fillna(default, subset=list(values)) if default is not None else out


def curve_arrays(
    curve: DataFrame, time: str, values: Sequence[str], timeline: Sequence[float], *, keys: Sequence[str] = (), defaults: Sequence[float] = ()
) -> DataFrame:
    """(keys, one array per value): the step curve of each key over the times of ``timeline``, in its order.

    Before a curve's first step the value is the default, or null.
    """
    at = F.posexplode(F.array(*[F.lit(float(t)) for t in timeline])).alias("_at", time)
    asked = curve.select(*keys).distinct() if keys else curve.sparkSession.range(1).select()
    found = at_or_before(asked.select(*keys, at), curve, time, values, keys=keys)
    ordered = F.sort_array(F.collect_list(F.struct("_at", *values)))
    filled = dict(zip(values, [F.lit(float(d)) for d in defaults]))

    def of(value: str) -> Column:
        missing = filled.get(value, F.lit(None).cast("double"))
        return F.transform("_all", lambda step: F.coalesce(step[value], missing)).alias(value)

    arrays = [of(v) for v in values]
    return found.groupBy(*keys).agg(ordered.alias("_all")).select(*keys, *arrays)


def survival_arrays(
    df: DataFrame, baseline: DataFrame, time: str, log_risk: str, timeline: Sequence[float],
    *, keys: Sequence[str] = (), survival: str = "survival", hazard: str = "hazard",
) -> DataFrame:
    """Add each row's survival and cumulative hazard over ``timeline``, as two arrays.

    ``baseline`` has (keys, time, hazard) steps. Its values over the timeline are looked up
    once per key; a row's arrays are then expressions. They are null where the key has no
    baseline or the row no log risk.
    """
    arrays = curve_arrays(baseline, time, ["hazard"], timeline, keys=keys, defaults=[0.0])
    arrays = arrays.select(key_column(keys).alias("_ak"), F.col("hazard").alias("_h0"))
    joined = df.withColumn("_k", key_column(keys)).join(arrays, F.col("_k") == F.col("_ak"), "left")
    grown = F.when(F.col(log_risk).isNotNull(), F.transform("_h0", lambda h: h * F.exp(F.col(log_risk))))
    joined = joined.withColumn("_grown", grown).withColumns({survival: F.transform("_grown", lambda h: F.exp(-h)), hazard: F.col("_grown")})
    kept = [c for c in df.columns if c not in (survival, hazard)]
    return joined.select(*kept, survival, hazard)


def survival_targets(
    df: DataFrame, time: str, event: str, *, fit_mask: Column, km: str = "t_kmf", bfh: str = "t_bfhf"
) -> DataFrame:
    """Kaplan-Meier and exp(-Nelson-Aalen) survival at each row's own time.

    The curves are fitted where ``fit_mask`` holds. Times not on the curve take
    the last step before; before the first step survival is 1, and rows
    without a time have none.
    """
    curve = survival_curve(df.filter(fit_mask), time, event)
    found = at_or_before(df, curve, time, ["km", "bfh"])
    before_first = F.when(F.col(time).isNotNull(), 1.0)
    return found.withColumns(
        {km: F.coalesce("km", before_first), bfh: F.coalesce("bfh", before_first)}
    ).drop("km", "bfh")
