"""Running sums, carried values, exact quantiles and tied hazards."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from survloom.operators.curves import at_or_before, survival_arrays, survival_curve, tied_hazard
from survloom.operators.prefix import carry_last, running_sums
from survloom.operators.ranks import normalized_rank, quantiles


@pytest.fixture(scope="module")
def numbers():
    rng = np.random.default_rng(0)
    rows = [
        (k, float(x), float(rng.integers(1, 9)))
        for k in ("a", None, "b")
        for x in rng.choice(5000, 700, replace=False)
    ]
    return pd.DataFrame(rows, columns=["k", "x", "m"])


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums(spark, numbers, descending):
    df = spark.createDataFrame(numbers, "k string, x double, m double")
    got = running_sums(
        df, ["x"], {"s": F.col("m")}, keys=["k"], descending=descending, totals=True
    ).toPandas()
    want = numbers.sort_values("x", ascending=not descending)
    grouped = want.groupby("k", dropna=False)["m"]
    want = want.assign(s=grouped.cumsum() - want["m"], s_total=grouped.transform("sum"))
    order = ["k", "x"]
    got = got.sort_values(order, ignore_index=True)[["k", "x", "m", "s", "s_total"]]
    want = want.sort_values(order, ignore_index=True)[["k", "x", "m", "s", "s_total"]]
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_running_sums_uses_no_single_task_over_the_rows(spark, numbers):
    df = spark.createDataFrame(numbers, "k string, x double, m double")
    plan = running_sums(df, ["x"], {"s": F.col("m")}, cuts=[100.0, 2000.0])
    text = plan._jdf.queryExecution().executedPlan().toString()
    # The only one-partition exchange is the window over the per-range rows.
    assert text.count("SinglePartition") <= 1 and "CartesianProduct" not in text


def test_carry_last(spark):
    curve = spark.createDataFrame(
        [("a", 1.0, 10.0), ("a", 5.0, None), ("b", 2.0, 7.0)], "k string, t double, v double"
    )
    probes = spark.createDataFrame(
        [("a", 0.5), ("a", 1.0), ("a", 4.0), ("a", 9.0), ("b", 1.0), ("b", 100.0), ("c", 3.0)],
        "k string, t double",
    )
    for cuts in ([], [2.0], [0.7, 3.0, 6.0, 50.0]):
        got = carry_last(curve, probes, "t", ["v"], keys=["k"], cuts=cuts).collect()
        assert {(r.k, r.t): r.v for r in got} == {
            ("a", 0.5): None,
            ("a", 1.0): 10.0,
            ("a", 4.0): 10.0,
            ("a", 9.0): None,  # the step at 5 carries a null
            ("b", 1.0): None,
            ("b", 100.0): 7.0,
            ("c", 3.0): None,
        }


def test_lookup_keeps_rows_and_defaults(spark):
    curve = spark.createDataFrame([(1.0, 0.5)], "t double, s double")
    rows = spark.createDataFrame([(1, 0.0), (2, 3.0), (3, 3.0)], "id long, t double")
    got = at_or_before(rows, curve, "t", ["s"], default=1.0).orderBy("id").collect()
    assert [r.s for r in got] == [1.0, 0.5, 0.5]


@pytest.mark.parametrize("probs", [[0.5], [0.0, 0.25, 0.5, 1.0], [i / 52 for i in range(53)]])
def test_quantiles(spark, numbers, probs):
    repeated = pd.concat([numbers, numbers.head(300)])
    df = spark.createDataFrame(repeated, "k string, x double, m double")
    for column in ("x", "m"):
        got = quantiles(df, column, probs, keys=["k"]).toPandas()
        for k, part in repeated.groupby("k", dropna=False):
            mine = got[got.k.isna() if pd.isna(k) else got.k == k].sort_values("prob")
            assert mine["quantile"].to_numpy() == pytest.approx(np.quantile(part[column], probs))


def test_quantile_of_one_row(spark):
    df = spark.createDataFrame([(3.0,), (None,)], "x double")
    got = quantiles(df, "x", [0.0, 0.5, 1.0]).collect()
    assert [r["quantile"] for r in got] == [3.0, 3.0, 3.0]


def test_rank_of_constant_and_null(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, None)], "id long, x double")
    got = normalized_rank(df, "x", "r").orderBy("id").collect()
    # Equal values all hold the top rank 1.5: (1.5 - 1) / (1.5 - 1).
    assert [r.r for r in got] == [1.0, 1.0, None]


@pytest.mark.parametrize(
    "deaths, at_risk",
    [(0, 5), (1, 1), (3, 10), (64, 64), (65, 65), (65, 100), (900, 901), (1000, 5000), (5000, 5000), (200, 10**7)],
)
def test_tied_hazard(spark, deaths, at_risk):
    got = spark.range(1).select(tied_hazard(F.lit(deaths), F.lit(at_risk)).alias("h")).first().h
    want = sum(1.0 / (at_risk - i) for i in range(deaths))
    assert got == pytest.approx(want, rel=1e-12, abs=1e-300)


def test_curve_is_monotone_and_ignores_order(spark, numbers):
    df = spark.createDataFrame(numbers, "k string, x double, m double").withColumn(
        "e", (F.col("m") > 4).cast("int")
    )
    a = survival_curve(df, "x", "e").orderBy("x").collect()
    b = survival_curve(df.repartition(7, "m"), "x", "e").orderBy("x").collect()
    assert [r.km for r in a] == pytest.approx([r.km for r in b])
    km = [r.km for r in a]
    assert all(x >= y for x, y in zip(km, km[1:])) and 0 <= km[-1] <= km[0] <= 1


def test_plain_hazard_option(spark):
    df = spark.createDataFrame([(1.0, 1), (1.0, 1), (2.0, 0)], "t double, e int")
    rows = survival_curve(df, "t", "e", tied_deaths=False).orderBy("t").collect()
    assert rows[0].na == pytest.approx(2 / 3)


def test_arrays_over_a_timeline(spark):
    """Defaults before the first step, the last step after it, nulls for unknown keys and risks."""
    baseline = spark.createDataFrame([("a", 1.0, 0.1), ("a", 3.0, 0.5), ("b", 2.0, 1.0)], "k string, t double, hazard double")
    rows = spark.createDataFrame([(1, "a", 0.0, "x"), (2, "b", 1.0, "y"), (3, "c", 0.0, "z"), (4, "a", None, "w")], "id long, k string, lp double, survival string")
    out = survival_arrays(rows, baseline, "t", "lp", [0.0, 3.0, 1.5, 3.0], keys=["k"])
    got = {r.id: (r.survival, r.hazard) for r in out.collect()}
    assert got[1][1] == pytest.approx([0.0, 0.5, 0.1, 0.5]) and got[1][0] == pytest.approx(np.exp([-0.0, -0.5, -0.1, -0.5]))
    assert got[2][1] == pytest.approx([0.0, np.e, 0.0, np.e])
    assert got[3] == (None, None) and got[4] == (None, None)
    whole = survival_arrays(rows, baseline.filter("k = 'a'").drop("k"), "t", "lp", [2.0])
    assert {r.id: r.hazard for r in whole.collect()}[2] == pytest.approx([0.1 * np.e])
