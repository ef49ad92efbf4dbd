"""Ranges by histogram refinement: order, depth, heavy values, and sums over many levels."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from survloom.operators import prefix, ranges
from survloom.operators.concordance import concordance_counts
from survloom.operators.prefix import carry_last, running_sums
from survloom.operators.ranges import fit_ranges

RNG = np.random.default_rng(3)
SHAPES = {
    "uniform": RNG.uniform(-5, 9, 3000),
    "skewed": np.exp(RNG.uniform(-300, 300, 2000)) * RNG.choice([-1, 1], 2000),
    "few": RNG.integers(0, 7, 2500).astype(float),
    "heavy": np.r_[np.full(2000, 3.25), RNG.normal(3.25, 1e-9, 800), -0.0, 0.0],
    "extreme": np.r_[np.inf, -np.inf, np.nan, 1.7e308, -1.7e308, 5e-324, RNG.normal(0, 1, 500)],
    "one": np.full(40, 2.0),
    "none": np.zeros(0),
}


@pytest.mark.parametrize("name", SHAPES)
@pytest.mark.parametrize("bins", [32, 4096])
def test_ranges_follow_the_order_and_are_not_too_deep(spark, monkeypatch, name, bins):
    monkeypatch.setattr(ranges, "BINS", bins)
    values = SHAPES[name]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    target = 100
    fitted = fit_ranges(df, "x", target)
    out = fitted.add(df, "x", "r").collect()
    largest = np.finfo(float).max

    def order(x):
        return largest if x is None or x != x else min(max(x, -largest), largest)

    out.sort(key=lambda r: order(r.x))
    numbers = [r.r for r in out]
    assert numbers == sorted(numbers) and numbers[-1] <= fitted.top
    held: dict = {}
    for r in out:
        held.setdefault(r.r, []).append(order(r.x))
    seen: dict = {}
    for number, own in held.items():
        assert len(own) < 2 * target or len(set(own)) == 1
        if fitted.levels:
            assert (number % 2 == 1) == (len(own) > target and len(set(own)) == 1) or len(own) <= 2 * target
        for x in own:
            assert seen.setdefault(x, number) == number


@pytest.mark.parametrize("descending", [False, True])
def test_sums_over_many_levels(spark, monkeypatch, descending):
    """With windows over two ranges each, offsets pass through many levels."""
    monkeypatch.setattr(prefix, "FAN_BITS", 1)
    rows = [(k, float(x), int(m)) for k in ("a", None) for x, m in zip(RNG.choice(900, 400, replace=False), RNG.integers(1, 9, 400))]
    df = spark.createDataFrame(rows, "k string, x double, m long")
    cuts = fit_ranges(df, "x", 20)
    assert cuts.top > 30
    got = running_sums(df, ["x"], {"s": F.col("m")}, keys=["k"], cuts=cuts, descending=descending, totals=True).collect()
    for r in got:
        before = [m for k, x, m in rows if k == r.k and (x > r.x if descending else x < r.x)]
        assert r.s == sum(before) and r.s_total == sum(m for k, _, m in rows if k == r.k)
    assert len(got) == len(rows)


def test_carried_values_over_many_levels(spark, monkeypatch):
    monkeypatch.setattr(prefix, "FAN_BITS", 1)
    steps = [(k, float(t), float(t) / 7) for k in "ab" for t in sorted(RNG.choice(1000, 12, replace=False))]
    asked = [(k, float(t)) for k in "abc" for t in range(0, 1000, 9)]
    curve = spark.createDataFrame(steps, "k string, t double, v double")
    probes = spark.createDataFrame(asked, "k string, t double")
    both = curve.select("t").union(probes.select("t"))
    got = carry_last(curve, probes, "t", ["v"], keys=["k"], cuts=fit_ranges(both, "t", 10)).collect()
    want = {(k, t): max(((s, v) for j, s, v in steps if j == k and s <= t), default=(0, None))[1] for k, t in asked}
    assert {(r.k, r.t): r.v for r in got} == want


def test_pairs_over_many_levels(spark, monkeypatch):
    rows = [(float(t), int(e), float(r)) for t, e, r in zip(RNG.integers(0, 60, 500), RNG.integers(0, 2, 500), RNG.integers(0, 25, 500))]
    rows += [(30.0, 1, 4.0)] * 90 + [(30.0, 0, 4.0)] * 60
    df = spark.createDataFrame(rows, "t double, e int, r double")
    whole = concordance_counts(df, "t", "e", "r").collect()
    monkeypatch.setattr(prefix, "FAN_BITS", 1)
    assert concordance_counts(df, "t", "e", "r", group_rows=8).collect() == whole
    pairs = [(a, b) for a in rows if a[1] for b in rows if a[0] < b[0] or (a[0] == b[0] and not b[1])]
    assert whole[0]["pairs"] == len(pairs)
    assert whole[0]["concordant"] == sum(a[2] > b[2] for a, b in pairs) and whole[0]["tied"] == sum(a[2] == b[2] for a, b in pairs)


def test_plan_has_no_list_of_cuts(spark):
    df = spark.range(20_000).select((F.col("id") * 7 % 9973).cast("double").alias("x")).distinct()
    cuts = fit_ranges(df, "x", 10)
    plan = cuts.add(df, "x", "r")._jdf.queryExecution().optimizedPlan().toString()
    assert cuts.top > 1000 and len(plan) < 20_000
