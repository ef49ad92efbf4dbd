"""Pair counts against brute force, on ties, hot values and nulls."""

from __future__ import annotations

import numpy as np
import pytest

from survloom.operators.concordance import concordance_counts, count_ordered_pairs


def brute(rows):
    pairs = concordant = tied = 0
    for t, e, p in rows:
        if e != 1:
            continue
        for u, f, q in rows:
            if t < u or (t == u and f != 1):
                pairs += 1
                concordant += p > q
                tied += p == q
    return pairs, concordant, tied


@pytest.mark.parametrize("n", [1, 2, 7, 60, 200])
def test_local_counts(n):
    rng = np.random.default_rng(n)
    code = np.unique(rng.integers(0, max(1, n // 2), n), return_inverse=True)[1]
    risk = rng.integers(0, max(1, n // 3), n).astype(float)
    left, right = rng.integers(0, 3, n), rng.integers(0, 3, n)
    less = code[:, None] < code[None, :]
    weight = left[:, None] * right[None, :] * less
    expected = (
        weight.sum(),
        (weight * (risk[:, None] > risk[None, :])).sum(),
        (weight * (risk[:, None] == risk[None, :])).sum(),
    )
    assert count_ordered_pairs(code, risk, left, right) == expected


def test_local_counts_beyond_64_bits():
    big = 1 << 40
    got = count_ordered_pairs(
        np.array([0, 1]), np.array([2.0, 1.0]), np.array([big, 0]), np.array([0, big])
    )
    assert got == (big * big, big * big, 0)


def make(rng, n, *, times, preds, hot_time=False, hot_pred=False):
    rows = []
    for _ in range(n):
        t = float(rng.integers(0, times))
        p = float(rng.integers(0, preds)) / 7
        if hot_time and rng.random() < 0.4:
            t = times / 2
        if hot_pred and rng.random() < 0.4:
            p = 1.0
        rows.append((t, int(rng.random() < 0.6), p))
    return rows


@pytest.mark.parametrize("group_rows", [1 << 20, 90])
@pytest.mark.parametrize(
    "case",
    [
        dict(times=1000, preds=1000),
        dict(times=5, preds=4),
        dict(times=1000, preds=1000, hot_time=True, hot_pred=True),
    ],
)
def test_counts_per_key(spark, case, group_rows):
    rng = np.random.default_rng(3)
    groups = {"a": make(rng, 400, **case), None: make(rng, 120, **case), "c": make(rng, 1, **case)}
    rows = [(k, *r) for k, part in groups.items() for r in part]
    df = spark.createDataFrame(rows, "k string, t double, e int, p double").repartition(3)
    got = {
        r.k: (int(r.pairs), int(r.concordant), int(r.tied))
        for r in concordance_counts(df, "t", "e", "p", keys=["k"], group_rows=group_rows).collect()
    }
    assert got == {k: brute(part) for k, part in groups.items()}


def test_own_time_as_risk(spark):
    df = spark.range(50).selectExpr("double(id) AS t", "1 AS e", "-double(id) AS p")
    assert concordance_counts(df, "t", "e", "p", group_rows=8).first().c_index == 1.0


def test_empty(spark):
    df = spark.createDataFrame([], "t double, e int, p double")
    row = concordance_counts(df, "t", "e", "p").collect()
    assert row == [] or (int(row[0].pairs) == 0 and row[0].c_index is None)
