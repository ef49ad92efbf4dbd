"""Folds of several seeds, taken from the first rows of the folds."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from survloom.operators import folds
from survloom.operators.crossfit import with_seed_folds


@pytest.mark.parametrize("n, n_splits", [(0, 3), (1, 3), (2, 5), (10, 3), (1000, 7), (1001, 10), (40, 1)])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_seed_folds_are_those_of_the_fold_table(spark, n, n_splits, kind):
    rows = spark.range(n).select((F.col("id") * 7).cast(kind).alias("ID"), (F.col("id") % 3).alias("x"))
    seeds = [1, 2, 0]
    got = with_seed_folds(rows, "ID", n_splits, seeds)
    assert got.columns == ["ID", "x", "fold_1", "fold_2", "fold_0"]
    found = {(r["ID"], s, r[f"fold_{s}"]) for r in got.collect() for s in seeds}
    table = folds.fold_table(rows, "ID", n_splits, seeds)
    assert found == {(r["ID"], r["seed"], r["fold"]) for r in table.collect()}
    assert [f.dataType.simpleString() for f in got.schema][2:] == ["int"] * 3


def test_seed_folds_shared_groups(spark, monkeypatch):
    """Several folds that start in one group of leading digits."""
    monkeypatch.setattr(folds, "_COUNTED_DIGITS", 0)
    rows = spark.range(57).withColumnRenamed("id", "ID")
    got = {(r["ID"], r["fold_3"]) for r in with_seed_folds(rows, "ID", 9, [3]).collect()}
    assert got == {(r["ID"], r["fold"]) for r in folds.fold_table(rows, "ID", 9, [3]).collect()}


def test_adding_folds_moves_no_rows(spark):
    """Rows were shuffled and joined by id."""
    rows = spark.range(50).select(F.col("id").alias("ID"), (F.col("id") * 2).alias("x"))
    plan = with_seed_folds(rows, "ID", 4, [1, 2])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
