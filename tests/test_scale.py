"""Steps that once took work per fold, round or point of a curve."""

from __future__ import annotations

from functools import reduce

import pytest
from pyspark.sql import functions as F

from survloom.functions.parametric import mean_survival, survival_at
from survloom.operators import crossfit as cf
from survloom.operators.concordance import concordance_counts
from survloom.operators.models import GroupMeanRegressor, predict
from survloom.settings import staged


def test_mean_survival_is_taken_on_batches(spark):
    """Interpreted functions of array elements took 100 points x heads steps per row."""
    nan, inf = float("nan"), float("inf")
    a = [(2.0, 0.5, 0.75), (-1.0, 1.5, 0.25), (3.0, 0.0, 1.0), (0.5, 2.0, -1.0), (0.0, 1.0, 1.0)]
    lists = [
        (a, []), ([], a), (a[:2], a[1:]), ([], []), (None, a), (a, None), ([a[0], None], []), (a, [(1.0, None, 1.0)]),
        ([(nan, 1.0, 1.0)], []), ([(1.0, inf, 1.0)], []), ([(inf, 1.0, 1.0)], []), ([(1.0, nan, 1.0)], a),
    ]
    heads = "array<struct<eta:double,k:double,w:double>>"
    df = spark.createDataFrame([(i, *pair) for i, pair in enumerate(lists)], f"id int, a {heads}, b {heads}").repartition(3)

    # The mean of the survival at each of the points, by the expression for one time.
    steps = [survival_at(F.col("a"), F.col("b"), F.lit(i / 9.0)) for i in range(10)]
    plain = reduce(lambda x, y: x + y, steps) / 10
    out = df.select("id", plain.alias("want"), mean_survival(F.col("a"), F.col("b"), 10).alias("got"))
    rows = {r.id: (r.want, r.got) for r in out.collect()}
    assert len(rows) == len(lists) and all(rows[i] == (None, None) for i in (4, 5, 6, 7))
    assert all(got == pytest.approx(want, abs=1e-14, nan_ok=True) for want, got in rows.values() if want is not None)
    assert rows[3][1] == 1.0 and all(v != v for i in (8, 9, 11) for v in rows[i])
    plan = df.select(mean_survival(F.col("a"), F.col("b")))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "aggregate(" not in plan


def _jobs(spark, run):
    """The result of ``run`` and the number of Spark jobs that it started."""
    spark.sparkContext.setJobGroup("counted", "counted")
    try:
        out = run()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def _grouped(spark):
    rows = [(i, i % 7 if i % 41 else None, f"g{i % 3}" if i % 5 else None, float(i * i % 97), 1.0 + i % 4) for i in range(300)]
    rows += [(1000, 0, "alone", 5.0, 1.0), (1001, 2, "unknown", None, 1.0), (1002, 3, "g1", float("nan"), 1.0)]
    return staged(spark.createDataFrame(rows, "id int, fold int, g string, y double, w double"))


def test_group_means_of_all_folds_take_one_pass(spark):
    df, usable = _grouped(spark), ~F.isnan("y") | F.col("y").isNull()
    means = GroupMeanRegressor(["g"], "y", "w")
    make = lambda: cf.cross_fit(means, df, name="m", meta=["id"], usable=usable)
    run, jobs = _jobs(spark, make)
    # Each fold once took three jobs or more, and a scan and a join of its own.
    assert jobs <= 8
    assert run.predictions._jdf.queryExecution().analyzed().toString().count("Join") == 1
    got = {r.id: (r.pred, r.fold, r.name) for r in run.predictions.collect()}
    assert len(got) == df.filter("fold IS NOT NULL").count()
    for fold in range(7):
        model = means.fit(df.filter(usable).filter(F.col("fold") != fold))
        for m in (model, run.models["m", fold]):
            for r in predict(m, df.filter(F.col("fold") == fold)).collect():
                assert got[r.id] == (pytest.approx(r.pred, abs=1e-12), fold, "m")


def test_new_rows_meet_all_group_means_in_one_join(spark):
    df = _grouped(spark).filter(~F.isnan("y") | F.col("y").isNull())
    models = list(cf.cross_fit(GroupMeanRegressor(["g"], "y"), df, name="m", meta=["id"]).models.values())
    new = spark.createDataFrame([(1, "g0"), (2, "alone"), (3, None), (4, "never")], "id int, g string")
    scored = cf.score_models(models, new)
    assert scored.columns == ["id", "g", "pred"]
    assert scored._jdf.queryExecution().analyzed().toString().count("Join LeftOuter") == 1
    for r in scored.collect():
        single = [predict(m, new).filter(F.col("id") == r.id).first().pred for m in models]
        assert r.pred == pytest.approx(sum(single) / len(single), abs=1e-12)


def test_keys_of_a_range_are_counted_in_one_call(spark):
    """A call per key and range cost more than the counting."""
    rows = [(k if k else None, float(i * 37 % 101), i % 3 != 0, float(i * k % 53)) for k in range(12) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, t double, e boolean, r double").withColumn("e", F.col("e").cast("int"))
    counts = concordance_counts(df, "t", "e", "r", keys=["k"], group_rows=50)
    got = {r.k: (int(r.pairs), int(r.concordant), int(r.tied)) for r in counts.collect()}
    for key in {r[0] for r in rows}:
        own = [r[1:] for r in rows if r[0] == key]
        pairs = [(a, b) for a in own for b in own if a[1] and (a[0] < b[0] or (a[0] == b[0] and not b[1]))]
        assert got[key] == (len(pairs), sum(a[2] > b[2] for a, b in pairs), sum(a[2] == b[2] for a, b in pairs))
    plan = counts._jdf.queryExecution().analyzed().toString()
    assert plan.count("FlatMapGroupsInArrow [_a") == 1 and plan.count("FlatMapGroupsInArrow [_b") == 1
