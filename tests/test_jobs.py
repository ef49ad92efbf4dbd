"""Scopes of staged folders, manifests of folds, concurrent fits and prefixes of ensembles."""

from __future__ import annotations

import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from survloom import settings
from survloom.operators import crossfit as cf
from survloom.operators.models import GroupMeanRegressor, regressor
from survloom.settings import fresh_path, keep, scope, staged


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"id": range(240), "a": rng.normal(size=240), "b": rng.normal(size=240)})
    pdf["efs_time"] = np.round(rng.exponential(np.exp(-pdf.a)) * 20)
    pdf["efs"] = (rng.random(240) < 1 / (1 + np.exp(-2 * pdf.a))).astype(int)
    pdf["stratum"], pdf["g"], pdf["fold"] = pdf.id % 2, pdf.id % 5, (pdf.id % 3).astype("int32")
    pdf["held"] = pdf.id % 4 == 0
    return spark.createDataFrame(pdf).persist()


def _there(spark, folder):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def test_a_scope_leaves_no_folder_and_no_kept_frame(spark):
    outside = keep(spark.range(5).withColumn("x", F.rand(1)))
    with scope(spark) as outer:
        table = staged(spark.range(10), "outer")
        with pytest.raises(RuntimeError), scope(spark) as inner:
            staged(spark.range(3), "inner")
            frame = keep(spark.range(7).withColumn("y", F.rand(2)))
            raise RuntimeError
        assert not _there(spark, inner.folders[0]) and not frame.is_cached
        assert table.count() == 10 and _there(spark, outer.folders[0]) and len(outer.folders) == 1
        parallel = cf.concurrently(spark, [lambda: staged(spark.range(2), "thread").count()] * 3)
        assert parallel == [2, 2, 2] and len(outer.folders) == 4
    assert not any(_there(spark, f) for f in outer.folders)
    assert outside.is_cached and settings._scope.get() is None


def test_concurrent_jobs_keep_order_and_raise(spark):
    gate = threading.Barrier(3, timeout=20)

    def job(i):
        gate.wait()  # passes only if three run at once
        return i * spark.range(4).count()

    assert cf.concurrently(spark, [lambda i=i: job(i) for i in range(3)], 3) == [0, 4, 8]
    with pytest.raises(ZeroDivisionError):
        cf.concurrently(spark, [lambda: 1, lambda: 1 // 0])


def test_folds_fitted_together_equal_folds_in_turn(rows):
    ridge = regressor("ridge", ["a", "b"], "efs_time", alpha=1.0)
    one, many = (cf.cross_fit(ridge, rows, name="r", meta=["id"], workers=w).predictions.orderBy("id").collect() for w in (1, 4))
    assert one == many and len(one) == 240


def test_a_changed_input_or_parameter_refits(spark, rows):
    store, calls = cf.FoldStore(spark, fresh_path(spark, "store")), []

    class Counting(GroupMeanRegressor):
        def _fit(self, dataset):
            calls.append(1)
            return super()._fit(dataset)

    def run(df, label="efs_time", **options):
        calls.clear()
        cf.cross_fit(Counting(["g"], label), df, name="m", meta=["id"], store=store, **options)
        return len(calls)

    table = staged(rows)
    assert run(table) == 3 and run(table) == 0
    # Order and partitions of the rows do not matter, a value, a parameter and the filter do.
    assert run(table.repartition(5).orderBy(F.desc("id"))) == 0
    changed = staged(table.withColumn("efs_time", F.when(F.col("id") == 7, 99.0).otherwise(F.col("efs_time"))))
    assert run(changed) == 3 and run(changed) == 0
    assert run(changed, "a") == 3
    assert run(changed, "a", usable=F.col("id") > 3) == 3
    assert run(changed, "a", usable=F.col("id") > 3) == 0


def test_fingerprints_tell_pipelines_apart(rows):
    made = [cf.fingerprint(rows, regressor("logloss", ["a", "b"], "efs", maxIter=n, seed=1)) for n in (3, 3, 4)]
    assert made[0] == made[1] != made[2]


@pytest.mark.parametrize("objective", ["logloss", "rmse"])
def test_prefixes_equal_smaller_ensembles(rows, objective):
    """The first k trees of one fit are the trees of a fit of k rounds."""
    label = "efs" if objective == "logloss" else "efs_time"
    make = lambda k: regressor(objective, ["a", "b"], label, maxIter=k, maxDepth=2, seed=1)
    whole = make(4).fit(rows)
    got = {r.id: r.preds for r in cf.staged_predictions(whole, rows).select("id", "preds").collect()}
    for k in (1, 2, 4):
        want = cf.predict(make(k).fit(rows), rows).select("id", "pred").collect()
        assert all(got[r.id][k - 1] == pytest.approx(r.pred, abs=1e-12) for r in want)
    assert cf.predict_rounds(whole, rows, 2).filter(F.col("id") == 3).first().pred == got[3][1]


def test_early_stopping_fits_once_and_scores_every_round(rows):
    trees = regressor("logloss", ["a", "b"], "efs", maxIter=6, maxDepth=2, seed=1)
    model, rounds, scores = cf.stop_early(trees, rows, validation="held", metric=cf.concordance_metric(), patience=2)
    found = {r.rounds: r.score for r in scores.collect()}
    assert set(found) == set(range(1, 7)) and 1 <= rounds <= 6
    best = max(found[k] for k in range(1, rounds + 1))
    assert found[rounds] == best and len(model.stages[-1].trees) == 6


def test_patience(spark):
    scores = spark.createDataFrame([(1, 0.5), (2, 0.6), (3, None), (4, 0.55), (5, 0.9)], "rounds int, score double")
    assert cf.stopping_round(scores, 2) == 2 and cf.stopping_round(scores, 3) == 5
