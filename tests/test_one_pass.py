"""Folds and seeds that are fitted and predicted in one pass equal fits one by one."""

from __future__ import annotations

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from survloom.operators import folds
from survloom.operators import crossfit as cf
from survloom.operators.concordance import concordance_counts
from survloom.operators.models import GroupMeanRegressor, predict, regressor
from survloom.settings import staged


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(90).select(
        F.col("id").alias("ID"), (F.col("id") % 3).alias("g"), (F.col("id") * 7 % 11 + 100.0).alias("a"), (F.col("id") * 5 % 13).alias("b"),
        (F.col("id") % 17 + F.col("id") * 7 % 11 * 0.5).alias("y"), (F.col("id") % 4 / 4 + 0.25).alias("w"),
    )
    folds = {f"fold_{s}": (F.col("ID") * (s + 4) % 19 % 4).cast("int") for s in (1, 2)}
    return staged(df.withColumns(folds))


def test_ridges_of_all_folds_from_one_pass(rows):
    make = lambda i, seed: regressor("ridge", ["a", "b"], "y", weight="w", alpha=3.0 + i)
    usable = F.col("ID") % 7 != 0
    run = cf.cross_fit_seeds(make, rows, name="r", seeds=[1, 2], meta=["ID", "y"], usable=usable)
    assert run.predictions.columns == ["ID", "y", "pred", "name", "fold"] and set(run.models) == {(f"r_{s}", f) for s in (1, 2) for f in range(4)}
    got = {(r.name, r.ID): (r.fold, r.pred) for r in run.predictions.collect()}
    assert len(got) == 180
    for i, seed in enumerate((1, 2)):
        for fold in range(4):
            model = make(i, seed).fit(rows.filter(usable & (F.col(f"fold_{seed}") != fold)))
            own, last = run.models[f"r_{seed}", fold], model.stages[-1]
            assert own.stages[-1].coefficients.toArray() == pytest.approx(last.coefficients.toArray(), abs=1e-9)
            assert own.stages[-1].intercept == pytest.approx(last.intercept, abs=1e-7)
            for r in predict(model, rows.filter(F.col(f"fold_{seed}") == fold)).collect():
                assert got[f"r_{seed}", r.ID] == (fold, pytest.approx(r.pred, abs=1e-9))


def test_predictions_read_the_rows_once(rows):
    """Rows were read once for each seed and fold."""
    for make in (lambda i, seed: regressor("ridge", ["a"], "y", alpha=1.0), lambda i, seed: GroupMeanRegressor(["g"], "y")):
        run = cf.cross_fit_seeds(make, rows, name="r", seeds=[1, 2], meta=["ID"])
        tree = run.predictions._jdf.queryExecution().optimizedPlan().toString()
        assert sum("Relation" in line and "ID#" in line for line in tree.splitlines()) == 1


def test_models_made_from_sums_are_saved_and_score_together(rows, tmp_path):
    run = cf.cross_fit_seeds(lambda i, seed: regressor("ridge", ["a", "b"], "y", alpha=1.0), rows, name="r", seeds=[1], meta=["ID"])
    models = list(run.models.values())
    models[0].write().save(str(tmp_path / "model"))
    probe = rows.filter("ID < 9")
    singly = [{r.ID: r.pred for r in predict(m, probe).collect()} for m in [PipelineModel.load(str(tmp_path / "model")), *models[1:]]]
    scored = cf.score_models(models, probe)
    assert scored.columns == [*probe.columns, "pred"] and "UDF" not in scored._jdf.queryExecution().optimizedPlan().toString()
    assert {r.ID: r.pred for r in scored.collect()} == {k: pytest.approx(sum(s[k] for s in singly) / 4, abs=1e-9) for k in singly[0]}


def test_unsound_rows_are_refused(rows):
    ridge = regressor("ridge", ["a"], "y", weight="w", alpha=1.0)
    for column, value in (("a", None), ("a", float("nan")), ("y", None), ("w", -1.0)):
        odd = rows.withColumn(column, F.when(F.col("ID") == 5, F.lit(value).cast("double")).otherwise(F.col(column)))
        with pytest.raises(Exception, match="null or NaN|must be finite"):
            cf.cross_fit(ridge, odd, name="r", meta=["ID"], fold_col="fold_1")


def test_a_key_counts_as_a_whole_too(rows):
    parts = rows.select(F.col("a").alias("t"), (F.col("ID") % 2).alias("e"), F.round("y", 0).alias("r"), "g", F.col("fold_1").alias("fold"))
    parts = parts.unionByName(parts.limit(3).withColumns({"fold": F.lit(None).cast("int"), "g": F.lit(9).cast("long")}))
    both = parts.unionByName(parts.filter("fold IS NOT NULL").withColumn("fold", F.lit(None).cast("int")))
    found = concordance_counts(parts, "t", "e", "r", keys=["fold", "g"], whole="fold")
    want = concordance_counts(both, "t", "e", "r", keys=["fold", "g"])
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert found.filter("fold IS NULL").count() == 4


def test_scores_of_folds_and_of_all_folds(rows):
    run = cf.cross_fit_seeds(lambda i, seed: GroupMeanRegressor(["g"], "y"), rows, name="r", seeds=[1, 2], meta=["ID", "y", "a", "w"])
    metric = cf.concordance_metric("a", "e", "g", "pred")
    named = lambda df: df.withColumns({"e": (F.col("ID") % 2).cast("int"), "g": F.lit("one")})
    run.predictions = named(run.predictions)
    last = run.predictions.filter("name = 'r_1'").withColumns({"name": F.lit("final"), "fold": F.lit(None).cast("int")})
    found = {(r.name, r.fold): r.score for r in run.scores(metric, last).collect()}
    assert set(found) == {("final", None), *((f"r_{s}", f) for s in (1, 2) for f in (None, *range(4)))}
    assert found["final", None] == found["r_1", None]
    for (name, fold), score in found.items():
        own = last if name == "final" else run.predictions.filter((F.col("name") == name) & (F.lit(fold is None) | (F.col("fold") == (fold or 0))))
        assert concordance_counts(own, "a", "e", "pred").first().c_index == pytest.approx(score, abs=1e-12)


@pytest.mark.parametrize("compared", [0, 64])
def test_both_ways_to_find_folds(spark, monkeypatch, compared):
    monkeypatch.setattr(folds, "_COMPARED", compared)
    monkeypatch.setattr(folds, "GROUP_ROWS", 40)
    ids = spark.range(500).withColumnRenamed("id", "ID")
    got = {(r["ID"], s, r[f"fold_{s}"]) for r in cf.with_seed_folds(ids, "ID", 10, [3, 4]).collect() for s in (3, 4)}
    assert got == {(r["ID"], r["seed"], r["fold"]) for r in folds.fold_table(ids, "ID", 10, [3, 4]).collect()}
