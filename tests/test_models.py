"""Cox regression, ridge, fractional labels, blending, cross-fitting and file ends."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from survloom.operators import cox, prefix
from survloom.operators import crossfit as cf
from survloom.operators.blend import simplex_least_squares
from survloom.operators.cox import CoxRegression
from survloom.operators.ranges import fit_ranges
from survloom.operators.models import GroupMeanRegressor, RidgeRegressor, feature_importances, mark_nominal, predict, regressor
from survloom.plans.experiments import EXPERIMENTS, WEIGHTS
from survloom.settings import fresh_path, keep, staged
from survloom.sources.files import diagonal_union, write_predictions


def efron(t, e, x, beta, cases=None):
    """Log-likelihood, score and information by a loop over times."""
    cases = np.ones(len(t)) if cases is None else cases
    w = cases * np.exp(x @ beta)
    p = x.shape[1]
    ll, score, info = 0.0, np.zeros(p), np.zeros((p, p))
    for now in np.unique(t[e == 1]):
        risk, dead = t >= now, (t == now) & (e == 1)
        d = dead.sum()
        v = cases[dead].sum() / d
        ll += (cases[dead] * (x[dead] @ beta)).sum()
        score += cases[dead] @ x[dead]
        for q in range(d):
            wq = w * (risk - q / d * dead)
            s0, s1 = wq.sum(), wq @ x
            ll -= v * np.log(s0)
            score -= v * s1 / s0
            info += v * ((x.T * wq) @ x / s0 - np.outer(s1, s1) / s0**2)
    return ll, score, info


@pytest.fixture(scope="module")
def survival(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 2))
    t = np.ceil(rng.exponential(np.exp(-0.7 * x[:, 0] + 0.3 * x[:, 1])) * 10)
    e = (rng.random(300) < 0.7).astype(int)
    pdf = pd.DataFrame({"id": range(300), "efs_time": t, "efs": e, "a": x[:, 0], "b": x[:, 1]})
    return pdf, spark.createDataFrame(pdf).cache()


def test_cox_fit(survival, spark):
    pdf, df = survival
    x, t, e = pdf[["a", "b"]].to_numpy(), pdf.efs_time.to_numpy(), pdf.efs.to_numpy()
    model = CoxRegression(["a", "b"]).fit(df)
    beta = np.array([model.coefficients["a"], model.coefficients["b"]])
    ll, score, _ = efron(t, e, x, beta)
    assert np.abs(score).max() < 1e-3
    assert model.options["log_likelihood"] == pytest.approx(efron(t, e, x - x.mean(0), beta)[0], abs=1e-4)

    lp = (x - x.mean(0)) @ beta
    hazard = [
        sum((e[t == u] == 1).sum() / np.exp(lp[t >= u]).sum() for u in np.unique(t) if u <= now)
        for now in t
    ]
    got = model.survival_at_own_time(df, "s").orderBy("id").toPandas().s.to_numpy()
    assert got == pytest.approx(np.exp(-np.array(hazard) * np.exp(lp)), abs=1e-9)

    path = fresh_path(spark, "cox")
    model.write().save(path)
    again = cox.CoxModel.load(path)
    assert again.coefficients == model.coefficients


@pytest.mark.parametrize("one_by_one", [0, 299])
def test_cox_many_ties_and_weights(spark, one_by_one):
    """Two times hold nearly all rows, at one of them everybody left dies."""
    rng = np.random.default_rng(one_by_one)
    x = rng.normal(size=(600, 2))
    t = np.where(np.arange(600) < 300 + one_by_one // 2, 1.0, 2.0)
    e = (rng.random(600) < 0.9) | (t == 2)
    cases = rng.integers(1, 4, 600) / 2
    beta = np.array([0.4, -0.3])
    rows = pd.DataFrame({"_t": t, "_x0": x[:, 0], "_x1": x[:, 1], "_n": cases, "_d": e.astype(int), "_dw": cases * e})
    got = cox.newton_terms(spark.createDataFrame(rows), beta, [1.5])
    expected = efron(t, e.astype(int), x, beta, cases)
    for ours, theirs in zip(got, expected, strict=True):
        assert ours == pytest.approx(theirs, rel=1e-10, abs=1e-9)


def test_cox_heavy_times_and_small_pieces(spark, monkeypatch):
    """A time that is a range of its own, windows over two ranges, and times in small pieces."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 3))
    t = np.where(rng.random(500) < 0.4, 7.0, rng.integers(0, 60, 500)).astype(float)
    e, cases = rng.integers(0, 2, 500), rng.integers(1, 4, 500) / 2
    beta = np.array([0.4, -0.3, 0.1])
    rows = pd.DataFrame({"_t": t, **{f"_x{i}": x[:, i] for i in range(3)}, "_n": cases, "_d": e, "_dw": cases * e})
    df = spark.createDataFrame(rows).repartition(3).persist()
    monkeypatch.setattr(prefix, "FAN_BITS", 1)
    cuts = fit_ranges(df, "_t", 20)
    assert cuts.add(df, "_t", "r").filter("r % 2 = 1").count() >= 100
    expected = efron(t, e, x, beta, cases)
    for ours, theirs in zip(cox.newton_terms(df, beta, cuts), expected, strict=True):
        assert ours == pytest.approx(theirs, rel=1e-10, abs=1e-9)


def test_tie_sums_agree_where_the_formulas_meet():
    """One time of d deaths, added singly and by the expansion, around the size where that begins."""
    for d in (1, 2, 63, 64, 65, 66, 200, 5000):
        for r in (1e-9, 0.3, 0.999, 1.0):
            y = 1 - r * np.arange(d) / d
            want = np.log(y).sum(), (1 / y).sum(), (1 / y**2).sum()
            got = cox.tie_sums(np.array([float(d)]), np.array([r]))
            assert [float(g[0]) for g in got] == pytest.approx(want, rel=1e-11, abs=1e-11)


def test_cox_wide_fit_with_an_indicator_per_category(spark):
    """Fifty covariates, ten of them indicators that add up to one: predictions as without one of them."""
    rng = np.random.default_rng(9)
    n, kinds = 10_000, rng.integers(0, 10, 10_000)
    x = np.concatenate((rng.normal(size=(n, 40)), np.eye(10)[kinds]), axis=1)
    t = np.round(rng.exponential(np.exp(-x[:, 0] / 2 - kinds / 10)) * 500)
    names = [f"c{i}" for i in range(50)]
    rows = pd.DataFrame(x, columns=names).assign(efs_time=t, efs=rng.integers(0, 2, n))
    df = spark.createDataFrame(rows).repartition(4).persist()
    start = time.monotonic()
    model = CoxRegression(names).fit(df)
    assert time.monotonic() - start < 60
    beta = np.array([model.coefficients[c] for c in names])
    x0 = x - x.mean(axis=0)
    _, score, _ = efron_score(t, rows.efs.to_numpy(), x0, beta)
    assert np.abs(score).max() < 1.0


def efron_score(t, e, x, beta):
    """Score of the partial likelihood by one pass from the latest time."""
    w = np.exp(x @ beta)
    s0, s1, score = 0.0, np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for u in np.unique(t)[::-1]:
        at = t == u
        s0, s1 = s0 + w[at].sum(), s1 + w[at] @ x[at]
        dead = at & (e == 1)
        d, e0, e1 = dead.sum(), w[dead].sum(), w[dead] @ x[dead]
        score += x[dead].sum(axis=0)
        for q in range(d):
            score -= (s1 - q / d * e1) / (s0 - q / d * e0)
    return 0.0, score, None


def test_cox_weighted_fit(survival, spark):
    """A whole weight counts like repeated rows in the score; weight 0 and null take no part."""
    pdf, df = survival
    x, t, e = pdf[["a", "b"]].to_numpy(), pdf.efs_time.to_numpy(), pdf.efs.to_numpy()
    cases = 1.0 + pdf.id.to_numpy() % 3
    weighted = df.withColumn("w", F.lit(1.0) + F.col("id") % 3)
    strange = df.limit(4).withColumn("w", F.expr("if(id % 2 = 0, 0D, null)"))
    model = CoxRegression(["a", "b"], weightCol="w").fit(weighted.unionByName(strange))
    beta = np.array([model.coefficients["a"], model.coefficients["b"]])
    assert np.abs(efron(t, e, x, beta, cases)[1]).max() < 2e-3


def test_cox_rejects_constant_covariate(survival):
    with pytest.raises(ValueError):
        CoxRegression(["a", "one"]).fit(survival[1].withColumn("one", F.lit(1.0)))


@pytest.mark.parametrize("weighted", [False, True])
def test_ridge_closed_form(survival, weighted):
    pdf, df = survival
    w = 1.0 + pdf.efs.to_numpy() if weighted else np.ones(len(pdf))
    x, y = pdf[["a", "b"]].to_numpy(), pdf.efs_time.to_numpy()
    mx, my = np.average(x, axis=0, weights=w), np.average(y, weights=w)
    xc = x - mx
    beta = np.linalg.solve((xc.T * w) @ xc + 20 * np.eye(2), (xc.T * w) @ (y - my))
    rows = df.withColumn("w", F.lit(1.0) + F.col("efs"))
    model = regressor("ridge", ["a", "b"], "efs_time", weight="w" if weighted else None, alpha=20.0).fit(rows)
    assert model.stages[-1].coefficients.toArray() == pytest.approx(beta, rel=1e-9)
    assert isinstance(RidgeRegressor(2.0).alpha, float)


def test_unknown_objective():
    with pytest.raises(ValueError):
        regressor("hinge", ["a"], "y")


def test_simplex_weights_against_grid():
    rng = np.random.default_rng(1)
    for _ in range(20):
        x, y = rng.normal(size=(50, 3)), rng.normal(size=50)
        gram, cross = x.T @ x, x.T @ y
        w = simplex_least_squares(gram, cross)
        assert w.min() >= 0 and w.sum() == pytest.approx(1)
        grid = [
            np.array([a, b, 100 - a - b]) / 100 for a in range(101) for b in range(101 - a)
        ]
        loss = lambda v: v @ gram @ v / 2 - cross @ v
        assert loss(w) <= min(map(loss, grid)) + 1e-9


def test_cross_fit_reuses_finished_folds(spark, survival):
    df = staged(survival[1].withColumns({"fold": (F.col("id") % 3).cast("int"), "g": F.col("efs")}))
    store = cf.FoldStore(spark, fresh_path(spark, "store"))
    calls = []

    class Counting(GroupMeanRegressor):
        def _fit(self, dataset):
            calls.append(1)
            return super()._fit(dataset)

    first = cf.cross_fit(Counting(["g"], "efs_time"), df, name="m", meta=["id", "efs"], store=store)
    again = cf.cross_fit(Counting(["g"], "efs_time"), df, name="m", meta=["id", "efs"], store=store)
    assert len(calls) == 3
    a, b = (r.predictions.orderBy("id").collect() for r in (first, again))
    assert a == b and len(a) == 300
    cf.cross_fit(Counting(["g"], "efs_time"), df, name="m", meta=["id"], folds=[1], store=store, overwrite=True)
    assert len(calls) == 4
    assert store.predictions().count() == 300


def test_scores_per_fold_and_overall(survival):
    df = keep(survival[1].withColumns({"fold": (F.col("id") % 2).cast("int"), "stratum": F.lit("s")}))
    run = cf.cross_fit(
        CoxRegression(["a", "b"], tol=1e-3),
        df,
        name="cox",
        meta=["id", "efs", "efs_time", "stratum"],
        features=["a", "b"],
    )
    scores = {r.fold: r.score for r in run.scores(cf.concordance_metric()).collect()}
    assert set(scores) == {0, 1, None} and min(scores.values()) > 0.6
    top = cf.importance_top_k(run.importances(), 1).first()
    assert top.feature == "a"
    assert cf.importance_detail(run.importances(), 1).count() == 2


def test_positive_class_probability(survival):
    model = regressor("logistic", ["a", "b"], "efs").fit(survival[1])
    got = predict(model, survival[1])
    assert set(got.columns) == {*survival[1].columns, "pred"}
    low, high = got.agg(F.min("pred"), F.max("pred")).first()
    assert 0 < low < high < 1


def test_union_types_and_prediction_folders(spark):
    a = spark.createDataFrame([(1, 2)], "id long, v int")
    b = spark.createDataFrame([(2, 0.5, "x")], "id long, v double, w string")
    out = diagonal_union(a, b)
    assert dict(out.dtypes) == {"id": "bigint", "v": "double", "w": "string"}
    assert out.filter("w IS NULL").count() == 1
    path = fresh_path(spark, "pred")
    write_predictions(spark.createDataFrame([(1, 0.5, "m", 0)], "id long, pred double, name string, fold int"), path)
    assert spark.read.parquet(f"{path}/name=m/fold=0").count() == 1


@pytest.mark.parametrize("objective", ["ridge", "tweedie", "gamma", "cross_entropy"])
def test_numbering_of_categories_does_not_matter(spark, objective):
    rng = np.random.default_rng(3)
    kind = rng.integers(0, 5, 400)
    goal = np.array([0.3, 0.9, 0.1, 0.6, 0.5])[kind] + rng.random(400) / 20
    moved = np.array([3, 0, 4, 1, 2])[kind]
    pdf = pd.DataFrame({"id": range(400), "n": rng.random(400), "kind": kind, "moved": moved, "goal": goal})
    df = mark_nominal(spark.createDataFrame(pdf), {"kind": 5, "moved": 5})
    params = {"ridge": {"alpha": 0.1}}.get(objective, {"regParam": 1e-3})
    found = []
    for name in ("kind", "moved"):
        model = regressor(objective, [name, "n"], "goal", categories=[name], **params).fit(df)
        # A code that fitting has not seen is scored, too.
        new = df.limit(1).withColumn(name, F.lit(9)).withColumn("id", F.lit(-1))
        out = predict(model, df.unionByName(new))
        assert set(out.columns) == {*df.columns, "pred"}
        assert set(feature_importances(model, [name, "n"]) if objective != "cross_entropy" else [name, "n"]) == {name, "n"}
        found.append(out.orderBy("id").toPandas().pred.to_numpy())
    assert found[0] == pytest.approx(found[1], abs=1e-4)
    assert np.corrcoef(found[0][-400:], goal)[0, 1] > 0.95


def test_trees_split_sets_of_categories(spark):
    """One split separates the same categories however they are numbered."""
    kind = np.arange(400) % 5
    goal = np.array([0.3, 0.9, 0.1, 0.8, 0.2])[kind]
    moved = np.array([3, 0, 4, 2, 1])[kind]
    rows = spark.createDataFrame(pd.DataFrame({"id": range(400), "kind": kind, "moved": moved, "goal": goal}))
    for name in ("kind", "moved"):
        df = mark_nominal(rows, {name: 5})
        model = regressor("rmse", [name], "goal", categories=[name], maxIter=1, maxDepth=1, seed=1).fit(df)
        got = predict(model, df).orderBy("id").toPandas().pred.to_numpy()
        assert got == pytest.approx(np.array([0.2, 0.85, 0.2, 0.85, 0.2])[kind], abs=1e-9)


def test_matrix_is_complete():
    names = set(EXPERIMENTS)
    assert {"tweedie_km_graded", "gamma_cox_none", "cross_entropy_km_half", "cox_none"} <= names
    assert all(e.weighting in WEIGHTS for e in EXPERIMENTS.values())
    cells = {(e.target, e.objective, e.weighting, e.n_splits, e.prob_clip, e.input_features) for e in EXPERIMENTS.values()}
    assert len(cells) == len(EXPERIMENTS)
    assert EXPERIMENTS["tweedie_cox_graded"].seeds == (2, 3, 4, 5, 6)
    assert EXPERIMENTS["stack_rmse_graded"].n_splits == 10
