"""Queries on cross-fitting, scoring, objectives and ensembles."""

from __future__ import annotations

from functools import partial

from pyspark.ml import Estimator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from survloom.operators import crossfit as cf
from survloom.operators.blend import average_by_id, fit_blend_weights
from survloom.operators.encoders import OneHotEncoder
from survloom.operators.folds import assign_folds
from survloom.operators.models import GroupMeanRegressor, mark_nominal, predict, regressor
from survloom.plans.experiments import (
    EXPERIMENTS,
    WEIGHTS,
    Columns,
    Fitting,
    Learner,
    run_experiment,
    run_stack,
    target_stage,
)
from survloom.plans.experiments import hazard_stage as cox_stage
from survloom.plans.registry import query, rounded, sql_folds, sql_rounded
from survloom.plans.tables import SQL_CURVE
from survloom.settings import fresh_path, keep, staged
from survloom.sources.frames import survival_frame, training_rows

_FEATURES = ["price_k", "balance_k"]


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with scaled numeric columns and a positive target."""
    return survival_frame(spark, folder).withColumns(
        {
            "price_k": F.col("price") / 100000,
            "balance_k": F.col("balance") / 1000,
            "years": F.col("efs_time") / 365,
            "share": F.col("efs_time") / 3650,
            "weight": F.when(F.col("efs") == 1, 1.0).otherwise(0.5),
        }
    )


def _train(spark: SparkSession, folder: str, n_splits: int = 4, seed: int = 1) -> DataFrame:
    """Training rows with folds, staged because each fold reads them again."""
    return staged(
        assign_folds(_rows(spark, folder).filter(training_rows()), "ID", n_splits, seed), "train"
    )


_TRAIN_SQL = f"""folded AS ({sql_folds('''(SELECT *, price / 100000 AS price_k, balance / 1000 AS balance_k,
    efs_time / 365 AS years, efs_time / 3650 AS share, CASE WHEN efs = 1 THEN 1.0 ELSE 0.5 END AS weight
    FROM frame WHERE dataset = 'TRAIN')''', 4, 1)})"""

_GROUP_MEAN = f"""SELECT * FROM (WITH {_TRAIN_SQL},
  means AS (SELECT s.fold, g.stratum, g.status, sum(g.years * g.weight) / sum(g.weight) AS m
            FROM (SELECT DISTINCT fold FROM folded) s JOIN folded g ON g.fold <> s.fold GROUP BY 1, 2, 3)
  SELECT f.ID, f.fold, {sql_rounded('m')} AS pred FROM folded f
  JOIN means n ON n.fold = f.fold AND n.stratum = f.stratum AND n.status = f.status)"""


def _group_mean() -> GroupMeanRegressor:
    return GroupMeanRegressor(["stratum", "status"], "years", "weight")


@query("oof_group_mean", _GROUP_MEAN)
def oof_group_mean(spark: SparkSession, folder: str) -> DataFrame:
    run = cf.cross_fit(_group_mean(), _train(spark, folder), name="mean", meta=["ID"])
    return run.predictions.select("ID", "fold", rounded("pred").alias("pred"))


@query("fold_reuse", _GROUP_MEAN)
def fold_reuse(spark: SparkSession, folder: str) -> DataFrame:
    """The second run loads the models of the first; predictions come from the store."""
    train = _train(spark, folder)
    store = cf.FoldStore(spark, fresh_path(spark, "folds"))
    for _ in range(2):
        cf.cross_fit(_group_mean(), train, name="mean", meta=["ID"], store=store)
    return store.predictions().select("ID", "fold", rounded("pred").alias("pred"))


_RIDGE_COUNTS = f"""SELECT * FROM (WITH {_TRAIN_SQL}
  SELECT fold, count(*) AS n, CAST(sum(ID) AS BIGINT) AS ids FROM folded GROUP BY fold)"""


@query("oof_ridge_counts", _RIDGE_COUNTS)
def oof_ridge_counts(spark: SparkSession, folder: str) -> DataFrame:
    ridge = regressor("scaled_ridge", _FEATURES, "years", weight="weight", alpha=1.0)
    run = cf.cross_fit(ridge, _train(spark, folder), name="ridge", meta=["ID"])
    return (
        run.predictions.filter(F.col("pred").isNotNull())
        .groupBy("fold")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("ID").alias("ids"))
    )


@query(
    "oof_ridge",
    f"""SELECT * FROM (WITH {_TRAIN_SQL},
      sums AS (SELECT s.fold, sum(weight) AS w, sum(weight * price_k) AS x, sum(weight * years) AS y,
                      sum(weight * price_k * price_k) AS xx, sum(weight * price_k * years) AS xy
               FROM (SELECT DISTINCT fold FROM folded) s JOIN folded g ON g.fold <> s.fold GROUP BY 1),
      fits AS (SELECT fold, x / w AS mx, y / w AS my, (xy - x * y / w) / (xx - x * x / w + 50) AS slope FROM sums)
      SELECT ID, f.fold, {sql_rounded('my + slope * (price_k - mx)')} AS pred FROM folded f JOIN fits t ON t.fold = f.fold)""",
)
def oof_ridge(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted ridge on one column, where the closed form fits in SQL."""
    ridge = regressor("ridge", ["price_k"], "years", weight="weight", alpha=50.0)
    run = cf.cross_fit(ridge, _train(spark, folder), name="ridge", meta=["ID"])
    return run.predictions.select("ID", "fold", rounded("pred").alias("pred"))


@query(
    "score_mean_models",
    f"""SELECT * FROM (WITH {_TRAIN_SQL},
      means AS (SELECT s.fold, g.stratum, g.status, sum(g.years * g.weight) / sum(g.weight) AS m
                FROM (SELECT DISTINCT fold FROM folded) s JOIN folded g ON g.fold <> s.fold GROUP BY 1, 2, 3)
      SELECT ID, f.stratum, {sql_rounded('avg(m)')} AS pred FROM frame f
      JOIN means n ON n.stratum = f.stratum AND n.status = f.status WHERE f.dataset = 'TEST' GROUP BY ID, f.stratum)""",
)
def score_mean_models(spark: SparkSession, folder: str) -> DataFrame:
    run = cf.cross_fit(_group_mean(), _train(spark, folder), name="mean", meta=["ID"])
    test = _rows(spark, folder).filter(~training_rows()).select("ID", "stratum", "status")
    scored = cf.score_models(list(run.models.values()), test)
    return scored.select("ID", "stratum", rounded("pred").alias("pred"))


def _seed_sql(seed: int) -> str:
    folds = sql_folds("(SELECT ID, stratum, efs_time / 365 AS years FROM frame WHERE dataset = 'TRAIN')", 3, seed)
    return f"""SELECT f.ID, m FROM ({folds}) f JOIN (
        SELECT s.fold, g.stratum, avg(g.years) AS m FROM (SELECT DISTINCT fold FROM ({folds})) s
        JOIN ({folds}) g ON g.fold <> s.fold GROUP BY 1, 2) n ON n.fold = f.fold AND n.stratum = f.stratum"""


@query(
    "multi_seed",
    f"SELECT ID, {sql_rounded('avg(m)')} AS pred FROM ({' UNION ALL '.join(_seed_sql(s) for s in (1, 2))}) GROUP BY ID",
)
def multi_seed(spark: SparkSession, folder: str) -> DataFrame:
    train = _rows(spark, folder).filter(training_rows()).select("ID", "stratum", "years")
    folded = staged(cf.with_seed_folds(train, "ID", 3, [1, 2]), "train")
    run = cf.cross_fit_seeds(
        lambda i, seed: GroupMeanRegressor(["stratum"], "years"),
        folded,
        name="mean",
        seeds=[1, 2],
        meta=["ID"],
    )
    return average_by_id(run.predictions, "ID").select("ID", rounded("pred").alias("pred"))


# --- objectives: saturated models have closed forms ----------------------------


def _saturated(spark: SparkSession, folder: str, objective: str, label: str, **params) -> DataFrame:
    """One model on the one-hot stratum, whose predictions are group means."""
    train = keep(
        _rows(spark, folder)
        .filter(training_rows())
        .select("ID", "stratum", "efs", "years", "share", "weight")
    )
    coded = keep(OneHotEncoder("stratum", "ID").fit(train).transform(train))
    features = [c for c in coded.columns if c.startswith("stratum_")]
    pipeline = regressor(objective, features, label, weight="weight", **params)
    scored = predict(pipeline.fit(coded), coded)
    return scored.select("ID", rounded("pred", 5).alias("pred"))


def _saturated_sql(label: str) -> str:
    return f"""SELECT * FROM (WITH {_TRAIN_SQL} SELECT ID, {sql_rounded(f'sum({label} * weight) OVER w / sum(weight) OVER w', 5)} AS pred
        FROM folded WINDOW w AS (PARTITION BY stratum))"""


@query("objective_tweedie", _saturated_sql("years"))
def objective_tweedie(spark: SparkSession, folder: str) -> DataFrame:
    return _saturated(spark, folder, "tweedie", "years", tol=1e-12, maxIter=100)


@query("objective_gamma", _saturated_sql("years"))
def objective_gamma(spark: SparkSession, folder: str) -> DataFrame:
    return _saturated(spark, folder, "gamma", "years", tol=1e-12, maxIter=100)


@query("objective_cross_entropy", _saturated_sql("share"))
def objective_cross_entropy(spark: SparkSession, folder: str) -> DataFrame:
    return _saturated(spark, folder, "cross_entropy", "share", tol=1e-14, maxIter=500)


@query("objective_logistic", _saturated_sql("efs"))
def objective_logistic(spark: SparkSession, folder: str) -> DataFrame:
    return _saturated(spark, folder, "logistic", "efs", tol=1e-14, maxIter=500)


@query("objective_rmse_trees")
def objective_rmse_trees(spark: SparkSession, folder: str) -> DataFrame:
    """Boosted trees on numeric columns and a category, stopped early on held-out training rows."""
    train = _train(spark, folder)
    coded = staged(OneHotEncoder("stratum", "ID", drop_last=False).fit(train).transform(train))
    code = sum(F.col(c) * i for i, c in enumerate(c for c in coded.columns if c.startswith("stratum_")))
    rows = mark_nominal(coded.withColumn("stratum_code", code.cast("double")), {"stratum_code": 5})
    rows = rows.withColumn("held", F.col("fold") == 0)
    trees = regressor(
        "rmse",
        [*_FEATURES, "stratum_code"],
        "years",
        weight="weight",
        validation="held",
        maxIter=10,
        maxDepth=3,
        seed=1,
    )
    return predict(trees.fit(rows), rows.filter("held")).select("ID", "pred")


@query("weibull_fit")
def weibull_fit(spark: SparkSession, folder: str) -> DataFrame:
    """Accelerated failure time fit: expected time per row."""
    rows = keep(_train(spark, folder).withColumn("efs", F.col("efs").cast("double")))
    pipeline = regressor("weibull", _FEATURES, "years", event="efs", maxIter=50)
    return predict(pipeline.fit(rows), rows).select("ID", "pred")


@query("early_stopping")
def early_stopping(spark: SparkSession, folder: str) -> DataFrame:
    """Stratified concordance on validation rows after each tree of one boosted ensemble, and where it stops."""
    rows = _train(spark, folder).withColumn("held", F.col("fold") == 0)
    trees = regressor("logloss", _FEATURES, "efs", maxIter=20, maxDepth=3, seed=1)
    _, rounds, scores = cf.stop_early(
        trees, rows, validation="held", metric=cf.concordance_metric(), patience=5
    )
    return scores.withColumn("chosen", F.col("rounds") == rounds)


_PREFIX_STEPS = ("round(price / 1000, 0)", "-round(balance / 100, 0)", "ID % 50")


def _prefix_sql() -> str:
    sums = [" + ".join(f"({s})" for s in _PREFIX_STEPS[: k + 1]) for k in range(len(_PREFIX_STEPS))]
    rows = " UNION ALL ".join(f"SELECT {k + 1} AS rounds, stratum, efs_time AS t, efs AS e, {s} AS r FROM frame WHERE ID % 4 = 0" for k, s in enumerate(sums))
    return f"""SELECT rounds, {sql_rounded('avg(c) - stddev_pop(c)')} AS score FROM (
      SELECT a.rounds, a.stratum, sum(CASE WHEN a.r > b.r THEN 1.0 WHEN a.r = b.r THEN 0.5 ELSE 0 END) / count(*) AS c
      FROM ({rows}) a JOIN ({rows}) b ON a.rounds = b.rounds AND a.stratum = b.stratum AND a.e = 1
        AND (a.t < b.t OR (a.t = b.t AND b.e = 0)) GROUP BY ALL) GROUP BY rounds"""


@query("early_stopping_scores", _prefix_sql())
def early_stopping_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of all prefixes of an ensemble on the validation rows, for steps that SQL can follow."""
    frame = survival_frame(spark, folder).filter("ID % 4 = 0")
    total, preds = F.lit(0.0), []
    for step in _PREFIX_STEPS:
        total = total + F.expr(step)
        preds.append(total)
    rows = frame.select("stratum", "efs", "efs_time", F.array(*preds).alias("preds"))
    scores = cf.prefix_scores(rows, "preds", cf.concordance_metric())
    return scores.select("rounds", rounded("score").alias("score"))


@query("model_importances")
def model_importances(spark: SparkSession, folder: str) -> DataFrame:
    """Mean importance per feature over the folds of boosted trees."""
    trees = regressor("logloss", _FEATURES, "efs", maxIter=3, maxDepth=3, seed=1)
    run = cf.cross_fit(
        trees, _train(spark, folder, 3), name="trees", meta=["ID"], features=_FEATURES
    )
    return cf.importance_top_k(run.importances(), 2)


@query("blend_weights")
def blend_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Weights of two prediction columns with the least squared error."""
    rows = _rows(spark, folder).select(
        "years", F.col("price_k").alias("a"), (F.col("balance_k") / 2).alias("b")
    )
    weights = fit_blend_weights(rows, ["a", "b"], "years")
    return spark.createDataFrame(list(weights.items()), "source string, weight double")


@query("hazard_stage")
def hazard_stage(spark: SparkSession, folder: str) -> DataFrame:
    """Cox regression as a cross-fitted model, averaged over seeds."""
    rows = _experiment_rows(spark, folder)
    numeric = Columns(numeric=("price", "balance"))
    ids = rows.filter(training_rows()).select("ID")
    return cox_stage(rows, ids, numeric, seeds=(1,), n_splits=2)


# --- whole jobs ----------------------------------------------------------------

_COLUMNS = Columns(
    stratum="stratum",
    numeric=("price", "balance"),
    categorical=("priority", "status", "stratum"),
)


def _experiment_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of a job, staged because every stage of it reads them again."""
    rows = survival_frame(spark, folder).select(
        "ID", "dataset", "efs", "efs_time", "stratum", "priority", "status", "price", "balance"
    )
    return staged(rows, "rows")


@query("event_probability")
def event_probability(spark: SparkSession, folder: str) -> DataFrame:
    """Out-of-fold event probability from two classifiers, averaged, and the scaled targets."""
    targets = target_stage(_experiment_rows(spark, folder), _COLUMNS, seeds=(1,), n_splits=2)
    return targets.select(
        "ID", "t_event_pred", "t_kmf", "t_bfhf", "t_kmf_event_scaled", "t_bfhf_event_scaled"
    )


@query("base_experiment")
def base_experiment(spark: SparkSession, folder: str) -> DataFrame:
    """One experiment from raw rows to out-of-fold and test predictions."""
    rows = _experiment_rows(spark, folder)
    targets = target_stage(rows, _COLUMNS, seeds=(1,), n_splits=2)
    result = run_experiment(
        EXPERIMENTS["tweedie_km_graded"], rows, targets, _COLUMNS, seeds=(1, 2), n_splits=2
    )
    return result.oof.unionByName(result.test)


@query("stack_experiment")
def stack_experiment(spark: SparkSession, folder: str) -> DataFrame:
    """Two experiments stacked by a third."""
    rows = _experiment_rows(spark, folder)
    targets = target_stage(rows, _COLUMNS, seeds=(1,), n_splits=2)
    names = ("tweedie_km_graded", "gamma_km_half")
    jobs = [
        partial(run_experiment, EXPERIMENTS[name], rows, targets, _COLUMNS, seeds=(1,), n_splits=2)
        for name in names
    ]
    results = dict(zip(names, cf.concurrently(spark, jobs), strict=True))
    result = run_stack(
        EXPERIMENTS["stack_rmse_graded"],
        rows,
        targets,
        results,
        _COLUMNS,
        seeds=(1,),
        n_splits=2,
        params={"maxIter": 3},
    )
    return result.oof.unionByName(result.test)


# --- whole jobs with learners that SQL can follow ---------------------------------

_STAGE_SEEDS, _BASE_SEEDS = (0, 1, 2, 3, 4), (1, 2, 3, 4, 5)


def _means(*keys: str) -> Learner:
    """Learners that predict the weighted mean goal of a group."""
    return lambda i, seed, to: GroupMeanRegressor(list(keys), to.label, to.weight)


def _own_means_sql(rows: str, n_splits: int, seeds: tuple[int, ...], keys: str, y: str, w: str = "1") -> str:
    """(ID, pred): mean over seeds of the group mean of the other folds' rows."""
    parts = [
        f"""SELECT ID, (sum({y} * {w}) OVER k - sum({y} * {w}) OVER f) / (sum({w}) OVER k - sum({w}) OVER f)::DOUBLE AS m
            FROM ({sql_folds(rows, n_splits, seed)}) WINDOW k AS (PARTITION BY {keys}), f AS (PARTITION BY {keys}, fold)"""
        for seed in seeds
    ]
    return f"SELECT ID, avg(m) AS pred FROM ({' UNION ALL '.join(parts)}) GROUP BY ID"


def _new_means_sql(rows: str, n_splits: int, seeds: tuple[int, ...], keys: str, y: str, w: str) -> str:
    """({keys}, pred): mean over seeds and folds of the group mean without the fold's rows."""
    parts = [
        f"""SELECT {keys}, g.fold, (any_value(a.y) - coalesce(sum(o.y), 0)) / (any_value(a.w) - coalesce(sum(o.w), 0)) AS m
            FROM (SELECT {keys}, sum({y} * {w}) AS y, sum({w}) AS w FROM {rows} GROUP BY ALL) a
            CROSS JOIN range({n_splits}) g(fold)
            LEFT JOIN (SELECT {keys}, fold, sum({y} * {w}) AS y, sum({w}) AS w
                       FROM ({sql_folds(rows, n_splits, seed)}) GROUP BY ALL) o USING ({keys}, fold)
            GROUP BY {keys}, g.fold"""
        for seed in seeds
    ]
    return f"SELECT {keys}, avg(m) AS pred FROM ({' UNION ALL '.join(parts)}) GROUP BY {keys}"


_TRAINED = f"""{SQL_CURVE},
  trained AS (SELECT * FROM own WHERE dataset = 'TRAIN'),
  event_pred AS (SELECT ID, avg(pred) AS p FROM (
    {_own_means_sql('trained', 10, _STAGE_SEEDS, 'stratum, status', 'efs')} UNION ALL
    {_own_means_sql('trained', 10, _STAGE_SEEDS, 'priority', 'efs')}) GROUP BY ID),
  aimed AS (SELECT t.*, p FROM trained t JOIN event_pred USING (ID))"""


def _targets_by_means(rows: DataFrame) -> DataFrame:
    learners = {"cells": _means("stratum", "status"), "priority": _means("priority")}
    return target_stage(rows, _COLUMNS, seeds=_STAGE_SEEDS, n_splits=10, learners=learners)


def _sql_shift(p: str, t: str, over: str = "") -> str:
    """ln p / f + t with f = min(ln p) / -min(t); t where f is undefined or 0."""
    low_p, low_t = f"(min(ln({p})) OVER ({over}))", f"(min({t}) OVER ({over}))"
    return f"(CASE WHEN {low_t} = 0 OR {low_p} = 0 THEN 0 ELSE ln({p}) / ({low_p} / (0 - {low_t})) END + {t})"


@query(
    "event_probability_means",
    f"""SELECT * FROM (WITH {_TRAINED}
        SELECT ID, {sql_rounded('p')} AS t_event_pred, {sql_rounded('t_kmf')} AS t_kmf, {sql_rounded('t_bfhf')} AS t_bfhf,
               {sql_rounded(_sql_shift('p', 't_kmf'))} AS t_kmf_event_scaled,
               {sql_rounded(_sql_shift('p', 't_bfhf'))} AS t_bfhf_event_scaled FROM aimed)""",
)
def event_probability_means(spark: SparkSession, folder: str) -> DataFrame:
    """The target stage with ten folds and five seeds of two learners of group means."""
    targets = _targets_by_means(_experiment_rows(spark, folder))
    shown = ("t_event_pred", "t_kmf", "t_bfhf", "t_kmf_event_scaled", "t_bfhf_event_scaled")
    return targets.select("ID", *[rounded(c).alias(c) for c in shown])


@query(
    "hazard_stage_means",
    f"""SELECT ID, {sql_rounded('pred')} AS t_hazard_pred FROM (
        {_own_means_sql("(SELECT * FROM frame WHERE dataset = 'TRAIN')", 10, _STAGE_SEEDS, 'stratum, status', 'efs')})""",
)
def hazard_stage_means(spark: SparkSession, folder: str) -> DataFrame:
    """The hazard stage with ten folds and five seeds of group means."""
    rows = _experiment_rows(spark, folder)
    ids = rows.filter(training_rows()).select("ID")
    targets = cox_stage(rows, ids, _COLUMNS, seeds=_STAGE_SEEDS, learner=_means("stratum", "status"))
    return targets.select("ID", rounded("t_hazard_pred").alias("t_hazard_pred"))


def _sql_weight(limits: tuple[tuple[float, float], tuple[float, float]]) -> str:
    """Event-time weight of the rows of ``aimed``."""
    (low0, high0), (low1, high1) = limits
    share = "(efs_time - min(efs_time) OVER (PARTITION BY efs)) / (max(efs_time) OVER (PARTITION BY efs) - min(efs_time) OVER (PARTITION BY efs))"
    return f"CASE WHEN efs = 0 THEN (1 - {share}) * {high0 - low0} + {low0} ELSE {share} * {high1 - low1} + {low1} END"


def _goal_sql(name: str, weighting: str) -> str:
    """Rows with the goal and weight of an experiment on the scaled survival target."""
    goal = f"exp({_sql_shift('2 * p', 't_kmf', 'PARTITION BY efs')})"
    return f"{name} AS (SELECT *, {goal} AS goal, {_sql_weight(WEIGHTS[weighting])} AS wt FROM aimed)"


_BASES = {
    "tweedie_km_graded": ("priority", "stratum"),
    "gamma_km_half": ("status", "stratum"),
}


def _base_sql(name: str) -> str:
    """(ID, dataset, pred) of a base experiment as the common table ``{name}``."""
    keys = ", ".join(_BASES[name])
    return f"""{_goal_sql(f'{name}_goal', EXPERIMENTS[name].weighting)},
  {name} AS (
    SELECT ID, 'TRAIN' AS dataset, pred FROM ({_own_means_sql(f'{name}_goal', 7, _BASE_SEEDS, keys, 'goal', 'wt')})
    UNION ALL SELECT ID, 'TEST', n.pred FROM frame
    JOIN ({_new_means_sql(f'{name}_goal', 7, _BASE_SEEDS, keys, 'goal', 'wt')}) n USING ({keys}) WHERE dataset = 'TEST')"""


@query(
    "base_experiment_means",
    f"""SELECT * FROM (WITH {_TRAINED}, {_base_sql('tweedie_km_graded')}
        SELECT ID, dataset, {sql_rounded('pred')} AS pred FROM tweedie_km_graded)""",
)
def base_experiment_means(spark: SparkSession, folder: str) -> DataFrame:
    """One experiment with its own seven folds and five seeds, from raw rows to predictions."""
    rows = _experiment_rows(spark, folder)
    targets = _targets_by_means(rows)
    name = "tweedie_km_graded"
    result = run_experiment(EXPERIMENTS[name], rows, targets, _COLUMNS, learner=_means(*_BASES[name]))
    return result.oof.unionByName(result.test).select("ID", "dataset", rounded("pred").alias("pred"))


_STACK, _ALPHA = "stack_rmse_graded", 50.0


def _stack_sql() -> str:
    """A weighted ridge per seed and fold on the first base experiment's predictions."""
    first = next(iter(_BASES))
    sums = "sum(wt) AS w, sum(wt * x) AS x, sum(wt * goal) AS y, sum(wt * x * x) AS xx, sum(wt * x * goal) AS xy"
    folds = {s: sql_folds("stacked_rows", EXPERIMENTS[_STACK].n_splits, s) for s in EXPERIMENTS[_STACK].seeds}
    folded = " UNION ALL ".join(f"SELECT {s} AS seed, * FROM ({sql})" for s, sql in folds.items())
    return f"""SELECT * FROM (WITH {_TRAINED}, {_base_sql(first)}, {_goal_sql('last_goal', EXPERIMENTS[_STACK].weighting)},
      stacked_rows AS (SELECT g.ID, g.goal, g.wt, b.pred AS x FROM last_goal g JOIN {first} b ON b.ID = g.ID),
      folded AS ({folded}),
      sums AS (SELECT seed, fold, {sums} FROM folded GROUP BY seed, fold),
      others AS (SELECT a.seed, a.fold, sum(b.w) AS w, sum(b.x) AS x, sum(b.y) AS y, sum(b.xx) AS xx, sum(b.xy) AS xy
                 FROM sums a JOIN sums b ON b.seed = a.seed AND b.fold <> a.fold GROUP BY a.seed, a.fold),
      fits AS (SELECT seed, fold, x / w AS mx, y / w AS my, (xy - x * y / w) / (xx - x * x / w + {_ALPHA}) AS slope FROM others)
      SELECT ID, 'TRAIN' AS dataset, {sql_rounded('avg(my + slope * (x - mx))')} AS pred
      FROM folded JOIN fits USING (seed, fold) GROUP BY ID
      UNION ALL SELECT ID, 'TEST', {sql_rounded('avg(my + slope * (pred - mx))')} FROM {first} CROSS JOIN fits
      WHERE dataset = 'TEST' GROUP BY ID)"""


@query("stack_experiment_means", _stack_sql())
def stack_experiment_means(spark: SparkSession, folder: str) -> DataFrame:
    """Two experiments stacked by a ridge, all with their own folds and seeds."""
    rows = _experiment_rows(spark, folder)
    targets = _targets_by_means(rows)
    jobs = [
        partial(run_experiment, EXPERIMENTS[name], rows, targets, _COLUMNS, learner=_means(*keys))
        for name, keys in _BASES.items()
    ]
    results = dict(zip(_BASES, cf.concurrently(spark, jobs), strict=True))

    def ridge(i: int, seed: int, to: Fitting) -> Estimator:
        return regressor("ridge", [f"f_pred_{next(iter(_BASES))}"], to.label, weight=to.weight, alpha=_ALPHA)

    result = run_stack(EXPERIMENTS[_STACK], rows, targets, results, _COLUMNS, learner=ridge)
    return result.oof.unionByName(result.test).select("ID", "dataset", rounded("pred").alias("pred"))
