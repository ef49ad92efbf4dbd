"""K-fold cross-fitting of any Spark ML estimator, over seeds, with reuse of finished folds."""

from __future__ import annotations

import contextvars
import hashlib
import json
from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import partial, reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from survloom.functions.expr import mean_of
from survloom.operators.concordance import stratified_score
from survloom.operators.folds import add_seed_folds
from survloom.operators.models import (
    feature_importances,
    folds_together,
    linear_together,
    one_prediction,
    predict,
    share_groups,
    transform_together,
)
from survloom.operators.ranks import mean_squared_error, roc_auc
from survloom.settings import staged

Metric = Callable[[DataFrame, Sequence[str]], DataFrame]

#: Fits that run at the same time; each is a series of small jobs with gaps between them.
WORKERS = 4


def concurrently(spark: SparkSession, jobs: Iterable[Callable[[], object]], workers: int = WORKERS) -> list:
    """Results of independent driver-side jobs, in order, at most ``workers`` at a time.

    Spark deals tasks of the running jobs to free cores. An error of any job is raised.
    """
    jobs = list(jobs)
    if workers < 2 or len(jobs) < 2:
        return [job() for job in jobs]
    with ThreadPoolExecutor(min(workers, len(jobs))) as pool:
        # Each job has the caller's local properties and scope.
        running = [pool.submit(contextvars.copy_context().run, inheritable_thread_target(spark)(job)) for job in jobs]
        return [r.result() for r in running]


def described(stage: object) -> object:
    """Class and parameters of an estimator, and of the stages in it, without generated names."""
    if isinstance(stage, Pipeline):
        return [described(s) for s in stage.getStages()]
    params = {p.name: repr(v) for p, v in stage.extractParamMap().items()} if hasattr(stage, "extractParamMap") else {}
    own = {k: described(v) if isinstance(v, Estimator) else repr(v) for k, v in vars(stage).items() if not k.startswith("_") and k != "uid"}
    plain = {k: str(v).replace(getattr(stage, "uid", "\0"), "") for k, v in {**own, **params}.items() if " at 0x" not in str(v)}
    return [type(stage).__name__, dict(sorted(plain.items()))]


def fingerprint(df: DataFrame, estimator: Estimator, usable: Column | None = None) -> str:
    """A digest of the rows, in any order, and of how they are fitted: one pass over ``df``."""
    rows = df if usable is None else df.withColumn("_usable", usable)
    plain = [vector_to_array(c) if t.typeName() == "vectorudt" else F.col(f"`{c}`") for c, t in ((f.name, f.dataType) for f in rows.schema)]
    sums = [F.sum(F.xxhash64(F.lit(seed), *plain).cast("decimal(38,0)")) for seed in (1, 2)]
    found = rows.agg(F.count(F.lit(1)), *sums).first()
    text = json.dumps([df.schema.simpleString(), [str(v) for v in found], described(estimator)], default=str)
    return hashlib.sha256(text.encode()).hexdigest()


@dataclass(frozen=True)
class FoldStore:
    """Fold models and predictions under one folder of a shared file system."""

    spark: SparkSession
    path: str

    def _at(self, name: str, fold: int, what: str) -> str:
        return f"{self.path}/{what}/name={name}/fold={fold}"

    def _exists(self, path: str) -> bool:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        return hadoop.getFileSystem(conf).exists(hadoop)

    def has_model(self, name: str, fold: int, made_from: str | None = None) -> bool:
        """Whether the fold is finished, from the inputs of this fingerprint if one is given.

        A model counts once its last stage is written: the manifest comes last.
        """
        done = self._at(name, fold, "done")
        if not self._exists(done):
            return False
        return made_from is None or self.spark.read.parquet(done).first()["made_from"] == made_from

    def save_model(self, name: str, fold: int, model: PipelineModel, made_from: str | None = None) -> None:
        model.write().overwrite().save(self._at(name, fold, "models"))
        manifest = self.spark.createDataFrame([(made_from,)], "made_from string")
        manifest.write.mode("overwrite").parquet(self._at(name, fold, "done"))

    def load_model(self, name: str, fold: int) -> PipelineModel:
        return PipelineModel.load(self._at(name, fold, "models"))

    def save_predictions(self, name: str, fold: int, predictions: DataFrame) -> None:
        target = self._at(name, fold, "predictions")
        predictions.drop("name", "fold").write.mode("overwrite").parquet(target)

    def predictions(self) -> DataFrame:
        """All saved predictions: name and fold come from the folder names."""
        return self.spark.read.parquet(f"{self.path}/predictions")


@dataclass(frozen=True)
class ConcordanceMetric:
    """The stratified concordance score as a metric of a frame and key columns.

    ``whole`` is a key whose values are also scored together, under null.
    """

    time: str
    event: str
    stratum: str
    pred: str

    def __call__(self, df: DataFrame, keys: Sequence[str], whole: str | None = None) -> DataFrame:
        return stratified_score(df, self.time, self.event, self.pred, self.stratum, keys=keys, whole=whole)


@dataclass
class CrossFit:
    """Out-of-fold predictions (meta columns, pred, name, fold) and the fold models."""

    predictions: DataFrame
    models: dict[tuple[str, int], Model]
    features: Sequence[str] = field(default_factory=list)

    def scores(self, metric: Metric, also: DataFrame | None = None) -> DataFrame:
        """(name, fold, score): every fold, and fold null for all folds of a name together.

        ``also`` are rows of further names, like ``predictions``, that are scored in the same jobs.
        """
        rows = self.predictions if also is None else self.predictions.unionByName(also)
        if isinstance(metric, ConcordanceMetric):
            return metric(rows, ["name", "fold"], "fold")
        whole = self.predictions.withColumn("fold", F.lit(None).cast("int"))
        return metric(rows.unionByName(whole), ["name", "fold"])

    def importances(self) -> DataFrame:
        """(name, fold, feature, importance), from each fold's own model."""
        rows = [
            (name, fold, feature, value)
            for (name, fold), model in self.models.items()
            for feature, value in feature_importances(model, self.features).items()
        ]
        return self.predictions.sparkSession.createDataFrame(
            rows, "name string, fold int, feature string, importance double"
        )


def _own_predictions(df: DataFrame, fits: Sequence[tuple[str, str, Sequence[int], object]], meta: Sequence[str]) -> DataFrame:
    """(meta, pred, name, fold) of fits (name, fold column, folds, fit of all folds): rows are read once for all of them."""
    wide, found = df, []
    for i, (name, fold_col, folds, together) in enumerate(fits):
        wide = one_prediction(together.transform(wide), f"_own_{i}").select(*[F.col(f"`{c}`") for c in wide.columns], f"_own_{i}")
        fold = F.col(fold_col).cast("int")
        wanted = F.coalesce(F.col(fold_col).isin(list(folds)), F.lit(False))
        found.append(F.struct(F.col(f"_own_{i}").alias("pred"), F.lit(name).alias("name"), fold.alias("fold"), wanted.alias("_wanted")))
    kept = [m for m in meta if m not in {fold_col for _, fold_col, *_ in fits}]
    return wide.select(*kept, F.inline(F.array(*found))).filter("_wanted").drop("_wanted")


def cross_fit(
    estimator: Estimator,
    df: DataFrame,
    *,
    name: str,
    meta: Sequence[str],
    fold_col: str = "fold",
    folds: Sequence[int] | None = None,
    features: Sequence[str] = (),
    store: FoldStore | None = None,
    overwrite: bool = False,
    usable: Column | None = None,
    workers: int = WORKERS,
) -> CrossFit:
    """Per fold: fit on the other folds, predict the fold's own rows.

    Rows that are not ``usable`` are left out of fitting only. ``df`` is read twice per
    fold: pass a staged or persisted frame. ``workers`` folds are fitted at the same time.
    With a ``store``, a finished fold's model is loaded instead of fitted if it was fitted
    on the same rows with the same parameters, unless ``overwrite``. Estimators of
    :func:`folds_together` fit and predict all folds in one pass, if no store asks for single ones.
    """
    spark = df.sparkSession
    if folds is None:
        folds = sorted(r[0] for r in df.select(fold_col).dropna().distinct().collect())
    fitting = df if usable is None else df.filter(usable)
    fit_folds = folds_together(estimator, df) if store is None and folds else None
    if fit_folds:
        together = fit_folds(fitting, fold_col, folds)
        own = _own_predictions(df, [(name, fold_col, folds, together)], meta)
        return CrossFit(own, {(name, fold): together.model(fold) for fold in folds}, list(features))
    made_from = fingerprint(df, estimator, usable) if store else None

    def one(fold: int) -> tuple[Model, DataFrame]:
        if store and not overwrite and store.has_model(name, fold, made_from):
            model = store.load_model(name, fold)
        else:
            model = estimator.fit(fitting.filter(F.col(fold_col) != fold))
            if store:
                saved = model if isinstance(model, PipelineModel) else PipelineModel([model])
                store.save_model(name, fold, saved, made_from)
        own = predict(model, df.filter(F.col(fold_col) == fold)).select(
            *[m for m in meta if m != fold_col],
            "pred",
            F.lit(name).alias("name"),
            F.lit(fold).cast("int").alias("fold"),
        )
        if store:
            store.save_predictions(name, fold, own)
        return model, own

    fitted = concurrently(spark, [partial(one, fold) for fold in folds], workers)
    models = {(name, fold): model for fold, (model, _) in zip(folds, fitted, strict=True)}
    return CrossFit(reduce(DataFrame.unionByName, [own for _, own in fitted]), models, list(features))


def with_seed_folds(
    df: DataFrame, id_col: str, n_splits: int, seeds: Sequence[int]
) -> DataFrame:
    """Add ``fold_{seed}`` for every seed, from the first rows of the folds: rows stay where they are.

    A null or repeated id is an error: its rows could not be told apart.
    """
    ids = staged(df.select(id_col), "ids")
    bad = ids.groupBy(id_col).count().filter(F.col(id_col).isNull() | (F.col("count") > 1))
    if not bad.isEmpty():
        raise ValueError(f"{id_col} must be unique and not null")
    rest = [F.col(f"`{c}`") for c in df.columns if c != id_col]
    return add_seed_folds(df.select(id_col, *rest), ids, id_col, n_splits, seeds)


def cross_fit_seeds(
    make: Callable[[int, int], Estimator],
    df: DataFrame,
    *,
    name: str,
    seeds: Sequence[int],
    meta: Sequence[str],
    features: Sequence[str] = (),
    folds: Sequence[int] | None = None,
    store: FoldStore | None = None,
    overwrite: bool = False,
    usable: Column | None = None,
) -> CrossFit:
    """Cross-fit ``make(index, seed)`` on the folds ``fold_{seed}`` of each seed.

    Hyperparameters may depend on the index. Names are ``{name}_{seed}``. Only
    ``folds`` are fitted and predicted, by default all.
    """
    estimators = [make(i, seed) for i, seed in enumerate(seeds)]
    ways = [folds_together(e, df) if store is None else None for e in estimators]
    if estimators and all(ways):
        return _cross_fit_together(ways, df, name, seeds, meta, features, folds, usable)
    runs = [
        cross_fit(
            estimator,
            df,
            name=f"{name}_{seed}",
            meta=meta,
            fold_col=f"fold_{seed}",
            folds=folds,
            features=features,
            store=store,
            overwrite=overwrite,
            usable=usable,
        )
        for estimator, seed in zip(estimators, seeds, strict=True)
    ]
    models = {key: model for run in runs for key, model in run.models.items()}
    long = reduce(DataFrame.unionByName, [run.predictions for run in runs])
    return CrossFit(long, models, list(features))


def _cross_fit_together(
    ways: Sequence[Callable],
    df: DataFrame,
    name: str,
    seeds: Sequence[int],
    meta: Sequence[str],
    features: Sequence[str],
    folds: Sequence[int] | None,
    usable: Column | None,
) -> CrossFit:
    """All folds of a seed are fitted in one pass, and rows are read once for the predictions of all seeds."""
    columns = [f"fold_{seed}" for seed in seeds]
    seen = df.agg(*[F.collect_set(c).alias(c) for c in dict.fromkeys(columns)]).first() if folds is None else None
    wanted = [list(folds) if seen is None else sorted(seen[c]) for c in columns]
    fitting = df if usable is None else df.filter(usable)
    fitted = concurrently(df.sparkSession, [partial(way, fitting, c, own) for way, c, own in zip(ways, columns, wanted, strict=True)])
    names = [f"{name}_{seed}" for seed in seeds]
    models = {(n, fold): fit.model(fold) for n, own, fit in zip(names, wanted, fitted, strict=True) for fold in own}
    return CrossFit(_own_predictions(df, list(zip(names, columns, wanted, fitted, strict=True)), meta), models, list(features))


def score_models(models: Sequence[Model], df: DataFrame, *, out: str = "pred") -> DataFrame:
    """Mean prediction of fitted models on new rows: a chain of transforms, or one join of all group means,
    or sums on plain columns."""
    scored = df
    names = [f"_pred_{i}" for i in range(len(models))]
    linear = linear_together(models, df, names)
    if share_groups(models):
        scored = transform_together(models, df, names)
    elif linear is not None:
        scored = linear
    else:
        for model, name in zip(models, names, strict=True):
            scored = predict(model, scored, name)
    return scored.withColumn(out, mean_of(names)).drop(*names)


def concordance_metric(
    time: str = "efs_time", event: str = "efs", stratum: str = "stratum", pred: str = "pred"
) -> Metric:
    """The stratified concordance score as a metric of a frame and key columns."""
    return ConcordanceMetric(time, event, stratum, pred)


def auc_metric(event: str = "efs", pred: str = "pred") -> Metric:
    """The area under the ROC curve as a metric of a frame and key columns."""

    def score(df: DataFrame, keys: Sequence[str]) -> DataFrame:
        found = roc_auc(df, event, pred, keys=keys)
        return found.withColumnRenamed(next(c for c in found.columns if c not in keys), "score")

    return score


def mse_metric(target: str, pred: str = "pred") -> Metric:
    """The mean squared error as a metric of a frame and key columns."""
    return lambda df, keys: mean_squared_error(df, target, pred, keys=keys).withColumnRenamed("mse", "score")


def best_by_metric(
    candidates: Mapping[str, Estimator],
    df: DataFrame,
    *,
    validation: str,
    metric: Metric,
) -> tuple[str, Model, DataFrame]:
    """Fit each candidate on training rows, score all on validation rows in one job.

    Early stopping on a ranking metric: the candidates are, for example, boosting
    with a growing number of rounds. Returns the best key, its model, the scores.
    """
    train, held = df.filter(~F.col(validation)), df.filter(F.col(validation))
    models = {key: estimator.fit(train) for key, estimator in candidates.items()}
    scored = reduce(
        DataFrame.unionByName,
        [predict(m, held).withColumn("candidate", F.lit(key)) for key, m in models.items()],
    )
    scores = metric(scored, ["candidate"])
    best = scores.orderBy(F.desc_nulls_last("score"), "candidate").first()["candidate"]
    return best, models[best], scores


def staged_predictions(model: Model, df: DataFrame, out: str = "preds") -> DataFrame:
    """``df`` with the predictions after 1, 2, ... trees of one fitted boosted ensemble, as an array.

    ``model`` is a boosted classifier (probabilities of class 1) or regressor, or a pipeline that ends in one.
    """
    stages = list(getattr(model, "stages", [model]))
    scored = PipelineModel(stages[:-1]).transform(df) if stages[:-1] else df
    last = stages[-1]
    names = [f"_tree_{i}" for i in range(len(last.trees))]
    for tree, column in zip(last.trees, names, strict=True):
        scored = tree.copy().setPredictionCol(column).transform(scored)
    margin, steps = F.lit(0.0), []
    for column, weight in zip(names, last.treeWeights, strict=True):
        margin = margin + F.col(column) * F.lit(float(weight))
        steps.append(1 / (1 + F.exp(-2 * margin)) if hasattr(last, "numClasses") else margin)
    return scored.withColumn(out, F.array(*steps)).select(*df.columns, out)


def prefix_scores(df: DataFrame, preds: str, metric: Metric, *, keys: Sequence[str] = (), pred: str = "pred") -> DataFrame:
    """(keys, rounds, score): ``metric`` of every prefix of an ensemble, all in one job."""
    kept = [c for c in df.columns if c not in (pred, preds, "rounds")]
    long = df.select(*kept, F.posexplode(preds).alias("_at", pred)).withColumn("rounds", F.col("_at") + 1)
    return metric(long.drop("_at"), [*keys, "rounds"])


def stopping_round(scores: DataFrame, patience: int) -> int:
    """The round with the best score before ``patience`` rounds in a row brought none better."""
    best, at = None, 0
    for row in scores.orderBy("rounds").select("rounds", "score").collect():
        if row["score"] is not None and (best is None or row["score"] > best):
            best, at = row["score"], row["rounds"]
        elif row["rounds"] - at >= patience:
            break
    return at


def stop_early(
    estimator: Estimator, df: DataFrame, *, validation: str, metric: Metric, patience: int = 10
) -> tuple[Model, int, DataFrame]:
    """Fit one boosted ensemble on training rows; score each of its prefixes on validation rows.

    Returns the model, the number of trees to use (see :func:`stopping_round`) and the scores.
    """
    model = estimator.fit(df.filter(~F.col(validation)))
    held = staged_predictions(model, df.filter(F.col(validation)))
    # Staged, since the caller reads them too: one row per round.
    scores = staged(prefix_scores(held, "preds", metric), "scores")
    return model, stopping_round(scores, patience), scores


def predict_rounds(model: Model, df: DataFrame, rounds: int, out: str = "pred") -> DataFrame:
    """Predictions of the first ``rounds`` trees."""
    return staged_predictions(model, df, "_preds").withColumn(out, F.element_at("_preds", rounds)).drop("_preds")


def importance_top_k(importances: DataFrame, k: int) -> DataFrame:
    """The k features with the largest mean importance."""
    means = importances.groupBy("feature").agg(F.avg("importance").alias("importance"))
    return means.orderBy(F.desc("importance"), "feature").limit(k)


def importance_detail(importances: DataFrame, k: int) -> DataFrame:
    """The importance rows of the top k features."""
    return importances.join(importance_top_k(importances, k).select("feature"), "feature", "left_semi")


