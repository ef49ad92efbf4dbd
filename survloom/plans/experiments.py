"""The experiment matrix: targets, weights and objectives, cross-fitted over seeds.

Every stage writes its frame to the shared folder before it is read in a loop,
so the driver only holds fitted models, scores and the plans of single stages.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import partial, reduce

from pyspark.ml import Estimator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from survloom.functions.expr import clamp_codes, columns_with_prefix, signed_time
from survloom.operators.blend import average_by_id
from survloom.operators.cox import CoxRegression
from survloom.operators.crossfit import (
    CrossFit,
    FoldStore,
    concordance_metric,
    concurrently,
    cross_fit_seeds,
    score_models,
    with_seed_folds,
)
from survloom.operators.curves import survival_targets
from survloom.operators.encoders import MeanImputer, OneHotEncoder, OrdinalEncoder
from survloom.operators.models import mark_nominal, regressor
from survloom.operators.stacking import long_predictions, stack_sources
from survloom.operators.targets import (
    event_time_weight,
    normalize_by_max,
    scale_target,
    scale_target_by_event,
)
from survloom.settings import staged

#: Weight limits (censored, observed) by name: fixed values of the matrix.
WEIGHTS: dict[str, tuple[tuple[float, float], tuple[float, float]] | None] = {
    "graded": ((0.01, 0.5), (1.0, 1.5)),
    "half": ((0.5, 0.5), (1.0, 1.0)),
    "none": None,
    "stack_tweedie": ((0.5, 0.5), (1.0, 2.0)),
    "stack_rmse": ((0.4, 0.5), (1.0, 1.0)),
}


@dataclass(frozen=True)
class Columns:
    """Names and roles of the input columns."""

    id: str = "ID"
    time: str = "efs_time"
    event: str = "efs"
    stratum: str = "stratum"
    dataset: str = "dataset"
    numeric: Sequence[str] = ()
    categorical: Sequence[str] = ()

    @property
    def meta(self) -> list[str]:
        return [self.id, self.time, self.event, self.stratum]

    @property
    def is_train(self) -> Column:
        return F.col(self.dataset) == "TRAIN"


@dataclass(frozen=True)
class Fitting:
    """What a learner is told: names of the features, the goal and the weight.

    ``categories`` are the features that are codes, with their numbers of codes.
    """

    features: Sequence[str]
    label: str
    weight: str | None = None
    categories: Mapping[str, int] = field(default_factory=dict)


#: Makes the estimator for the i-th seed: (i, seed, fitting) -> estimator. Its model must
#: add ``prediction`` (or ``probability``) to the rows, as Spark ML models do.
Learner = Callable[[int, int, Fitting], Estimator]


@dataclass(frozen=True)
class Experiment:
    """One cell of the matrix."""

    name: str
    target: str
    objective: str
    weighting: str
    seeds: tuple[int, ...] = (1, 2, 3, 4, 5)
    n_splits: int = 7
    prob_clip: tuple[float, float] | None = None
    #: A stack that also sees the encoded input columns.
    input_features: bool = False


def _matrix() -> dict[str, Experiment]:
    """Families of (target, objective), each with its weightings."""
    cells = []
    later_seeds = (2, 3, 4, 5, 6)
    for base in ("km", "cox"):
        seeds = later_seeds if base == "cox" else (1, 2, 3, 4, 5)
        for weighting in ("graded", "half", "none"):
            for objective, target in (
                ("tweedie", "scaled"),
                ("cross_entropy", "normalized"),
                ("gamma", "scaled"),
            ):
                cells.append(
                    Experiment(
                        f"{objective}_{base}_{weighting}",
                        f"{base}_{target}",
                        objective,
                        weighting,
                        seeds if objective == "tweedie" else (1, 2, 3, 4, 5),
                    )
                )
        cells.append(
            Experiment(
                f"tweedie_{base}_clipped", f"{base}_scaled", "tweedie", "graded", prob_clip=(0.1, 2.0)
            )
        )
    cells += [Experiment(f"cox_{w}", "signed_time", "cox", w) for w in ("graded", "half", "none")]
    cells += [
        Experiment("rmse_km_graded", "km_scaled", "rmse", "graded"),
        Experiment("rmse_km_half", "km_scaled", "rmse", "half"),
        Experiment("stack_tweedie_graded", "km_scaled", "tweedie", "stack_tweedie", n_splits=10),
        Experiment("stack_rmse_graded", "km_scaled", "rmse", "stack_rmse", n_splits=10),
        Experiment(
            "stack_rmse_inputs", "km_scaled", "rmse", "stack_tweedie", n_splits=10, input_features=True
        ),
    ]
    return {c.name: c for c in cells}


EXPERIMENTS = _matrix()


@dataclass
class Result:
    """Averaged predictions (id, pred, dataset) and the scores (name, fold, score)."""

    oof: DataFrame
    test: DataFrame
    scores: DataFrame
    runs: CrossFit = field(repr=False)


def build_features(rows: DataFrame, columns: Columns) -> DataFrame:
    """``f_n_`` numeric columns with means for nulls and ``f_c_`` codes from 0.

    Fitted on the training rows only. Codes of unknown or missing categories are
    0; the seen ones keep their numbers.
    """
    train = rows.filter(columns.is_train)
    filled = MeanImputer(columns.numeric, prefix="f_n_").fit(train).transform(rows)
    if not columns.categorical:
        return filled
    coded = OrdinalEncoder(columns.categorical, columns.id, "f_c_").fit(train).transform(filled)
    return clamp_codes(coded, [f"f_c_{c}" for c in columns.categorical])


def _feature_names(df: DataFrame) -> list[str]:
    return columns_with_prefix(df, "f_")


def _categories(df: DataFrame, columns: Columns) -> dict[str, int]:
    """Number of codes of each category feature of ``df``."""
    names = [f"f_c_{c}" for c in columns.categorical if f"f_c_{c}" in df.columns]
    if not names:
        return {}
    most = df.agg(*[F.max(c).alias(c) for c in names]).first()
    return {c: int(most[c] or 0) + 1 for c in names}


def _bins(categories: Mapping[str, int]) -> int:
    """Bins of a tree: at least one per code of the largest category."""
    return max([32, *categories.values()])


def event_learners(rounds: int = 10) -> dict[str, Learner]:
    """The classifiers of the event probability; ``rounds`` is the number of trees."""

    def trees(i: int, seed: int, to: Fitting) -> Estimator:
        # Later seeds use deeper trees; the learning rate stays.
        return regressor(
            "logloss", to.features, to.label, categories=list(to.categories),
            maxBins=_bins(to.categories), maxIter=rounds, maxDepth=min(3 + i, 7), seed=seed,
        )

    def logistic(i: int, seed: int, to: Fitting) -> Estimator:
        return regressor(
            "logistic", to.features, to.label, categories=list(to.categories), regParam=0.001 * (i + 1)
        )

    return {"trees": trees, "logistic": logistic}


def target_stage(
    rows: DataFrame,
    columns: Columns,
    *,
    seeds: Sequence[int] = (0, 1, 2, 3, 4),
    n_splits: int = 10,
    store: FoldStore | None = None,
    rounds: int = 10,
    learners: Mapping[str, Learner] | None = None,
) -> DataFrame:
    """Training targets: survival at the own time, event probability, and both combined.

    The probability is the mean of the out-of-fold predictions of the ``learners`` over
    the seeds: by default those of :func:`event_learners` with ``rounds`` trees.
    """
    train = rows.filter(columns.is_train)
    survival = staged(
        survival_targets(train, columns.time, columns.event, fit_mask=F.lit(True)), "survival"
    ).withColumn("t_cox", signed_time(F.col(columns.time), F.col(columns.event)))
    features = build_features(survival, columns)
    folded = staged(with_seed_folds(features, columns.id, n_splits, seeds), "folded")
    names = _feature_names(folded)
    categories = _categories(folded, columns)
    folded = mark_nominal(folded, categories)
    to = Fitting(names, columns.event, None, categories)
    jobs = [
        partial(
            cross_fit_seeds,
            lambda i, seed, make=make: make(i, seed, to),
            folded,
            name=name,
            seeds=seeds,
            meta=columns.meta,
            features=names,
            store=store,
        )
        for name, make in (event_learners(rounds) if learners is None else learners).items()
    ]
    runs = concurrently(rows.sparkSession, jobs)
    long = reduce(DataFrame.unionByName, [run.predictions for run in runs])
    mean = average_by_id(long, columns.id).withColumnRenamed("pred", "t_event_pred")
    joined = staged(
        survival.select(*columns.meta, "t_kmf", "t_bfhf", "t_cox").join(mean, columns.id, "left"),
        "targets",
    )
    for base in ("t_kmf", "t_bfhf"):
        joined = scale_target(joined, base, "t_event_pred")
    return joined


def hazard_stage(
    rows: DataFrame,
    targets: DataFrame,
    columns: Columns,
    *,
    seeds: Sequence[int] = (0, 1, 2, 3, 4),
    n_splits: int = 10,
    store: FoldStore | None = None,
    learner: Learner | None = None,
) -> DataFrame:
    """Targets with ``t_hazard_pred``, the mean out-of-fold log hazard of Cox fits.

    Another ``learner`` gives its own prediction in that place.
    """
    features = build_features(rows.filter(columns.is_train), columns)
    folded = staged(with_seed_folds(features, columns.id, n_splits, seeds), "folded")
    to = Fitting(_feature_names(folded), columns.event, None, _categories(folded, columns))
    make = learner or (lambda i, seed, to: CoxRegression(to.features, columns.time, columns.event))
    run = cross_fit_seeds(
        lambda i, seed: make(i, seed, to),
        folded,
        name="cox",
        seeds=seeds,
        meta=columns.meta,
        store=store,
    )
    hazard = average_by_id(run.predictions, columns.id).withColumnRenamed("pred", "t_hazard_pred")
    return targets.join(hazard, columns.id, "left")


def cox_target(rows: DataFrame, columns: Columns, out: str = "t_cox_pred") -> DataFrame:
    """(id, out): survival at the own time under a Cox fit on the one-hot stratum."""
    train = staged(rows.filter(columns.is_train).select(*columns.meta), "cox")
    coded = OneHotEncoder(columns.stratum, columns.id).fit(train).transform(train)
    names = columns_with_prefix(coded, f"{columns.stratum}_")
    model = CoxRegression(names, columns.time, columns.event).fit(coded)
    return model.survival_at_own_time(coded, out).select(columns.id, out)


def _goal(spec: Experiment, rows: DataFrame, targets: DataFrame, columns: Columns) -> DataFrame:
    """(id, goal): the regression target of an experiment."""
    if spec.target == "signed_time":
        return targets.select(columns.id, F.col("t_cox").alias("goal"))
    base = "t_kmf"
    if spec.target.startswith("cox"):
        base = "t_cox_pred"
        targets = targets.join(cox_target(rows, columns), columns.id, "left")
    goal = scale_target_by_event(
        targets, base, "t_event_pred", columns.event, prob_clip=spec.prob_clip, out="goal"
    )
    if spec.target.endswith("normalized"):
        goal = normalize_by_max(goal, "goal", out="goal")
    return goal.select(columns.id, "goal")


def _cross_fit_goal(
    spec: Experiment,
    train: DataFrame,
    test: DataFrame,
    columns: Columns,
    seeds: Sequence[int],
    n_splits: int,
    store: FoldStore | None,
    params: Mapping,
    learner: Learner | None,
) -> Result:
    """Weights, folds, fits, averages and scores, given rows with ``goal`` and features."""
    limits = WEIGHTS[spec.weighting]
    weight = "weight" if limits else None
    if limits:
        train = event_time_weight(
            train, columns.time, columns.event, censored=limits[0], observed=limits[1]
        )
    folded = staged(with_seed_folds(train, columns.id, n_splits, seeds), "folded")
    names = _feature_names(folded)
    categories = _categories(folded, columns)
    folded = mark_nominal(folded, categories)

    to = Fitting(names, "goal", weight, categories)

    def make(i: int, seed: int) -> Estimator:
        if learner is not None:
            return learner(i, seed, to)
        if spec.objective == "cox":
            return CoxRegression(names, columns.time, columns.event, weightCol=weight)
        tuned = dict(params)
        if spec.objective == "rmse":
            tuned.setdefault("maxDepth", 2 + i % 2)
            tuned.setdefault("maxBins", _bins(categories))
            tuned["seed"] = seed
        return regressor(
            spec.objective, names, "goal", weight=weight, categories=list(categories), **tuned
        )

    # An undefined goal or weight (no known event, probability 0) cannot be learned from.
    known = [] if spec.objective == "cox" else ["goal", *([weight] if weight else [])]
    usable = reduce(lambda seen, c: seen & F.col(c).isNotNull() & ~F.isnan(c), known, F.lit(True))
    run = cross_fit_seeds(
        make,
        folded,
        name=spec.name,
        seeds=seeds,
        meta=columns.meta,
        features=names,
        store=store,
        usable=usable,
    )
    run.predictions = staged(run.predictions, "predictions")
    metric = concordance_metric(columns.time, columns.event, columns.stratum)
    oof = staged(
        average_by_id(run.predictions, columns.id).join(
            folded.select(*columns.meta), columns.id, "left"
        ),
        "oof",
    )
    final = oof.select(
        *columns.meta, "pred", F.lit("final").alias("name"), F.lit(None).cast("int").alias("fold")
    )
    # Staged: a stack reads the test predictions several times.
    scored = staged(score_models(list(run.models.values()), test).select(columns.id, "pred"), "test")
    tagged = [
        df.select(columns.id, "pred", F.lit(tag).alias(columns.dataset))
        for df, tag in ((oof, "TRAIN"), (scored, "TEST"))
    ]
    return Result(tagged[0], tagged[1], run.scores(metric, final), run)


def run_experiment(
    spec: Experiment,
    rows: DataFrame,
    targets: DataFrame,
    columns: Columns,
    *,
    seeds: Sequence[int] | None = None,
    n_splits: int | None = None,
    store: FoldStore | None = None,
    params: Mapping | None = None,
    learner: Learner | None = None,
) -> Result:
    """Features, target, weights, cross-fit over seeds, scores, and test predictions.

    ``learner`` takes the place of the objective's own estimator; ``params`` are for that one.
    """
    features = staged(build_features(rows, columns), "features")
    train = staged(
        features.filter(columns.is_train).join(
            _goal(spec, rows, targets, columns), columns.id, "left"
        ),
        "goals",
    )
    test = features.filter(F.col(columns.dataset) == "TEST")
    return _cross_fit_goal(
        spec,
        train,
        test,
        columns,
        seeds or spec.seeds,
        n_splits or spec.n_splits,
        store,
        params or {},
        learner,
    )


def run_stack(
    spec: Experiment,
    rows: DataFrame,
    targets: DataFrame,
    results: Mapping[str, Result],
    columns: Columns,
    *,
    seeds: Sequence[int] | None = None,
    n_splits: int | None = None,
    store: FoldStore | None = None,
    params: Mapping | None = None,
    learner: Learner | None = None,
) -> Result:
    """An experiment whose features are the predictions and ranks of earlier ones.

    ``input_features`` of the experiment adds the encoded input columns. Ids
    missing from a later source get the mean of that source.
    """
    sources = {name: {"oof": r.oof, "test": r.test} for name, r in results.items()}
    wide = stack_sources(long_predictions(sources, columns.id), list(results), columns.id)
    base = build_features(rows, columns) if spec.input_features else rows
    joined = staged(base.join(wide, columns.id, "left"), "stacked")
    names = columns_with_prefix(wide, "f_")
    train_rows = joined.filter(columns.is_train)
    features = MeanImputer(names).fit(train_rows).transform(joined)
    train = staged(
        features.filter(columns.is_train).join(
            _goal(spec, rows, targets, columns), columns.id, "left"
        ),
        "goals",
    )
    test = features.filter(F.col(columns.dataset) == "TEST")
    return _cross_fit_goal(
        spec,
        train,
        test,
        columns,
        seeds or spec.seeds,
        n_splits or spec.n_splits,
        store,
        params or {},
        learner,
    )
