"""Estimators for the objectives in use, all trained by Spark ML."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import partial, reduce

import numpy as np
from pyspark import SparkContext
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, OneHotEncoderModel, StandardScaler, VectorAssembler
from pyspark.ml.common import _py2java
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import TypeConverters
from pyspark.ml.regression import (
    AFTSurvivalRegression,
    GBTRegressor,
    GeneralizedLinearRegression,
    LinearRegression,
    LinearRegressionModel,
)
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReader, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from survloom.operators.persistence import Configured, TableModel, setting
from survloom.settings import staged


def mark_nominal(df: DataFrame, cardinalities: Mapping[str, int]) -> DataFrame:
    """Tell trees that these columns hold category codes 0..n-1, not quantities.

    They become doubles: assembling a vector keeps the mark of no other type.
    """
    out = df
    for column, n in cardinalities.items():
        attribute = {"ml_attr": {"type": "nominal", "vals": [str(i) for i in range(n)]}}
        out = out.withColumn(column, F.col(column).cast("double")).withMetadata(column, attribute)
    return out


class GroupMeanModel(TableModel):
    """Predicts the (weighted) target mean of the row's group."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        keys = self.options["keys"]
        found = dataset.join(self.table, keys, "left")
        default = F.lit(self.options["overall"])
        return found.select(
            *dataset.columns, F.coalesce("_mean", default).alias(self.options["predictionCol"])
        )


class GroupMeanFolds:
    """Group means without the rows of each fold, as one table (_fold, keys, _mean)."""

    def __init__(self, keys: Sequence[str], table: DataFrame, overall: Mapping[int, float | None], fold_col: str, out: str):
        self.keys, self.table, self.overall, self.fold_col, self.out = list(keys), table, dict(overall), fold_col, out

    def model(self, fold: int) -> GroupMeanModel:
        """The model of the rows outside ``fold``."""
        options = {"keys": self.keys, "overall": self.overall.get(fold), "predictionCol": self.out}
        own = self.table.filter(F.col("_fold") == fold)
        return GroupMeanModel(options, own.select(*self.keys, "_mean"))

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the prediction of the model of each row's own fold: one join for all folds."""
        own = self.table.withColumnRenamed("_fold", self.fold_col)
        found = df.join(own, [self.fold_col, *self.keys], "left")
        default = F.lit(None).cast("double")
        for fold, mean in self.overall.items():
            default = F.when(F.col(self.fold_col) == fold, F.lit(mean).cast("double")).otherwise(default)
        return found.select(*df.columns, F.coalesce("_mean", default).alias(self.out))


def transform_together(models: Sequence[GroupMeanModel], df: DataFrame, outs: Sequence[str]) -> DataFrame:
    """``df`` with the prediction of each model, whose tables of the same keys are joined as one."""
    keys = models[0].options["keys"]
    tables = [m.table.select(*keys, F.lit(i).alias("_model"), "_mean") for i, m in enumerate(models)]
    wide = reduce(DataFrame.unionByName, tables).groupBy(*keys).pivot("_model", list(range(len(models))))
    means = {str(i): f"_mean_{i}" for i in range(len(models))}
    found = df.join(wide.agg(F.first("_mean")).withColumnsRenamed(means), keys, "left")
    preds = [
        F.coalesce(f"_mean_{i}", F.lit(m.options["overall"])).cast("double").alias(out)
        for i, (m, out) in enumerate(zip(models, outs, strict=True))
    ]
    return found.select(*df.columns, *preds)


def share_groups(models: Sequence[Model]) -> bool:
    """Whether these are several models of means over the same keys."""
    if len(models) < 2 or not all(isinstance(m, GroupMeanModel) for m in models):
        return False
    keys = models[0].options["keys"]
    return bool(keys) and all(m.options["keys"] == keys for m in models)


class GroupMeanRegressor(Estimator, Configured):
    """Target mean per group; groups not seen in fitting get the overall mean."""

    keys = setting("keys", "group keys", TypeConverters.toListString)
    labelCol = setting("labelCol", "target", TypeConverters.toString)
    weightCol = setting("weightCol", "case weights", TypeConverters.toString)
    predictionCol = setting("predictionCol", "output", TypeConverters.toString)

    def __init__(
        self,
        keys: Sequence[str] = (),
        labelCol: str = "label",
        weightCol: str | None = None,
        predictionCol: str = "prediction",
    ):
        super().__init__()
        self._configure(
            keys=list(keys), labelCol=labelCol, weightCol=weightCol, predictionCol=predictionCol
        )

    def _fit(self, dataset: DataFrame) -> GroupMeanModel:
        keys, label, weight = (self.value(n) for n in ("keys", "labelCol", "weightCol"))
        w = F.col(weight) if weight else F.lit(1.0)
        w = F.when(F.col(label).isNotNull(), w)
        table = staged(
            dataset.groupBy(*keys)
            .agg(F.sum(F.col(label) * w).alias("_wy"), F.sum(w).alias("_w"))
            .withColumn("_mean", F.try_divide("_wy", "_w"))
        )
        overall = table.agg(F.try_divide(F.sum("_wy"), F.sum("_w"))).first()[0]
        options = {"keys": keys, "overall": overall, "predictionCol": self.value("predictionCol")}
        return GroupMeanModel(options, table.select(*keys, "_mean"))

    def fit_folds(self, dataset: DataFrame, fold_col: str, folds: Sequence[int]) -> GroupMeanFolds:
        """For each of ``folds`` the means over the rows of all other folds, from one pass over the rows.

        Sums per fold and group are added to the folds they do not belong to: nothing is subtracted.
        """
        keys, label, weight = (self.value(n) for n in ("keys", "labelCol", "weightCol"))
        w = F.col(weight) if weight else F.lit(1.0)
        w = F.when(F.col(label).isNotNull(), w)
        known = dataset.filter(F.col(fold_col).isNotNull())
        sums = known.groupBy(F.col(fold_col).alias("_own"), *keys).agg(
            F.sum(F.col(label) * w).alias("_wy"), F.sum(w).alias("_w")
        )
        others = F.explode(F.array(*[F.lit(f) for f in folds])).alias("_fold")
        table = staged(
            sums.select("*", others)
            .filter(F.col("_fold") != F.col("_own"))
            .groupBy("_fold", *keys)
            .agg(F.sum("_wy").alias("_wy"), F.sum("_w").alias("_w"))
            .withColumn("_mean", F.try_divide("_wy", "_w"))
        )
        whole = table.groupBy("_fold").agg(F.try_divide(F.sum("_wy"), F.sum("_w"))).collect()
        return GroupMeanFolds(
            keys, table.select("_fold", *keys, "_mean"), {f: m for f, m in whole}, fold_col, self.value("predictionCol")
        )


class _FractionalWriter(MLWriter):
    def __init__(self, stage: FractionalLabels):
        super().__init__()
        self._stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self._stage, path, self.sparkSession)
        self._stage.classifier.save(f"{path}/classifier")


class _FractionalReader(MLReader):
    def load(self, path: str) -> FractionalLabels:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        classifier = DefaultParamsReader.loadParamsInstance(f"{path}/classifier", self.sparkSession)
        stage = FractionalLabels(classifier)
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        return stage


class FractionalLabels(Estimator, Configured):
    """Fit a classifier to labels in [0, 1]: cross entropy on fractions.

    Each row becomes one of label 1 with weight w*y and one of label 0 with
    weight w*(1-y), which has the same loss.
    """

    labelCol = setting("labelCol", "target in [0, 1]", TypeConverters.toString)
    weightCol = setting("weightCol", "case weights", TypeConverters.toString)

    def __init__(self, classifier: Estimator, labelCol: str = "label", weightCol: str | None = None):
        super().__init__()
        self.classifier = classifier
        self._configure(labelCol=labelCol, weightCol=weightCol)

    def write(self) -> MLWriter:
        return _FractionalWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _FractionalReader()

    def _fit(self, dataset: DataFrame) -> Model:
        y = F.col(self.value("labelCol"))
        w = F.col(self.value("weightCol")) if self.value("weightCol") else F.lit(1.0)
        halves = F.inline(
            F.array(
                F.struct(F.lit(1.0).alias("_label"), (w * y).alias("_weight")),
                F.struct(F.lit(0.0).alias("_label"), (w * (1 - y)).alias("_weight")),
            )
        )
        doubled = dataset.select("*", halves).filter(F.col("_weight") > 0)
        fitted = self.classifier.copy(
            {
                self.classifier.getParam("labelCol"): "_label",
                self.classifier.getParam("weightCol"): "_weight",
            }
        )
        return fitted.fit(doubled)


class RidgeRegressor(Estimator, Configured):
    """Least squares with penalty alpha * |coefficients|^2, intercept not penalised.

    Spark divides the loss by the sum of weights and the penalty by the label's
    deviation; ``regParam`` is set so that both cancel.
    """

    penalty = setting("penalty", "alpha, the weight of the squared coefficients", TypeConverters.toFloat)
    featuresCol = setting("featuresCol", "vector of features", TypeConverters.toString)
    labelCol = setting("labelCol", "target", TypeConverters.toString)
    weightCol = setting("weightCol", "case weights", TypeConverters.toString)
    predictionCol = setting("predictionCol", "output", TypeConverters.toString)

    def __init__(
        self,
        alpha: float = 1.0,
        *,
        featuresCol: str = "features",
        labelCol: str = "label",
        weightCol: str | None = None,
        predictionCol: str = "prediction",
    ):
        super().__init__()
        self._configure(
            penalty=float(alpha), featuresCol=featuresCol, labelCol=labelCol, weightCol=weightCol,
            predictionCol=predictionCol,
        )

    @property
    def alpha(self) -> float:
        return self.value("penalty")

    def _fit(self, dataset: DataFrame) -> Model:
        label, weight = self.value("labelCol"), self.value("weightCol")
        w = F.col(weight) if weight else F.lit(1.0)
        y = F.col(label)
        s = dataset.agg(
            F.sum(w).alias("w"), F.sum(w * y).alias("wy"), F.sum(w * y * y).alias("wyy")
        ).first()
        deviation = math.sqrt(max(s["wyy"] / s["w"] - (s["wy"] / s["w"]) ** 2, 0.0))
        regression = LinearRegression(
            solver="normal",
            elasticNetParam=0.0,
            standardization=False,
            regParam=self.alpha / s["w"] * deviation,
            featuresCol=self.value("featuresCol"),
            labelCol=label,
            predictionCol=self.value("predictionCol"),
        )
        if weight:
            regression = regression.setWeightCol(weight)
        return regression.fit(dataset)


#: Features up to which sums of products are columns of one aggregate.
_SUMMED = 8


def _plain(assembler: VectorAssembler, df: DataFrame) -> bool:
    """Whether the assembled vector is of plain numbers and refuses null and NaN."""
    kinds = {f.name: f.dataType for f in df.schema}
    return assembler.getHandleInvalid() == "error" and all(isinstance(kinds.get(c), T.NumericType) for c in assembler.getInputCols())


def _number(name: str) -> Column:
    """A feature as the assembler reads it: null and NaN are errors."""
    x = F.col(f"`{name}`").cast("double")
    return F.when(x.isNull() | F.isnan(x), F.raise_error(F.lit(f"{name} has a null or NaN")).cast("double")).otherwise(x)


class RidgeFolds:
    """Ridge fits without the rows of each fold, as one (coefficients, intercept) per fold."""

    def __init__(self, assembler: VectorAssembler, ridge: RidgeRegressor, found: Mapping[int, tuple[np.ndarray, float]], fold_col: str):
        self.assembler, self.ridge, self.found, self.fold_col = assembler, ridge, dict(found), fold_col

    def model(self, fold: int) -> PipelineModel:
        """The model of the rows outside ``fold``."""
        coefficients, intercept = self.found[fold]
        sc = SparkContext._active_spark_context
        made = sc._jvm.org.apache.spark.ml.regression.LinearRegressionModel(
            LinearRegression().uid, _py2java(sc, Vectors.dense(coefficients)), float(intercept)
        )
        model = LinearRegressionModel(made)
        model._resetUid(made.uid())
        model.setFeaturesCol(self.ridge.value("featuresCol")).setPredictionCol(self.ridge.value("predictionCol"))
        return PipelineModel([self.assembler, model])

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the prediction of the model of each row's own fold, without a vector."""
        at = F.array_position(F.array(*[F.lit(f) for f in self.found]), F.col(self.fold_col)).cast("int")
        own = lambda values: F.try_element_at(F.array(*[F.lit(float(v)) for v in values]), F.nullif(at, F.lit(0)))
        out = own(i for _, i in self.found.values())
        for j, name in enumerate(self.assembler.getInputCols()):
            out = out + own(c[j] for c, _ in self.found.values()) * _number(name)
        return df.withColumn(self.ridge.value("predictionCol"), out)


def _ridge_folds(
    assembler: VectorAssembler, ridge: RidgeRegressor, dataset: DataFrame, fold_col: str, folds: Sequence[int]
) -> RidgeFolds:
    """For each of ``folds`` the fit on the rows of all other folds, from one pass over the rows.

    Sums of products per fold are added to the folds they do not belong to.
    """
    label, weight = ridge.value("labelCol"), ridge.value("weightCol")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    y, xs = F.col(label).cast("double"), [_number(c) for c in assembler.getInputCols()]
    sound = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    terms = [F.lit(1.0), *xs, y]
    at = [(i, j) for i in range(len(terms)) for j in range(i, len(terms))]
    sums = [F.sum(w * terms[i] * terms[j]).alias(f"s{n}") for n, (i, j) in enumerate(at)]
    bad = F.count_if(~sound(y) | ~sound(w) | (w < 0)).alias("bad")
    # As ``fold <> f`` does, this leaves rows without a fold out.
    rows = dataset.filter(F.col(fold_col).isNotNull()).groupBy(F.col(fold_col).alias("own")).agg(bad, *sums).collect()
    if any(r["bad"] for r in rows):
        raise ValueError(f"{label} and {weight or 'weights'} must be finite, and weights not negative")
    moments = {r["own"]: np.array([r[f"s{n}"] for n in range(len(at))]) for r in rows}
    found = {}
    for fold in folds:
        total = sum((m for own, m in moments.items() if own != fold), np.zeros(len(at)))
        if not total[0] > 0:
            raise ValueError(f"no rows outside fold {fold} to fit on")
        square = np.zeros((len(terms), len(terms)))
        for n, (i, j) in enumerate(at):
            square[i, j] = square[j, i] = total[n]
        means = square[0, 1:] / square[0, 0]
        centred = square[1:, 1:] - square[0, 0] * np.outer(means, means)
        coefficients = np.linalg.solve(centred[:-1, :-1] + ridge.alpha * np.eye(len(xs)), centred[:-1, -1])
        found[fold] = coefficients, float(means[-1] - means[:-1] @ coefficients)
    return RidgeFolds(assembler, ridge, found, fold_col)


def folds_together(estimator: Estimator, df: DataFrame) -> Callable[[DataFrame, str, Sequence[int]], GroupMeanFolds | RidgeFolds] | None:
    """How to fit on the rows outside each fold of ``df`` in one pass, or None if folds are fitted one by one.

    It is the estimator's own ``fit_folds``, or that of a ridge on a few plain columns.
    """
    if hasattr(estimator, "fit_folds"):
        return estimator.fit_folds
    stages = estimator.getStages() if isinstance(estimator, Pipeline) else []
    if [type(s) for s in stages] != [VectorAssembler, RidgeRegressor]:
        return None
    assembler, ridge = stages
    if len(assembler.getInputCols()) > _SUMMED or ridge.alpha <= 0 or assembler.getOutputCol() != ridge.value("featuresCol"):
        return None
    return partial(_ridge_folds, assembler, ridge) if _plain(assembler, df) else None


def linear_together(models: Sequence[Model], df: DataFrame, outs: Sequence[str]) -> DataFrame | None:
    """``df`` with the predictions of linear models on the same few plain columns, or None if they are others."""
    stages = [getattr(m, "stages", []) for m in models]
    if len(models) < 2 or not all([type(s) for s in own] == [VectorAssembler, LinearRegressionModel] for own in stages):
        return None
    inputs = stages[0][0].getInputCols()
    if len(inputs) > _SUMMED or not _plain(stages[0][0], df) or any(
        a.getInputCols() != inputs or a.getHandleInvalid() != "error" or a.getOutputCol() != m.getFeaturesCol() for a, m in stages
    ):
        return None
    names = [f"_x_{j}" for j in range(len(inputs))]
    rows = df.select("*", *[_number(c).alias(n) for c, n in zip(inputs, names, strict=True)])
    preds = [
        reduce(lambda seen, at: seen + F.col(at[0]) * F.lit(float(at[1])), zip(names, m.coefficients.toArray(), strict=True), F.lit(float(m.intercept)))
        for _, m in stages
    ]
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], *[p.alias(n) for p, n in zip(preds, outs, strict=True)])


_HOT = "_hot_"
#: Objectives whose trees split a set of category codes by themselves.
_TREES = ("rmse", "logloss")


def _assemblers(features: Sequence[str], hot: Sequence[str], out: str = "features") -> list[Estimator]:
    """Stages that make the feature vector; ``hot`` features become sparse indicators.

    A category that the fitted rows lack has no indicator: all are zero for it.
    """
    columns = [_HOT + c if c in hot else c for c in features]
    assembler = VectorAssembler(inputCols=columns, outputCol=out, handleInvalid="error")
    if not hot:
        return [assembler]
    inputs = [c for c in features if c in hot]
    encoder = OneHotEncoder(inputCols=inputs, outputCols=[_HOT + c for c in inputs], handleInvalid="keep")
    return [encoder, assembler]


def regressor(
    objective: str,
    features: Sequence[str],
    label: str,
    *,
    weight: str | None = None,
    event: str | None = None,
    validation: str | None = None,
    categories: Sequence[str] = (),
    **params,
) -> Pipeline:
    """A pipeline for one objective.

    ``rmse``, ``logloss`` (boosted trees), ``tweedie`` and ``gamma`` (log-link
    linear models), ``cross_entropy`` (labels in [0, 1]), ``logistic``, ``ridge``
    (``scaled_ridge`` on standardised features), ``weibull`` (accelerated
    failure time; ``event`` is its censor flag). ``validation`` names a boolean
    column of rows that only decide when boosting stops. ``categories`` names the
    features that are codes 0..n-1: linear objectives see one indicator per code, trees
    take them as sets if :func:`mark_nominal` has marked them.
    """
    weighted = {"weightCol": weight} if weight else {}
    held_out = {"validationIndicatorCol": validation} if validation else {}
    vector = "scaled" if objective == "scaled_ridge" else "features"
    makers = {
        "rmse": lambda: GBTRegressor(labelCol=label, **weighted, **held_out, **params),
        "logloss": lambda: GBTClassifier(labelCol=label, **weighted, **held_out, **params),
        "logistic": lambda: LogisticRegression(labelCol=label, **weighted, **params),
        "tweedie": lambda: GeneralizedLinearRegression(
            family="tweedie", variancePower=1.5, linkPower=0.0, labelCol=label, **weighted, **params
        ),
        "gamma": lambda: GeneralizedLinearRegression(
            family="gamma", link="log", labelCol=label, **weighted, **params
        ),
        "cross_entropy": lambda: FractionalLabels(LogisticRegression(**params), label, weight),
        "ridge": lambda: RidgeRegressor(labelCol=label, featuresCol=vector, **weighted, **params),
        "weibull": lambda: AFTSurvivalRegression(labelCol=label, censorCol=event, **params),
    }
    makers["scaled_ridge"] = makers["ridge"]
    if objective not in makers:
        raise ValueError(f"objective {objective!r} is not one of {sorted(makers)}")
    hot = [] if objective in _TREES else [c for c in features if c in set(categories)]
    stages = _assemblers(features, hot)
    if objective == "scaled_ridge":
        # The scaler is a stage of the model: new rows are scaled by training statistics.
        stages.append(StandardScaler(inputCol="features", outputCol=vector, withMean=True))
    return Pipeline(stages=[*stages, makers[objective]()])


def one_prediction(scored: DataFrame, out: str = "pred") -> DataFrame:
    """One number per row: the positive-class probability if there is one, else the prediction."""
    if "probability" in scored.columns:
        return scored.withColumn(out, vector_to_array("probability")[1])
    return scored.withColumn(out, F.col("prediction").cast("double"))


_WORKING = ("features", "scaled", "rawPrediction", "probability", "prediction")


def predict(model: Model, df: DataFrame, out: str = "pred") -> DataFrame:
    """``df`` with the model's prediction and none of its working columns."""
    scored = one_prediction(model.transform(df), out)
    made = [c for c in scored.columns if c in _WORKING or c.startswith(_HOT)]
    return scored.drop(*[c for c in made if c not in df.columns])


def feature_importances(model: Model, features: Sequence[str]) -> dict[str, float]:
    """Importance per feature of the last stage: impurity gain, or the coefficient.

    A feature of several indicators has the sum of their absolute coefficients.
    """
    last = model.stages[-1] if hasattr(model, "stages") else model
    found = getattr(last, "featureImportances", None)
    if found is None:
        found = last.coefficients
    if isinstance(found, dict):
        return {f: float(found.get(f, 0.0)) for f in features}
    widths: dict[str, int] = {}
    for stage in getattr(model, "stages", []):
        if isinstance(stage, OneHotEncoderModel):
            widths = dict(zip(stage.getInputCols(), stage.categorySizes))
    values, at, out = found.toArray(), 0, {}
    for f in features:
        n = widths.get(f)
        part = values[at : at + (1 if n is None else n)]
        out[f] = float(part[0] if n is None else abs(part).sum())
        at += len(part)
    return out
