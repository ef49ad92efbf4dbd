"""Encoders and estimators saved, loaded, copied with other settings, alone and in pipelines."""

from __future__ import annotations

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from survloom.operators import encoders as enc
from survloom.operators.cox import CoxRegression
from survloom.operators.models import FractionalLabels, GroupMeanRegressor, RidgeRegressor, regressor
from survloom.settings import fresh_path


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, f"g{i % 3}", None if i % 5 == 0 else f"t{i % 2}", float(i % 7), None if i % 4 == 0 else float(i)) for i in range(40)]
    return spark.createDataFrame(data, "ID long, g string, t string, x double, y double").persist()


def reloaded(spark, stage):
    path = fresh_path(spark, "stage")
    stage.write().save(path)
    return type(stage).load(path)


def collected(df):
    return sorted(df.collect(), key=lambda r: r.ID)


STAGES = [
    lambda: enc.RawColumns(["g", "y"], "copy_"),
    lambda: enc.NullFlags(["t"], suffix="_gone"),
    lambda: enc.ArithmeticCombinations(["x", "y"], operator="*", drop_origin=True),
    lambda: enc.StringCombinations(separator="/", include=["g"], exclude=["ID"]),
    lambda: enc.CategoryCrosses(["g", "t"]),
    lambda: enc.OrdinalEncoder(["g", "t"], "ID"),
    lambda: enc.OneHotEncoder("g", "ID", drop_last=False),
    lambda: enc.TargetMeanEncoder(["g"], "y", "ID", smoothing=2.0),
    lambda: enc.GroupStatisticsEncoder(
        "g", ["avg(y) AS mean"], quantile_columns={"median": ("y", 0.5)}, deviations=[{"method": "mean-diff", "val": "x", "mean": "mean"}]
    ),
    lambda: enc.ScalingEncoder(["x", "y"], "minmax", "s_"),
    lambda: enc.MeanImputer(["y"], "m_"),
    lambda: enc.QuantileBinsEncoder(["x"], 4),
    lambda: GroupMeanRegressor(["g"], "y", "x"),
]


@pytest.mark.parametrize("make", STAGES)
def test_a_loaded_stage_does_what_the_saved_one_does(spark, rows, make):
    stage = make()
    again = reloaded(spark, stage)
    assert again.uid == stage.uid and type(again) is type(stage)

    def apply(s):
        return collected((s if isinstance(s, enc.RowEncoder) else s.fit(rows)).transform(rows))

    assert apply(again) == apply(stage)


def test_a_whole_pipeline_before_and_after_fitting(spark, rows):
    stages = [make() for make in STAGES if not isinstance(make(), (enc.ArithmeticCombinations, GroupMeanRegressor))]
    pipeline = Pipeline(stages=stages)
    path = fresh_path(spark, "pipeline")
    pipeline.write().save(f"{path}/a")
    fitted = Pipeline.load(f"{path}/a").fit(rows)
    fitted.write().save(f"{path}/b")
    want = collected(pipeline.fit(rows).transform(rows))
    assert collected(PipelineModel.load(f"{path}/b").transform(rows)) == want


def test_copies_have_their_own_settings(rows):
    encoder = enc.MeanImputer(["y"], "m_")
    other = encoder.copy({encoder.prefix: "z_"})
    assert (encoder.value("prefix"), other.value("prefix")) == ("m_", "z_")
    assert "z_y" in other.fit(rows).transform(rows).columns
    ridge = RidgeRegressor(1.0)
    assert [ridge.copy(g).alpha for g in ParamGridBuilder().addGrid(ridge.penalty, [0.5, 2.0]).build()] == [0.5, 2.0]
    wrong = enc.ScalingEncoder(["x"])
    with pytest.raises(ValueError, match="scaling"):
        wrong.copy({wrong.method: "cubic"}).fit(rows)


def test_optional_settings_stay_unset(spark):
    for stage in (enc.TargetMeanEncoder(["g"], "y"), GroupMeanRegressor(["g"], "y"), CoxRegression(["x"])):
        again = reloaded(spark, stage)
        names = [p.name for p in stage.params]
        assert {n: again.value(n) for n in names} == {n: stage.value(n) for n in names}


def test_columns_as_aggregates_cannot_be_saved(spark, rows):
    encoder = enc.GroupStatisticsEncoder("g", [F.avg("y").alias("mean")])
    assert "f_mean_grpby_g" in encoder.copy().fit(rows).transform(rows).columns
    with pytest.raises(ValueError, match="SQL"):
        encoder.write()


@pytest.mark.parametrize("objective", ["ridge", "cross_entropy"])
def test_objectives_of_own_estimators_reload(spark, rows, objective):
    label = rows.withColumn("share", F.col("x") / 7).na.fill(0.0)
    pipeline = regressor(objective, ["x", "y"], "share")
    path = fresh_path(spark, "objective")
    pipeline.write().save(path)
    scored = [p.fit(label).transform(label).orderBy("ID").select("prediction").collect() for p in (pipeline, Pipeline.load(path))]
    assert scored[0] == scored[1]


def test_fractional_labels_keep_their_classifier(spark):
    again = reloaded(spark, FractionalLabels(LogisticRegression(maxIter=7), "share", "w"))
    assert (again.classifier.getMaxIter(), again.value("labelCol"), again.value("weightCol")) == (7, "share", "w")
