"""Encoders, folds and targets on edge cases."""

from __future__ import annotations

import math

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from survloom.functions.expr import clip, nonconstant_columns, weighted_mean
from survloom.operators import encoders as enc
from survloom.operators.folds import assign_folds, fold_table, mark_holdout
from survloom.operators.targets import normalize_by_max, scale_target, scale_target_by_event
from survloom.settings import fresh_path


def values(df, column):
    return [r[column] for r in df.orderBy("id").collect()]


@pytest.fixture(scope="module")
def pets(spark):
    rows = [(5, "dog", None), (2, "cat", "x"), (9, "dog", "x"), (7, "eel", "y"), (3, "cat", None)]
    return spark.createDataFrame(rows, "id long, pet string, tag string")


def test_ordinal_by_first_appearance(spark, pets):
    model = enc.OrdinalEncoder(["pet", "tag"], "id").fit(pets)
    new = spark.createDataFrame(
        [(1, "dog", "y"), (2, "cat", None), (3, "fox", "z"), (4, None, "x")], "id long, pet string, tag string"
    )
    coded = model.transform(new)
    # pet: cat (2), dog (5), eel (7); no null seen. tag: x (2), null (3), y (7).
    assert values(coded, "f_c_pet") == [2, 1, -1, -2]
    assert values(coded, "f_c_tag") == [3, 2, -1, 1]


def test_encoders_save_and_load_in_a_pipeline(spark, pets):
    fitted = Pipeline(stages=[enc.OrdinalEncoder(["pet"], "id"), enc.MeanImputer(["id"], "m_")]).fit(pets)
    path = fresh_path(spark, "model")
    fitted.write().save(path)
    loaded = PipelineModel.load(path)
    want = values(fitted.transform(pets), "f_c_pet")
    assert values(loaded.transform(pets), "f_c_pet") == want


def test_one_hot(spark, pets):
    coded = enc.OneHotEncoder("pet", "id").fit(pets).transform(pets)
    assert [c for c in coded.columns if c.startswith("pet_")] == ["pet_1", "pet_2"]
    assert values(coded, "pet_1") == [1, 1, 0, 0, 0]
    constant = pets.withColumn("pet", F.lit("dog"))
    assert enc.OneHotEncoder("pet", "id").fit(constant).transform(constant).columns == pets.columns
    with pytest.raises(ValueError):
        enc.OneHotEncoder("pet", "id", max_columns=2).fit(pets)


def test_null_flags_and_combination_names(pets):
    flags = enc.null_flags(["tag"]).transform(pets)
    assert values(flags, "f_tag_is_null") == [0, 1, 1, 0, 0]
    crossed = enc.category_crosses(["pet", "tag"]).transform(pets)
    assert [r["pet+tag"] for r in crossed.orderBy("id").collect()][:3] == ["catx", "catNULL", "dogNULL"]
    joined = enc.string_combinations(["pet", "tag"]).transform(pets)
    assert values(joined, "pet tag_concat")[:2] == ["cat x", None]
    with pytest.raises(ValueError):
        enc.category_crosses(["pet"], r=2)
    with pytest.raises(ValueError):
        enc.arithmetic_combinations(["a"], operator="-")


def test_arithmetic_nulls(spark):
    df = spark.createDataFrame([(1, 2.0, None), (2, 3.0, 4.0)], "id long, b double, a double")
    assert values(enc.arithmetic_combinations(["b", "a"]).transform(df), "a+b_combi") == [2.0, 7.0]
    product = enc.arithmetic_combinations(["b", "a"], operator="*").transform(df)
    assert values(product, "a*b_combi") == [None, 12.0]


def test_combinations_of_all_columns(spark, pets):
    df = spark.createDataFrame([(1, 2.0, 3.0, 4.0)], "id long, a double, b double, c double")
    out = enc.arithmetic_combinations(exclude=["id"], drop_origin=True).transform(df)
    assert out.columns == ["id", "a+b_combi", "a+c_combi", "b+c_combi"]
    fixed = enc.arithmetic_combinations(["a", "b"], include=["c"], r=3).transform(df)
    assert fixed.columns[-1] == "c+a+b_combi" and fixed.first()["c+a+b_combi"] == 9.0
    texts = enc.string_combinations(drop_origin=True, separator="_").transform(pets)
    assert texts.columns == ["id", "pet_tag_concat"]


def test_group_of_one_and_null_key(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 3.0), (3, "b", 5.0), (4, None, 7.0)], "id long, g string, v double")
    encoder = enc.GroupStatisticsEncoder(
        "g",
        [F.avg("v").alias("mean"), F.stddev_samp("v").alias("std")],
        quantile_columns={"median": ("v", 0.5)},
        deviations=[
            {"method": "z-score", "val": "v", "mean": "mean", "std": "std"},
            {"method": "med-abs-dev", "val": "v", "median": "median"},
        ],
    )
    model = encoder.fit(df)
    for _ in range(2):  # a second transform must give the same
        coded = model.transform(df)
        assert values(coded, "f_mean_grpby_g") == [2.0, 2.0, 5.0, None]
        z = values(coded, "f_z-score_v_grpby_g")
        assert z[0] == pytest.approx(-1 / math.sqrt(2)) and z[2:] == [None, None]
        assert values(coded, "f_med-abs-dev_v_grpby_g") == [1.0, 1.0, 0.0, None]
    with pytest.raises(ValueError):
        enc.GroupStatisticsEncoder("g", deviations=[{"method": "range", "min": "mean"}])


def test_target_means(spark):
    rows = [(1, "a", 1.0, 0), (2, "a", 0.0, 1), (3, "a", 1.0, 1), (4, "b", 1.0, 0), (5, None, 1.0, 0)]
    df = spark.createDataFrame(rows, "id long, c string, y double, fold int")
    encoder = enc.TargetMeanEncoder(["c"], "y", "id", fold_col="fold")
    assert values(encoder.fit_transform(df), "f_te_by_y_c") == [0.5, 1.0, 1.0, -1.0, -2.0]
    new = spark.createDataFrame([(1, "a"), (2, "z"), (3, None)], "id long, c string")
    got = values(encoder.fit(df).transform(new), "f_te_by_y_c")
    assert got == pytest.approx([2 / 3, -1.0, -2.0])


def test_scaling_without_spread(spark):
    df = spark.createDataFrame([(1, 4.0), (2, 4.0)], "id long, x double")
    for method in ("standard", "minmax", "robust"):
        assert values(enc.ScalingEncoder(["x"], method).fit(df).transform(df), "x") == [0.0, 0.0]


def test_bins_of_few_values(spark):
    df = spark.createDataFrame([(i, float(i % 3)) for i in range(9)] + [(9, None)], "id long, x double")
    binned = enc.QuantileBinsEncoder(["x"], 4).fit(df).transform(df)
    assert values(binned, "x_bin")[:3] == [0, 1, 1] and values(binned, "x_bin")[9] is None
    beyond = enc.QuantileBinsEncoder(["x"], 4).fit(df).transform(df.withColumn("x", F.lit(9.0)))
    assert set(values(beyond, "x_bin")) == {1}


def test_clip_blend_and_constant_columns(spark):
    df = spark.createDataFrame([(1, None, 1.0, 0), (2, 5.0, 2.0, 0), (3, -1.0, 3.0, 0)], "id long, x double, y double, z int")
    assert values(df.withColumn("x", clip(F.col("x"), 0.0, 2.0)), "x") == [None, 2.0, 0.0]
    assert nonconstant_columns(df, ["x", "y", "z"]) == ["x", "y"]
    assert values(df.withColumn("m", weighted_mean({"y": 1.0, "z": 3.0})), "m") == [0.25, 0.5, 0.75]


def test_fold_table_matches_single_seeds(spark):
    ids = spark.range(101).withColumnRenamed("id", "id")
    table = fold_table(ids, "id", 7, [1, 2])
    for seed in (1, 2):
        assert values(table.filter(F.col("seed") == seed), "fold") == values(
            assign_folds(ids, "id", 7, seed), "fold"
        )
    sizes = sorted(r["count"] for r in table.groupBy("seed", "fold").count().collect())
    assert sizes == [14] * 8 + [15] * 6


def test_holdout_takes_training_rows_only(spark):
    df = spark.range(20).withColumn("dataset", F.when(F.col("id") < 10, "TRAIN").otherwise("TEST"))
    marked = mark_holdout(df, "id", 0.25, 1)
    counts = {r["dataset"]: r["count"] for r in marked.groupBy("dataset").count().collect()}
    assert counts == {"TRAIN": 7, "VALID": 3, "TEST": 10}


def test_zero_probability_and_zero_survival(spark):
    df = spark.createDataFrame([(1, 0.0, 0.5), (2, 0.5, 0.25), (3, 1.0, 0.5)], "id long, p double, t double")
    got = values(scale_target(df, "t", "p", out="s"), "s")
    factor = math.log(0.5) / (0 - 0.25)
    assert got[0] is None and got[1:] == pytest.approx([math.log(0.5) / factor + 0.25, 0.5])
    reaching_zero = df.withColumn("t", F.when(F.col("id") == 3, 0.0).otherwise(F.col("t")))
    assert values(scale_target(reaching_zero, "t", "p", out="s"), "s") == [None, 0.25, 0.0]


def test_scaling_by_event_with_null_event(spark):
    df = spark.createDataFrame(
        [(1, 0.2, 0.5, 1), (2, 0.4, 0.25, 0), (3, 0.3, 0.5, None)], "id long, p double, t double, e int"
    )
    got = values(scale_target_by_event(df, "t", "p", "e", exponential=False, out="s"), "s")
    # One row per class: its own log probability over the factor is minus its own target.
    assert got[:2] == pytest.approx([0.0, 0.0]) and got[2] is None
    clipped = scale_target_by_event(df, "t", "p", "e", prob_clip=(0.1, 0.5), out="s")
    assert values(clipped, "s")[0] is not None
    assert values(normalize_by_max(df, "t", out="n"), "n") == [1.0, 0.5, 1.0]
