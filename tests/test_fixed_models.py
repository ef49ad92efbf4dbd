"""Fitted models stay as they were; keys, unions and metrics say what they do."""

from __future__ import annotations

import pytest

from survloom.operators.crossfit import auc_metric, cross_fit_seeds, mse_metric, with_seed_folds
from survloom.operators.encoders import MeanImputer, OrdinalEncoder
from survloom.operators.models import GroupMeanRegressor
from survloom.settings import release
from survloom.sources.files import diagonal_union, read_csv, write_csv


def test_models_do_not_follow_their_input(spark, tmp_path):
    path = str(tmp_path / "rows")

    def write(shift):
        rows = [(i, float(i + shift), f"c{(i + shift) % 7}", float(i * shift)) for i in range(40)]
        spark.createDataFrame(rows, "ID long, x double, c string, y double").write.mode("overwrite").parquet(path)
        spark.catalog.refreshByPath(path)

    write(0)
    df = spark.read.parquet(path)
    probe = spark.createDataFrame([(100, None, "c3", 0.0)], "ID long, x double, c string, y double")
    models = [MeanImputer(["x"], prefix="f_").fit(df), OrdinalEncoder(["c"], "ID").fit(df), GroupMeanRegressor(["c"], "y").fit(df)]
    before = [m.transform(probe).collect() for m in models]
    write(1000)
    release()
    assert [m.transform(probe).collect() for m in models] == before


@pytest.mark.parametrize("ids", [[1, 2, None], [1, 2, 2]])
def test_folds_refuse_unsound_keys(spark, ids):
    df = spark.createDataFrame([(i, 1.0) for i in ids], "ID long, x double")
    with pytest.raises(ValueError, match="unique"):
        with_seed_folds(df, "ID", 2, [1])


def test_rows_left_out_of_fitting_are_predicted(spark):
    rows = [(i, i % 2, "a", 1.0 if i < 8 else 1000.0) for i in range(10)]
    df = spark.createDataFrame(rows, "ID long, fold_1 int, g string, y double")
    run = cross_fit_seeds(
        lambda i, seed: GroupMeanRegressor(["g"], "y"), df, name="m", seeds=[1], meta=["ID", "y", "fold_1"], folds=[0], usable=df["y"] < 10
    )
    assert sorted((r.ID, r.pred) for r in run.predictions.collect()) == [(i, 1.0) for i in range(0, 10, 2)]
    errors = run.scores(mse_metric("y")).collect()
    assert {r.score for r in errors} == {999.0**2 / 5}


def test_auc_as_a_metric(spark):
    df = spark.createDataFrame([("m", 1, 0.9), ("m", 0, 0.1), ("m", 1, 0.1)], "name string, efs int, pred double")
    assert auc_metric()(df, ["name"]).first().asDict() == {"name": "m", "score": 0.75}


def test_union_of_decimals_dates_and_flags(spark):
    a = spark.sql("SELECT 1.25BD AS d, DATE '2020-01-02' AS t, true AS f, 1L AS n")
    b = spark.sql("SELECT 2.5D AS d, TIMESTAMP '2020-01-02 03:00:00' AS t, 7 AS f, 1.5BD AS n")
    out = diagonal_union(a, b)
    assert dict(out.dtypes) == {"d": "double", "t": "timestamp", "f": "bigint", "n": "decimal(20,1)"}
    assert sorted(r.d for r in out.collect()) == [1.25, 2.5]


def test_csv_of_quotes_and_line_breaks(spark, tmp_path):
    # An empty text reads as null, like an empty field.
    rows = [(1, 'say "x", y'), (2, "two\nlines"), (3, None)]
    df = spark.createDataFrame(rows, "id long, v string")
    write_csv(df, str(tmp_path / "own"))
    assert sorted(tuple(r) for r in read_csv(spark, str(tmp_path / "own"), df.schema, multi_line=True).collect()) == rows
    (tmp_path / "other.csv").write_text('id,v\n1,"say ""x"", y"\n')
    assert read_csv(spark, str(tmp_path / "other.csv"), df.schema).first().v == 'say "x", y'
