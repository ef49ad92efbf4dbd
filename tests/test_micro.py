"""The hand-computed fixture."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from survloom.functions.expr import signed_time, unsigned_time
from survloom.operators.concordance import concordance_counts, stratified_score
from survloom.operators.curves import survival_curve, survival_targets
from survloom.operators.folds import assign_folds
from survloom.operators.ranks import normalized_rank, roc_auc
from survloom.operators.targets import event_time_weight


def by_id(df, column):
    return [r[column] for r in df.orderBy("id").collect()]


def test_curve(micro):
    rows = survival_curve(micro, "time", "event").orderBy("time").collect()
    assert [(r.at_risk, r.deaths) for r in rows] == [(6, 1), (5, 1), (3, 1), (2, 0), (1, 0)]
    assert [r.km for r in rows] == pytest.approx([0.833333, 0.666667, 0.444444, 0.444444, 0.444444], abs=1e-6)
    assert [r.bfh for r in rows] == pytest.approx([0.846482, 0.693041, 0.496585, 0.496585, 0.496585], abs=1e-6)


def test_targets_at_own_time(micro):
    got = survival_targets(micro, "time", "event", fit_mask=F.lit(True))
    assert by_id(got, "t_kmf") == pytest.approx(
        [0.833333, 0.666667, 0.666667, 0.444444, 0.444444, 0.444444], abs=1e-6
    )


def test_targets_before_first_step_and_without_time(spark, micro):
    more = micro.unionByName(
        spark.createDataFrame([(7, 0.5, 1, 0.0), (8, None, 1, 0.0)], micro.schema)
    )
    got = survival_targets(more, "time", "event", fit_mask=F.col("id") <= 6)
    assert by_id(got, "t_kmf")[6:] == [1.0, None]


def test_concordance(micro):
    row = concordance_counts(micro, "time", "event", "pred").first()
    assert (int(row.pairs), int(row.concordant), int(row.tied)) == (11, 9, 1)
    assert row.c_index == pytest.approx(0.863636, abs=1e-6)


def test_concordance_on_cells_agrees(micro):
    row = concordance_counts(micro, "time", "event", "pred", group_rows=2).first()
    assert (int(row.pairs), int(row.concordant), int(row.tied)) == (11, 9, 1)


def test_opposite_risk_adds_to_one(micro):
    a = concordance_counts(micro, "time", "event", "pred").first().c_index
    b = concordance_counts(micro.withColumn("pred", -F.col("pred")), "time", "event", "pred").first().c_index
    assert a + b == pytest.approx(1.0)


def test_equal_risk_is_one_half(micro):
    got = concordance_counts(micro.withColumn("pred", F.lit(1.0)), "time", "event", "pred").first()
    assert got.c_index == 0.5


def test_all_censored(micro):
    none = micro.withColumn("event", F.lit(0))
    row = concordance_counts(none, "time", "event", "pred").first()
    assert int(row.pairs) == 0 and row.c_index is None
    curve = survival_curve(none, "time", "event").collect()
    assert {r.km for r in curve} == {1.0}


def test_score_is_null_when_a_stratum_has_no_pair(micro):
    split = micro.withColumn("g", F.when(F.col("id") == 6, "b").otherwise("a"))
    assert stratified_score(split, "time", "event", "pred", "g").first().score is None


def test_score_of_one_stratum_is_its_c_index(micro):
    one = micro.withColumn("g", F.lit(None).cast("string"))
    assert stratified_score(one, "time", "event", "pred", "g").first().score == pytest.approx(9.5 / 11)


def test_incomplete_rows_make_the_score_null(spark, micro):
    unknown = [(7, 1.5, 1, None), (8, 1.5, 1, float("nan")), (9, None, 1, 0.1), (10, 1.5, None, 0.1)]
    more = micro.unionByName(spark.createDataFrame(unknown, micro.schema))
    row = concordance_counts(more, "time", "event", "pred").first()
    assert int(row.pairs) == 11 and row.incomplete == 4
    scored = stratified_score(more.withColumn("g", F.lit("a")), "time", "event", "pred", "g")
    assert scored.first().score is None


def test_two_deaths_at_one_time_are_no_pair(spark):
    df = spark.createDataFrame([(1.0, 1, 0.1), (1.0, 1, 0.9)], "time double, event int, pred double")
    assert int(concordance_counts(df, "time", "event", "pred").first().pairs) == 0
    row = survival_curve(df, "time", "event").first()
    assert row.km == 0.0 and row.na == pytest.approx(1 / 2 + 1)


def test_last_row_an_event(micro):
    ends = micro.withColumn("event", F.when(F.col("id") == 6, 1).otherwise(F.col("event")))
    rows = survival_curve(ends, "time", "event").orderBy("time").collect()
    assert rows[-1].km == 0.0 and rows[-2].km > 0


def test_normalized_rank(micro):
    assert by_id(normalized_rank(micro, "pred", "r"), "r") == pytest.approx([1, 0.5, 0.5, 0.8, 0.2, 0])


def test_weights(micro):
    graded = event_time_weight(micro, "time", "event")
    assert by_id(graded, "weight") == pytest.approx([1.0, 1.25, 0.5, 1.5, 0.173333, 0.01], abs=1e-6)
    half = event_time_weight(micro, "time", "event", censored=(0.5, 0.5), observed=(1, 1))
    assert by_id(half, "weight") == [1, 1, 0.5, 1, 0.5, 0.5]


def test_constant_weight_without_time_range(spark):
    df = spark.createDataFrame([(1, 2.0, 0), (2, 2.0, 1), (3, 2.0, None)], "id long, time double, event int")
    half = event_time_weight(df, "time", "event", censored=(0.5, 0.5), observed=(1, 1))
    assert by_id(half, "weight") == [0.5, 1.0, None]


def test_signed_time(micro):
    signed = micro.withColumn("s", signed_time(F.col("time"), F.col("event")))
    assert by_id(signed, "s") == [1, 2, -2, 3, -4, -5]
    time, event = unsigned_time(F.col("s"))
    assert by_id(signed.withColumn("t", time), "t") == by_id(micro, "time")
    assert by_id(signed.withColumn("e", event), "e") == by_id(micro, "event")


def test_auc(micro):
    assert roc_auc(micro, "event", "pred").first().auc == pytest.approx(0.944444, abs=1e-6)


def test_fold_sizes(micro):
    sizes = assign_folds(micro, "id", 4, 1).groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in sizes] == [2, 2, 1, 1]


def test_more_folds_than_rows(micro):
    folds = by_id(assign_folds(micro, "id", 10, 1), "fold")
    assert sorted(folds) == list(range(6))


def test_folds_do_not_depend_on_partitioning(micro):
    once = by_id(assign_folds(micro, "id", 3, 5), "fold")
    again = by_id(assign_folds(micro.orderBy(F.desc("id")).repartition(5), "id", 3, 5), "fold")
    assert once == again
