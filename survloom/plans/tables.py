"""Queries on sources, joins, aggregates, folds, weights and targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from survloom.functions.expr import clip, mean_of, nonconstant_columns, signed_time, weighted_mean
from survloom.operators.blend import average_by_id, gram_table
from survloom.operators.crossfit import importance_top_k
from survloom.operators.curves import survival_targets
from survloom.operators.folds import assign_folds, fold_table, mark_holdout
from survloom.operators.ranks import normalized_rank
from survloom.operators.stacking import long_predictions, stack_sources
from survloom.operators.targets import (
    event_time_weight,
    normalize_by_max,
    scale_target,
    scale_target_by_event,
)
from survloom.plans.registry import query, rounded, sql_folds, sql_rank, sql_rounded
from survloom.settings import fresh_path, keep
from survloom.sources.files import (
    diagonal_union,
    read_csv,
    sorted_for_output,
    submission,
    tagged_union,
    write_csv,
)
from survloom.sources.frames import survival_frame, training_rows


@query(
    "csv_round_trip",
    """SELECT ID, nullif(priority, '3-MEDIUM') AS priority,
              CASE WHEN efs = 1 THEN efs_time END AS shipped_after, price,
              'say "' || status || '", then' || chr(10) || priority AS note FROM frame""",
)
def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Nulls, and a text with quotes, commas and a line break."""
    df = survival_frame(spark, folder).select(
        "ID",
        F.nullif("priority", F.lit("3-MEDIUM")).alias("priority"),
        F.when(F.col("efs") == 1, F.col("efs_time")).alias("shipped_after"),
        "price",
        F.concat(F.lit('say "'), "status", F.lit('", then\n'), "priority").alias("note"),
    )
    path = fresh_path(spark, "csv")
    write_csv(df, path)
    return read_csv(spark, path, df.schema, multi_line=True)


@query("source_projection", "SELECT ID, pred FROM frame")
def source_projection(spark: SparkSession, folder: str) -> DataFrame:
    df = survival_frame(spark, folder).select("ID", "stratum", "efs", "efs_time", "pred")
    path = fresh_path(spark, "csv")
    write_csv(df, path)
    return read_csv(spark, path, df.schema, ["ID", "pred"])


@query("submission", "SELECT ID, pred AS prediction FROM frame WHERE dataset = 'TEST'")
def submission_file(spark: SparkSession, folder: str) -> DataFrame:
    test = survival_frame(spark, folder).filter(F.col("dataset") == "TEST")
    return submission(test)


_UNION_SQL = """
SELECT ID, dataset, CAST(efs AS DOUBLE) AS efs, efs_time, stratum, CAST(fold AS DOUBLE) AS fold, amount FROM (
  SELECT ID, 'TRAIN' AS dataset, efs, efs_time, stratum, -1 AS fold,
         CAST(customer AS DOUBLE) AS amount FROM frame WHERE dataset = 'TRAIN'
  UNION ALL
  SELECT ID, 'TEST', NULL, NULL, stratum, NULL, price FROM frame WHERE dataset = 'TEST')"""


def _train_and_test(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    frame = survival_frame(spark, folder)
    train = frame.filter(training_rows()).select(
        "ID",
        F.col("efs").cast("double").alias("efs"),
        "efs_time",
        "stratum",
        F.lit(-1.0).alias("fold"),
        F.col("customer").alias("amount"),
    )
    test = frame.filter(F.col("dataset") == "TEST").select(
        "ID", "stratum", F.col("price").alias("amount")
    )
    return train, test


@query("diagonal_union", _UNION_SQL)
def union_of_unlike_tables(spark: SparkSession, folder: str) -> DataFrame:
    train, test = _train_and_test(spark, folder)
    return diagonal_union(
        train.withColumn("dataset", F.lit("TRAIN")), test.withColumn("dataset", F.lit("TEST"))
    )


@query("union_sorted", _UNION_SQL + " ORDER BY dataset DESC, ID")
def union_sorted(spark: SparkSession, folder: str) -> DataFrame:
    train, test = _train_and_test(spark, folder)
    return sorted_for_output(tagged_union({"TRAIN": train, "TEST": test}), "ID")


@query(
    "clip_probability",
    """SELECT ID, CASE WHEN q IS NULL THEN NULL ELSE least(greatest(q, 0.1), 2) END AS p FROM (
         SELECT ID, CASE WHEN status <> 'P' THEN 2 * price / 400000 END AS q FROM frame)""",
)
def clip_probability(spark: SparkSession, folder: str) -> DataFrame:
    doubled = F.when(F.col("status") != "P", 2 * F.col("price") / 400000)
    return survival_frame(spark, folder).select("ID", clip(doubled, 0.1, 2.0).alias("p"))


@query("nonconstant_columns", "SELECT ID, price, status FROM frame")
def varying_columns(spark: SparkSession, folder: str) -> DataFrame:
    df = survival_frame(spark, folder).withColumns(
        {
            "unit": F.lit(1),
            "nothing": F.lit(None).cast("string"),
            "half": F.when(F.col("efs") == 1, F.lit("x")),
            "test_only": F.when(F.col("dataset") == "TEST", F.col("price")).otherwise(0.0),
        }
    )
    candidates = ["unit", "nothing", "half", "test_only", "price", "status"]
    return df.select("ID", *nonconstant_columns(df.filter(training_rows()), candidates))


@query(
    "attach_targets",
    """SELECT f.ID, f.stratum, t.goal FROM frame f LEFT JOIN (
         SELECT ID, efs_time * 2 AS goal FROM frame WHERE dataset = 'TRAIN') t ON t.ID = f.ID""",
)
def attach_targets(spark: SparkSession, folder: str) -> DataFrame:
    frame = survival_frame(spark, folder)
    goals = frame.filter(training_rows()).select("ID", (F.col("efs_time") * 2).alias("goal"))
    return frame.select("ID", "stratum").join(goals, "ID", "left")


@query(
    "seed_average",
    f"""SELECT ID, {sql_rounded('avg(pred)')} AS pred FROM (
          SELECT ID, seed, price / 1000 + seed * balance / 7 AS pred
          FROM frame, (VALUES (1), (2), (3)) s(seed)
          WHERE status <> 'P' OR seed <> 2) GROUP BY ID""",
)
def seed_average(spark: SparkSession, folder: str) -> DataFrame:
    seeds = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))
    long = (
        survival_frame(spark, folder)
        .select("ID", "price", "balance", "status", seeds.alias("seed"))
        .filter((F.col("status") != "P") | (F.col("seed") != 2))
        .select("ID", (F.col("price") / 1000 + F.col("seed") * F.col("balance") / 7).alias("pred"))
    )
    return average_by_id(long, "ID").select("ID", rounded("pred").alias("pred"))


@query(
    "model_mean",
    f"SELECT ID, {sql_rounded('(price + balance + efs_time) / 3')} AS pred FROM frame",
)
def model_mean(spark: SparkSession, folder: str) -> DataFrame:
    mean = mean_of(["price", "balance", "efs_time"])
    return survival_frame(spark, folder).select("ID", rounded(mean).alias("pred"))


@query(
    "weighted_blend",
    f"SELECT ID, {sql_rounded('(0.5 * price + 1.5 * balance + 0.25 * efs_time) / 2.25')} AS pred FROM frame",
)
def weighted_blend(spark: SparkSession, folder: str) -> DataFrame:
    blend = weighted_mean({"price": 0.5, "balance": 1.5, "efs_time": 0.25})
    return survival_frame(spark, folder).select("ID", rounded(blend).alias("pred"))


_GRAM_SQL = "\nUNION ALL\n".join(
    f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", {sql_rounded(f'avg({a} * {b})', 5)} AS product FROM scaled"
    for a, b in [
        ("p", "p"), ("p", "b"), ("p", "y"), ("b", "b"), ("b", "y"), ("y", "y"),
    ]
)


@query(
    "blend_gram",
    f"SELECT * FROM (WITH scaled AS (SELECT price / 100000 AS p, balance / 1000 AS b, efs_time / 365 AS y FROM frame) {_GRAM_SQL})",
)
def blend_gram(spark: SparkSession, folder: str) -> DataFrame:
    scaled = survival_frame(spark, folder).select(
        (F.col("price") / 100000).alias("p"),
        (F.col("balance") / 1000).alias("b"),
        (F.col("efs_time") / 365).alias("y"),
    )
    n = scaled.agg(F.count(F.lit(1)).alias("n")).scalar()
    return gram_table(scaled, ["p", "b"], "y").select(
        "left", "right", rounded(F.col("product") / n, 5).alias("product")
    )


@query(
    "normalized_rank",
    f"""SELECT ID, dataset, r AS rank FROM (
          SELECT ID, dataset, NULL AS r FROM frame WHERE status = 'P' UNION ALL
          SELECT ID, dataset, {sql_rounded('(a - 1) / (max(a) OVER (PARTITION BY dataset) - 1)')} FROM (
            SELECT ID, dataset, {sql_rank('pred', 'dataset')} AS a FROM frame WHERE status <> 'P'))""",
)
def rank_per_dataset(spark: SparkSession, folder: str) -> DataFrame:
    df = keep(
        survival_frame(spark, folder).select(
            "ID", "dataset", F.when(F.col("status") != "P", F.col("pred")).alias("pred")
        )
    )
    ranked = normalized_rank(df, "pred", "rank", keys=["dataset"])
    return ranked.select("ID", "dataset", rounded("rank").alias("rank"))


def _source_tables(frame: DataFrame) -> dict[str, dict[str, DataFrame]]:
    def parts(df: DataFrame) -> dict[str, DataFrame]:
        return {
            "oof": df.filter(training_rows()).select("ID", "pred"),
            "test": df.filter(~training_rows()).select("ID", "pred"),
        }

    return {
        "a": parts(frame.filter(F.col("status") != "P")),
        "b": parts(frame.withColumn("pred", F.col("balance")).filter(F.col("balance") > 0)),
        "c": parts(frame.withColumn("pred", -F.col("efs_time"))),
    }


_STACK_CTE = f"""
src AS (
  SELECT ID, 'a' AS source, dataset, pred FROM frame WHERE status <> 'P' UNION ALL
  SELECT ID, 'b', dataset, balance FROM frame WHERE balance > 0 UNION ALL
  SELECT ID, 'c', dataset, -efs_time FROM frame),
ranked AS (
  SELECT ID, source, pred, {sql_rounded('(a - 1) / (max(a) OVER (PARTITION BY source, dataset) - 1)')} AS r
  FROM (SELECT *, {sql_rank('pred', 'source, dataset')} AS a FROM src)),
stacked AS (
  SELECT a.ID, a.pred AS f_pred_a, b.pred AS f_pred_b, c.pred AS f_pred_c,
         a.r AS f_rank_pred_a, b.r AS f_rank_pred_b, c.r AS f_rank_pred_c
  FROM (SELECT * FROM ranked WHERE source = 'a') a
  LEFT JOIN (SELECT * FROM ranked WHERE source = 'b') b ON b.ID = a.ID
  LEFT JOIN (SELECT * FROM ranked WHERE source = 'c') c ON c.ID = a.ID)"""


_STACKED = ["ID", "dataset", "status", "pred", "balance", "efs_time"]


def _stacked(frame: DataFrame) -> DataFrame:
    wide = stack_sources(long_predictions(_source_tables(frame), "ID"), ["a", "b", "c"], "ID")
    ranks = {f"f_rank_pred_{s}": rounded(f"f_rank_pred_{s}") for s in "abc"}
    return wide.withColumns(ranks)


@query("stack_sources", f"SELECT * FROM (WITH {_STACK_CTE} SELECT * FROM stacked)")
def stack_of_sources(spark: SparkSession, folder: str) -> DataFrame:
    return _stacked(keep(survival_frame(spark, folder).select(*_STACKED)))


@query(
    "stack_features",
    f"""SELECT * FROM (WITH {_STACK_CTE}
        SELECT f.ID, f.stratum, f.price AS f_n_price, s.* EXCLUDE (ID)
        FROM frame f LEFT JOIN stacked s ON s.ID = f.ID WHERE f.dataset = 'TRAIN')""",
)
def stack_features(spark: SparkSession, folder: str) -> DataFrame:
    frame = keep(survival_frame(spark, folder).select(*_STACKED, "stratum", "price"))
    rows = frame.filter(training_rows()).select("ID", "stratum", F.col("price").alias("f_n_price"))
    return rows.join(_stacked(frame), "ID", "left")


@query(
    "importance_top_k",
    f"""SELECT feature, {sql_rounded('avg(importance)')} AS importance FROM (
          SELECT efs_time % 7 AS fold, feature, abs(corr(v, efs_time)) AS importance FROM (
            SELECT efs_time, 'price' AS feature, price AS v FROM frame UNION ALL
            SELECT efs_time, 'balance', balance FROM frame UNION ALL
            SELECT efs_time, 'pred', pred FROM frame UNION ALL
            SELECT efs_time, 'efs', CAST(efs AS DOUBLE) FROM frame) GROUP BY 1, 2)
        GROUP BY feature ORDER BY avg(importance) DESC, feature LIMIT 3""",
)
def most_important(spark: SparkSession, folder: str) -> DataFrame:
    long = (
        survival_frame(spark, folder)
        .select("efs_time", "price", "balance", "pred", F.col("efs").cast("double").alias("efs"))
        .unpivot(["efs_time"], ["price", "balance", "pred", "efs"], "feature", "v")
    )
    importances = long.groupBy((F.col("efs_time") % 7).alias("fold"), "feature").agg(
        F.abs(F.corr("v", "efs_time")).alias("importance")
    )
    return importance_top_k(importances, 3).select("feature", rounded("importance").alias("importance"))


# --- folds -------------------------------------------------------------------


@query("assign_folds", f"SELECT ID, fold FROM ({sql_folds('frame', 7, 3)})")
def folds_of_orders(spark: SparkSession, folder: str) -> DataFrame:
    ids = survival_frame(spark, folder).select("ID")
    return assign_folds(ids, "ID", 7, 3)


@query(
    "assign_folds_seeds",
    f"SELECT ID, seed, fold FROM ({sql_folds('(SELECT ID, seed FROM frame, (VALUES (1), (2), (3)) s(seed))', 10, 'seed', part='seed')})",
)
def folds_of_seeds(spark: SparkSession, folder: str) -> DataFrame:
    return fold_table(survival_frame(spark, folder), "ID", 10, [1, 2, 3])


@query(
    "fold_train_valid_counts",
    f"""SELECT fold, count(*) AS n_valid, (SELECT count(*) FROM frame WHERE dataset = 'TRAIN') - count(*) AS n_train
        FROM ({sql_folds("(SELECT ID FROM frame WHERE dataset = 'TRAIN')", 7, 1)}) GROUP BY fold""",
)
def fold_counts(spark: SparkSession, folder: str) -> DataFrame:
    train = survival_frame(spark, folder).filter(training_rows()).select("ID")
    folded = assign_folds(train, "ID", 7, 1)
    n = train.agg(F.count(F.lit(1)).alias("n")).scalar()
    counts = folded.groupBy("fold").agg(F.count(F.lit(1)).alias("n_valid"))
    return counts.select("fold", "n_valid", (n - F.col("n_valid")).alias("n_train"))


@query(
    "holdout_split",
    """SELECT ID, CASE WHEN dataset = 'TRAIN' AND place < ceil(0.2 * total) THEN 'VALID' ELSE dataset END AS dataset
       FROM (SELECT ID, dataset, row_number() OVER (PARTITION BY dataset ORDER BY md5(concat(ID, ':', 42)), ID) - 1 AS place,
                    count(*) OVER (PARTITION BY dataset) AS total FROM frame)""",
)
def holdout(spark: SparkSession, folder: str) -> DataFrame:
    rows = survival_frame(spark, folder).select("ID", "dataset")
    return mark_holdout(rows, "ID", 0.2, 42)


# --- weights and targets -----------------------------------------------------

_EVENT_N = "CASE WHEN status <> 'P' OR stratum = 'BUILDING' THEN efs END"


def _with_null_events(df: DataFrame) -> DataFrame:
    known = (F.col("status") != "P") | (F.col("stratum") == "BUILDING")
    return df.withColumn("efs", F.when(known, F.col("efs")))


@query(
    "weight_graded",
    f"""SELECT ID, {sql_rounded('''CASE WHEN e = 0 THEN (1 - (efs_time - lo) / (hi - lo)) * 0.49 + 0.01
                                   WHEN e = 1 THEN (efs_time - lo) / (hi - lo) * 0.5 + 1.0 END''')} AS weight
        FROM (SELECT *, min(efs_time) OVER (PARTITION BY e) AS lo, max(efs_time) OVER (PARTITION BY e) AS hi
              FROM (SELECT ID, efs_time, {_EVENT_N} AS e FROM frame))""",
)
def weight_graded(spark: SparkSession, folder: str) -> DataFrame:
    df = _with_null_events(survival_frame(spark, folder))
    return event_time_weight(df, "efs_time", "efs").select("ID", rounded("weight").alias("weight"))


@query("weight_half", "SELECT ID, CASE WHEN efs = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM frame")
def weight_half(spark: SparkSession, folder: str) -> DataFrame:
    weighted = event_time_weight(
        survival_frame(spark, folder), "efs_time", "efs", censored=(0.5, 0.5), observed=(1.0, 1.0)
    )
    return weighted.select("ID", "weight")


@query(
    "signed_time",
    f"SELECT ID, CASE WHEN e = 0 THEN -efs_time WHEN e = 1 THEN efs_time END AS t_cox FROM (SELECT ID, efs_time, {_EVENT_N} AS e FROM frame)",
)
def signed_times(spark: SparkSession, folder: str) -> DataFrame:
    df = _with_null_events(survival_frame(spark, folder))
    return df.select("ID", signed_time(F.col("efs_time"), F.col("efs")).alias("t_cox"))


#: Survival curves of the training rows in SQL: km, na and bfh per time.
SQL_CURVE = """
life AS (
  SELECT efs_time AS t, sum(efs) AS d, sum(count(*)) OVER (ORDER BY efs_time DESC) AS n
  FROM frame WHERE dataset = 'TRAIN' GROUP BY efs_time),
curve AS (
  SELECT t, d, n,
         CASE WHEN max(CASE WHEN d = n THEN 1 ELSE 0 END) OVER (ORDER BY t) = 1 THEN 0
              ELSE exp(sum(CASE WHEN d < n THEN ln(1 - d / n::DOUBLE) ELSE 0 END) OVER (ORDER BY t)) END AS km,
         sum(h) OVER (ORDER BY t) AS na
  FROM (SELECT *, CASE WHEN d = 0 THEN 0 ELSE
               list_sum(list_transform(range(d::BIGINT), lambda i: 1.0::DOUBLE / (n::BIGINT - i))) END AS h FROM life)),
own AS (
  SELECT f.*, coalesce(km, 1) AS t_kmf, coalesce(exp(-na), 1) AS t_bfhf
  FROM frame f ASOF LEFT JOIN curve ON t <= efs_time)"""


def _targets(spark: SparkSession, folder: str) -> DataFrame:
    rows = keep(survival_frame(spark, folder).select("ID", "efs", "efs_time", "price", "dataset"))
    return survival_targets(rows, "efs_time", "efs", fit_mask=training_rows())


@query("km_target", f"SELECT * FROM (WITH {SQL_CURVE} SELECT ID, {sql_rounded('t_kmf')} AS t_kmf FROM own)")
def km_target(spark: SparkSession, folder: str) -> DataFrame:
    return _targets(spark, folder).select("ID", rounded("t_kmf").alias("t_kmf"))


@query("bfh_target", f"SELECT * FROM (WITH {SQL_CURVE} SELECT ID, {sql_rounded('t_bfhf')} AS t_bfhf FROM own)")
def bfh_target(spark: SparkSession, folder: str) -> DataFrame:
    return _targets(spark, folder).select("ID", rounded("t_bfhf").alias("t_bfhf"))


def _with_probability(spark: SparkSession, folder: str) -> DataFrame:
    """Targets with a stand-in event probability in (0, 1)."""
    return keep(_targets(spark, folder).withColumn("prob", (F.col("price") + 1000) / 600000))


_PROB = "(price + 1000) / 600000"


@query(
    "scale_target_pooled",
    f"""SELECT * FROM (WITH {SQL_CURVE}
        SELECT ID, {sql_rounded(f'ln({_PROB}) / ((SELECT min(ln({_PROB})) FROM own) / (0 - (SELECT min(t_bfhf) FROM own))) + t_bfhf')} AS scaled
        FROM own)""",
)
def scale_pooled(spark: SparkSession, folder: str) -> DataFrame:
    scaled = scale_target(_with_probability(spark, folder), "t_bfhf", "prob", out="scaled")
    return scaled.select("ID", rounded("scaled").alias("scaled"))


_SCALED2 = f"""
factors AS (SELECT efs AS e, min(ln(2 * {_PROB})) / (0 - min(t_bfhf)) AS f FROM own GROUP BY 1),
scaled2 AS (SELECT ID, exp(ln(2 * {_PROB}) / f + t_bfhf) AS s FROM own JOIN factors ON e = efs)"""


@query(
    "scale_target_by_event",
    f"SELECT * FROM (WITH {SQL_CURVE}, {_SCALED2} SELECT ID, {sql_rounded('s')} AS scaled FROM scaled2)",
)
def scale_by_event(spark: SparkSession, folder: str) -> DataFrame:
    scaled = scale_target_by_event(
        _with_probability(spark, folder), "t_bfhf", "prob", "efs", out="scaled"
    )
    return scaled.select("ID", rounded("scaled").alias("scaled"))


@query(
    "normalize_target",
    f"""SELECT * FROM (WITH {SQL_CURVE}, {_SCALED2}
        SELECT ID, {sql_rounded('s / (SELECT max(s) FROM scaled2)')} AS scaled FROM scaled2)""",
)
def normalize_target(spark: SparkSession, folder: str) -> DataFrame:
    scaled = keep(
        scale_target_by_event(
            _with_probability(spark, folder), "t_bfhf", "prob", "efs", out="s"
        )
    )
    return normalize_by_max(scaled, "s", out="scaled").select("ID", rounded("scaled").alias("scaled"))
