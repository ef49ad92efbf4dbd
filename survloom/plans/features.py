"""Queries on feature encoders."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from survloom.functions.expr import clamp_codes
from survloom.operators import encoders as enc
from survloom.plans.registry import query, rounded, sql_folds, sql_rounded
from survloom.settings import fresh_path, keep
from survloom.sources.frames import survival_frame, training_rows

#: Rows with nulls: in ``priority`` everywhere, in ``status`` among test rows only.
_HOLES = """
holes AS (SELECT * REPLACE (nullif(priority, '3-MEDIUM') AS priority,
                            CASE WHEN dataset = 'TEST' AND status = 'P' THEN NULL ELSE status END AS status,
                            CASE WHEN status = 'O' AND stratum = 'FURNITURE' THEN NULL ELSE balance END AS balance)
          FROM frame)"""


def _holes(spark: SparkSession, folder: str) -> DataFrame:
    test_p = (F.col("dataset") == "TEST") & (F.col("status") == "P")
    unknown_balance = (F.col("status") == "O") & (F.col("stratum") == "FURNITURE")
    return keep(survival_frame(spark, folder)).withColumns(
        {
            "priority": F.nullif("priority", F.lit("3-MEDIUM")),
            "status": F.when(~test_p, F.col("status")),
            "balance": F.when(~unknown_balance, F.col("balance")),
        }
    )


def _with_holes(sql: str) -> str:
    return f"SELECT * FROM (WITH {_HOLES} {sql})"


def _only_new(df: DataFrame) -> DataFrame:
    return df.select("ID", *[c for c in df.columns if c.startswith("f_")])


@query("encode_raw", "SELECT ID, price AS f_n_price, stratum AS f_n_stratum FROM frame")
def encode_raw(spark: SparkSession, folder: str) -> DataFrame:
    frame = survival_frame(spark, folder)
    return _only_new(enc.raw(["price", "stratum"], "f_n_").transform(frame))


_CODES = ["priority", "status", "stratum", "customer"]


def _codes_sql() -> str:
    tables = ",\n".join(
        f"""code_{c} AS (SELECT {c}::VARCHAR AS v, CAST(row_number() OVER (ORDER BY min(ID)) AS INTEGER) AS code
            FROM fit GROUP BY 1)"""
        for c in _CODES
    )
    values = ", ".join(
        f"coalesce(code_{c}.code, CASE WHEN h.{c} IS NULL THEN -2 ELSE -1 END) AS f_c_{c}"
        for c in _CODES
    )
    joins = " ".join(
        f"LEFT JOIN code_{c} ON code_{c}.v IS NOT DISTINCT FROM h.{c}::VARCHAR" for c in _CODES
    )
    return (
        f"{_HOLES}, fit AS (SELECT * FROM holes WHERE dataset = 'TRAIN' AND stratum <> 'BUILDING'),"
        f"{tables}, coded AS (SELECT h.ID, {values} FROM holes h {joins})"
    )


def _ordinal(spark: SparkSession, folder: str) -> DataFrame:
    rows = _holes(spark, folder)
    fit_rows = rows.filter(training_rows() & (F.col("stratum") != "BUILDING"))
    return _only_new(enc.OrdinalEncoder(_CODES, "ID").fit(fit_rows).transform(rows))


@query("encode_ordinal", f"SELECT * FROM (WITH {_codes_sql()} SELECT * FROM coded)")
def encode_ordinal(spark: SparkSession, folder: str) -> DataFrame:
    return _ordinal(spark, folder)


_CLAMPED = ", ".join(f"greatest(f_c_{c}, 0) AS f_c_{c}" for c in _CODES)


@query("clamp_codes", f"SELECT * FROM (WITH {_codes_sql()} SELECT ID, {_CLAMPED} FROM coded)")
def clamped_codes(spark: SparkSession, folder: str) -> DataFrame:
    return clamp_codes(_ordinal(spark, folder), [f"f_c_{c}" for c in _CODES])


@query(
    "encode_null_flags",
    _with_holes(
        """SELECT ID, CASE WHEN priority IS NULL THEN 1 ELSE 0 END AS f_priority_is_null,
                  CASE WHEN balance IS NULL THEN 1 ELSE 0 END AS f_balance_is_null FROM holes"""
    ),
)
def encode_null_flags(spark: SparkSession, folder: str) -> DataFrame:
    return _only_new(enc.null_flags(["priority", "balance"]).transform(_holes(spark, folder)))


@query(
    "encode_sum_pairs",
    _with_holes(
        f"""SELECT ID, {sql_rounded('price + coalesce(balance, 0)', 4)} AS "f_balance+price_combi",
                   {sql_rounded('price + pred', 4)} AS "f_pred+price_combi",
                   {sql_rounded('coalesce(balance, 0) + pred', 4)} AS "f_balance+pred_combi" FROM holes"""
    ),
)
def encode_sum_pairs(spark: SparkSession, folder: str) -> DataFrame:
    encoder = enc.arithmetic_combinations(["price", "balance", "pred"], prefix="f_")
    out = _only_new(encoder.transform(_holes(spark, folder)))
    return out.select("ID", *[rounded(F.col(f"`{c}`"), 4).alias(c) for c in out.columns[1:]])


@query(
    "encode_product_pairs",
    _with_holes(
        f"""SELECT ID, {sql_rounded('pred * efs_time', 4)} AS "f_pred*efs_time_combi",
                   {sql_rounded('pred * balance', 4)} AS "f_pred*balance_combi" FROM holes"""
    ),
)
def encode_product_pairs(spark: SparkSession, folder: str) -> DataFrame:
    encoder = enc.arithmetic_combinations(
        ["efs_time", "balance"], operator="*", include=["pred"], prefix="f_"
    )
    out = _only_new(encoder.transform(_holes(spark, folder)))
    return out.select("ID", *[rounded(F.col(f"`{c}`"), 4).alias(c) for c in out.columns[1:]])


@query(
    "encode_string_pairs",
    _with_holes(
        """SELECT ID, priority || '|' || status AS "f_priority|status_concat",
                  priority || '|' || stratum AS "f_priority|stratum_concat",
                  status || '|' || stratum AS "f_status|stratum_concat" FROM holes"""
    ),
)
def encode_string_pairs(spark: SparkSession, folder: str) -> DataFrame:
    encoder = enc.string_combinations(
        ["priority", "status", "stratum"], separator="|", prefix="f_"
    )
    return _only_new(encoder.transform(_holes(spark, folder)))


@query(
    "encode_category_cross",
    _with_holes(
        """SELECT ID, coalesce(priority, 'NULL') || coalesce(status, 'NULL') AS "priority+status",
                  coalesce(priority, 'NULL') || coalesce(customer::VARCHAR, 'NULL') AS "priority+customer",
                  coalesce(status, 'NULL') || coalesce(customer::VARCHAR, 'NULL') AS "status+customer" FROM holes"""
    ),
)
def encode_category_cross(spark: SparkSession, folder: str) -> DataFrame:
    crossed = enc.category_crosses(["priority", "status", "customer"]).transform(
        _holes(spark, folder)
    )
    return crossed.select("ID", *[F.col(f"`{c}`") for c in crossed.columns if "+" in c])


_GROUP = "stratum_x_priority"
_STATS = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max", "median": "median"}


def _group_sql(columns: dict[str, str]) -> str:
    """Statistics of training prices by (stratum, priority), joined to every row."""
    stats = ", ".join(f"{fn}(price) AS {a}" for a, fn in _STATS.items())
    shown = ", ".join(f'{sql_rounded(e, 4)} AS "{n}"' for n, e in columns.items())
    return _with_holes(
        f"""SELECT ID, {shown} FROM holes h LEFT JOIN (
              SELECT stratum AS s, priority AS p, {stats} FROM holes WHERE dataset = 'TRAIN' GROUP BY 1, 2) g
            ON s = stratum AND p = priority"""
    )


def _grouped(spark: SparkSession, folder: str, deviations: list[dict[str, str]]) -> DataFrame:
    rows = _holes(spark, folder)
    encoder = enc.GroupStatisticsEncoder(
        ["stratum", "priority"],
        [
            F.avg("price").alias("mean"),
            F.stddev_samp("price").alias("std"),
            F.min("price").alias("min"),
            F.max("price").alias("max"),
        ],
        quantile_columns={"median": ("price", 0.5)}
        if not deviations or "median" in deviations[0]
        else None,
        deviations=deviations,
    )
    coded = _only_new(encoder.fit(rows.filter(training_rows())).transform(rows))
    shown = [c for c in coded.columns[1:] if not deviations or deviations[0]["method"] in c]
    return coded.select("ID", *[rounded(F.col(f"`{c}`"), 4).alias(c) for c in shown])


@query("encode_aggregate", _group_sql({f"f_{a}_grpby_{_GROUP}": a for a in _STATS}))
def encode_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    return _grouped(spark, folder, [])


def _deviation_query(key: str, spec: dict[str, str], shown: str, formula: str) -> None:
    name = f"f_{spec['method']}_{shown}_grpby_{_GROUP}"

    @query(key, _group_sql({name: formula}))
    def deviation(spark: SparkSession, folder: str) -> DataFrame:
        return _grouped(spark, folder, [spec])


for _key, _spec, _shown, _formula in [
    ("zscore", {"method": "z-score", "val": "price", "mean": "mean", "std": "std"}, "price",
     "(price - mean) / std"),
    ("mad", {"method": "med-abs-dev", "val": "price", "median": "median"}, "price",
     "abs(price - median)"),
    ("mean_diff", {"method": "mean-diff", "val": "price", "mean": "mean"}, "price", "price - mean"),
    ("median_diff", {"method": "median-diff", "val": "price", "median": "median"}, "price",
     "price - median"),
    ("mean_ratio", {"method": "mean-ratio", "val": "price", "mean": "mean"}, "price", "price / mean"),
    ("range", {"method": "range", "min": "min", "max": "max"}, "max_min", "max - min"),
]:
    _deviation_query(f"encode_group_{_key}", _spec, _shown, _formula)


_TE = ["priority", "customer"]


def _target_sql() -> str:
    parts, joins = [], []
    for c in _TE:
        parts.append(
            f"""{sql_rounded(f'''CASE WHEN f.{c} IS NULL THEN -2.0::DOUBLE
                  WHEN t_{c}.n > o_{c}.n THEN (t_{c}.s - o_{c}.s) / (t_{c}.n - o_{c}.n)::DOUBLE ELSE -1.0::DOUBLE END''')}
                AS f_te_by_efs_{c}"""
        )
        joins.append(
            f"""LEFT JOIN (SELECT {c} AS v, sum(efs) AS s, count(*) AS n FROM folded GROUP BY 1) t_{c} ON t_{c}.v = f.{c}
                LEFT JOIN (SELECT {c} AS v, fold AS w, sum(efs) AS s, count(*) AS n FROM folded GROUP BY 1, 2) o_{c}
                  ON o_{c}.v = f.{c} AND o_{c}.w = f.fold"""
        )
    folds = sql_folds("(SELECT * FROM holes WHERE dataset = 'TRAIN')", 5, 42)
    return f"SELECT * FROM (WITH {_HOLES}, folded AS ({folds}) SELECT ID, {', '.join(parts)} FROM folded f {' '.join(joins)})"


@query("encode_target_oof", _target_sql())
def encode_target_oof(spark: SparkSession, folder: str) -> DataFrame:
    train = _holes(spark, folder).filter(training_rows())
    coded = enc.TargetMeanEncoder(_TE, "efs", "ID").fit_transform(train)
    return coded.select("ID", *[rounded(f"f_te_by_efs_{c}").alias(f"f_te_by_efs_{c}") for c in _TE])


@query(
    "encode_target_new_rows",
    _with_holes(
        f"""SELECT ID, {sql_rounded('''CASE WHEN customer IS NULL THEN -2.0::DOUBLE ELSE coalesce((s + 10 * (SELECT avg(efs) FROM holes WHERE dataset = 'TRAIN')) / (n + 10), -1) END''')} AS f_te_by_efs_customer
            FROM holes LEFT JOIN (SELECT customer AS v, sum(efs) AS s, count(*) AS n FROM holes
                                  WHERE dataset = 'TRAIN' GROUP BY 1) ON v = customer
            WHERE dataset = 'TEST'"""
    ),
)
def encode_target_new_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = _holes(spark, folder)
    model = enc.TargetMeanEncoder(["customer"], "efs", "ID", smoothing=10.0).fit(
        rows.filter(training_rows())
    )
    coded = model.transform(rows.filter(~training_rows()))
    return coded.select("ID", rounded("f_te_by_efs_customer").alias("f_te_by_efs_customer"))


@query(
    "encode_one_hot",
    f"""SELECT * FROM (WITH {_HOLES}, codes AS (
          SELECT priority AS v, row_number() OVER (ORDER BY min(ID)) AS code FROM holes WHERE dataset = 'TRAIN' GROUP BY 1)
        SELECT ID, {", ".join(f"CAST(coalesce(code = {k}, false) AS INTEGER) AS priority_{k}" for k in range(1, 5))}
        FROM holes LEFT JOIN codes ON v IS NOT DISTINCT FROM priority)""",
)
def encode_one_hot(spark: SparkSession, folder: str) -> DataFrame:
    rows = _holes(spark, folder)
    coded = enc.OneHotEncoder("priority", "ID").fit(rows.filter(training_rows())).transform(rows)
    return coded.select("ID", *[c for c in coded.columns if c.startswith("priority_")])


@query(
    "impute_mean",
    _with_holes(
        f"""SELECT ID, {sql_rounded("coalesce(balance, (SELECT avg(balance) FROM holes WHERE dataset = 'TRAIN'))")} AS balance
            FROM holes"""
    ),
)
def impute_mean(spark: SparkSession, folder: str) -> DataFrame:
    rows = _holes(spark, folder)
    filled = enc.MeanImputer(["balance"]).fit(rows.filter(training_rows())).transform(rows)
    return filled.select("ID", rounded("balance").alias("balance"))


def _scaling_query(method: str, center: str, scale: str) -> None:
    def scaled_sql(c: str) -> str:
        train = "holes WHERE dataset = 'TRAIN'"
        return sql_rounded(
            f"({c} - (SELECT {center.format(c)} FROM {train})) / (SELECT {scale.format(c)} FROM {train})"
        )

    columns = ["price", "balance", "efs_time"]
    shown = ", ".join(f"{scaled_sql(c)} AS f_{c}" for c in columns)

    @query(f"scale_{method}", _with_holes(f"SELECT ID, {shown} FROM holes"))
    def scaled(spark: SparkSession, folder: str) -> DataFrame:
        rows = _holes(spark, folder)
        encoder = enc.ScalingEncoder(columns, method, prefix="f_")
        out = encoder.fit(rows.filter(training_rows())).transform(rows)
        return out.select("ID", *[rounded(f"f_{c}").alias(f"f_{c}") for c in columns])


_scaling_query("standard", "avg({0})", "stddev_pop({0})")
_scaling_query("minmax", "min({0})", "max({0}) - min({0})")
_scaling_query("robust", "median({0})", "quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25)")

_PROBS = [i / 52 for i in range(53)]


def _bins_sql() -> str:
    edges, shown = [], []
    for c in ("price", "balance"):
        edges.append(
            f"""(SELECT list_sort(list_distinct(quantile_cont({c}, {_PROBS}))) FROM holes WHERE dataset = 'TRAIN') AS e_{c}"""
        )
        index = f"len(list_filter(e_{c}[2:len(e_{c}) - 1], lambda e: e <= {c}))"
        known = f"CASE WHEN {c} IS NOT NULL THEN {index} END"
        shown.append(f"CAST({known} AS DOUBLE) AS {c}_bin")
        low, high = f"e_{c}[{known} + 1]", f"e_{c}[{known} + 2]"
        shown.append(f"{sql_rounded(f'({c} - {low}) / ({high} - {low})')} AS {c}_frac")
    return _with_holes(
        f"SELECT ID, {', '.join(shown)} FROM (SELECT *, {', '.join(edges)} FROM holes)"
    )


@query("quantile_bins", _bins_sql())
def quantile_bins(spark: SparkSession, folder: str) -> DataFrame:
    rows = _holes(spark, folder)
    binned = enc.QuantileBinsEncoder(["price", "balance"]).fit(
        rows.filter(training_rows())
    ).transform(rows)
    return binned.select(
        "ID",
        F.col("price_bin").cast("double").alias("price_bin"),
        rounded("price_frac").alias("price_frac"),
        F.col("balance_bin").cast("double").alias("balance_bin"),
        rounded("balance_frac").alias("balance_frac"),
    )


@query(
    "pipeline_reload",
    f"""SELECT * FROM (WITH {_codes_sql()},
          train AS (SELECT * FROM fit),
          means AS (SELECT stratum AS s, avg(price) AS mean FROM train GROUP BY 1)
        SELECT h.ID, CASE WHEN h.priority IS NULL THEN 1 ELSE 0 END AS f_priority_is_null,
               {sql_rounded('h.price + coalesce(h.balance, 0)', 4)} AS f_total,
               f_c_priority, f_c_status,
               {sql_rounded('coalesce(h.balance, (SELECT avg(balance) FROM train))', 4)} AS f_n_balance,
               {sql_rounded('h.price - mean', 4)} AS f_difference,
               {sql_rounded('(h.price - (SELECT avg(price) FROM train)) / (SELECT stddev_pop(price) FROM train)')} AS f_s_price
        FROM holes h JOIN coded c ON c.ID = h.ID LEFT JOIN means ON s = h.stratum)""",
)
def pipeline_reload(spark: SparkSession, folder: str) -> DataFrame:
    """A pipeline of encoders saved and loaded before fitting, and its model again after."""
    rows = _holes(spark, folder)
    stages = [
        enc.NullFlags(["priority"]),
        enc.ArithmeticCombinations(["price", "balance"], prefix="f_"),
        enc.OrdinalEncoder(["priority", "status"], "ID"),
        enc.MeanImputer(["balance"], prefix="f_n_"),
        enc.GroupStatisticsEncoder(
            "stratum",
            ["avg(price) AS mean"],
            deviations=[{"method": "mean-diff", "val": "price", "mean": "mean"}],
        ),
        enc.ScalingEncoder(["price"], prefix="f_s_"),
    ]
    path = fresh_path(spark, "pipeline")
    Pipeline(stages=stages).write().save(f"{path}/unfitted")
    fit_rows = rows.filter(training_rows() & (F.col("stratum") != "BUILDING"))
    Pipeline.load(f"{path}/unfitted").fit(fit_rows).write().save(f"{path}/fitted")
    coded = PipelineModel.load(f"{path}/fitted").transform(rows)
    return coded.select(
        "ID",
        "f_priority_is_null",
        rounded(F.col("`f_balance+price_combi`"), 4).alias("f_total"),
        "f_c_priority",
        "f_c_status",
        rounded("f_n_balance", 4).alias("f_n_balance"),
        rounded("f_mean-diff_price_grpby_stratum", 4).alias("f_difference"),
        rounded("f_s_price").alias("f_s_price"),
    )
