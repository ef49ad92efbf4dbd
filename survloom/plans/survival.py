"""Queries on survival curves, ranking metrics, Cox regression and parametric survival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from survloom.functions.parametric import mean_survival, softmax, survival_at
from survloom.operators.concordance import concordance_counts, stratified_score
from survloom.operators.cox import CoxRegression, breslow_baseline, newton_terms
from survloom.operators.crossfit import concordance_metric
from survloom.operators.curves import at_or_before, survival_arrays, survival_curve
from survloom.operators.encoders import OneHotEncoder
from survloom.operators.folds import assign_folds
from survloom.operators.ranges import fit_ranges
from survloom.operators.ranks import mean_squared_error, roc_auc
from survloom.plans.registry import query, rounded, sql_folds, sql_rank, sql_rounded
from survloom.settings import fresh_path, keep
from survloom.sources.files import write_scores
from survloom.sources.frames import line_frame, survival_frame, training_rows

# --- curves ------------------------------------------------------------------


def _sql_curve(rows: str, part: str) -> str:
    """Curve per ``part`` of ``rows`` (part, t, e): at risk, deaths, km, na."""
    by = f"PARTITION BY {part}"
    return f"""
life AS (SELECT {part}, t, CAST(sum(e) AS BIGINT) AS d,
                CAST(sum(count(*)) OVER ({by} ORDER BY t DESC) AS BIGINT) AS n
         FROM ({rows}) GROUP BY {part}, t),
curve AS (
  SELECT *, CASE WHEN max(CASE WHEN d = n THEN 1 ELSE 0 END) OVER ({by} ORDER BY t) = 1 THEN 0
                 ELSE exp(sum(CASE WHEN d < n THEN ln(1 - d / n::DOUBLE) ELSE 0 END) OVER ({by} ORDER BY t)) END AS km,
         sum(CASE WHEN d = 0 THEN 0 ELSE list_sum(list_transform(range(d), lambda i: 1.0::DOUBLE / (n - i))) END)
           OVER ({by} ORDER BY t) AS na
  FROM life)"""


_LINES = """SELECT l_linestatus AS stratum, l_quantity AS quantity, l_extendedprice AS price,
                   CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END AS e FROM lineitem"""


@query(
    "km_curve",
    f"""SELECT * FROM (WITH {_sql_curve(f"SELECT stratum, price AS t, e FROM ({_LINES})", "stratum")}
        SELECT stratum, t AS efs_time, n AS at_risk, d AS deaths, {sql_rounded('km')} AS km FROM curve)""",
)
def km_curve(spark: SparkSession, folder: str) -> DataFrame:
    curve = survival_curve(line_frame(spark, folder), "efs_time", "efs", keys=["stratum"])
    return curve.select("stratum", "efs_time", "at_risk", "deaths", rounded("km").alias("km"))


@query(
    "nelson_aalen_curve",
    f"""SELECT * FROM (WITH {_sql_curve(f"SELECT stratum, quantity AS t, e FROM ({_LINES})", "stratum")}
        SELECT stratum, t AS quantity, n AS at_risk, d AS deaths, {sql_rounded('na')} AS na,
               {sql_rounded('exp(-na)')} AS bfh FROM curve)""",
)
def nelson_aalen_curve(spark: SparkSession, folder: str) -> DataFrame:
    curve = survival_curve(line_frame(spark, folder), "quantity", "efs", keys=["stratum"])
    return curve.select(
        "stratum", "quantity", "at_risk", "deaths", rounded("na").alias("na"), rounded("bfh").alias("bfh")
    )


@query(
    "asof_curve_lookup",
    f"""SELECT * FROM (WITH {_sql_curve("SELECT stratum, efs_time AS t, efs AS e FROM frame WHERE dataset = 'TRAIN' AND efs_time > 60", "stratum")}
        SELECT f.ID, {sql_rounded('coalesce(km, 1)')} AS km
        FROM frame f ASOF LEFT JOIN curve c ON c.stratum = f.stratum AND c.t <= f.efs_time)""",
)
def asof_curve_lookup(spark: SparkSession, folder: str) -> DataFrame:
    rows = keep(survival_frame(spark, folder).select("ID", "stratum", "efs_time", "efs", "dataset"))
    # Early times are left out of the fit: some rows come before the first step.
    fit_rows = rows.filter(training_rows() & (F.col("efs_time") > 60))
    curve = survival_curve(fit_rows, "efs_time", "efs", keys=["stratum"])
    found = at_or_before(rows, curve, "efs_time", ["km"], keys=["stratum"], default=1.0)
    return found.select("ID", rounded("km").alias("km"))


# --- ranking metrics ---------------------------------------------------------


def _sql_pairs(rows: str, part: str) -> str:
    """Brute-force pair counts per ``part`` of ``rows`` (part, t, e, p)."""
    same = " AND ".join(f"j.{c.strip()} IS NOT DISTINCT FROM i.{c.strip()}" for c in part.split(","))
    mine = ", ".join(f"i.{c.strip()}" for c in part.split(","))
    return f"""
pair_rows AS ({rows}),
counts AS (
  SELECT {mine}, count(*)::DOUBLE AS pairs,
         sum(CASE WHEN i.p > j.p THEN 1 ELSE 0 END)::DOUBLE AS concordant,
         sum(CASE WHEN i.p = j.p THEN 1 ELSE 0 END)::DOUBLE AS tied
  FROM pair_rows i JOIN pair_rows j
    ON {same} AND i.e = 1 AND (i.t < j.t OR (i.t = j.t AND j.e = 0)) GROUP BY {mine})"""


_PAIR_FRAME = "SELECT stratum, efs_time AS t, efs AS e, pred AS p FROM frame"
_NUMBERS = ("pairs", "concordant", "tied")


@query(
    "concordance_counts",
    f"SELECT * FROM (WITH {_sql_pairs(_PAIR_FRAME, 'stratum')} SELECT * FROM counts)",
)
def concordance_of_orders(spark: SparkSession, folder: str) -> DataFrame:
    counts = concordance_counts(
        survival_frame(spark, folder), "efs_time", "efs", "pred", keys=["stratum"]
    )
    return counts.select("stratum", *[F.col(c).cast("double").alias(c) for c in _NUMBERS])


def _sql_pairs_by_levels(rows: str, levels: int = 40) -> str:
    """The counts of :func:`_sql_pairs` for one column ``stratum``, without joining pairs.

    Rows are numbered by time, events before censored rows of the same time. The numbers of
    a comparable pair share their leading bits down to one bit, 0 in the event's number and 1
    in the other's: every pair is counted at the level of that bit, by running counts.
    """
    return f"""
numbered AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY stratum ORDER BY t, 1 - e) - 1 AS BIGINT) AS k FROM ({rows})),
leveled AS (
  SELECT stratum, level, k >> CAST(level + 1 AS INTEGER) AS block, p,
         ((k >> level) & 1) AS later, (1 - ((k >> level) & 1)) * e AS earlier
  FROM numbered CROSS JOIN range({levels}) r(level) WHERE (1::BIGINT << level) <= (SELECT max(k) FROM numbered)),
counted AS (
  SELECT earlier, stratum, sum(later) OVER (PARTITION BY stratum, level, block) AS reach,
         sum(later) OVER (PARTITION BY stratum, level, block ORDER BY p) AS up_to,
         sum(later) OVER (PARTITION BY stratum, level, block, p) AS same
  FROM leveled)
SELECT stratum, sum(earlier * reach)::DOUBLE AS pairs, sum(earlier * (up_to - same))::DOUBLE AS concordant,
       sum(earlier * same)::DOUBLE AS tied FROM counted GROUP BY stratum"""


_PAIR_LINES = """SELECT l_linestatus AS stratum, l_extendedprice AS t, CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END AS e,
                        round(l_extendedprice * (1 - l_discount) / 100, 0) AS p FROM lineitem"""


@query("concordance_counts_lines", f"SELECT * FROM (WITH {_sql_pairs_by_levels(_PAIR_LINES)})")
def concordance_of_lines(spark: SparkSession, folder: str) -> DataFrame:
    """All line items, with the continuous price as time: too many pairs for an SQL pair join."""
    counts = concordance_counts(
        line_frame(spark, folder), "efs_time", "efs", "pred", keys=["stratum"]
    )
    return counts.select("stratum", *[F.col(c).cast("double").alias(c) for c in _NUMBERS])


@query(
    "stratified_c_index",
    f"""SELECT * FROM (WITH {_sql_pairs(_PAIR_FRAME, 'stratum')}
        SELECT {sql_rounded('avg(c) - stddev_pop(c)')} AS score
        FROM (SELECT (concordant + tied / 2) / pairs AS c FROM counts))""",
)
def stratified_c_index(spark: SparkSession, folder: str) -> DataFrame:
    score = stratified_score(survival_frame(spark, folder), "efs_time", "efs", "pred", "stratum")
    return score.select(rounded("score").alias("score"))


_FOLD_SCORES = f"""SELECT * FROM (WITH folded AS ({sql_folds("(SELECT * FROM frame WHERE dataset = 'TRAIN')", 5, 1)}),
  named AS (SELECT stratum, efs_time AS t, efs AS e, pred AS p, 'price' AS name, fold FROM folded
            UNION ALL SELECT stratum, efs_time, efs, balance, 'balance', fold FROM folded),
  {_sql_pairs("SELECT * FROM named UNION ALL SELECT * REPLACE (NULL AS fold) FROM named", "name, fold, stratum")}
  SELECT name, CAST(fold AS DOUBLE) AS fold, {sql_rounded('avg(c) - stddev_pop(c)')} AS score
  FROM (SELECT *, (concordant + tied / 2) / pairs AS c FROM counts) GROUP BY name, fold)"""


def _fold_scores(spark: SparkSession, folder: str) -> DataFrame:
    train = survival_frame(spark, folder).filter(training_rows())
    folded = keep(
        assign_folds(
            train.select("ID", "efs", "efs_time", "stratum", "pred", "balance"), "ID", 5, 1
        )
    )
    named = folded.withColumn("name", F.lit("price")).unionByName(
        folded.withColumn("pred", F.col("balance")).withColumn("name", F.lit("balance"))
    )
    whole = named.withColumn("fold", F.lit(None).cast("int"))
    scores = concordance_metric()(named.unionByName(whole), ["name", "fold"])
    return scores.select(
        "name", F.col("fold").cast("double").alias("fold"), rounded("score").alias("score")
    )


@query("fold_scores", _FOLD_SCORES)
def fold_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _fold_scores(spark, folder)


@query("score_sink", _FOLD_SCORES)
def score_sink(spark: SparkSession, folder: str) -> DataFrame:
    """The fold scores, written as JSON and read back."""
    scores = _fold_scores(spark, folder)
    path = fresh_path(spark, "scores")
    write_scores(scores, path)
    return spark.read.schema(scores.schema).json(path)


@query(
    "roc_auc",
    f"""SELECT status, {sql_rounded('(r - p * (p + 1) / 2) / (p * q)')} AS auc FROM (
          SELECT status, sum(CASE WHEN efs = 1 THEN a END) AS r, sum(efs)::DOUBLE AS p, (count(*) - sum(efs))::DOUBLE AS q
          FROM (SELECT status, efs, {sql_rank('pred', 'status')} AS a FROM frame) GROUP BY status)""",
)
def auc_by_status(spark: SparkSession, folder: str) -> DataFrame:
    rows = keep(survival_frame(spark, folder).select("status", "efs", "pred"))
    auc = roc_auc(rows, "efs", "pred", keys=["status"])
    return auc.select("status", rounded("auc").alias("auc"))


@query(
    "mse",
    f"SELECT stratum, {sql_rounded('avg(power(efs_time / 365 - pred / 100, 2))')} AS mse FROM frame GROUP BY stratum",
)
def mse_by_stratum(spark: SparkSession, folder: str) -> DataFrame:
    rows = survival_frame(spark, folder).select(
        "stratum", (F.col("efs_time") / 365).alias("y"), (F.col("pred") / 100).alias("p")
    )
    return mean_squared_error(rows, "y", "p", keys=["stratum"]).select(
        "stratum", rounded("mse").alias("mse")
    )


# --- Cox regression ----------------------------------------------------------


@query(
    "breslow_baseline",
    f"""SELECT t AS efs_time, {sql_rounded('sum(d / s) OVER (ORDER BY t)')} AS hazard FROM (
          SELECT efs_time AS t, sum(efs) AS d,
                 sum(sum(exp(price / 500000 - balance / 20000))) OVER (ORDER BY efs_time DESC) AS s
          FROM frame GROUP BY efs_time)""",
)
def baseline_hazard(spark: SparkSession, folder: str) -> DataFrame:
    risk = F.col("price") / 500000 - F.col("balance") / 20000
    rows = keep(survival_frame(spark, folder).select("efs_time", "efs", risk.alias("lp")))
    baseline = breslow_baseline(rows, "efs_time", "efs", "lp")
    return baseline.select("efs_time", rounded("hazard").alias("hazard"))


_COX_X = ("price / 200000 - 1", "balance / 5000 - 1")
_COX_BETA = (0.15, -0.1)


def _cox_sql() -> str:
    """Log-likelihood, score and information at fixed coefficients, Efron ties."""
    u, v = _COX_X
    b, c = _COX_BETA
    moments = {"0": "1", "u": "u", "v": "v", "uu": "u * u", "uv": "u * v", "vv": "v * v"}
    risk = ", ".join(
        f"sum(sum(w * {m})) OVER (ORDER BY t DESC) AS s{k}, sum(CASE WHEN e = 1 THEN w * {m} ELSE 0 END) AS d{k}"
        for k, m in moments.items()
    )
    phi = ", ".join(f"s{k} - q / d::DOUBLE * d{k} AS f{k}" for k in moments)
    return f"""SELECT * FROM (WITH x AS (
      SELECT efs_time AS t, efs AS e, {u} AS u, {v} AS v FROM frame),
    w AS (SELECT *, {b} * u + {c} * v AS eta, exp({b} * u + {c} * v) AS w FROM x),
    times AS (SELECT t, sum(e) AS d, {risk} FROM w GROUP BY t),
    phi AS (SELECT {phi} FROM (SELECT *, unnest(range(d::BIGINT)) AS q FROM times WHERE d > 0))
    SELECT {sql_rounded("(SELECT sum(eta) FROM w WHERE e = 1) - sum(ln(f0))", 4)} AS ll,
           {sql_rounded("(SELECT sum(u) FROM w WHERE e = 1) - sum(fu / f0)", 4)} AS u0,
           {sql_rounded("(SELECT sum(v) FROM w WHERE e = 1) - sum(fv / f0)", 4)} AS u1,
           {sql_rounded("sum(fuu / f0 - fu * fu / f0 / f0)", 4)} AS i00,
           {sql_rounded("sum(fuv / f0 - fu * fv / f0 / f0)", 4)} AS i01,
           {sql_rounded("sum(fvv / f0 - fv * fv / f0 / f0)", 4)} AS i11
    FROM phi)"""


@query("cox_newton_terms", _cox_sql())
def cox_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Derivatives of the partial likelihood at fixed coefficients: what each Newton step sums up."""
    patterns = keep(
        survival_frame(spark, folder)
        .select(
            F.col("efs_time").alias("_t"),
            (F.col("price") / 200000 - 1).alias("_x0"),
            (F.col("balance") / 5000 - 1).alias("_x1"),
            F.col("efs").cast("long").alias("_d"),
        )
        .groupBy("_t", "_x0", "_x1")
        .agg(F.count(F.lit(1)).alias("_n"), F.sum("_d").alias("_d"), F.sum("_d").alias("_dw"))
    )
    cuts = fit_ranges(patterns, "_t")
    ll, score, info = newton_terms(patterns, _COX_BETA, cuts)
    row = (float(ll), *map(float, score), *map(float, (info[0, 0], info[0, 1], info[1, 1])))
    names = ["ll", "u0", "u1", "i00", "i01", "i11"]
    return spark.createDataFrame([row], names).select(*[rounded(n, 4).alias(n) for n in names])


_TIMELINE = (0.0, 5.0, 30.5, 100.0, 400.0, 5000.0)


@query(
    "survival_curve_array",
    f"""SELECT * FROM (
      WITH r AS (SELECT ID, stratum, efs, efs_time AS t, pred / 500 AS lp FROM frame),
      times AS (SELECT stratum, t, sum(efs) AS d, sum(exp(lp)) AS w FROM r GROUP BY ALL),
      risk AS (SELECT *, sum(w) OVER (PARTITION BY stratum ORDER BY t DESC) AS s0 FROM times),
      base AS (SELECT stratum, t, sum(d / s0) OVER (PARTITION BY stratum ORDER BY t) AS h FROM risk),
      grid AS (SELECT unnest({list(_TIMELINE)}) AS g),
      looked AS (SELECT stratum, g, coalesce(max(h) FILTER (WHERE t <= g), 0) AS h FROM base, grid GROUP BY ALL)
      SELECT ID, CAST(g AS DOUBLE) AS at_time, {sql_rounded('exp(-h * exp(lp))')} AS survival, {sql_rounded('h * exp(lp)')} AS hazard
      FROM r JOIN looked ON looked.stratum = r.stratum)""",
)
def survival_curve_array(spark: SparkSession, folder: str) -> DataFrame:
    """Every row's survival and hazard over a timeline, from its stratum's baseline."""
    rows = keep(survival_frame(spark, folder).select("ID", "stratum", "efs", "efs_time", (F.col("pred") / 500).alias("lp")))
    baseline = breslow_baseline(rows, "efs_time", "efs", "lp", keys=["stratum"])
    curves = survival_arrays(rows, baseline, "efs_time", "lp", _TIMELINE, keys=["stratum"])
    times = F.array(*[F.lit(t) for t in _TIMELINE])
    points = F.explode(F.arrays_zip(times.alias("at_time"), "survival", "hazard")).alias("p")
    return curves.select("ID", points).select("ID", "p.at_time", rounded("p.survival").alias("survival"), rounded("p.hazard").alias("hazard"))


_COX_STEPS = 8


def _cox_two_sql() -> str:
    """Newton steps from zero for two standardised covariates, four CTEs a step."""
    pairs = ("aa", "ab", "bb")
    steps = ["b0 AS (SELECT 0::DOUBLE AS ba, 0::DOUBLE AS bb)"]
    names = ["0", "a", "b", *pairs]
    factor = {"0": "1", "a": "a", "b": "b", "aa": "a * a", "ab": "a * b", "bb": "b * b"}
    for k in range(_COX_STEPS):
        own = ", ".join(f"sum(w * {factor[n]}) AS s{n}, sum(e * w * {factor[n]}) AS e{n}" for n in names)
        later = ", ".join(f"sum(s{n}) OVER (ORDER BY t DESC) AS r{n}, e{n}" for n in names)
        means = ", ".join(f"(r{n} - q / d * e{n}) / (r0 - q / d * e0) AS m{n}" for n in names[1:])
        info = ", ".join(f"sum(m{p} - m{p[0]} * m{p[1]}) AS i{p}" for p in pairs)
        steps += [
            f"r{k} AS (SELECT t, sum(e) AS d, {own} FROM (SELECT z.*, exp(a * ba + b * bb) AS w FROM z, b{k}) GROUP BY t)",
            f"c{k} AS (SELECT t, d::DOUBLE AS d, {later} FROM r{k})",
            f"f{k} AS (SELECT {means} FROM (SELECT *, unnest(range(d::BIGINT))::DOUBLE AS q FROM c{k} WHERE d > 0))",
            f"""g{k} AS (SELECT (SELECT sum(e * a) FROM z) - sum(ma) AS ua, (SELECT sum(e * b) FROM z) - sum(mb) AS ub, {info} FROM f{k})""",
            f"""b{k + 1} AS (SELECT ba + (ibb * ua - iab * ub) / (iaa * ibb - iab * iab) AS ba,
                  bb + (iaa * ub - iab * ua) / (iaa * ibb - iab * iab) AS bb FROM g{k}, b{k})""",
        ]
    return f"""SELECT feature, {sql_rounded('coefficient', 13)} AS coefficient FROM (
      WITH m AS (SELECT avg(price) AS pm, stddev_pop(price) AS ps, avg(balance) AS qm, stddev_pop(balance) AS qs FROM frame),
      z AS (SELECT efs_time AS t, efs AS e, (price - pm) / ps AS a, (balance - qm) / qs AS b FROM frame, m),
      {", ".join(steps)}
      SELECT 'price' AS feature, ba / ps AS coefficient FROM b{_COX_STEPS}, m UNION ALL
      SELECT 'balance', bb / qs FROM b{_COX_STEPS}, m)"""


@query("cox_fit", _cox_two_sql())
def cox_fit(spark: SparkSession, folder: str) -> DataFrame:
    """Coefficients of a fit on two numeric columns."""
    rows = keep(survival_frame(spark, folder).select("efs_time", "efs", "price", "balance"))
    model = CoxRegression(["price", "balance"], tol=1e-14).fit(rows)
    pairs = [(name, float(beta)) for name, beta in model.coefficients.items()]
    fitted = spark.createDataFrame(pairs, "feature string, coefficient double")
    return fitted.select("feature", rounded("coefficient", 13).alias("coefficient"))




def _cox_fit_sql() -> str:
    """Newton steps from zero for one 0/1 covariate and case weights, one CTE a step."""
    steps = ["b0 AS (SELECT 0::DOUBLE AS beta)"]
    for k in range(_COX_STEPS):
        steps.append(f"""p{k} AS (SELECT v, f1 * exp(beta) / (f0 + f1 * exp(beta)) AS p FROM phi, b{k})""")
        steps.append(
            f"""b{k + 1} AS (SELECT (SELECT beta FROM b{k})
                  + ((SELECT sum(dx) FROM times) - sum(v * p)) / sum(v * p * (1 - p)) AS beta FROM p{k})"""
        )
    return f"""SELECT 'dear' AS feature, {sql_rounded('beta')} AS coefficient FROM (
      WITH x AS (SELECT efs_time AS t, efs AS e, CASE WHEN price > 150000 THEN 1 ELSE 0 END AS x,
                        1 + 0.5 * (ID % 3) AS w FROM frame),
      times AS (SELECT t, sum(e) AS d, sum(w * e) AS dw, sum(w * e * x) AS dx, sum(w * e * (1 - x)) AS d0,
                       sum(sum(w * x)) OVER (ORDER BY t DESC) AS r1,
                       sum(sum(w * (1 - x))) OVER (ORDER BY t DESC) AS r0 FROM x GROUP BY t),
      phi AS (SELECT dw::DOUBLE / d AS v, (r0 - q / d::DOUBLE * d0)::DOUBLE AS f0, (r1 - q / d::DOUBLE * dx)::DOUBLE AS f1
              FROM (SELECT *, unnest(range(d::BIGINT)) AS q FROM times WHERE d > 0)),
      {", ".join(steps)}
      SELECT beta FROM b{_COX_STEPS})"""


@query("cox_fit_weighted", _cox_fit_sql())
def cox_fit_weighted(spark: SparkSession, folder: str) -> DataFrame:
    """Coefficient of a case-weighted fit on one indicator."""
    dear = F.when(F.col("price") > 150000, 1.0).otherwise(0.0)
    rows = survival_frame(spark, folder).select(
        "efs_time", "efs", dear.alias("dear"), (1 + 0.5 * (F.col("ID") % 3)).alias("w")
    )
    model = CoxRegression(["dear"], weightCol="w", tol=1e-14).fit(keep(rows))
    pairs = spark.createDataFrame(list(model.coefficients.items()), "feature string, coefficient double")
    return pairs.select("feature", rounded("coefficient").alias("coefficient"))


@query("cox_survival_target")
def cox_survival_target(spark: SparkSession, folder: str) -> DataFrame:
    """Survival at the own time from a fit on the one-hot stratum."""
    train = keep(
        survival_frame(spark, folder)
        .filter(training_rows())
        .select("ID", "efs", "efs_time", "stratum")
    )
    coded = keep(OneHotEncoder("stratum", "ID").fit(train).transform(train))
    features = [c for c in coded.columns if c.startswith("stratum_")]
    model = CoxRegression(features).fit(coded)
    return model.survival_at_own_time(coded, "t_cox_pred").select("ID", "t_cox_pred")


# --- parametric survival -----------------------------------------------------

_ETA, _K = "balance / 4000", "price / 250000 + 0.5"


def _heads(*weights: float) -> Column:
    return F.array(
        *[
            F.struct(
                (F.col("balance") / 4000 * (i + 1)).alias("eta"),
                (F.col("price") / 250000 + 0.5).alias("k"),
                F.lit(w).alias("w"),
            )
            for i, w in enumerate(weights)
        ]
    )


def _sql_survival(weibull: list[str], loglogistic: list[str], time: str) -> str:
    power = f"power({time}, greatest({_K}, 0))"
    terms = [
        f"{w} * greatest({_ETA} * {i + 1}, 0) * {power}" for i, w in enumerate(weibull)
    ] + [f"{w} * ln(1 + greatest({_ETA} * {i + 1}, 0) * {power})" for i, w in enumerate(loglogistic)]
    return f"exp(-({' + '.join(terms)}))"


def _sql_mean(weibull: list[str], loglogistic: list[str]) -> str:
    at = _sql_survival(weibull, loglogistic, "(i / 99.0::DOUBLE)")
    return f"list_sum(list_transform(range(100), lambda i: {at})) / 100"


def _curve_query(name: str, weibull: list[float], loglogistic: list[float]) -> None:
    w, g = [str(v) for v in weibull], [str(v) for v in loglogistic]

    @query(
        name,
        f"""SELECT ID, {sql_rounded(_sql_survival(w, g, "0.5::DOUBLE"))} AS at_half,
                   {sql_rounded('-(' + _sql_mean(w, g) + ')')} AS pred FROM frame""",
    )
    def curve(spark: SparkSession, folder: str) -> DataFrame:
        none = F.filter(_heads(0.0), lambda h: F.lit(False))
        heads = [_heads(*v) if v else none for v in (weibull, loglogistic)]
        return survival_frame(spark, folder).select(
            "ID",
            rounded(survival_at(*heads, F.lit(0.5))).alias("at_half"),
            rounded(-mean_survival(*heads)).alias("pred"),
        )


_curve_query("weibull_curve", [0.75, 0.25], [])
_curve_query("loglogistic_curve", [], [0.5, 1.0])
_curve_query("mixture_curve", [0.5, 0.125], [0.25])


@query(
    "softmax_heads",
    f"""SELECT ID, {sql_rounded('exp(a) / (exp(a) + exp(b) + 1)')} AS w0, {sql_rounded('exp(b) / (exp(a) + exp(b) + 1)')} AS w1
        FROM (SELECT ID, price / 100000 AS a, balance / 2000 AS b FROM frame)""",
)
def softmax_heads(spark: SparkSession, folder: str) -> DataFrame:
    scores = F.array(F.col("price") / 100000, F.col("balance") / 2000, F.lit(0.0))
    weights = softmax(scores)
    return survival_frame(spark, folder).select(
        "ID", rounded(weights[0]).alias("w0"), rounded(weights[1]).alias("w1")
    )
