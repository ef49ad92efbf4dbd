"""Cox proportional hazards: fit by Newton steps, each one Spark job."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import Estimator
from pyspark.ml.param import TypeConverters
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from survloom.operators import prefix
from survloom.operators.curves import at_or_before
from survloom.operators.persistence import Configured, TableModel, setting
from survloom.operators.prefix import running_sums
from survloom.operators.ranges import Ranges, fit_ranges
from survloom.settings import keep, staged

#: Last steps of a time's tied deaths that are added one by one; see tie_sums.
_ONE_BY_ONE = 64
#: Numbers that one task holds as moments at once: rows times moments per row.
_HELD = 1 << 22

# The functions below run in Python workers: ship them with the task, so that the
# executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def tie_sums(d: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Efron's sums over the steps q = 0 .. d - 1 of each time, of ln y, 1 / y and 1 / y^2.

    With y = 1 - r q / d. The last (smallest) y are added one by one, all before them by
    the Euler-Maclaurin formula, whose error is there below the rounding of the sums: the
    work for a time does not grow with its deaths.
    """
    many = np.maximum(0.0, d - _ONE_BY_ONE)
    q = many[:, None] + np.arange(min(_ONE_BY_ONE, int(d.max(initial=1))))
    there = q < d[:, None]
    y = np.where(there, 1 - r[:, None] * q / d[:, None], 1.0)
    sums = [np.log(y).sum(axis=1), (there / y).sum(axis=1), (there / y**2).sum(axis=1)]
    at = np.flatnonzero(many)
    if len(at):
        n, step = many[at], np.maximum(r[at] / d[at], 1e-300)
        z = step * (n - 1)
        y = 1 - z
        # y ln y + z loses its digits where z is small: there it is a power series.
        small = np.where(z < 0.1, z, 0.0)
        series = sum(small**k / (k * (k + 1)) for k in range(1, 18)) * (n - 1)
        integral = np.where(z < 0.1, series, (y * np.log(y) + z) / step)
        sums[0][at] += -integral + np.log(y) / 2 - step * (1 / y - 1) / 12 + step**3 * (y**-3 - 1) / 360
        sums[1][at] += -np.log1p(-step * (n - 1)) / step + (1 / y + 1) / 2 + step * (y**-2 - 1) / 12 - step**3 * (y**-4 - 1) / 120
        sums[2][at] += (n - 1) / y + (y**-2 + 1) / 2 + step * (y**-3 - 1) / 6 - step**3 * (y**-5 - 1) / 30
    return sums[0], sums[1], sums[2]


def moments(x: np.ndarray) -> np.ndarray:
    """One, the covariates and their products (upper triangle) of each row, packed side by side."""
    i, j = np.triu_indices(x.shape[1])
    return np.concatenate((np.ones((len(x), 1)), x, x[:, i] * x[:, j]), axis=1)


def step_terms(d: np.ndarray, dw: np.ndarray, risk: np.ndarray, dead: np.ndarray) -> np.ndarray:
    """What the risk sets of some times add to log-likelihood, score and information, packed.

    ``d`` deaths of weight ``dw`` at each time; ``risk`` the weighted moments of those at
    risk, ``dead`` those of the deaths. The deaths' own covariates are not in it.
    """
    p = int((math.isqrt(8 * risk.shape[1] + 1) - 3) // 2)
    i, j = np.triu_indices(p)
    share = np.minimum(1.0, dead[:, 0] / risk[:, 0])
    ln, g, h = tie_sums(d, share)
    a = risk[:, 1:] / risk[:, :1]
    b = np.divide(dead[:, 1:], dead[:, :1], out=np.zeros_like(a), where=dead[:, :1] > 0)
    (a1, a2), (b1, b2) = ((v[:, :p], v[:, p:]) for v in (a, b))
    per, g, h, n = ((v * 1.0)[:, None] for v in (dw / d, g, h, d))
    score = -per * (a1 * g - b1 * (g - n))
    information = per * (
        a2 * g - b2 * (g - n) - a1[:, i] * a1[:, j] * h
        + (a1[:, i] * b1[:, j] + b1[:, i] * a1[:, j]) * (h - g) - b1[:, i] * b1[:, j] * (h - 2 * g + n)
    )
    level = -(dw / d) * (d * np.log(risk[:, 0]) + ln)
    return np.concatenate(([level.sum()], score.sum(axis=0), information.sum(axis=0)))


def linear_predictor(coefficients: dict[str, float], centers: dict[str, float]) -> Column:
    """Sum of coefficient * (column - center)."""
    total = F.lit(0.0)
    for name, beta in coefficients.items():
        total = total + F.lit(float(beta)) * (F.col(name) - F.lit(float(centers.get(name, 0.0))))
    return total


def _columns(rows: pa.Table | pa.RecordBatch, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    x = np.stack([rows.column(f"_x{i}").to_numpy() for i in range(p)], axis=1).astype(float)
    return x, *(rows.column(c).to_numpy().astype(float) for c in ("_n", "_d", "_dw"))


def _range_moments(ranged: DataFrame, beta: np.ndarray) -> DataFrame:
    """(_b, _k, v): packed moments of each range, weighted for the risk and, after them, for the deaths.

    The last number is the count of deaths, before it is their weight. Sums are taken in
    the task first.
    """
    p = len(beta)
    arrow = pa.schema([("_b", pa.int32()), ("_k", pa.int32()), ("v", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def all_held() -> pa.RecordBatch:
            width = len(next(iter(held.values()))) if held else 0
            values = np.concatenate([np.zeros(0), *held.values()])
            ranges = np.repeat(np.array(list(held), np.int32), width)
            numbers = np.tile(np.arange(width, dtype=np.int32), len(held))
            return pa.RecordBatch.from_arrays([pa.array(ranges), pa.array(numbers), pa.array(values)], schema=arrow)

        for batch in batches:
            most = max(1, _HELD // ((p + 1) * (p + 2)))
            for piece in (batch.slice(at, most) for at in range(0, batch.num_rows, most)):
                x, n, d, dw = _columns(piece, p)
                w, each = np.exp(x @ beta), moments(x)
                own = np.concatenate(((n * w)[:, None] * each, (dw * w)[:, None] * each, dw[:, None], d[:, None]), axis=1)
                b = piece.column("_b").to_numpy()
                order = np.argsort(b, kind="stable")
                starts = np.flatnonzero(np.r_[True, np.diff(b[order]) != 0])
                for r, v in zip(b[order][starts].tolist(), np.add.reduceat(own[order], starts), strict=True):
                    held[r] = held[r] + v if r in held else v
                if len(held) * own.shape[1] > _HELD:
                    yield all_held()
                    held.clear()
        yield all_held()

    partial = ranged.mapInArrow(run, "_b int, _k int, v double")
    return partial.groupBy("_b", "_k").agg(F.sum("v").alias("v"))


def newton_terms(
    patterns: DataFrame, beta: Sequence[float], cuts: Sequence[float] | Ranges
) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood, score and information of the partial likelihood, ties by Efron.

    ``patterns`` has ``_t``, standardised ``_x0.._xp``, and per pattern the weight of its
    rows ``_n``, the number of its deaths ``_d`` and their weight ``_dw``. The state along
    the times is one packed array of moments: summed per range of times, passed from the
    latest range on, and run through the times inside each range. A range that holds a
    single heavy time needs its sums only. 1 + p + p (p + 1) / 2 numbers reach the driver.
    """
    beta = np.asarray(beta, float)
    p = len(beta)
    width = 1 + p + p * (p + 1) // 2
    ranged = prefix.with_range(patterns, "_t", cuts, "_b")
    sums = keep(_range_moments(ranged, beta))
    top = cuts.top if isinstance(cuts, Ranges) else len(cuts)
    risk = sums.filter(F.col("_k") < width).withColumnRenamed("v", "later")
    later = prefix.over_levels(risk, ["later"], top, "DESC", "sum({})", "coalesce({x}, 0) + coalesce({y}, 0)")
    single = (F.col("_b") % 2 == 1) if isinstance(cuts, Ranges) and cuts.levels else F.lit(False)
    packed = lambda df, v: df.groupBy("_b").agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", v))), lambda s: s[v]).alias(f"_{v}"))
    heads = packed(later.withColumn("later", F.coalesce("later", F.lit(0.0))), "later")
    heads = heads.join(packed(sums.filter(single), "v"), "_b", "left")
    told = ranged.filter(~single).unionByName(heads, allowMissingColumns=True)

    def run(rows: pa.Table) -> pa.Table:
        is_head = np.array(rows.column("_later").is_valid())
        head, rows = rows.filter(pa.array(is_head)), rows.filter(pa.array(~is_head))
        state = np.array(head.column("_later")[0].as_py())
        total = np.zeros(width)
        own = head.column("_v")[0].as_py()
        if own is not None:
            risk, dead, (dw, d) = np.array(own[:width]) + state, np.array(own[width:-2]), own[-2:]
            if d > 0:
                total += step_terms(np.array([d]), np.array([dw]), risk[None], dead[None])
        if rows.num_rows:
            x, n, d, dw = _columns(rows, p)
            t = rows.column("_t").to_numpy()
            order = np.argsort(-t, kind="stable")
            x, n, d, dw, t = x[order], n[order], d[order], dw[order], t[order]
            starts = np.flatnonzero(np.r_[True, np.diff(t) != 0])
            ends = np.r_[starts[1:], len(t)]
            w, most, at = np.exp(x @ beta), max(1, _HELD // (2 * width)), 0
            while at < len(starts):
                # Whole times, as many as fit; a time of many patterns comes alone.
                to = max(at + 1, int(np.searchsorted(ends, starts[at] + most, "right")))
                part = slice(starts[at], ends[to - 1])
                each, begins = moments(x[part]), starts[at:to] - starts[at]
                risk = state + np.cumsum(np.add.reduceat((n[part] * w[part])[:, None] * each, begins), axis=0)
                dead = np.add.reduceat((dw[part] * w[part])[:, None] * each, begins)
                deaths, weight = (np.add.reduceat(v[part], begins) for v in (d, dw))
                state, some = risk[-1], deaths > 0
                if some.any():
                    total += step_terms(deaths[some], weight[some], risk[some], dead[some])
                at = to
        return pa.table({"_k": np.arange(width, dtype=np.int32), "v": total})

    found = told.groupBy("_b").applyInArrow(run, "_k int, v double").groupBy("_k").agg(F.sum("v").alias("v"))
    terms = np.zeros(width)
    for row in found.collect():
        terms[row["_k"]] = row["v"]
    # What the deaths themselves add: their linear predictors and covariates.
    lived = [F.sum(F.col("_dw") * F.col(f"_x{i}")).alias(f"x{i}") for i in range(p)]
    dx = np.array(patterns.agg(*lived).first(), dtype=float)
    information = np.zeros((p, p))
    information[np.triu_indices(p)] = terms[1 + p :]
    information = information + np.triu(information, 1).T
    return float(terms[0] + dx @ beta), terms[1 : 1 + p] + dx, information


def newton_step(information: np.ndarray, score: np.ndarray) -> np.ndarray:
    """The step of least length: directions without information, as of one indicator per category, are left alone."""
    values, vectors = np.linalg.eigh(information)
    known = values > values.max(initial=0.0) * 1e-10
    return vectors[:, known] @ ((vectors[:, known].T @ score) / values[known])


class CoxModel(TableModel):
    """Coefficients, covariate means, and the baseline step table (time, hazard)."""

    @property
    def coefficients(self) -> dict[str, float]:
        return self.options["coefficients"]

    @property
    def featureImportances(self) -> dict[str, float]:
        return self.coefficients

    def _predictor(self) -> Column:
        return linear_predictor(self.options["coefficients"], self.options["centers"])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.options["predictionCol"], self._predictor())

    def survival_at_own_time(self, df: DataFrame, out: str) -> DataFrame:
        """S(t | x) of each row at its own time."""
        time = self.options["time"]
        base = self.table.select(time, F.col("hazard").alias("_h0"))
        looked_up = at_or_before(df, base, time, ["_h0"])
        hazard = F.when(F.col(time).isNotNull(), F.coalesce("_h0", F.lit(0.0)))
        return looked_up.withColumn(out, F.exp(-hazard * F.exp(self._predictor()))).drop("_h0")


class CoxRegression(Estimator, Configured):
    """Proportional hazards on numeric columns; ``transform`` adds the log risk.

    Ties by Efron, baseline by Breslow, covariates centred on their means. ``weightCol``
    holds case weights; rows whose weight is null or not above 0 take no part.
    """

    features = setting("features", "covariates", TypeConverters.toListString)
    time = setting("time", "time of the event or of censoring", TypeConverters.toString)
    event = setting("event", "1 where the event took place", TypeConverters.toString)
    max_iter = setting("max_iter", "most Newton steps", TypeConverters.toInt)
    tol = setting("tol", "likelihood gain that ends the steps", TypeConverters.toFloat)
    predictionCol = setting("predictionCol", "output", TypeConverters.toString)
    weightCol = setting("weightCol", "case weights", TypeConverters.toString)

    def __init__(
        self,
        features: Sequence[str] = (),
        time: str = "efs_time",
        event: str = "efs",
        *,
        max_iter: int = 30,
        tol: float = 1e-8,
        predictionCol: str = "prediction",
        weightCol: str | None = None,
    ):
        super().__init__()
        self._configure(
            features=list(features), time=time, event=event, max_iter=max_iter, tol=tol,
            predictionCol=predictionCol, weightCol=weightCol,
        )

    def _fit(self, dataset: DataFrame) -> CoxModel:
        features, time, event, weight_col = (self.value(n) for n in ("features", "time", "event", "weightCol"))
        weight = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
        dataset = dataset.filter(weight > 0)
        known = dataset.select(
            weight.alias("_cw"),
            F.col(time).cast("double").alias("_t"),
            (F.col(event) == 1).cast("long").alias("_d"),
            *[F.col(c).cast("double").alias(c) for c in features],
        ).dropna()
        stats = known.agg(
            *[F.avg(c).alias(f"m_{c}") for c in features],
            *[F.stddev_pop(c).alias(f"s_{c}") for c in features],
        ).first()
        constant = [c for c in features if not stats[f"s_{c}"]]
        if constant:
            raise ValueError(f"constant covariates: {constant}")
        # Equal rows collapse: for one-hot covariates to one row per time and category.
        patterns = keep(
            known.groupBy(
                "_t",
                *[
                    ((F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"])).alias(f"_x{i}")
                    for i, c in enumerate(features)
                ],
            ).agg(
                F.sum("_cw").alias("_n"),
                F.sum("_d").alias("_d"),
                F.sum(F.col("_cw") * F.col("_d")).alias("_dw"),
            )
        )
        cuts = fit_ranges(patterns.select("_t").distinct(), "_t")
        if not patterns.agg(F.sum("_d")).first()[0]:
            raise ValueError("no event to fit on")

        beta = np.zeros(len(features))
        ll, score, information = newton_terms(patterns, beta, cuts)
        for _ in range(self.value("max_iter")):
            step = newton_step(information, score)
            if abs(float(score @ step)) / 2 < self.value("tol"):
                break
            for _ in range(20):
                trial = newton_terms(patterns, beta + step, cuts)
                if trial[0] >= ll - 1e-9 * abs(ll):
                    break
                step = step / 2
            beta = beta + step
            ll, score, information = trial
        else:
            raise RuntimeError(f"no convergence in {self.value('max_iter')} steps")
        patterns.unpersist()

        coefficients = {c: float(beta[i] / stats[f"s_{c}"]) for i, c in enumerate(features)}
        centers = {c: float(stats[f"m_{c}"]) for c in features}
        options = {
            "coefficients": coefficients,
            "centers": centers,
            "time": time,
            "log_likelihood": float(ll),
            "predictionCol": self.value("predictionCol"),
        }
        scored = dataset.withColumn("_lp", linear_predictor(coefficients, centers))
        baseline = staged(breslow_baseline(scored, time, event, "_lp", weight=weight_col))
        return CoxModel(options, baseline.select(time, "hazard"))


def breslow_baseline(
    df: DataFrame, time: str, event: str, log_risk: str, *, keys: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Cumulative baseline ``hazard`` per distinct time: sum of deaths / risk at risk.

    Deaths and risks count by ``weight``, if that is given.
    """
    w = F.col(weight) if weight else F.lit(1)
    known = df.filter(
        F.col(time).isNotNull() & F.col(event).isNotNull() & F.col(log_risk).isNotNull()
    )
    times = known.groupBy(*keys, F.col(time).cast("double").alias(time)).agg(
        F.sum(F.when(F.col(event) == 1, w).otherwise(0)).alias("deaths"),
        F.sum(w * F.exp(log_risk)).alias("_risk"),
    )
    times = keep(times)
    cuts = fit_ranges(times, time)
    later = running_sums(
        times, [time], {"_later": F.col("_risk")}, keys=keys, cuts=cuts, descending=True
    )
    steps = keep(later.withColumn("_dh", F.col("deaths") / (F.col("_later") + F.col("_risk"))))
    summed = running_sums(steps, [time], {"_before": F.col("_dh")}, keys=keys, cuts=cuts)
    return summed.select(
        *keys, time, "deaths", (F.col("_before") + F.col("_dh")).alias("hazard")
    )
