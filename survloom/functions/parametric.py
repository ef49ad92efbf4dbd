"""Survival of mixtures of Weibull and log-logistic heads, from per-row parameters."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Points of the unit timeline on which mean survival is taken (fixed value).
TIMELINE_POINTS = 100

# The means are taken in Python workers: ship the functions with the task, so that the
# executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def positive_part(value: Column) -> Column:
    """max(value, 0), null for null."""
    return F.when(value < 0, 0.0).otherwise(value)


def softmax(values: Column) -> Column:
    """Array scaled to positive weights of sum 1."""
    top = F.array_max(values)
    powers = F.transform(values, lambda v: F.exp(v - top))
    total = F.aggregate(powers, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(powers, lambda v: v / total)


def cumulative_hazard(weibull: Column, loglogistic: Column, time: Column) -> Column:
    """Weighted hazards of all heads up to ``time``.

    Each argument is an array of structs (eta, k, w); negative parameters count
    as 0. A Weibull head adds w * eta * t^k, a log-logistic one
    w * ln(1 + eta * t^k).
    """

    def power(head: Column) -> Column:
        return positive_part(head["eta"]) * F.pow(time, positive_part(head["k"]))

    straight = F.aggregate(
        weibull, F.lit(0.0), lambda acc, h: acc + positive_part(h["w"]) * power(h)
    )
    return F.aggregate(
        loglogistic, straight, lambda acc, h: acc + positive_part(h["w"]) * F.log1p(power(h))
    )


def survival_at(weibull: Column, loglogistic: Column, time: Column) -> Column:
    """exp(-cumulative hazard)."""
    return F.exp(-cumulative_hazard(weibull, loglogistic, time))


def _parameters(heads: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray]:
    """The row of each head, its positive parameters, and which rows lack something."""
    flat = heads.flatten()
    counts = pc.fill_null(pc.list_value_length(heads), 0).to_numpy()
    row = np.repeat(np.arange(len(heads)), counts)
    lacking = heads.is_null().to_numpy(zero_copy_only=False)
    values = {}
    for name in ("eta", "k", "w"):
        found = pc.struct_field(flat, name).cast(pa.float64())
        lacking[row[found.is_null().to_numpy(zero_copy_only=False)]] = True
        number = found.to_numpy(zero_copy_only=False)
        values[name] = np.where(number < 0, 0.0, number)
    return row, values, lacking


def _mean_over(points: int) -> Callable[[pa.Array, pa.Array], pa.Array]:
    """Mean survival of a batch of rows, one point of the timeline after the other."""

    def mean(weibull: pa.Array, loglogistic: pa.Array) -> pa.Array:
        n = len(weibull)
        (row, straight, lacking), (other, bent, also) = _parameters(weibull), _parameters(loglogistic)

        def power(heads: dict[str, np.ndarray], time: float) -> np.ndarray:
            k = heads["k"]
            grown = np.exp(k * math.log(time)) if time else np.where(k > 0, 0.0, np.where(k == 0, 1.0, k))
            return heads["eta"] * grown

        total = np.zeros(n)
        with np.errstate(all="ignore"):
            for i in range(points):
                time = i / float(points - 1)
                hazard = np.bincount(row, straight["w"] * power(straight, time), n) + np.bincount(
                    other, bent["w"] * np.log1p(power(bent, time)), n
                )
                total += np.exp(-hazard)
        return pa.array(total / points, mask=lacking | also)

    return mean


def mean_survival(weibull: Column, loglogistic: Column, points: int = TIMELINE_POINTS) -> Column:
    """Mean survival over equally spaced times of [0, 1]; its negative is a risk score.

    Taken on batches of rows: Spark interprets functions of array elements, once per
    row, point and head.
    """
    return F.arrow_udf(_mean_over(points), "double")(weibull, loglogistic)
