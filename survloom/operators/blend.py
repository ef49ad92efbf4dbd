"""Averages of predictions: over seeds, over columns, with fitted weights."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def average_by_id(predictions: DataFrame, id_col: str, pred_col: str = "pred") -> DataFrame:
    """Mean prediction per id over seeds, folds and models."""
    return predictions.groupBy(id_col).agg(F.avg(pred_col).alias(pred_col))


def gram_table(
    df: DataFrame, columns: Sequence[str], target: str, *, weight: str | None = None
) -> DataFrame:
    """Cross products of prediction columns and target: (left, right, product), one pass.

    Rows with a null in any of the columns are left out.
    """
    names = [*columns, target]
    w: Column = F.col(weight) if weight else F.lit(1.0)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = df.dropna(subset=names).agg(
        *[F.sum(F.col(a) * F.col(b) * w).alias(f"p{n}") for n, (a, b) in enumerate(pairs)]
    )
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"p{n}").alias("product"))
            for n, (a, b) in enumerate(pairs)
        ]
    )
    return sums.select(F.inline(rows))


def simplex_least_squares(gram: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """Weights w >= 0 with sum 1 that minimise w'Gw/2 - c'w (p by p, on the driver).

    Active set: solve on the positive weights, step back to the boundary when one
    would turn negative, add the weight whose multiplier is most negative.
    """
    p = len(cross)
    scale = max(np.trace(gram) / p, 1e-300)
    gram = gram / scale + 1e-12 * np.eye(p)
    cross = cross / scale
    start = int(np.argmin(np.diag(gram) / 2 - cross))
    w = np.zeros(p)
    w[start] = 1.0
    free = [start]
    for _ in range(50 * p):
        k = len(free)
        system = np.block([[gram[np.ix_(free, free)], np.ones((k, 1))], [np.ones((1, k)), np.zeros((1, 1))]])
        solved = np.linalg.solve(system, np.r_[cross[free], 1.0])
        goal, multiplier = solved[:k], solved[k]
        if (goal < 0).any():
            now = w[free]
            falling = goal < now
            reach = np.where(falling & (goal < 0), now / np.where(falling, now - goal, 1.0), np.inf)
            out = int(np.argmin(reach))
            w[free] = now + min(reach[out], 1.0) * (goal - now)
            w[free[out]] = 0.0
            free.pop(out)
            continue
        w[free] = goal
        slack = gram @ w - cross + multiplier
        slack[free] = 0.0
        worst = int(np.argmin(slack))
        if slack[worst] >= -1e-10:
            break
        free.append(worst)
    return w


def fit_blend_weights(
    df: DataFrame, columns: Sequence[str], target: str, *, weight: str | None = None
) -> dict[str, float]:
    """Non-negative weights of sum 1 with the least squared error."""
    table = {(r["left"], r["right"]): r["product"] for r in gram_table(df, columns, target, weight=weight).collect()}
    p = len(columns)
    gram = np.array(
        [[table.get((a, b), table.get((b, a))) for b in columns] for a in columns], dtype=float
    ).reshape(p, p)
    cross = np.array([table[(a, target)] for a in columns], dtype=float)
    return dict(zip(columns, simplex_least_squares(gram, cross).tolist()))
