"""From many prediction tables to one row of features per id."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from survloom.operators.ranks import normalized_rank


def long_predictions(
    sources: Mapping[str, Mapping[str, DataFrame]], id_col: str, pred_col: str = "pred"
) -> DataFrame:
    """(id, source, part, pred) of tables given as source -> part -> table."""
    return reduce(
        DataFrame.unionByName,
        [
            df.select(
                id_col,
                F.lit(source).alias("source"),
                F.lit(part).alias("part"),
                F.col(pred_col).cast("double").alias(pred_col),
            )
            for source, parts in sources.items()
            for part, df in parts.items()
        ],
    )


def stack_sources(
    predictions: DataFrame,
    sources: list[str],
    id_col: str,
    *,
    pred_col: str = "pred",
    ranks: bool = True,
    prefix: str = "f_",
) -> DataFrame:
    """One row per id of the first source: ``{prefix}pred_{source}`` and ``{prefix}rank_pred_{source}``.

    ``predictions`` is long: (id, source, part, pred). Ranks are taken per source
    and part, for all of them in one pass, and one pivot replaces a chain of
    joins. A source that lacks an id leaves null.
    """
    rows = predictions.filter(F.col("source").isin(sources))
    if ranks:
        rows = normalized_rank(rows, pred_col, "_rank", keys=["source", "part"])
    # One aggregate instead of a pivot, which takes two.
    values, out = [F.max(F.col("source") == sources[0]).alias("_kept")], []
    for made, column in (("pred", pred_col), ("rank_pred", "_rank"))[: 2 if ranks else 1]:
        for s in sources:
            values.append(F.first(F.when(F.col("source") == s, F.col(column)), ignorenulls=True).alias(f"{prefix}{made}_{s}"))
            out.append(f"{prefix}{made}_{s}")
    wide = rows.groupBy(id_col).agg(*values)
    return wide.filter("_kept").select(id_col, *[F.col(f"`{c}`") for c in out])
