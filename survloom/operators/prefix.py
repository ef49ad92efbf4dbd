"""Running sums and carried values over an order, without a one-task window.

A window that orders a whole table moves it to one task. Here the order is cut
into equi-depth ranges (see operators.ranges); only one summary row per (key, range)
passes through windows over the ranges, and its result joins the range it
belongs to as an extra leading row. Detail rows are shuffled once, by
(key, range), and no range holds more than about rows/ranges of them as long as
equal order values have been merged by the caller. The windows over ranges work in
levels of ``FAN`` neighbours, so that no window grows with the table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from survloom.operators.ranges import Ranges, fit_ranges
from survloom.settings import keep

_INF = float("inf")
#: Neighbouring ranges that one window passes over, as a power of two.
FAN_BITS = 12


def key_column(keys: Sequence[str]) -> Column:
    """Keys as one struct: grouping and joining on it treat null as a value."""
    return F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0)


def key_fields(keys: Sequence[str], packed: str = "_k") -> list[Column]:
    """The columns packed by :func:`key_column`."""
    return [F.col(f"{packed}.{k}").alias(k) for k in keys]


def with_range(df: DataFrame, column: str, cuts: Sequence[float] | Ranges, out: str = "_b") -> DataFrame:
    """Add the index of the range ``column`` falls in (equal values, equal range).

    Lists of cuts are for a few given edges; fitted ranges for cuts that grow with a table.
    """
    if isinstance(cuts, Ranges):
        return cuts.add(df, column, out)
    if not cuts:
        return df.withColumn(out, F.lit(0))
    bucketizer = Bucketizer(
        splits=[-_INF, *cuts, _INF], inputCol="_num", outputCol="_idx", handleInvalid="keep"
    )
    ranged = bucketizer.transform(df.withColumn("_num", F.col(column).cast("double")))
    return ranged.withColumn(out, F.col("_idx").cast("int")).drop("_num", "_idx")


def _last_range(cuts: Sequence[float] | Ranges) -> int:
    return cuts.top if isinstance(cuts, Ranges) else len(cuts)


def over_levels(heads: DataFrame, names: Sequence[str], top: int, way: str, combine: str, add: str) -> DataFrame:
    """Per (_k, _b): each of ``names`` combined over the ranges strictly before, level by level.

    ``combine`` is the SQL aggregate of one level, ``add`` how what lies before a group of
    ranges (x) meets what lies before the range in its group (y).
    """
    def before(by: str) -> list[str]:
        over = f"OVER (PARTITION BY {by} ORDER BY _b {way} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        return [f"{combine.format(f'`{n}`')} {over} AS `{n}`" for n in names]

    if top >> FAN_BITS == 0:
        return heads.selectExpr("_k", "_b", *before("_k"))
    grouped = heads.withColumn("_g", F.shiftright("_b", FAN_BITS))
    if combine.startswith("sum"):
        upper = [F.expr(f"sum(`{n}`) AS `{n}`") for n in names]
    else:
        # The last value that is there: the largest range number that has one.
        upper = [F.expr(f"max_by(`{n}`, _b) FILTER (WHERE `{n}` IS NOT NULL) AS `{n}`") for n in names]
    above = over_levels(
        grouped.groupBy("_k", F.col("_g").alias("_b")).agg(*upper), names, top >> FAN_BITS, way, combine, add
    ).select("_k", F.col("_b").alias("_g"), *[F.col(n).alias(f"_up_{n}") for n in names])
    inside = grouped.selectExpr("_k", "_b", "_g", *before("_k, _g"))
    joined = inside.join(above, ["_k", "_g"])
    return joined.selectExpr("_k", "_b", *[f"{add.format(x=f'`_up_{n}`', y=f'`{n}`')} AS `{n}`" for n in names])


def running_sums(
    df: DataFrame,
    order: Sequence[str],
    sums: Mapping[str, Column],
    *,
    keys: Sequence[str] = (),
    cuts: Sequence[float] | Ranges | None = None,
    bucket: Column | None = None,
    buckets: int = 1 << FAN_BITS,
    descending: bool = False,
    totals: bool = False,
) -> DataFrame:
    """Add, per key, the sum of each measure over the rows strictly before a row.

    ``order`` must be unique within a key; ``order[0]`` is numeric unless a
    ``bucket`` that never decreases along the order is given, a number below ``buckets``.
    Without ``cuts`` or ``bucket`` the rows are kept and ranges fitted to them. With
    ``totals`` every measure ``m`` also gets ``m_total``, its sum over the key.
    """
    names = list(sums)
    if bucket is None and cuts is None:
        df = keep(df)
        cuts = fit_ranges(df, order[0])
    rows = df.select("*", *[expr.alias(f"_m_{name}") for name, expr in sums.items()])
    rows = rows.withColumn("_b", bucket) if bucket is not None else with_range(rows, order[0], cuts)
    rows = rows.withColumn("_k", key_column(keys))

    way = "DESC" if descending else "ASC"
    # One SQL text per column: these selects can be wide.
    measures = [f"_m_{n}" for n in names]
    by_range = rows.groupBy("_k", "_b").agg(*[F.expr(f"sum(`{m}`) AS `{m}`") for m in measures])
    top = buckets - 1 if bucket is not None else _last_range(cuts)
    heads = over_levels(by_range, measures, top, way, "sum({})", "coalesce({x}, 0) + coalesce({y}, 0)")
    heads = heads.selectExpr("_k", "_b", "0 AS _row", *[f"coalesce(`{m}`, 0) AS `{m}`" for m in measures])
    if totals:
        whole = by_range.groupBy("_k").agg(*[F.expr(f"sum(`_m_{n}`) AS `{n}_total`") for n in names])
        heads = heads.join(whole, "_k")
    joined = rows.withColumn("_row", F.lit(1)).unionByName(heads, allowMissingColumns=True)
    inside = "PARTITION BY _k, _b"
    steps = ", ".join(["_row", *[f"`{c}` {way}" for c in order]])
    before = f"OVER ({inside} ORDER BY {steps} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    out = joined.selectExpr(
        *[f"`{c}`" for c in df.columns],
        "_row",
        *[f"sum(`_m_{n}`) {before} AS `{n}`" for n in names],
        *[f"max(`{n}_total`) OVER ({inside}) AS `{n}_total`" for n in names if totals],
    )
    return out.filter("_row = 1").drop("_row")


def carry_last(
    curve: DataFrame,
    probes: DataFrame,
    order: str,
    values: Sequence[str],
    *,
    keys: Sequence[str] = (),
    cuts: Sequence[float] | Ranges | None = None,
) -> DataFrame:
    """For each distinct (keys, order) of ``probes``: the values of the last curve row at or before.

    ``values`` are null where no curve row comes first.
    """
    steps = curve.select(
        key_column(keys).alias("_k"),
        F.col(order).cast("double").alias(order),
        F.lit(1).alias("_row"),
        F.struct(*values).alias("_v"),
    )
    asked = probes.select(
        key_column(keys).alias("_k"), F.col(order).cast("double").alias(order)
    ).distinct().withColumn("_row", F.lit(2))
    rows = steps.unionByName(asked, allowMissingColumns=True)
    if cuts is None:
        rows = keep(rows)
        cuts = fit_ranges(rows, order)
    rows = with_range(rows, order, cuts)

    heads = rows.groupBy("_k", "_b").agg(F.max_by("_v", F.when(F.col("_row") == 1, F.col(order))).alias("_v"))
    heads = over_levels(heads, ["_v"], _last_range(cuts), "ASC", "last({}, true)", "coalesce({y}, {x})")
    heads = heads.select("_k", "_b", F.lit(0).alias("_row"), "_v")
    upto = (
        Window.partitionBy("_k", "_b")
        .orderBy(F.when(F.col("_row") == 0, 0).otherwise(1), order, "_row")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    found = rows.unionByName(heads, allowMissingColumns=True).select(
        "_k", order, "_row", F.last("_v", ignorenulls=True).over(upto).alias("_v")
    )
    return found.filter(F.col("_row") == 2).select(
        *key_fields(keys), order, *[F.col(f"_v.{v}").alias(v) for v in values]
    )
