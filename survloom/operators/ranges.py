"""Equi-depth ranges of a numeric order, found by rounds of histogram refinement.

The values from the smallest to the largest are counted in ``BINS`` cells.
A cell with more than the target of rows, unless it holds a single value, is cut into
``BINS`` cells of its own, between its own smallest and largest value, and so on. Every
round is one partial aggregate, and every window over cells is over the cells of one
parent. A cell's rows before it give the number of its range, so ranges of about equal
depth come out in order, a heavy value is alone in its range, and equal values always
share one. The driver sees three numbers; rows find their range by an equi-join
with the cells, whose number is that of the parents times ``BINS`` at most.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from survloom.settings import GROUP_ROWS, bucket_count, staged

#: Cells of one refinement.
BINS = 1 << 12
_LARGEST = 1.7976931348623157e308
_CELL = ("_cell_node", "_cell_bin")


def _value(column: str) -> Column:
    """The order value as a finite number; null, NaN and infinity are the largest."""
    x = F.col(column).cast("double")
    return F.when(x.isNull() | F.isnan(x), F.lit(_LARGEST)).otherwise(F.greatest(F.least(x, F.lit(_LARGEST)), F.lit(-_LARGEST)))


def _bin(x: Column, lo: Column, hi: Column, finer: bool) -> Column:
    """The cell of a value between ``lo`` and ``hi``: never decreases with the value.

    Cells of the first round are of equal width. A finer round that has to part numbers
    of different magnitude uses equal widths of their logarithm, from zero outwards if
    there are both signs. Wherever the values lie, a few rounds are enough.
    """
    share = (x / 2 - lo / 2) / (hi / 2 - lo / 2)
    if finer:
        unit = F.greatest(F.abs(lo), F.abs(hi)) * F.lit(2.0**-64)
        outward = lambda v: F.signum(v) * F.log1p(F.abs(v) / unit)
        share = (
            F.when((lo > 0) & (hi / 4 > lo), (F.log(x) - F.log(lo)) / (F.log(hi) - F.log(lo)))
            .when((hi < 0) & (lo / 4 < hi), 1 - (F.log(-x) - F.log(-hi)) / (F.log(-lo) - F.log(-hi)))
            .when((lo <= 0) & (hi >= 0) & (unit > 0), (outward(x) - outward(lo)) / (outward(hi) - outward(lo)))
            .otherwise(share)
        )
    place = F.when(hi > lo, F.floor(share * BINS)).otherwise(F.lit(0))
    return F.least(F.greatest(place, F.lit(0)), F.lit(BINS - 1)).cast("int")


@dataclass
class Ranges:
    """Ranges fitted to one column; numbers grow with the value, odd ones hold a single heavy value."""

    rows: int
    target: int
    low: float = 0.0
    high: float = 0.0
    levels: list[DataFrame] = field(default_factory=list)

    @property
    def top(self) -> int:
        """No range has a larger number."""
        return 2 * (self.rows // self.target) + 1

    def add(self, df: DataFrame, column: str, out: str) -> DataFrame:
        """Add the number of the range of ``column``, whose values must have been fitted."""
        if not self.levels:
            return df.withColumn(out, F.lit(0))
        x = _value(column)
        first = [F.lit(0).cast("long"), _bin(x, F.lit(self.low), F.lit(self.high), False)]
        rows = df.withColumns(dict(zip(_CELL, first)))
        found: Column = F.lit(None).cast("int")
        for depth, cells in enumerate(self.levels):
            names = {c: f"_range{depth}_{c}" for c in ("node", "bin", "idx", "child", "lo", "hi")}
            cells = cells.select(*[F.col(c).alias(n) for c, n in names.items()])
            same = (rows[_CELL[0]] == cells[names["node"]]) & (rows[_CELL[1]] == cells[names["bin"]])
            rows = rows.join(cells, same, "left")
            found = F.coalesce(found, F.col(names["idx"]))
            # Rows that have their range match no further cell; below zero they spread over tasks.
            done = -1 - F.pmod(F.xxhash64(x), F.lit(1 << 20))
            rows = rows.withColumns(
                {
                    _CELL[0]: F.coalesce(F.col(names["child"]), done),
                    _CELL[1]: F.coalesce(_bin(x, F.col(names["lo"]), F.col(names["hi"]), True), F.lit(0)),
                }
            )
        return rows.withColumn(out, found).select(*[c for c in df.columns if c != out], out)


def fit_ranges(df: DataFrame, column: str, target: int | None = None) -> Ranges:
    """Ranges of about ``target`` rows of ``df``, and of less than twice as many unless a value is heavier.

    ``df`` is read once per round, so it should be kept or staged. Without a target, two
    ranges per shuffle partition, and more where these would have over ``GROUP_ROWS`` rows.
    """
    x = _value(column)
    seen = df.agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    rows = seen["n"]
    target = target or max(1, min(GROUP_ROWS, math.ceil(rows / bucket_count(df.sparkSession))))
    if not rows or seen["lo"] == seen["hi"]:
        return Ranges(rows, target)
    made = Ranges(rows, target, seen["lo"], seen["hi"])
    start = F.lit(0).cast("long").alias("node")
    part = df.select(x.alias("x"), start, F.lit(made.low).alias("lo"), F.lit(made.high).alias("hi"))
    while True:
        cell = _bin(F.col("x"), F.col("lo"), F.col("hi"), bool(made.levels))
        counted = part.groupBy("node", cell.alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")
        )
        earlier = Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        # A node is named by the rows before it, which no other node of its round has.
        before = F.col("node") + F.coalesce(F.sum("n").over(earlier), F.lit(0))
        heavy, single = F.col("n") > target, F.col("lo") == F.col("hi")
        idx = (2 * F.floor(F.col("before") / target) + F.when(heavy, 1).otherwise(0)).cast("int")
        # Written, not kept: a round builds on the last, and plans would nest.
        cells = staged(
            counted.withColumn("before", before).select(
                "node",
                "bin",
                F.when(~heavy | single, idx).alias("idx"),
                F.when(heavy & ~single, F.col("before")).alias("child"),
                "lo",
                "hi",
            ),
            "ranges",
        )
        made.levels.append(cells)
        open_cells = cells.filter("child IS NOT NULL")
        if not open_cells.count():
            return made
        finer = open_cells.select(F.col("node").alias("_n"), F.col("bin").alias("_b"), "child", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
        at = part.withColumn("bin", cell)
        part = at.join(finer, (F.col("node") == F.col("_n")) & (F.col("bin") == F.col("_b"))).select(
            "x", F.col("child").alias("node"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi")
        )
