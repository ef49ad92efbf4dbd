"""Concordance counts and the stratified concordance score, without a pair join.

A pair (i, j) is comparable when i has an event and j is later: a larger time,
or the same time and censored. It is concordant when i has the larger risk and
tied when the risks are equal.

Rows are cut into equi-depth ranges of time and of risk. A pair then falls in
exactly one of three places:

* same time range: counted inside that range;
* other time range, same risk range: counted inside the risk range;
* both ranges differ: decided by the ranges alone, so it is counted on the
  table of (time range, risk range) cells, level by level with wider ranges.

Equal rows are merged first; every distinct row is then shuffled twice, whatever
the size, and there is no other path for small tables. A value heavier than a range
gets a range of its own (an event time is split from the censorings at that
time), where no counting is needed, so no group outgrows ``group_rows``.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from survloom.operators import prefix
from survloom.operators.ranges import fit_ranges
from survloom.settings import GROUP_ROWS, keep

_COUNT = "decimal(38,0)"
_COUNTS = ("pairs", "concordant", "tied")
#: Neighbouring ranges joined per level of cells: 2 bits, so four of them.
_JOINED_BITS = 2

# The functions below run in Python workers: ship them with the task, so that the
# executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def count_ordered_pairs(
    code: np.ndarray, risk: np.ndarray, left: np.ndarray, right: np.ndarray
) -> tuple[int, int, int]:
    """(pairs, concordant, tied) over i, j with code_i < code_j, weighted left_i * right_j.

    Concordant: risk_i > risk_j. The rows are held in risk order and split by
    one bit of the code per round, from the top bit: two codes differ first at
    exactly one bit, and in that round the smaller one is on the zero side of
    the same node.
    """
    if len(code) == 0:
        return 0, 0, 0
    wide = int(left.sum()) * int(right.sum()) >= 1 << 62
    kind = object if wide else np.int64

    def dot(a: np.ndarray, b: np.ndarray) -> int:
        return int(np.dot(a.astype(kind), b.astype(kind)))

    by_code = np.argsort(code, kind="stable")
    new_code = np.r_[True, np.diff(code[by_code]) != 0]
    earlier = np.cumsum(left[by_code]) - left[by_code]
    pairs = dot(earlier[np.flatnonzero(new_code)][np.cumsum(new_code) - 1], right[by_code])

    order = np.argsort(-risk, kind="stable")
    c, e, w = code[order], left[order], right[order]
    block = np.cumsum(np.r_[True, np.diff(risk[order]) != 0])
    place = np.arange(len(c))
    concordant = tied = 0
    for bit in range(int(c.max()).bit_length() - 1, -1, -1):
        one = (c >> bit) & 1
        node = c >> (bit + 1)
        starts_node = np.r_[True, np.diff(node) != 0]
        node_first = np.flatnonzero(starts_node)
        node_of = np.cumsum(starts_node) - 1
        starts_block = starts_node | np.r_[True, np.diff(block) != 0]
        block_first = np.flatnonzero(starts_block)
        block_of = np.cumsum(starts_block) - 1

        lefts = np.where(one == 0, e, 0)
        before = np.r_[0, np.cumsum(lefts)]
        above = before[block_first] - before[node_first[node_of[block_first]]]
        within = before[np.r_[block_first[1:], len(c)]] - before[block_first]
        rights = np.where(one == 1, w, 0)
        concordant += dot(above[block_of], rights)
        tied += dot(within[block_of], rights)

        zeros = np.r_[0, np.cumsum(1 - one)]
        node_start = node_first[node_of]
        zeros_before = zeros[:-1] - zeros[node_start]
        node_zeros = zeros[np.r_[node_first[1:], len(c)]] - zeros[node_first]
        target = node_start + np.where(
            one == 0, zeros_before, node_zeros[node_of] + (place - node_start - zeros_before)
        )
        moved = np.empty_like(place)
        moved[target] = place
        c, e, w, block = c[moved], e[moved], w[moved], block[moved]
    return pairs, concordant, tied


def _dense_codes(major: np.ndarray, minor: np.ndarray) -> np.ndarray:
    order = np.lexsort((minor, major))
    step = (np.diff(major[order]) != 0) | (np.diff(minor[order]) != 0)
    codes = np.empty(len(order), dtype=np.int64)
    codes[order] = np.r_[0, np.cumsum(step)] if len(order) else []
    return codes


def _key_numbers(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """One number per combination of keys; null is a value."""
    numbers = np.zeros(len(table), dtype=np.int64)
    for k in keys:
        encoded = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
        both = numbers * max(1, len(encoded.dictionary)) + encoded.indices.to_numpy()
        numbers = np.unique(both, return_inverse=True)[1]
    return numbers


def _count_groups(
    rows: DataFrame, keys: Sequence[str], part: str, major: str, minor: str, *, together: bool = False
) -> DataFrame:
    """Pair counts inside each (keys, part) group: (keys, pairs, concordant, tied).

    ``together``: a part is of bounded size over all keys. One call then counts all keys of
    a part, one after the other: calls cost more than the counting of small groups.
    """
    columns = list(dict.fromkeys([*keys, part, major, minor, "_r", "_ev", "_n"]))
    schema = T.StructType([rows.schema[k] for k in keys])
    together = together and all(isinstance(f.dataType, T.AtomicType) for f in schema)
    for name in _COUNTS:
        schema = schema.add(name, _COUNT)

    def count(table: pa.Table) -> pa.Table:
        numbers = _key_numbers(table, keys) if together else np.zeros(len(table), dtype=np.int64)
        order = np.argsort(numbers, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(numbers[order]) != 0])
        values = {c: table.column(c).to_numpy() for c in {major, minor, "_r", "_ev", "_n"}}
        found = []
        for own in np.split(order, starts[1:]):
            codes = _dense_codes(values[major][own], values[minor][own])
            found.append(count_ordered_pairs(codes, values["_r"][own], values["_ev"][own], values["_n"][own]))
        out = {k: table.column(k).take(pa.array(order[starts])) for k in keys}
        for name, numbers in zip(_COUNTS, zip(*found)):
            out[name] = pa.array([Decimal(n) for n in numbers], pa.decimal128(38, 0))
        return pa.table(out)

    groups = [part] if together else [*keys, part]
    return rows.select(columns).groupBy(*groups).applyInArrow(count, schema)


def _earlier_products(cells: DataFrame, keys: Sequence[str], along: str, top: int) -> list[DataFrame]:
    """Parts that sum, per keys, to n times the events strictly earlier ``along`` the order.

    Two ranges first part in one level of ``FAN_BITS`` bits: there they are counted in a
    window over the neighbours of one group, and groups are the ranges of the next level.
    """
    parts = []
    level = cells.groupBy(*keys, F.col(along).alias("_at")).agg(F.sum("_ev").alias("_ev"), F.sum("_n").alias("_n"))
    while True:
        group = F.shiftright("_at", prefix.FAN_BITS)
        earlier = Window.partitionBy(*keys, group).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("_ev").over(earlier), F.lit(0))
        pairs = F.col("_n").cast("decimal(19,0)") * F.col("_before").cast("decimal(19,0)")
        counted = level.withColumn("_before", before).groupBy(*keys).agg(F.sum(pairs).cast(_COUNT).alias("_sum"))
        parts.append(counted)
        top >>= prefix.FAN_BITS
        if not top:
            return parts
        level = level.groupBy(*keys, group.alias("_at")).agg(F.sum("_ev").alias("_ev"), F.sum("_n").alias("_n"))


def _count_cells(
    cells: DataFrame, keys: Sequence[str], group_rows: int, a_top: int, b_top: int
) -> list[DataFrame]:
    """Parts that sum to the concordant pairs of cells that differ in both ranges.

    Four neighbouring ranges are joined per level: what falls in one joined range
    is counted there, the rest on the joined cells. Each level has a sixteenth
    of the possible cells, and one cell is left in the end. The largest range numbers
    tell how many levels there are.
    """
    rows = cells.withColumn("_r", F.col("_b").cast("double"))
    if (a_top + 1) * (b_top + 1) <= max(4, group_rows):
        return [_count_groups(rows.withColumn("_all", F.lit(0)), keys, "_all", "_a", "_a")]
    joined = rows.withColumns(
        {"_a4": F.shiftright("_a", _JOINED_BITS), "_b4": F.shiftright("_b", _JOINED_BITS)}
    )
    parts = [
        _count_groups(joined, keys, "_a4", "_a", "_a"),
        _count_groups(joined, keys, "_b4", "_a4", "_a4"),
    ]
    coarse = keep(
        joined.groupBy(*keys, F.col("_a4").alias("_a"), F.col("_b4").alias("_b")).agg(
            F.sum("_ev").alias("_ev"), F.sum("_n").alias("_n")
        )
    )
    return parts + _count_cells(coarse, keys, group_rows, a_top >> _JOINED_BITS, b_top >> _JOINED_BITS)


def _count(rows: DataFrame, keys: Sequence[str], group_rows: int) -> DataFrame:
    """Parts that add up, per keys, to the pair counts of ``rows``."""
    # Ranges over all keys together: fewer than group_rows rows of all keys in one, unless one value has more.
    times, risks = (fit_ranges(rows, c, max(1, group_rows // 2)) for c in ("_t", "_r"))
    ranged = risks.add(times.add(rows, "_t", "_a"), "_r", "_b")
    # Odd ranges hold one heavy value; an event time is then split from the censorings at that time.
    alone = F.col("_a") % 2 == 1
    ranged = ranged.select(
        *rows.columns,
        alone.alias("_alone"),
        (2 * F.col("_a") + F.when(alone, F.col("_late")).otherwise(0)).alias("_a"),
        "_b",
    )
    a_top = 2 * times.top + 1
    one_risk = F.col("_b") % 2 == 1
    zero = F.lit(0).cast(_COUNT)
    parts = [
        _count_groups(ranged.filter(~F.col("_alone")), keys, "_a", "_t", "_late", together=True),
        _count_groups(
            ranged.filter(~one_risk), keys, "_b", "_a", "_a", together=True
        ).withColumn("pairs", zero),
    ]
    cells = keep(
        ranged.groupBy(*keys, "_a", "_b").agg(F.sum("_ev").alias("_ev"), F.sum("_n").alias("_n"))
    )
    parts += [
        part.select(*keys, F.col("_sum").alias("pairs"), zero.alias("concordant"), zero.alias("tied"))
        for part in _earlier_products(cells, keys, "_a", a_top)
    ]
    parts += [
        part.select(*keys, zero.alias("pairs"), zero.alias("concordant"), F.col("_sum").alias("tied"))
        for part in _earlier_products(cells.filter(one_risk), [*keys, "_b"], "_a", a_top)
    ]
    parts += [
        part.select(*keys, zero.alias("pairs"), "concordant", zero.alias("tied"))
        for part in _count_cells(cells, keys, group_rows, a_top, risks.top)
    ]
    return reduce(DataFrame.unionByName, parts)


def concordance_counts(
    df: DataFrame,
    time: str,
    event: str,
    risk: str,
    *,
    keys: Sequence[str] = (),
    whole: str | None = None,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Per keys: comparable, concordant and tied pairs, and the C-index.

    ``whole`` names one of the keys: rows that have it also count with null there, for all
    its values together.

    Columns ``pairs``, ``concordant``, ``tied`` (decimal: they grow with the
    square of the rows), ``incomplete`` (rows with a null or NaN time, event or
    risk, which belong to no pair) and ``c_index``, null when no pair is comparable.
    """
    t, r = F.col(time).cast("double"), F.col(risk).cast("double")
    unknown = t.isNull() | F.isnan(t) | F.col(event).isNull() | r.isNull() | F.isnan(r)
    complete = ~unknown
    base = keep(
        df.select(
            *keys,
            t.alias("_t"),
            (F.col(event) != 1).cast("int").alias("_late"),
            r.alias("_r"),
            (F.col(event) == 1).cast("long").alias("_ev"),
            F.lit(1).cast("long").alias("_n"),
            complete.alias("_ok"),
        )
        .groupBy(*keys, "_t", "_late", "_r", "_ok")
        .agg(F.sum("_ev").alias("_ev"), F.sum("_n").alias("_n"))
    )
    if whole is not None:
        # Of the merged rows: hashing all rows a second time would cost as much as the first.
        again = base.filter(F.col(whole).isNotNull())
        base = base.unionByName(again.withColumn(whole, F.lit(None).cast(base.schema[whole].dataType)))
    counted = _count(base.filter("_ok").drop("_ok"), keys, group_rows)
    skipped = (
        base.filter(~F.col("_ok"))
        .groupBy(*keys)
        .agg(F.sum("_n").alias("incomplete"))
    )
    both = counted.unionByName(skipped, allowMissingColumns=True)
    total = [F.coalesce(F.sum(c), F.lit(0)).cast(_COUNT).alias(c) for c in _COUNTS]
    c_index = F.try_divide(
        F.col("concordant").cast("double") + F.col("tied").cast("double") / 2,
        F.col("pairs").cast("double"),
    )
    return (
        both.groupBy(*keys)
        .agg(*total, F.coalesce(F.sum("incomplete"), F.lit(0)).alias("incomplete"))
        .withColumn("c_index", c_index)
    )


def stratified_score(
    df: DataFrame,
    time: str,
    event: str,
    risk: str,
    stratum: str,
    *,
    keys: Sequence[str] = (),
    whole: str | None = None,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Mean minus population deviation of the C-index over strata: (keys, score).

    Null when a stratum has no comparable pair, or a row without prediction:
    such strata are never averaged away.
    """
    counts = concordance_counts(
        df, time, event, risk, keys=[*keys, stratum], whole=whole, group_rows=group_rows
    )
    usable = F.when(F.col("incomplete") == 0, F.col("c_index"))
    score = F.avg(usable) - F.stddev_pop(usable)
    whole = F.count(usable) == F.count(F.lit(1))
    return counts.groupBy(*keys).agg(F.when(whole, score).alias("score"))
