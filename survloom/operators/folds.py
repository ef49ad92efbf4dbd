"""Seeded fold and holdout assignment that does not depend on partitioning."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from survloom.operators.prefix import running_sums
from survloom.settings import GROUP_ROWS, bucket_count

_HEX_DIGITS = 7
#: Most leading digits of the hash whose groups are counted to find the first rows of folds.
_COUNTED_DIGITS = 4
#: Comparisons of hashes that are one expression each; more are code that the JVM does not compile.
_COMPARED = 64


def shuffle_key(id_col: Column, seed: Column | int) -> Column:
    """Pseudo-random sort key of a row: md5 of ``id:seed``."""
    return F.md5(F.concat_ws(":", id_col.cast("string"), F.lit(seed).cast("string")))


def _shuffled_place(df: DataFrame, id_col: str, keys: Sequence[str], seed: Column | int) -> DataFrame:
    """Add ``_place``, the 0-based position in shuffled order, and ``_place_total``."""
    buckets = bucket_count(df.sparkSession)
    keyed = df.withColumn("_hash", shuffle_key(F.col(id_col), seed))
    # The hash is uniform: its leading digits cut the order evenly, no sampling.
    leading = F.conv(F.substring("_hash", 1, _HEX_DIGITS), 16, 10).cast("long")
    bucket = F.floor(leading * buckets / F.lit(16**_HEX_DIGITS)).cast("int")
    return running_sums(
        keyed,
        ["_hash", id_col],
        {"_place": F.lit(1).cast("long")},
        keys=keys,
        bucket=bucket,
        buckets=buckets,
        totals=True,
    ).drop("_hash")


def _fold_of_place(n_splits: int) -> Column:
    """Fold of a position when the first ``n % n_splits`` folds hold one row more."""
    place, n = F.col("_place"), F.col("_place_total")
    small = F.floor(n / n_splits)
    larger = n % n_splits
    edge = (small + 1) * larger
    rest = larger + F.floor((place - edge) / F.greatest(small, F.lit(1)))
    return F.when(place < edge, F.floor(place / (small + 1))).otherwise(rest).cast("int")


def assign_folds(
    df: DataFrame, id_col: str, n_splits: int, seed: int, *, fold_col: str = "fold"
) -> DataFrame:
    """Add a fold number 0..n_splits-1; fold sizes differ by at most one row."""
    placed = _shuffled_place(df.drop(fold_col), id_col, [], seed)
    return placed.withColumn(fold_col, _fold_of_place(n_splits)).drop("_place", "_place_total")


def fold_table(
    df: DataFrame, id_col: str, n_splits: int, seeds: Sequence[int], *, fold_col: str = "fold"
) -> DataFrame:
    """(id, seed, fold) for several seeds from one pass over the ids alone."""
    ids = df.select(id_col, F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"))
    placed = _shuffled_place(ids, id_col, ["seed"], F.col("seed"))
    return placed.select(id_col, "seed", _fold_of_place(n_splits).alias(fold_col))


def fold_starts(n: int, n_splits: int) -> list[int]:
    """Positions at which folds 1, 2, ... of n rows start; the first ``n % n_splits`` folds hold one row more."""
    small, larger = divmod(n, n_splits)
    starts = [f * small + min(f, larger) for f in range(1, n_splits)]
    return [at for at in starts if at < n]


def _begun(key: Column, own: Column) -> Callable[[Column], Column]:
    """Whether a fold's first row is at or before the row of this hash and id."""
    return lambda at: (at["hash"] < key) | ((at["hash"] == key) & (at["id"] <= own))


def _folds_begun(starting: Sequence[tuple[Column, Column]], key: Column, own: Column, seen: int = 0) -> Column:
    """How many of the first rows (hash, id) of folds, in order, are at or before the row: by halves."""
    if not starting:
        return F.lit(seen)
    at = len(starting) // 2
    begun = _begun(key, own)(dict(zip(("hash", "id"), starting[at], strict=True)))
    return F.when(begun, _folds_begun(starting[at + 1 :], key, own, seen + at + 1)).otherwise(_folds_begun(starting[:at], key, own, seen))


def add_seed_folds(df: DataFrame, ids: DataFrame, id_col: str, n_splits: int, seeds: Sequence[int]) -> DataFrame:
    """Add ``fold_{seed}`` for every seed, as :func:`fold_table` has it for the unique ``ids`` of the rows.

    Only the first row of each fold is looked for: hashes are counted by their leading
    digits, and groups that a fold starts in are numbered. Ids are neither sorted nor
    joined; ``n_splits - 1`` rows a seed reach the driver. ``ids`` is read twice.
    """
    seeds = list(dict.fromkeys(seeds))
    hashed = ids.select(
        F.col(id_col).alias("_id"), F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed")
    ).withColumn("_hash", shuffle_key(F.col("_id"), F.col("seed")))
    total = ids.count()
    # At most 16^4 groups a seed, however many rows; fewer where they stay small.
    digits = next((d for d in range(_COUNTED_DIGITS) if total <= GROUP_ROWS // 4 * 16**d), _COUNTED_DIGITS)
    hashed = hashed.withColumn("_lead", F.substring("_hash", 1, digits))
    order = Window.partitionBy("seed").orderBy("_lead")
    upto = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    counted = hashed.groupBy("seed", "_lead").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", upto)
    starts = fold_starts(total, n_splits)
    holding = reduce(
        lambda seen, at: seen | ((F.col("upto") > at) & (F.col("upto") - F.col("n") <= at)), starts, F.lit(False)
    )
    groups = counted.filter(holding).select("seed", "_lead", "n", "upto").collect() if starts else []
    first = {(g["seed"], g["_lead"]): [at - g["upto"] + g["n"] + 1 for at in starts if g["upto"] - g["n"] <= at < g["upto"]] for g in groups}
    found = []
    if first:
        inside = reduce(
            lambda seen, s: seen | ((F.col("seed") == s) & F.col("_lead").isin([lead for t, lead in first if t == s])), seeds, F.lit(False)
        )
        place = F.row_number().over(Window.partitionBy("seed", "_lead").orderBy("_hash", "_id"))
        wanted = reduce(
            lambda seen, g: seen | ((F.col("seed") == g[0]) & (F.col("_lead") == g[1]) & F.col("_place").isin(first[g])), first, F.lit(False)
        )
        found = hashed.filter(inside).withColumn("_place", place).filter(wanted).select("seed", "_hash", "_id").collect()
    own, kind, folds = F.col(id_col), ids.schema[id_col].dataType, {}
    for seed in seeds:
        starting = sorted((r for r in found if r["seed"] == seed), key=lambda r: (r["_hash"], r["_id"]))
        if not starting:
            folds[f"fold_{seed}"] = F.lit(0)
            continue
        begins = [(F.lit(r["_hash"]), F.lit(r["_id"]).cast(kind)) for r in starting]
        if n_splits * len(seeds) <= _COMPARED:
            folds[f"fold_{seed}"] = _folds_begun(begins, F.col(f"_hash_{seed}"), own)
            continue
        # One function over an array instead of a comparison per fold in the plan.
        first = F.array(*[F.struct(h.alias("hash"), i.alias("id")) for h, i in begins])
        folds[f"fold_{seed}"] = F.size(F.filter(first, _begun(F.col(f"_hash_{seed}"), own)))
    # Columns of their own, so that a row is hashed once a seed and not once a fold.
    keys = {f"_hash_{seed}": shuffle_key(own, seed) for seed in seeds}
    return df.withColumns(keys).select("*", *[c.alias(n) for n, c in folds.items()]).drop(*keys)


def mark_holdout(
    df: DataFrame,
    id_col: str,
    ratio: float,
    seed: int,
    *,
    dataset_col: str = "dataset",
    train: str = "TRAIN",
    mark: str = "VALID",
) -> DataFrame:
    """Mark the first ceil(ratio * n) training rows of the shuffled order."""
    train_rows = df.withColumn("_train", F.coalesce(F.col(dataset_col) == train, F.lit(False)))
    placed = _shuffled_place(train_rows, id_col, ["_train"], seed)
    held = F.col("_train") & (F.col("_place") < F.ceil(F.lit(ratio) * F.col("_place_total")))
    return placed.withColumn(
        dataset_col, F.when(held, F.lit(mark)).otherwise(F.col(dataset_col))
    ).drop("_train", "_place", "_place_total")
