"""Feature encoders: fit on some rows, transform any rows.

Each is a ``pyspark.ml`` estimator whose model holds its dictionary as a
DataFrame, so encoders go into a ``pyspark.ml.Pipeline`` with any other stage.
A dictionary may be large: nothing of it passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from itertools import combinations

from pyspark.ml import Estimator, Transformer
from pyspark.ml.param import TypeConverters
from pyspark.ml.util import MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from survloom.functions.expr import crossed_text, joined_text, product_of, sum_of
from survloom.operators.folds import assign_folds
from survloom.operators.persistence import Configured, TableModel, setting
from survloom.operators.prefix import running_sums, with_range
from survloom.operators.ranks import quantiles
from survloom.settings import staged

UNKNOWN = -1
MISSING = -2

_TEXT, _TEXTS = TypeConverters.toString, TypeConverters.toListString


class RowEncoder(Transformer, Configured):
    """An encoder that needs no fitting: a list of new columns, added in one select."""

    def _build(self, df: DataFrame) -> Sequence[Column]:
        raise NotImplementedError

    def _dropped(self, df: DataFrame) -> Sequence[str]:
        return ()

    def _transform(self, dataset: DataFrame) -> DataFrame:
        dropped = set(self._dropped(dataset))
        kept = [F.col(f"`{c}`") for c in dataset.columns if c not in dropped]
        return dataset.select(*kept, *self._build(dataset))


# --- without a dictionary ----------------------------------------------------


class RawColumns(RowEncoder):
    """Copies of columns under a prefix."""

    columns = setting("columns", "columns to copy", _TEXTS)
    prefix = setting("prefix", "prefix of the copies", _TEXT)

    def __init__(self, columns: Sequence[str] = (), prefix: str = "f_"):
        super().__init__()
        self._configure(columns=list(columns), prefix=prefix)

    def _build(self, df: DataFrame) -> list[Column]:
        return [F.col(c).alias(self.value("prefix") + c) for c in self.value("columns")]


class NullFlags(RowEncoder):
    """1 where the column is null; no columns named means all of them."""

    columns = setting("columns", "columns to test, all if empty", _TEXTS)
    prefix = setting("prefix", "prefix of the flags", _TEXT)
    suffix = setting("suffix", "suffix of the flags", _TEXT)

    def __init__(self, columns: Sequence[str] = (), prefix: str = "f_", suffix: str = "_is_null"):
        super().__init__()
        self._configure(columns=list(columns), prefix=prefix, suffix=suffix)

    def _build(self, df: DataFrame) -> list[Column]:
        before, after = self.value("prefix"), self.value("suffix")
        return [F.col(c).isNull().cast("int").alias(before + c + after) for c in self.value("columns") or df.columns]


def _combined(
    columns: Sequence[str], include: Sequence[str], r: int
) -> list[tuple[list[str], list[str]]]:
    if not 0 < r - len(include) <= len(columns):
        raise ValueError("r must leave room for at least one free column and not exceed them")
    return [([*include, *free], list(free)) for free in combinations(columns, r - len(include))]


class _Combinations(RowEncoder):
    """Settings that arithmetic and text combinations share."""

    columns = setting("columns", "columns to combine", _TEXTS)
    include = setting("include", "columns that take part in every combination", _TEXTS)
    exclude = setting("exclude", "columns left out if none are named", _TEXTS)
    r = setting("r", "columns of one combination", TypeConverters.toInt)
    prefix = setting("prefix", "prefix of the new columns", _TEXT)
    suffix = setting("suffix", "suffix of the new columns", _TEXT)
    drop_origin = setting("drop_origin", "whether the combined columns go", TypeConverters.toBoolean)

    def _candidates(self, df: DataFrame) -> list[str]:
        return df.columns

    def _chosen(self, df: DataFrame) -> list[str]:
        left_out = {*self.value("exclude"), *self.value("include")}
        return self.value("columns") or [c for c in self._candidates(df) if c not in left_out]

    def _named(self, together: Sequence[str], free: Sequence[str]) -> tuple[str, Column]:
        raise NotImplementedError

    def _build(self, df: DataFrame) -> list[Column]:
        new: dict[str, Column] = {}
        for together, free in _combined(self._chosen(df), self.value("include"), self.value("r")):
            middle, column = self._named(together, free)
            name = self.value("prefix") + middle + self.value("suffix")
            new.setdefault(name, column.alias(name))
        return list(new.values())

    def _dropped(self, df: DataFrame) -> list[str]:
        return [*self.value("include"), *self._chosen(df)] if self.value("drop_origin") else []


class ArithmeticCombinations(_Combinations):
    """Sums (null as 0) or products (null poisons) of every combination of ``r`` columns.

    ``include`` columns take part in all of them. No columns named means all but
    the ``exclude`` ones; ``drop_origin`` drops the combined columns.
    """

    operator = setting("operator", "+ or *", _TEXT)

    _HOW = {"+": sum_of, "*": product_of}

    def __init__(
        self,
        columns: Sequence[str] = (),
        *,
        operator: str = "+",
        include: Sequence[str] = (),
        exclude: Sequence[str] = (),
        r: int = 2,
        prefix: str = "",
        suffix: str = "_combi",
        drop_origin: bool = False,
    ):
        super().__init__()
        self._configure(
            columns=list(columns), operator=operator, include=list(include), exclude=list(exclude), r=r,
            prefix=prefix, suffix=suffix, drop_origin=drop_origin,
        )
        self._how()

    def _how(self) -> Callable[[Sequence[str]], Column]:
        operator = self.value("operator")
        if operator not in self._HOW:
            raise ValueError(f"operator {operator!r} is not one of + and *")
        return self._HOW[operator]

    def _named(self, together: Sequence[str], free: Sequence[str]) -> tuple[str, Column]:
        name = self.value("operator").join([*self.value("include"), *sorted(free)])
        return name, self._how()(together)


class StringCombinations(_Combinations):
    """Joined text of every combination of ``r`` columns; one null makes it null.

    No columns named means all text columns but the ``exclude`` ones.
    """

    separator = setting("separator", "text between the columns", _TEXT)

    def __init__(
        self,
        columns: Sequence[str] = (),
        *,
        separator: str = " ",
        include: Sequence[str] = (),
        exclude: Sequence[str] = (),
        r: int = 2,
        prefix: str = "",
        suffix: str = "_concat",
        drop_origin: bool = False,
    ):
        super().__init__()
        self._configure(
            columns=list(columns), separator=separator, include=list(include), exclude=list(exclude), r=r,
            prefix=prefix, suffix=suffix, drop_origin=drop_origin,
        )

    def _candidates(self, df: DataFrame) -> list[str]:
        return [c for c, kind in df.dtypes if kind == "string"]

    def _named(self, together: Sequence[str], free: Sequence[str]) -> tuple[str, Column]:
        separator = self.value("separator")
        return separator.join(together), joined_text(together, separator)


class CategoryCrosses(RowEncoder):
    """Column ``a+b`` for every combination of ``r`` columns, null written as ``NULL``."""

    columns = setting("columns", "columns to cross", _TEXTS)
    r = setting("r", "columns of one cross", TypeConverters.toInt)

    def __init__(self, columns: Sequence[str] = (), r: int = 2):
        super().__init__()
        self._configure(columns=list(columns), r=r)
        if columns:
            self._sets()

    def _sets(self) -> list[tuple[str, ...]]:
        if not 0 < self.value("r") <= len(self.value("columns")):
            raise ValueError("r must be between 1 and the number of columns")
        return list(combinations(self.value("columns"), self.value("r")))

    def _build(self, df: DataFrame) -> list[Column]:
        return [crossed_text(c).alias("+".join(c)) for c in self._sets()]


raw = RawColumns
null_flags = NullFlags
arithmetic_combinations = ArithmeticCombinations
string_combinations = StringCombinations
category_crosses = CategoryCrosses


# --- dictionaries of categories ----------------------------------------------


def first_appearance(df: DataFrame, columns: Sequence[str], id_col: str) -> DataFrame:
    """(col, val, code): codes 1, 2, ... per column by the smallest id a value occurs with.

    All columns are numbered in one pass. A null value is numbered like others.
    """
    long = df.select(id_col, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [id_col], list(columns), "col", "val"
    )
    seen = long.groupBy("col", "val").agg(F.min(id_col).alias("_first"))
    # Ranges of the first ids themselves: most categories may first occur in a few early rows.
    numbered = running_sums(seen, ["_first"], {"_before": F.lit(1).cast("long")}, keys=["col"])
    return numbered.select("col", "val", (F.col("_before") + 1).cast("int").alias("code"))


def _lookup(df: DataFrame, table: DataFrame, column: str, value: str, out: str) -> DataFrame:
    """Left-join one column's dictionary; null finds null.

    The dictionary has one row per value. AQE broadcasts it when small at run
    time, and splits heavy values over tasks when it is not.
    """
    entries = table.filter(F.col("col") == column).select(
        F.struct("val").alias("_entry"), F.col(value).alias(out)
    )
    asked = F.struct(F.col(column).cast("string").alias("val"))
    return df.join(entries, asked == F.col("_entry"), "left").drop("_entry")


class OrdinalModel(TableModel):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = dataset
        names = {c: self.options["prefix"] + c for c in self.options["columns"]}
        for column, name in names.items():
            out = _lookup(out, self.table, column, "code", name)
        filled = {
            name: F.coalesce(name, F.when(F.col(c).isNull(), MISSING).otherwise(UNKNOWN))
            for c, name in names.items()
        }
        return out.withColumns(filled)


class OrdinalEncoder(Estimator, Configured):
    """Category codes in order of first appearance, by the smallest id.

    Unknown values get -1; null gets -2 unless nulls were seen in fitting, then
    null is a category of its own.
    """

    columns = setting("columns", "category columns", _TEXTS)
    id_col = setting("id_col", "column whose order numbers the categories", _TEXT)
    prefix = setting("prefix", "prefix of the code columns", _TEXT)

    def __init__(self, columns: Sequence[str] = (), id_col: str = "ID", prefix: str = "f_c_"):
        super().__init__()
        self._configure(columns=list(columns), id_col=id_col, prefix=prefix)

    def _fit(self, dataset: DataFrame) -> OrdinalModel:
        columns = self.value("columns")
        table = staged(first_appearance(dataset, columns, self.value("id_col")))
        return OrdinalModel({"columns": columns, "prefix": self.value("prefix")}, table)


class OneHotModel(TableModel):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        column = self.options["column"]
        coded = _lookup(dataset, self.table, column, "code", "_code")
        new = [
            F.coalesce((F.col("_code") == k).cast("int"), F.lit(0)).alias(f"{column}_{k}")
            for k in self.options["codes"]
        ]
        return coded.select(*dataset.columns, *new)


class OneHotEncoder(Estimator, Configured):
    """0/1 columns ``{column}_{k}``, k by first appearance; constant columns are dropped.

    ``drop_last`` leaves out the last category, as a baseline for linear models.
    One column per category makes sense for few of them: more than
    ``max_columns`` is an error.
    """

    column = setting("column", "category column", _TEXT)
    id_col = setting("id_col", "column whose order numbers the categories", _TEXT)
    drop_last = setting("drop_last", "whether the last category has no column", TypeConverters.toBoolean)
    max_columns = setting("max_columns", "most categories that are not an error", TypeConverters.toInt)

    def __init__(
        self, column: str = "", id_col: str = "ID", *, drop_last: bool = True, max_columns: int = 1000
    ):
        super().__init__()
        self._configure(column=column, id_col=id_col, drop_last=drop_last, max_columns=max_columns)

    def _fit(self, dataset: DataFrame) -> OneHotModel:
        column, most = self.value("column"), self.value("max_columns")
        table = staged(first_appearance(dataset, [column], self.value("id_col")))
        n = table.count()
        if n > most:
            raise ValueError(f"{n} categories in {column}, at most {most}")
        # With one category its indicator is constant; otherwise every one varies.
        codes = list(range(1, n + 1)) if n > 1 else []
        if self.value("drop_last") and codes:
            codes.pop()
        return OneHotModel({"column": column, "codes": codes}, table)


class TargetMeanModel(TableModel):
    """Category means of the target. ``transform`` is for new rows."""

    def _name(self, column: str) -> str:
        return f"{self.options['prefix']}te_by_{self.options['target']}_{column}"

    def _mean(self, total: Column, n: Column) -> Column:
        m, prior = self.options["smoothing"], F.lit(self.options["prior"])
        return F.when(n > 0, (total + m * prior) / (n + m)) if m else F.try_divide(total, n)

    def _coded(self, column: str, name: str) -> Column:
        return F.when(F.col(column).isNull(), float(MISSING)).otherwise(
            F.coalesce(F.col(name), F.lit(float(UNKNOWN)))
        )

    def _transform(self, dataset: DataFrame) -> DataFrame:
        means = self.table.groupBy("col", "val").agg(
            self._mean(F.sum("_sum"), F.sum("_n")).alias("_mean")
        )
        out = dataset
        names = {c: self._name(c) for c in self.options["columns"]}
        for column, name in names.items():
            out = _lookup(out, means, column, "_mean", name)
        return out.withColumns({n: self._coded(c, n) for c, n in names.items()})

    def out_of_fold(self, dataset: DataFrame, fold_col: str) -> DataFrame:
        """For the fitted rows: each row's mean leaves out the rows of its own fold."""
        totals = self.table.groupBy("col", "val").agg(
            F.sum("_sum").alias("_ts"), F.sum("_n").alias("_tn")
        )
        others = self.table.join(
            totals, ["col", "val"]
        ).select(
            "col",
            "val",
            "_fold",
            self._mean(F.col("_ts") - F.col("_sum"), F.col("_tn") - F.col("_n")).alias("_mean"),
        )
        out = dataset
        names = {c: self._name(c) for c in self.options["columns"]}
        for column, name in names.items():
            entries = others.filter(F.col("col") == column).select(
                F.col("val").alias("_val"), "_fold", F.col("_mean").alias(name)
            )
            same = (F.col(column).cast("string") == F.col("_val")) & (F.col(fold_col) == F.col("_fold"))
            out = out.join(entries, same, "left").drop("_val", "_fold")
        return out.withColumns({n: self._coded(c, n) for c, n in names.items()})


class TargetMeanEncoder(Estimator, Configured):
    """Mean target per category, named ``{prefix}te_by_{target}_{column}``.

    ``smoothing`` m mixes in m rows of the overall mean. ``fit_transform`` gives
    out-of-fold means for the fitted rows; the model's ``transform`` gives full
    means for other rows. Unknown categories get -1, missing ones -2.
    """

    columns = setting("columns", "category columns", _TEXTS)
    target = setting("target", "column whose mean is taken", _TEXT)
    id_col = setting("id_col", "unique key that folds are drawn from", _TEXT)
    n_splits = setting("n_splits", "folds of fit_transform", TypeConverters.toInt)
    seed = setting("seed", "seed of the folds", TypeConverters.toInt)
    smoothing = setting("smoothing", "rows of the overall mean mixed in", TypeConverters.toFloat)
    prefix = setting("prefix", "prefix of the new columns", _TEXT)
    fold_col = setting("fold_col", "column with given folds", _TEXT)

    def __init__(
        self,
        columns: Sequence[str] = (),
        target: str = "",
        id_col: str = "ID",
        *,
        n_splits: int = 5,
        seed: int = 42,
        smoothing: float = 0.0,
        prefix: str = "f_",
        fold_col: str | None = None,
    ):
        super().__init__()
        self._configure(
            columns=list(columns), target=target, id_col=id_col, n_splits=n_splits, seed=seed,
            smoothing=smoothing, prefix=prefix, fold_col=fold_col,
        )

    def _folded(self, dataset: DataFrame) -> DataFrame:
        if self.value("fold_col"):
            return dataset.withColumn("_fold", F.col(self.value("fold_col")))
        return assign_folds(
            dataset, self.value("id_col"), self.value("n_splits"), self.value("seed"), fold_col="_fold"
        )

    def _fit_folded(self, folded: DataFrame) -> TargetMeanModel:
        columns, target = self.value("columns"), self.value("target")
        long = folded.select(
            F.col(target).cast("double").alias("_y"),
            "_fold",
            *[F.col(c).cast("string").alias(c) for c in columns],
        ).unpivot(["_y", "_fold"], columns, "col", "val")
        table = staged(
            long.filter(F.col("val").isNotNull() & F.col("_y").isNotNull())
            .groupBy("col", "val", "_fold")
            .agg(F.sum("_y").alias("_sum"), F.count(F.lit(1)).alias("_n"))
        )
        prior = folded.agg(F.avg(target)).first()[0] if self.value("smoothing") else 0.0
        options = {
            "columns": columns,
            "target": target,
            "prefix": self.value("prefix"),
            "smoothing": self.value("smoothing"),
            "prior": prior,
        }
        return TargetMeanModel(options, table)

    def _fit(self, dataset: DataFrame) -> TargetMeanModel:
        return self._fit_folded(self._folded(dataset))

    def fit_transform(self, dataset: DataFrame) -> DataFrame:
        folded = self._folded(dataset).withColumnRenamed("_fold", "_own")
        model = self._fit_folded(folded.withColumnRenamed("_own", "_fold"))
        return model.out_of_fold(folded, "_own").drop("_own")


# --- statistics of groups ----------------------------------------------------

#: Deviation transforms: the statistics each needs, and its formula.
DEVIATIONS: dict[str, tuple[tuple[str, ...], Callable[..., Column]]] = {
    "z-score": (("val", "mean", "std"), lambda val, mean, std: F.try_divide(val - mean, std)),
    "med-abs-dev": (("val", "median"), lambda val, median: F.abs(val - median)),
    "mean-diff": (("val", "mean"), lambda val, mean: val - mean),
    "median-diff": (("val", "median"), lambda val, median: val - median),
    "mean-ratio": (("val", "mean"), lambda val, mean: F.try_divide(val, mean)),
    "range": (("min", "max"), lambda min, max: max - min),
}


class GroupStatisticsModel(TableModel):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        o = self.options
        renamed = {n: f"{n}_grpby_{o['group_name']}" for n in o["names"]}
        stats = self.table.withColumnsRenamed({n: o["prefix"] + r for n, r in renamed.items()})
        joined = dataset.join(stats, o["keys"], "left")

        def operand(role: str, name: str) -> Column:
            return F.col(name if role == "val" else o["prefix"] + renamed[name])

        new = {}
        for spec in o["deviations"]:
            roles, formula = DEVIATIONS[spec["method"]]
            named = "_".join(
                spec[r] for r in (("val",) if "val" in roles else ("max", "min"))
            )
            name = f"{o['prefix']}{spec['method']}_{named}_grpby_{o['group_name']}"
            new[name] = formula(**{r: operand(r, spec[r]) for r in roles})
        return joined.select(
            *dataset.columns,
            *[o["prefix"] + r for r in renamed.values()],
            *[c.alias(n) for n, c in new.items()],
        )


class GroupStatisticsEncoder(Estimator, Configured):
    """Aggregates of the fitted rows by group keys, joined to any rows.

    ``aggregates``: aliased aggregate columns, or SQL texts such as ``avg(x) AS mean``; only
    an encoder given texts can be saved. ``quantile_columns``: alias ->
    (column, probability), computed exactly and spread over tasks, which the
    built-in median is not. Outputs are ``{prefix}{alias}_grpby_{k1_x_k2}``.
    ``deviations``: dicts with a ``method`` of DEVIATIONS and the names of its
    operands (``val`` a column of the rows, others aliases of aggregates).
    Null keys match nothing.
    """

    keys = setting("keys", "group keys", _TEXTS)
    aggregate_texts = setting("aggregate_texts", "aggregates as SQL", _TEXTS)
    quantile_columns = setting("quantile_columns", "alias -> (column, probability)")
    deviations = setting("deviations", "methods and their operands")
    prefix = setting("prefix", "prefix of the new columns", _TEXT)

    def __init__(
        self,
        keys: str | Sequence[str] = (),
        aggregates: Sequence[Column | str] = (),
        *,
        quantile_columns: Mapping[str, tuple[str, float]] | None = None,
        deviations: Sequence[Mapping[str, str]] = (),
        prefix: str = "f_",
    ):
        super().__init__()
        #: Column objects have no text that Spark reads back, so they are no Param.
        self.aggregates = [a for a in aggregates if not isinstance(a, str)]
        self._configure(
            keys=[keys] if isinstance(keys, str) else list(keys),
            aggregate_texts=[a for a in aggregates if isinstance(a, str)],
            quantile_columns={k: list(v) for k, v in (quantile_columns or {}).items()},
            deviations=[dict(d) for d in deviations],
            prefix=prefix,
        )
        for spec in self.value("deviations"):
            wanted = DEVIATIONS[spec["method"]][0]
            if set(spec) != {"method", *wanted}:
                raise ValueError(f"{spec['method']} needs exactly {wanted}")

    def write(self) -> MLWriter:
        if self.aggregates:
            raise ValueError("give the aggregates as SQL texts to save this encoder")
        return super().write()

    def _fit(self, dataset: DataFrame) -> GroupStatisticsModel:
        keys = self.value("keys")
        known = dataset.dropna(subset=keys)
        aggregates = [*self.aggregates, *map(F.expr, self.value("aggregate_texts"))]
        table = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *aggregates)
        for alias, (column, prob) in self.value("quantile_columns").items():
            found = quantiles(known, column, [prob], keys=keys).select(
                *keys, F.col("quantile").alias(alias)
            )
            table = table.join(found, keys, "left")
        table = staged(table.drop("_n"))
        options = {
            "keys": keys,
            "group_name": "_x_".join(keys),
            "names": [c for c in table.columns if c not in keys],
            "deviations": self.value("deviations"),
            "prefix": self.value("prefix"),
        }
        return GroupStatisticsModel(options, table)


# --- numeric columns ---------------------------------------------------------


class ShiftScaleModel(TableModel):
    """(x - center) / scale per column; the table has one row per column."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        # One row per column of the request, each with three numbers.
        rows = {r["col"]: r for r in self.table.collect()}
        new = {
            self.options["prefix"] + c: (F.col(c) - F.lit(rows[c]["center"])) / F.lit(rows[c]["scale"])
            for c in self.options["columns"]
        }
        return dataset.withColumns(new)


class ScalingEncoder(Estimator, Configured):
    """``standard`` (mean, population deviation), ``minmax`` or ``robust`` (median, IQR).

    A column without spread is only shifted.
    """

    columns = setting("columns", "numeric columns", _TEXTS)
    method = setting("method", "standard, minmax or robust", _TEXT)
    prefix = setting("prefix", "prefix of the scaled columns", _TEXT)

    def __init__(self, columns: Sequence[str] = (), method: str = "standard", prefix: str = ""):
        super().__init__()
        self._configure(columns=list(columns), method=method, prefix=prefix)
        self._method()

    def _method(self) -> str:
        method = self.value("method")
        if method not in ("standard", "minmax", "robust"):
            raise ValueError(f"unknown scaling method {method!r}")
        return method

    def _fit(self, dataset: DataFrame) -> ShiftScaleModel:
        columns, method = self.value("columns"), self._method()
        long = dataset.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
            [], columns, "col", "x"
        )
        if method == "robust":
            found = (
                quantiles(long, "x", [0.25, 0.5, 0.75], keys=["col"])
                .groupBy("col")
                .pivot("prob", [0.25, 0.5, 0.75])
                .agg(F.first("quantile"))
            )
            table = found.select(
                "col",
                F.col("`0.5`").alias("center"),
                (F.col("`0.75`") - F.col("`0.25`")).alias("scale"),
            )
        else:
            center, spread = {
                "standard": (F.avg("x"), F.stddev_pop("x")),
                "minmax": (F.min("x"), F.max("x") - F.min("x")),
            }[method]
            table = long.groupBy("col").agg(center.alias("center"), spread.alias("scale"))
        scale = F.when(F.col("scale") == 0, 1.0).otherwise(F.col("scale"))
        table = staged(table.withColumn("scale", scale))
        return ShiftScaleModel({"columns": columns, "prefix": self.value("prefix")}, table)


class MeanImputerModel(TableModel):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        means = self.table.first().asDict()
        return dataset.withColumns(
            {
                self.options["prefix"] + c: F.coalesce(F.col(c).cast("double"), F.lit(means[c]))
                for c in self.options["columns"]
            }
        )


class MeanImputer(Estimator, Configured):
    """Null becomes the mean of the fitted rows."""

    columns = setting("columns", "numeric columns", _TEXTS)
    prefix = setting("prefix", "prefix of the filled columns", _TEXT)

    def __init__(self, columns: Sequence[str] = (), prefix: str = ""):
        super().__init__()
        self._configure(columns=list(columns), prefix=prefix)

    def _fit(self, dataset: DataFrame) -> MeanImputerModel:
        columns = self.value("columns")
        table = staged(dataset.agg(*[F.avg(c).alias(c) for c in columns]))
        return MeanImputerModel({"columns": columns, "prefix": self.value("prefix")}, table)


class QuantileBinsModel(TableModel):
    """Adds ``{c}_bin`` (0-based) and ``{c}_frac``, the linear position inside the bin."""

    def edges(self) -> dict[str, list[float]]:
        """Distinct bin edges per column: at most n_bins + 1 numbers each."""
        found: dict[str, set[float]] = {c: set() for c in self.options["columns"]}
        for row in self.table.collect():
            found[row["col"]].add(row["quantile"])
        return {c: sorted(v) for c, v in found.items()}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = dataset
        new = {}
        for column, edges in self.edges().items():
            out = with_range(out, column, edges[1:-1], f"{column}_bin")
            index = F.when(F.col(column).isNotNull(), F.col(f"{column}_bin"))
            points = F.array(*[F.lit(e) for e in edges])
            low, high = F.get(points, index), F.get(points, index + 1)
            new[f"{column}_bin"] = index
            new[f"{column}_frac"] = F.try_divide(F.col(column) - low, high - low)
        return out.withColumns(new)


class QuantileBinsEncoder(Estimator, Configured):
    """Equal-frequency bins with a linear fraction inside, for piecewise-linear features."""

    columns = setting("columns", "numeric columns", _TEXTS)
    n_bins = setting("n_bins", "bins of each column", TypeConverters.toInt)

    def __init__(self, columns: Sequence[str] = (), n_bins: int = 52):
        super().__init__()
        self._configure(columns=list(columns), n_bins=n_bins)

    def _fit(self, dataset: DataFrame) -> QuantileBinsModel:
        columns, n_bins = self.value("columns"), self.value("n_bins")
        long = dataset.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
            [], columns, "col", "x"
        )
        probs = [i / n_bins for i in range(n_bins + 1)]
        table = staged(quantiles(long, "x", probs, keys=["col"]))
        return QuantileBinsModel({"columns": columns}, table)
