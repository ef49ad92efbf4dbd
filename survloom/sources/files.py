"""CSV, JSON and Parquet ends of a job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    columns: Sequence[str] = (),
    *,
    multi_line: bool = False,
) -> DataFrame:
    """CSV with a header, quotes doubled; an empty field is null. Only named columns are parsed.

    With ``multi_line`` quoted values may hold line breaks; a file is then one
    task's work, since it cannot be split at a line.
    """
    df = spark.read.csv(
        path, header=True, schema=schema, mode="FAILFAST", quote='"', escape='"', multiLine=multi_line
    )
    return df.select(*columns) if columns else df


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, null as an empty field, and an empty text as a quoted one."""
    df.write.csv(path, header=True, emptyValue='""', nullValue="", quote='"', escape='"')


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Long predictions as Parquet in one folder per name and fold."""
    predictions.write.partitionBy("name", "fold").parquet(path)


def write_scores(scores: DataFrame, path: str) -> None:
    """(name, fold, score) as JSON lines."""
    scores.write.json(path)


def submission(predictions: DataFrame, id_col: str = "ID") -> DataFrame:
    """Id and prediction under the names of a submission file."""
    return predictions.select(id_col, F.col("pred").alias("prediction"))


_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def _common_type(types: Sequence[T.DataType]) -> T.DataType:
    found = set(types)
    if len(found) == 1:
        return types[0]
    if all(isinstance(t, (*_NUMERIC, T.DecimalType, T.BooleanType)) for t in found):
        if any(isinstance(t, (T.FloatType, T.DoubleType)) for t in found):
            return T.DoubleType()
        decimals = [t for t in found if isinstance(t, T.DecimalType)]
        if not decimals:
            return T.LongType()
        scale = max(t.scale for t in decimals)
        whole = max(19, *(t.precision - t.scale for t in decimals))
        return T.DecimalType(min(38, whole + scale), scale)
    if all(isinstance(t, (T.DateType, T.TimestampType)) for t in found):
        return T.TimestampType()
    return T.StringType()


def diagonal_union(*frames: DataFrame) -> DataFrame:
    """Union by name: missing columns are null, differing types meet in a common one."""
    seen: dict[str, list[T.DataType]] = {}
    for df in frames:
        for column in df.schema:
            seen.setdefault(column.name, []).append(column.dataType)
    target = {name: _common_type(types) for name, types in seen.items()}
    cast = [df.select(*[F.col(c).cast(target[c]).alias(c) for c in df.columns]) for df in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)


def tagged_union(parts: Mapping[str, DataFrame], *, dataset_col: str = "dataset") -> DataFrame:
    """Diagonal union of tables, each tagged with its name in ``dataset_col``."""
    return diagonal_union(
        *[df.withColumn(dataset_col, F.lit(tag)) for tag, df in parts.items()]
    )


def sorted_for_output(df: DataFrame, id_col: str, *, dataset_col: str = "dataset") -> DataFrame:
    """Dataset descending, id ascending: only for a sink that wants this order."""
    return df.orderBy(F.desc(dataset_col), F.asc(id_col))
