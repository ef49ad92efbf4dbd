"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """A text column with null read as empty."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(""))


def free(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have: the given one, after as many underscores as it takes."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def held_out(doc_id: str | Column) -> Column:
    """Whether a row is kept from learning: crc32 of the id as text, modulo 4, is 2.

    A row without an id counts as having the empty text as id (crc32 zero).
    """
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def sliced(batches: Iterator[pa.RecordBatch], text: str, max_chars: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut Arrow batches into runs of rows with about ``max_chars`` characters of text.

    A longer text comes alone; texts themselves are never cut.
    """
    for batch in batches:
        texts, start, size = [], 0, 0
        for i, value in enumerate(batch.column(text)):
            value = value.as_py() or ""
            if texts and size + len(value) > max_chars:
                yield batch.slice(start, i - start), texts
                texts, start, size = [], i, 0
            texts.append(value)
            size += len(value)
        if texts:
            yield batch.slice(start), texts


def batch_of(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    """A record batch from lists or arrays by column name."""
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=schema.field(n).type) for n, c in columns.items()]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)
