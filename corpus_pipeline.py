"""A corpus cleaning pipeline: toxicity, near-duplicates, repeated passages, privacy, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's docs. All but the last return the columns of
``documents``; texts that a stage changes get their new length in ``n_chars``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from survloom.llm import packing, privacy, simhash, substrings, toxicity
from survloom.llm.common import free, table
from survloom.settings import staged


def _measured(before: DataFrame, after: DataFrame) -> DataFrame:
    """The columns of ``before``, with the length of the text as it now is."""
    if "n_chars" in before.columns:
        after = after.withColumn("n_chars", F.char_length("text").cast(before.schema["n_chars"].dataType))
    return after.select(*before.columns)


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go; the model is fitted on labelled documents among them."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    output = free(docs, "toxicity")
    scored = toxicity.score(docs, model, output=output)
    return scored.filter(F.col(output) < toxicity.THRESHOLD).select(*docs.columns)


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_one(docs)


def passages_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines and passages stay where they stand first; no document is dropped."""
    return _measured(docs, substrings.deduplicate(docs, spans=free(docs, "removed")))


def private_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that disclose them are replaced; no document is dropped."""
    return _measured(docs, privacy.sanitise(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences; one row per piece."""
    return packing.pack(docs, *packing.tokenizer_file())


STAGES = [
    ("toxicity", toxic_out),
    ("simhash", near_duplicates_out),
    ("substrings", passages_out),
    ("privacy", private_out),
    ("packing", packed),
]

#: Hashing, learning and tokenising stages have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
