"""Substring deduplication by hashing of lines and the sentences in them.

A text is cut at line breaks, at sentence ends, and before a capitalised word that
follows a lower-case one; the last cut finds passages that were pasted into the
middle of a line. A part of fewer than ``LEAST_PART`` words goes with the part before
it; that depends on the part alone, so equal passages are cut alike wherever they
stand. Units are normalised (white space and case), hashed to 128 bits and grouped over
all texts. The occurrence that ranks first stays: by document id, then by place. All
others are removed where they, with removed neighbours, make at least ``LEAST_WORDS``
words: short phrases that recur by chance stay. Offsets (code points of the original
text, end exclusive) of what was removed are kept.

Rows without an id rank last, by their text's hash. Rows that repeat id and text are
one document with one result. A null text stays null, an empty one empty. Texts of any
length are cut whole; an empty table gives an empty table. Other columns are kept, whatever
their names. Grouping aggregates before it shuffles, and the join back is a plain
equi-join that adaptive execution splits, so a unit may hold any share of all rows.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from survloom.llm.common import batch_of, free, sliced, table, text_of
from survloom.settings import staged

#: Words of a unit, and of a removed run of units, at least.
LEAST_PART, LEAST_WORDS = 4, 8

_BREAK = re.compile(r"(?:(?<=[.!?…])\s+|(?:(?<=[a-zß-öø-ÿ])|(?<=[a-zß-öø-ÿ][,;:])) +(?=[A-ZÀ-ÖØ-Þ]))(?=\S)")
_WORD = re.compile(r"\S+")


def units(text: str) -> list[tuple[int, int, int]]:
    """Start, end and number of words of each unit of a text, in order."""
    out: list[tuple[int, int, int]] = []
    line_start = 0
    for line in text.split("\n"):
        first = len(out)
        bounds = [0, *(m.end() for m in _BREAK.finditer(line)), len(line)]
        for start, end in zip(bounds, bounds[1:], strict=False):
            part = line[start:end]
            n = len(part.split())
            if not n:
                continue
            begin = line_start + start + (len(part) - len(part.lstrip()))
            stop = line_start + start + len(part.rstrip())
            if n < LEAST_PART and len(out) > first:
                begin, n = out[-1][0], out[-1][2] + n
                out[-1] = (begin, stop, n)
            else:
                out.append((begin, stop, n))
        line_start += len(line) + 1
    return out


def digest(unit: str) -> tuple[int, int]:
    """Two halves of a 128-bit hash of the normalised unit."""
    return struct.unpack("<qq", hashlib.md5(" ".join(unit.lower().split()).encode()).digest())


def cut_out(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans; white space around a cut becomes one separator."""
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at:start])
        at = end
    kept.append(text[at:])
    out = kept[0]
    for piece in kept[1:]:
        edge = out[len(out.rstrip()) :] + piece[: len(piece) - len(piece.lstrip())]
        out, piece = out.rstrip(), piece.lstrip()
        out += ("\n" if "\n" in edge else " " if edge else "") + piece if out and piece else piece
    return out


def _listed(docs: DataFrame) -> DataFrame:
    """One row per unit: hash halves, document, number, offsets and words."""
    kinds = (("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32()))
    arrow = pa.schema(list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in sliced(batches, "text"):
            out = []
            for doc_id, key, text in zip(rows.column("doc_id").to_pylist(), rows.column("key").to_pylist(), texts, strict=True):
                out.extend((*digest(text[s:e]), doc_id, key, n, s, e, w) for n, (s, e, w) in enumerate(units(text)))
            if out:
                yield batch_of(arrow, dict(zip(arrow.names, map(list, zip(*out, strict=True)), strict=True)))

    return docs.select("doc_id", "key", "text").mapInArrow(run, "h1 long, h2 long, doc_id long, key long, n int, start int, end int, words int")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Spans to remove: columns doc_id, key and spans (array of start and end, in order).

    ``docs`` has doc_id (long), key (hash of the text) and text.
    """
    found = staged(_listed(docs), "units")
    rank = F.struct(F.col("doc_id").isNull().alias("anonymous"), "doc_id", "key", "n")
    grouped = found.groupBy("h1", "h2").agg(F.count("*").alias("times"), F.min(rank).alias("first")).filter("times > 1")
    later = found.join(grouped, ["h1", "h2"]).filter(rank != F.col("first")).select("doc_id", "key", "n", "start", "end", "words")
    per_document = later.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set(F.struct("n", "start", "end", "words"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = []
            for parts in rows.column("parts").to_pylist():
                spans, run_start, run_end, run_words, last = [], 0, 0, 0, None
                for p in [*parts, None]:
                    if p is not None and last is not None and p["n"] == last + 1:
                        run_end, run_words, last = p["end"], run_words + p["words"], p["n"]
                        continue
                    if last is not None and run_words >= LEAST_WORDS:
                        spans.append({"start": run_start, "end": run_end})
                    if p is not None:
                        run_start, run_end, run_words, last = p["start"], p["end"], p["words"], p["n"]
                out.append(spans)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("key"), pa.array(out, kind)], ["doc_id", "key", "spans"])

    spans = per_document.mapInArrow(run, "doc_id long, key long, spans array<struct<start:int, end:int>>")
    return spans.filter(F.size("spans") > 0)


def deduplicate(df: DataFrame, doc_id: str = "doc_id", text: str = "text", spans: str = "removed") -> DataFrame:
    """``df`` with the text cut, and an array of the removed spans of the original text."""
    own_id, own_key, rid, rkey, cuts = (free(df, x) for x in ("id", "key", "found_id", "found_key", "spans"))
    rows = df.drop(*([spans] if spans in df.columns and spans != text else []))
    rows = rows.withColumns({own_id: df[doc_id].cast("long"), own_key: F.xxhash64(text_of(df[text]))})
    docs = rows.select(F.col(own_id).alias("doc_id"), F.col(own_key).alias("key"), text_of(rows[text]).alias("text"))
    found = staged(repeated_spans(docs), "substrings")
    found = found.select(F.col("doc_id").alias(rid), F.col("key").alias(rkey), F.col("spans").alias(cuts))
    same = rows[own_id].eqNullSafe(found[rid]) & (rows[own_key] == found[rkey])
    joined = rows.join(found, same, "left").drop(rid, rkey, own_id, own_key)
    kept = [c for c in joined.columns if c not in (text, cuts)]
    names = [c if c != text else text for c in df.columns if c != spans] + [spans]
    span_type = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(text, T.StringType()), T.StructField(spans, span_type)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut, texts in sliced([batch], text):
                missing = cut.column(text).is_null().to_pylist()
                removed = [[(s["start"], s["end"]) for s in x or ()] for x in cut.column(cuts).to_pylist()]
                out = [None if gone else cut_out(t, r) if r else t for t, r, gone in zip(texts, removed, missing, strict=True)]
                lists = pa.array([[{"start": s, "end": e} for s, e in r] for r in removed], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
                yield pa.RecordBatch.from_arrays([*(cut.column(c) for c in kept), pa.array(out, pa.string()), lists], schema.names)

    return joined.mapInArrow(run, schema).select(*names)


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its cut text, and what was removed from it."""
    rows = deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return rows.select("doc_id", "text", "removed", F.size("removed").cast("long").alias("n_removed"), removed.alias("removed_chars"))
