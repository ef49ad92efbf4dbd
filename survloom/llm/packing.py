"""Lexical retrieval packing: BM25 neighbours of a seed document fill its window.

Whole windows at the front of a long document stand alone. What is left of each
document (its tail, shorter than a window) is indexed: tails that share their most
telling token go to the same shard, shards hold a bounded number of tails, and each
has its own inverted index. Document frequencies and lengths are those of the whole
corpus. In a shard, a seed's unused neighbours fill its window in the order of
their BM25 scores; the last is cut where the window ends, and the rest of it seeds
the next window. So only the last window of a shard is padded.

A null text is empty (one closing token). Repeated rows are separate documents.
Ties of scores go to the row read first. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from survloom.llm import tokens
from survloom.llm.common import batch_of, sliced, table, text_of
from survloom.settings import staged

WINDOW = 1024
#: Tails of one shard, about; the index of a shard lives in one task.
SHARD_TAILS = 1024
#: The usual saturation and length weights of BM25.
K1, B = 1.2, 0.75

_HEAD, _TAIL, _FREQUENCIES = 0, 1, 2
_CUT_SCHEMA = (
    "kind int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, topic int, ids binary, counts binary"
)
_PIECES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
_PIECE_SCHEMA = ", ".join(f"{n} long" for n in _PIECES)


def _tokenised(rows: DataFrame, tokenizer: str, pattern: str, closing: int, window: int) -> DataFrame:
    """Whole windows (only their digests), tails with ids, and tail frequencies per task."""
    arrow = pa.schema(
        [("kind", pa.int32()), *((n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")),
         ("topic", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokens.load(tokenizer)
        encoder = tokens.rank_encoder(model, pattern)
        frequency = np.zeros(model.get_vocab_size(with_added_tokens=True), np.int64)
        # Ids of such vocabularies are in the order of merging, from frequent to rare.
        rarity = np.log(2.0 + np.arange(len(frequency)))
        end = tokens.packed([closing])
        for batch, texts in sliced(batches, "text"):
            out = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder(texts), strict=True):
                data = ids + end
                total = len(data) // 4
                whole = total - total % window
                for start in range(0, whole, window):
                    crc = zlib.crc32(data[4 * start : 4 * (start + window)])
                    out.append((_HEAD, doc_id, start, window, crc, total, None, None, None))
                if whole < total:
                    tail = data[4 * whole :]
                    terms, tf = np.unique(np.frombuffer(tail, "<u4"), return_counts=True)
                    frequency[terms] += 1
                    topic = int(terms[np.argmax(tf * rarity[terms])])
                    out.append((_TAIL, doc_id, whole, total - whole, None, total, topic, tail, None))
            yield batch_of(arrow, dict(zip(arrow.names, map(list, zip(*out, strict=True)), strict=True)))
        used = np.flatnonzero(frequency)
        if len(used):
            row = [_FREQUENCIES, *[None] * 6, used.astype("<i4").tobytes(), frequency[used].astype("<i8").tobytes()]
            yield batch_of(arrow, dict(zip(arrow.names, ([v] for v in row), strict=True)))

    return rows.mapInArrow(run, _CUT_SCHEMA)


def _document_frequencies(cut: DataFrame, size: int) -> np.ndarray:
    """Tails that hold each id, over the corpus: one number per vocabulary entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for ids, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[np.frombuffer(ids, "<i4")] += np.frombuffer(counts, "<i8")
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["term", "n"])

    rows = cut.filter(F.col("kind") == _FREQUENCIES).select("ids", "counts").mapInArrow(run, "term int, n long")
    out = np.zeros(size, np.int64)
    for term, n in rows.groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[term] = n
    return out


def _shards(tails: DataFrame, size: int) -> DataFrame:
    """Add each tail's shard: topics side by side up to ``size`` tails, large topics split.

    The table of topics has at most one row per vocabulary entry, so it is broadcast.
    """
    counts = sorted(tails.groupBy("topic").count().toLocalIterator())
    rows, shard, filled = [], 0, 0
    for topic, n in counts:
        if n > size:
            shard += bool(filled)
            parts = -(-n // size)
            rows.append((topic, shard, parts))
            shard, filled = shard + parts, 0
            continue
        if filled + n > size:
            shard, filled = shard + 1, 0
        rows.append((topic, shard, 1))
        filled += n
    places = tails.sparkSession.createDataFrame(rows, "topic int, first long, parts int")
    part = F.pmod(F.xxhash64("row"), F.col("parts"))
    return tails.join(F.broadcast(places), "topic").withColumn("shard", F.col("first") + part).drop("first", "parts")


class _Index:
    """Inverted index of one shard with BM25 weights."""

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, mean_length: float):
        self.size = len(tails)
        length = np.array([len(t) for t in tails], np.int64)
        doc = np.repeat(np.arange(self.size), length)
        width = len(idf)
        pair, tf = np.unique(doc * width + np.concatenate(tails), return_counts=True)
        doc, term = pair // width, pair % width
        norm = K1 * (1 - B + B * length[doc] / mean_length)
        weight = idf[term] * tf * (K1 + 1) / (tf + norm)
        # A term of more than half of all tails weighs nothing: it has no postings.
        doc, term, weight = (x[idf[term] > 0] for x in (doc, term, weight))
        self._first = np.searchsorted(doc, np.arange(self.size + 1))
        self._terms = term
        order = np.argsort(term, kind="stable")
        self._doc, self._weight = doc[order], weight[order]
        self._posting = np.searchsorted(term[order], np.arange(width + 1))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 score of every tail of the shard for the terms of one tail."""
        terms = self._terms[self._first[seed] : self._first[seed + 1]]
        start, length = self._posting[terms], self._posting[terms + 1] - self._posting[terms]
        ends = np.cumsum(length)
        at = np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)
        return np.bincount(self._doc[at], weights=self._weight[at], minlength=self.size)


def _fill(lengths: list[int], index: _Index, window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Cut tails into windows: (tail, from, length, window number, offset in the window)."""
    unused = np.ones(len(lengths), bool)
    number = offset = next_seed = 0
    seed, done = -1, 0  # the tail that opens the window, and how much of it is placed

    def place(tail: int, begin: int) -> Iterator[tuple[int, int, int, int, int]]:
        nonlocal offset, seed, done
        take = min(lengths[tail] - begin, window - offset)
        yield tail, begin, take, number, offset
        offset += take
        seed, done = (tail, begin + take) if begin + take < lengths[tail] else (-1, 0)

    while True:
        if seed < 0:
            while next_seed < len(lengths) and not unused[next_seed]:
                next_seed += 1
            if next_seed == len(lengths):
                return
            seed, done = next_seed, 0
            unused[seed] = False
        opened = seed
        yield from place(seed, done)
        if offset < window and unused.any():
            scores = np.where(unused, index.scores(opened), -1.0)
            for tail in np.argsort(-scores, kind="stable"):
                if scores[tail] < 0 or offset == window:
                    break
                unused[tail] = False
                yield from place(int(tail), 0)
        if offset == window or not unused.any() and seed < 0:
            number, offset = number + 1, 0


def pack(
    df: DataFrame, tokenizer: str, pattern: str, closing: int = 0, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pack documents into sequences of at most ``window`` ids; one row per piece.

    ``tokenizer`` is the JSON text of a byte-level tokenizer and ``pattern`` its
    splitting pattern; the id ``closing`` ends each document.
    """
    rows = df.select(df[doc_id].cast("long").alias("doc_id"), text_of(df[text]).alias("text"))
    cut = staged(_tokenised(rows, tokenizer, pattern, closing, window), "packing")
    tails = cut.filter(F.col("kind") == _TAIL).withColumn("row", F.monotonically_increasing_id())
    vocabulary = tokens.load(tokenizer).get_vocab_size(with_added_tokens=True)
    n, mean_length = tails.agg(F.count("*"), F.avg("length")).first()
    frequency = _document_frequencies(cut, vocabulary)
    idf = np.maximum(0.0, np.log((n - frequency + 0.5) / (frequency + 0.5)))
    mean_length = mean_length or 1.0
    arrow = pa.schema([(name, pa.int64()) for name in _PIECES])

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("row")
        shard = group.column("shard")[0].as_py()
        ids, starts, docs, totals = (group.column(c).to_pylist() for c in ("ids", "start", "doc_id", "doc_tokens"))
        arrays = [np.frombuffer(i, "<u4").astype(np.int64) for i in ids]
        index = _Index(arrays, idf, mean_length)
        out = []
        for tail, begin, length, number, offset in _fill([len(a) for a in arrays], index, window):
            crc = zlib.crc32(ids[tail][4 * begin : 4 * (begin + length)])
            sequence = 2 * ((shard << 24) | number)
            out.append((docs[tail], starts[tail] + begin, length, crc, totals[tail], sequence, offset))
        columns = map(list, zip(*out, strict=True)) if out else [[]] * len(_PIECES)
        return pa.table([pa.array(c, pa.int64()) for c in columns], schema=arrow)

    packed = _shards(tails, SHARD_TAILS).select("shard", "row", "doc_id", "start", "doc_tokens", "ids")
    packed = packed.groupBy("shard").applyInArrow(run, _PIECE_SCHEMA)
    heads = cut.filter(F.col("kind") == _HEAD).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (2 * F.monotonically_increasing_id() + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    return heads.unionByName(packed)


def tokenizer_file(path: str | None = None) -> tuple[str, str]:
    """JSON text of a tokenizer file and its splitting pattern."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return file.read(), public_tokenizers.PATTERN


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 ids."""
    return pack(table(spark, sf_dir, "documents"), *tokenizer_file())
