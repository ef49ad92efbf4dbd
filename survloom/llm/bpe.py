"""Byte-level BPE encoding and decoding over Arrow batches.

Empty and null texts have no ids; repeated rows give repeated rows; other columns
stay as they are unless an output column replaces one of the same name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from survloom.llm import tokens
from survloom.llm.common import batch_of, sliced, table, text_of


def from_rank_file(path: str | None = None, pattern: str | None = None) -> str:
    """JSON text of a tokenizer with the ranks of a file; a few MB at most."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = tokens.read_ranks(file.read())
    return tokens.tokenizer_from_ranks(ranks, pattern or public_tokenizers.PATTERN).to_str()


def encode(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", offsets: str = "offsets") -> DataFrame:
    """Add the ids of each text (array of int) and the character offset of each id.

    An id that begins inside a character has the offset of that character.
    """
    kept = [c for c in df.columns if c not in (ids, offsets)]
    schema = T.StructType([*(df.schema[c] for c in kept)])
    schema.add(ids, T.ArrayType(T.IntegerType())).add(offsets, T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokens.load(tokenizer)
        encoder = tokens.CachedEncoder(tokens.tokenizers_encoder(model), tokens.packed)
        decoder = tokens.Decoder(model)
        for rows, texts in sliced(batches, text):
            found = [np.frombuffer(b"".join(p), "<u4") for p in encoder(texts)]
            lists = [pa.array([f.astype("i4") for f in x], pa.list_(pa.int32())) for x in (found, [decoder.offsets(f)[1] for f in found])]
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), *lists], [*kept, ids, offsets])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", output: str = "decoded") -> DataFrame:
    """Add the bytes of each id sequence; a null sequence gives null."""
    kept = [c for c in df.columns if c != output]
    schema = T.StructType([*(df.schema[c] for c in kept)]).add(output, T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = tokens.Decoder(tokens.load(tokenizer))
        for rows in batches:
            out = [None if x is None else decoder(np.array(x, np.int64)) for x in rows.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), pa.array(out, pa.binary())], [*kept, output])

    return df.mapInArrow(run, schema)


def round_trip_digests(df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, decode, and keep only digests of the ids and of the decoded bytes.

    The ids stay inside the worker that made them, so nothing but digests is written.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    arrow = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.string(), pa.string()], strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokens.load(tokenizer)
        decoder = tokens.Decoder(model)
        store: Callable = lambda ids: (" ".join(map(str, ids)), tokens.packed(ids))
        encoder = tokens.CachedEncoder(tokens.tokenizers_encoder(model), store)
        for rows, texts in sliced(batches, "text"):
            out: dict[str, list] = {n: [] for n in names[1:]}
            for kept in encoder(texts):
                ids = np.frombuffer(b"".join([k[1] for k in kept]), "<u4")
                out["n_tokens"].append(len(ids))
                decimal = " ".join([k[0] for k in kept if k[0]])
                out["ids_sha256"].append(hashlib.sha256(decimal.encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoder(ids)).hexdigest())
            yield batch_of(arrow, {"doc_id": rows.column("doc_id"), **out})

    rows = df.select(df[doc_id].cast("long").alias("doc_id"), text_of(df[text]).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and the decoded bytes of every document."""
    return round_trip_digests(table(spark, sf_dir, "documents"), from_rank_file())
