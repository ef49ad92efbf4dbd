"""SimHash near-duplicates through a grid of segment bit counts.

A fingerprint's 64 bits are 32 segments of two bits, and each segment is mapped to
its bit count: a point of the integer grid. The Manhattan distance of two points
never exceeds the number of differing bits. With at most ``2 r + 1`` differing bits,
one half of the segments differs by at most ``r`` in Manhattan distance, so each
half is range-joined on the grid with that radius, and what meets there is
verified on the fingerprints themselves.

Equal fingerprints are one node from the start. A grid cell's members are dealt to
blocks of bounded size and compared block by block. A pair of blocks gives a
spanning forest of its links, which loses no connection, rather than all links.

A null or empty text has the fingerprint zero and links like any other. Repeated
rows repeat in the result. A component whose documents all lack an id has a null
``component_id``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from survloom.llm.common import batch_of, free, sliced, table, text_of
from survloom.llm.components import connected
from survloom.settings import staged

#: Words of a shingle and largest number of differing bits of a link.
SHINGLE, MAX_BITS = 3, 3
#: Members of a grid cell that are compared in one piece.
BLOCK = 2048
#: Groups up to this size are compared together, many at a time.
_SMALL = 48


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles of one text (ASCII lower case, ASCII white space)."""
    return int(fingerprints([text], shingle)[0])


def fingerprints(texts: list[str], shingle: int = SHINGLE) -> np.ndarray:
    """SimHash of each text, as unsigned 64-bit numbers."""
    out = np.zeros(len(texts), np.uint64)
    shift = np.uint64(1) << np.arange(64, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        words = text.encode().lower().split()
        if not words:
            continue
        n = max(1, len(words) - shingle + 1)
        runs = zip(*(words[k : k + n] for k in range(shingle)), strict=True) if len(words) >= shingle else [words]
        hashes = np.fromiter((digest(b" ".join(r), 42) for r in runs), np.uint64, n)
        set_bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
        out[i] = np.bitwise_or.reduce(shift[2 * set_bits.sum(axis=0, dtype=np.int64) > n], initial=np.uint64(0))
    return out


def with_fingerprint(df: DataFrame, text: str = "text", output: str = "_fp", shingle: int = SHINGLE) -> DataFrame:
    """Add the fingerprint as a (signed) long; ``df`` is read once, row by row."""
    kept = [c for c in df.columns if c != output]
    names = [*kept, output]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in sliced(batches, text):
            found = pa.array(fingerprints(texts, shingle).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), found], names)

    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(output, T.LongType())])
    return df.mapInArrow(run, schema)


def _cells(nodes: DataFrame) -> DataFrame:
    """Each fingerprint at its own grid point (home) and, per half, one step up from it.

    Two points at distance one are a step up from each other, so radius one needs a
    home on one side only.
    """
    even = F.lit(0x55555555)
    bits = [F.shiftrightunsigned("fp", 32 * k).bitwiseAND(F.lit(0xFFFFFFFF)) for k in (0, 1)]
    point = [b.bitwiseAND(even) + F.shiftrightunsigned(b, 1).bitwiseAND(even) for b in bits]
    half = lambda k: F.col(f"half{k}")

    def places(k: int) -> Column:
        at = lambda cell, home: F.struct((2 * cell + k).alias("cell"), F.lit(home).alias("home"))
        up = [
            F.when(half(k).bitwiseAND(F.lit(3 << 2 * i)) < F.lit(2 << 2 * i), at(half(k) + F.lit(1 << 2 * i), False))
            for i in range(16)
        ]
        return F.array(at(half(k), True), *up)

    pointed = nodes.select("fp", *(point[k].alias(f"half{k}") for k in (0, 1)))
    placed = pointed.select("fp", F.explode(F.array_compact(F.concat(places(0), places(1)))).alias("at"))
    return placed.select("fp", "at.cell", "at.home")


def _forest(fp: np.ndarray, home: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that connect what is connected in one group: one per node but the first."""
    left, out = np.ones(len(fp), bool), []
    for start in range(len(fp)):
        if not left[start]:
            continue
        left[start] = False
        todo = [start]
        while todo:
            at = todo.pop()
            near = left & (np.bitwise_count(fp ^ fp[at]) <= max_bits)
            if not home[at]:
                near &= home
            found = np.flatnonzero(near)
            left[found] = False
            todo.extend(found.tolist())
            out.extend((at, int(f)) for f in found)
    return out


def _group_links(cell: np.ndarray, fp: np.ndarray, home: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal ``cell``; each run is whole."""
    change = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    size = np.diff(np.concatenate((change, [len(cell)])))
    run_end = np.repeat(change + size, size)
    row_size = np.repeat(size, size)
    a, b = [], []
    at = np.flatnonzero(row_size <= _SMALL)
    for step in range(1, _SMALL):
        at = at[at + step < run_end[at]]
        if not len(at):
            break
        other = at + step
        near = (home[at] | home[other]) & (np.bitwise_count(fp[at] ^ fp[other]) <= max_bits)
        a.append(fp[at[near]])
        b.append(fp[other[near]])
    for start, n in zip(change[size > _SMALL], size[size > _SMALL], strict=True):
        own = fp[start : start + n]
        links = np.array(_forest(own, home[start : start + n], max_bits), np.int64).reshape(-1, 2)
        a.append(own[links[:, 0]])
        b.append(own[links[:, 1]])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``fp`` of ``nodes``."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the grid join has radius one in each half: at most 3 differing bits")
    cells = _cells(nodes)
    busy = cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("home").alias("homes")).filter("n > 1 AND homes")
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    # Spark takes the exploded cells to be as small as the nodes, so neither side is to be broadcast.
    dealt = cells.join(busy.select("cell", parts.alias("parts")).hint("merge"), "cell")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    others = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least("part", j).alias("i"), F.greatest("part", j).alias("j"))
    )
    dealt = dealt.select("cell", "fp", "home", F.explode(others).alias("pair"))
    dealt = dealt.select("cell", "fp", "home", "pair.i", "pair.j").repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        for batch in batches:
            new = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("cell", "i", "j", "fp", "home")]
            new = [np.concatenate(x) for x in zip(kept, new, strict=True)] if kept else new
            if not len(new[0]):
                continue
            # The last group may go on in the next batch.
            last = np.flatnonzero((new[0] != new[0][-1]) | (new[1] != new[1][-1]) | (new[2] != new[2][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            kept = [x[cut:] for x in new]
            yield from found([x[:cut] for x in new])
        if kept:
            yield from found(kept)

    def found(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        cell, i, j, fp, home = rows
        if not len(cell):
            return
        change = np.concatenate(([True], (cell[1:] != cell[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
        a, b = _group_links(np.cumsum(change), fp.astype(np.int64).view(np.uint64), home.astype(bool), max_bits)
        yield batch_of(arrow, {"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return dealt.mapInArrow(run, "a long, b long")


def groups(fingerprinted: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """From rows (doc_id, fp): each distinct fp with the smallest doc_id of its component."""
    nodes = staged(fingerprinted.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    roots = connected(links(nodes.select("fp"), max_bits))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.select("fp", "root").join(smallest, "root").select("fp", "root", "component_id")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """Columns doc_id, fingerprint (hexadecimal) and component_id, one row per row of ``df``."""
    rows = df.select(df[doc_id].cast("long").alias("doc_id"), text_of(df[text]).alias("text"))
    marked = staged(with_fingerprint(rows, "text", "fp", shingle).select("doc_id", "fp"), "simhash")
    found = marked.join(groups(marked, max_bits), "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component stays: the smallest id, then the smallest hash of the text.

    One of several rows that repeat id and text stays. Rows without an id rank last. All
    columns of ``df`` are kept, whatever their names. Texts are read whole; what is compared
    and chosen are narrow rows. An empty table gives an empty table.
    """
    id_name, hash_name = free(df, "id"), free(df, "hash")
    own = {id_name: df[doc_id].cast("long"), hash_name: F.xxhash64(text_of(df[text]))}
    narrow = df.select(own[id_name].alias("doc_id"), own[hash_name].alias("hash"), text_of(df[text]).alias("text"))
    marked = with_fingerprint(narrow, "text", "fp", shingle).groupBy("doc_id", "hash", "fp").agg(F.count("*").alias("n"))
    marked = staged(marked, "simhash")
    rooted = marked.join(groups(marked, max_bits).select("fp", "root"), "fp")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("anonymous"), "doc_id", "hash", "n")).alias("first")
    kept = rooted.groupBy("root").agg(first).select(F.col("first.doc_id").alias("kept_id"), F.col("first.hash").alias("kept_hash"), F.col("first.n").alias("kept_n"))
    kept = staged(kept, "kept").select(*(F.col(f"kept_{x}").alias(free(df, f"kept_{x}")) for x in ("id", "hash", "n")))
    rows, (kept_id, kept_hash, kept_n) = df.withColumns(own), kept.columns
    mine = rows.join(kept, rows[id_name].eqNullSafe(kept[kept_id]) & (rows[hash_name] == kept[kept_hash]))
    # Only rows that repeat id and text are shuffled once more.
    single, repeated = mine.filter(F.col(kept_n) == 1), mine.filter(F.col(kept_n) > 1)
    return single.union(repeated.dropDuplicates([id_name, hash_name])).select(*df.columns)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))
