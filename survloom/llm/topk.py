"""Exact top-k inner products by MaxScore over sharded postings.

A dimension is a term, a vector's component its impact. In a shard each term has a
floor and a bound for a query: the least and the largest product over the shard.
Terms in the order of their spread (bound less floor) are split in two: the
non-essential ones are the most terms of small spread with which alone no vector
could reach the k-th score so far. Postings are traversed in blocks, each twice as long
as the one before, so that the k-th score rises early; in a block the essential terms are
traversed for all vectors, and those that stay competitive with the spreads that are left
are probed in the other terms, while they remain so. Shards' results are merged.

The queries are a stated part of the rows. Candidates are dealt to shards of bounded
size and queries to groups of bounded size; each pair of the two is one task's group,
so no task holds more, whatever the table's size. A vector that is null, empty or
holds a null or non-finite component takes no part, nor does a null id. Rows that repeat an
id are rows of their own: each is a candidate for the others, and each that is a query has
results. Only vectors of the query's length are its candidates. An empty table has no
results; other columns are not read. Scores are exact: products are summed in floating point only where all
sums are below its exact integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from survloom.llm.common import table
from survloom.settings import staged

#: Most vectors of a shard and most queries of a group, about.
SHARD_ROWS, QUERY_ROWS = 65_536, 16_384
#: A small table is still cut, down to shards of this size, to use all cores.
LEAST_SHARD = 2048
#: Vectors of the first block of a shard's postings.
FIRST = 64


def quantised(df: DataFrame, vec_id: str, vector: str, scale: int = 64) -> DataFrame:
    """Columns row, id and v (array of long): floor(scale * x) of each component as double; one row per usable row.

    ``row`` tells rows that repeat an id apart. The result is staged, so that it stays the same.
    """
    x = F.col(vector)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    usable = df.filter(F.col(vec_id).isNotNull() & x.isNotNull() & (F.size(x) > 0)).filter(~bad)
    whole = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    return staged(usable.select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("id"), whole.alias("v")), "vectors")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of equal length as rows."""
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks])
    return flat.reshape(len(column), -1)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to smaller ids."""
    if len(ids) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        chosen = scores >= least
        ids, scores = ids[chosen], scores[chosen]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def maxscore(
    rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, query_rows: np.ndarray, queries: np.ndarray, k: int, counts: dict | None = None
) -> list[tuple[int, int, int]]:
    """(query row, vector id, score): for each query its best k of one shard.

    ``counts`` gains the postings traversed, those probed and those there are.
    """
    limit = int(np.abs(vectors).max()) * int(np.abs(queries).max()) * vectors.shape[1]
    kind = np.float32 if limit < 1 << 24 else np.float64 if limit < 1 << 53 else object
    postings = np.ascontiguousarray(vectors.T.astype(kind))
    low, high = postings.min(axis=1), postings.max(axis=1)
    queries = queries.astype(kind)
    first = min(FIRST, len(rows))
    opening = queries @ postings[:, :first]
    edges = [first]
    while edges[-1] < len(rows):
        edges.append(min(len(rows), 2 * edges[-1]))
    traversed, probed, out = postings[:, :first].size * len(queries), 0, []
    for n, (query_row, query) in enumerate(zip(query_rows, queries, strict=True)):
        other = rows != query_row
        best_ids, best = _best(ids[:first][other[:first]], opening[n][other[:first]], k)
        floor, bound = np.minimum(query * low, query * high), np.maximum(query * low, query * high)
        order = np.argsort(floor - bound, kind="stable")
        # After each number of terms, in this order: floor of those, and bound of all that follow.
        after_bound = np.concatenate((np.cumsum(bound[order][::-1])[::-1], [kind(0) if kind is not object else 0]))
        before_floor = np.concatenate(([0], np.cumsum(floor[order])))
        for begin, end in zip(edges, edges[1:], strict=False):
            threshold = best[-1] if len(best) == k else None
            essential = len(order)
            if threshold is not None:
                # Essential: the fewest terms without which floor and bounds stay below the threshold.
                below = np.flatnonzero(before_floor + after_bound < threshold)
                essential = int(below[0]) if len(below) else len(order)
            alive = begin + np.flatnonzero(other[begin:end])
            terms = order[:essential]
            partial = query[terms] @ postings[terms, begin:end][:, alive - begin]
            traversed += essential * (end - begin)
            step = max(1, (len(order) - essential) // 4)
            while essential < len(order) and len(alive):
                near = partial + after_bound[essential] >= threshold
                alive, partial = alive[near], partial[near]
                terms = order[essential : essential + step]
                partial = partial + query[terms] @ postings[np.ix_(terms, alive)]
                probed += len(terms) * len(alive)
                essential = min(len(order), essential + step)
            if threshold is not None:
                near = partial >= threshold
                alive, partial = alive[near], partial[near]
            best_ids, best = _best(np.concatenate((best_ids, ids[alive])), np.concatenate((best, partial)), k)
        out.extend((int(query_row), int(i), int(s)) for i, s in zip(best_ids, best, strict=True))
    if counts is not None:
        for name, number in (("traversed", traversed), ("probed", probed), ("all", postings.size * len(queries))):
            counts[name] = counts.get(name, 0) + number
    return out


def search(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """Columns query_id, rank, vec_id, score for the rows (row, id, v) that ``is_query`` holds for."""
    spark = vectors.sparkSession
    vectors = vectors.withColumn("d", F.size("v"))
    n, n_queries = vectors.agg(F.count("*"), F.count_if(is_query)).first()
    shards = max(-(-n // SHARD_ROWS), min(-(-n // LEAST_SHARD), spark.sparkContext.defaultParallelism), 1)
    groups = max(1, -(-n_queries // QUERY_ROWS))
    numbers = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    of_row = lambda m: F.pmod(F.xxhash64("row"), F.lit(m)).cast("int")
    rows = vectors.withColumn("shard", of_row(shards)).withColumn("part", numbers(groups))
    queries = vectors.filter(is_query).withColumn("part", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(groups)).cast("int"))
    queries = queries.withColumn("shard", numbers(shards))
    key = ("d", "shard", "part")
    arrow = pa.schema([("query_row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        if len(candidates) and len(asked):
            rows, query_rows = (t.column("row").to_numpy() for t in (candidates, asked))
            found = maxscore(rows, candidates.column("id").to_numpy(), _matrix(candidates.column("v")), query_rows, _matrix(asked.column("v")), k)
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else [[]] * 3)], schema=arrow)

    partial = rows.groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(run, "query_row long, vec_id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    asked = vectors.filter(is_query).select(F.col("row").alias("query_row"), F.col("id").alias("query_id"))
    return ranked.join(asked, "query_row").select("query_id", "rank", "vec_id", "score")


def op7_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best other vectors of every 20th embedding."""
    return search(quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), F.col("id") % 20 == 0)


OP7_SQL = """
WITH q AS (
  SELECT row_number() OVER () AS rid, vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE) for x in embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.rid, a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM q a JOIN q b ON a.rid <> b.rid AND len(a.v) = len(b.v)
  WHERE a.vec_id % 20 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
