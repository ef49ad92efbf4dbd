"""Spelling variants: words one code point apart, through a dictionary of trie-node pairs.

The nodes of the trie of all words are numbered, and those of the trie of all reversed
words. A cut of a word is then a pair of integers: the node of what stands before the cut
and the node of what stands after. Two words differ

* by one replaced code point where both have the same pair around one skipped position;
* by one inserted (or deleted) code point where the pair around a position skipped in the
  longer one is the pair of a plain cut of the shorter one.

Pairs are numbers of nodes, not hashes, so what joins is a neighbour. A longer word skips
only the first of a run of equal code points, so every neighbour is found exactly once.
One pair has at most one member per letter of the alphabet, and the plain cut.

Nodes are numbered range by range over the sorted words: a word continues the path that
it shares with the word before, and the rest of its path is new. Paths that reach into
other ranges are paths of the first words of ranges, and have numbers of their own. Only
those first words, one for about ``RANGE_WORDS`` words, reach the driver.

Words are runs of letters, with the capitals A-Z lowered. A null or empty text has none, a
null id counts as the empty text. Repeated rows count as often as they stand. Ties between
neighbours go to the smaller word in code-point order. An empty table, or one without
frequent words, gives no rows. Texts and words of any length are taken whole; a word's
work grows with its length. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from survloom.llm.common import batch_of, table, text_of
from survloom.settings import staged

#: Code points of a word and occurrences, at least; how much more frequent a form is.
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
#: Sorted words that one task numbers.
RANGE_WORDS = 1 << 16
#: One in so many distinct runs of a document loses a code point.
SLIPS = 199

_RUN = r"[a-z\x{00C0}-\x{00FF}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Cuts that leave a task in one batch, about.
CUT_ROWS = 1 << 17
#: Bits of a node number below the range's.
_NODE_BITS = 38


def runs(text: Column) -> Column:
    """The letter runs of a text, in order."""
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(_RUN), F.lit(0))


def slipped(doc_id: Column, run: Column, every: int = SLIPS) -> Column:
    """The run, without one code point where the hash of document and run says so."""
    h = F.crc32(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), run))
    at = (h % F.char_length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(h % every == 0, cut).otherwise(run)


def vocabulary(df: DataFrame, doc_id: str = "doc_id", text: str = "text", every: int = SLIPS) -> DataFrame:
    """Columns word and n (occurrences in all texts) of the words that are frequent enough."""
    rows = df.select(df[doc_id].alias("doc_id"), F.explode(runs(text_of(df[text]))).alias("run"))
    words = rows.select(slipped(F.col("doc_id"), F.col("run"), every).alias("word"))
    counts = words.filter(F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= LEAST_COUNT)


def shared(a: str, b: str) -> int:
    """Code points of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 1:
        mid = (low + n) // 2
        low, n = (mid, n) if a[low:mid] == b[low:mid] else (low, mid)
    return low


def owners(firsts: list[str]) -> list[list[int]]:
    """For each first word of a range and each prefix length: the earliest range whose first word has that prefix."""
    out: list[list[int]] = []
    for i, word in enumerate(firsts):
        same = shared(firsts[i - 1], word) if i else 0
        out.append((out[-1][: same + 1] if i else [0]) + [i] * (len(word) - (same if i else 0)))
    return out


def number_range(index: int, words: list[str], firsts: list[str], owned: list[list[int]]) -> list[np.ndarray]:
    """Per sorted word of a range: the numbers of its trie nodes, from the root on.

    A node on the path of a range's first word is numbered by the earliest such range and
    its depth, below zero; any other lies in this range only.
    """
    edges = [(firsts[i], -1 - ((np.array(owned[i], np.int64) << _NODE_BITS) + np.arange(len(owned[i])))) for i in (index, index + 1) if i < len(firsts)]
    out, before, path, fresh = [], "", edges[0][1][:1], index << _NODE_BITS
    for word in words:
        nodes = np.empty(len(word) + 1, np.int64)
        known = shared(before, word)
        nodes[: known + 1] = path[: known + 1]
        for edge, ids in edges:
            same = shared(edge, word)
            if same > known:
                nodes[known + 1 : same + 1] = ids[known + 1 : same + 1]
                known = same
        nodes[known + 1 :] = np.arange(fresh, fresh + len(word) - known)
        fresh += len(word) - known
        out.append(nodes)
        before, path = word, nodes
    return out


def trie_nodes(words: DataFrame, count: int, output: str) -> DataFrame:
    """From rows (id, word): id and the node numbers of the word's prefixes, shortest first."""
    parts = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(count / RANGE_WORDS))
    piled = words.repartitionByRange(parts, "word").withColumn("piece", F.spark_partition_id())
    piled = staged(piled, "trie")
    firsts = piled.groupBy("piece").agg(F.min("word").alias("first")).orderBy("first").collect()
    index = {row["piece"]: i for i, row in enumerate(firsts)}
    first = [row["first"] for row in firsts]
    owned = owners(first)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("word")
        nodes = number_range(index[key[0].as_py()], rows.column("word").to_pylist(), first, owned)
        return pa.table({"id": rows.column("id"), output: pa.array(nodes, pa.list_(pa.int64()))})

    return piled.groupBy("piece").applyInArrow(run, f"id long, {output} array<long>")


def _cuts(rows: DataFrame) -> DataFrame:
    """Rows (pre, post, skip, first, id, n): every plain and every skipping cut of each word."""
    arrow = pa.schema([("pre", pa.int64()), ("post", pa.int64()), ("skip", pa.bool_()), ("first", pa.bool_()), ("id", pa.int64()), ("n", pa.int64())])

    def cut(row: dict) -> tuple:
        pre, post = np.array(row["pre"], np.int64), np.array(row["post"], np.int64)[::-1]
        m = len(pre) - 1
        # A position is the first of a run of equal letters where the letter before differs.
        letters = np.frombuffer(row["word"].encode("utf-32-le"), np.uint32)
        first = np.concatenate(([True], letters[1:] != letters[:-1], np.zeros(m + 1, bool)))
        own = np.full((2, 2 * m + 1), [[row["id"]], [row["n"]]])
        return np.concatenate((pre[:-1], pre)), np.concatenate((post[1:], post)), np.arange(2 * m + 1) < m, first, *own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, size = [], 0
            for row in [*batch.to_pylist(), None]:
                if row is not None:
                    done.append(cut(row))
                    size += len(done[-1][0])
                if done and (row is None or size >= CUT_ROWS):
                    yield batch_of(arrow, {name: pa.array(np.concatenate(c)) for name, c in zip(arrow.names, zip(*done, strict=True), strict=True)})
                    done, size = [], 0

    return rows.select("id", "word", "n", "pre", "post").mapInArrow(run, "pre long, post long, skip boolean, first boolean, id long, n long")


def neighbours(words: DataFrame) -> DataFrame:
    """From rows (id, word, n), ids in code-point order: id, n_near, and n and id of the most frequent neighbour.

    Words without a neighbour have no row.
    """
    count = words.count()
    forward = trie_nodes(words.select("id", "word"), count, "pre")
    backward = trie_nodes(words.select("id", F.reverse("word").alias("word")), count, "post")
    cuts = _cuts(words.join(forward, "id").join(backward, "id"))
    member = F.struct("skip", "first", "id", "n")
    pairs = cuts.groupBy("pre", "post").agg(F.collect_list(member).alias("all")).filter(F.size("all") > 1)
    # Both skip: a replacement. One skips: an insertion, found at the run's first position.
    apart = lambda m: lambda o: (o["id"] != m["id"]) & ((m["skip"] & o["skip"]) | (m["skip"] & m["first"] & ~o["skip"]) | (o["skip"] & o["first"] & ~m["skip"]))
    one = pairs.select("all", F.explode("all").alias("m"))
    near = one.select(F.col("m.id").alias("id"), F.filter("all", apart(F.col("m"))).alias("near")).filter(F.size("near") > 0)
    best = F.array_max(F.transform("near", lambda o: F.struct(o["n"].alias("n"), (-o["id"]).alias("back"))))
    found = near.select("id", F.size("near").cast("long").alias("k"), best.alias("best"))
    found = found.groupBy("id").agg(F.sum("k").alias("n_near"), F.max("best").alias("best"))
    return found.select("id", "n_near", F.col("best.n").alias("best_n"), (-F.col("best.back")).alias("best_id"))


def rooted(forms: DataFrame) -> DataFrame:
    """From rows (id, form), form null at an end: id and the last word that following forms leads to.

    Pointers are doubled: a chain of length c takes log2(c) rounds, and a form is several
    times as frequent as its word, so chains are short. Each round is written.
    """
    at = staged(forms.select("id", F.coalesce("form", "id").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("id").alias("root"), F.col("root").alias("further"))
        step = staged(at.join(ahead, "root").select("id", F.col("further").alias("root"), (F.col("further") != F.col("root")).alias("moved")), "roots")
        at = step.drop("moved")
        if step.filter("moved").isEmpty():
            return at


def variants(vocab: DataFrame, times: int = TIMES) -> DataFrame:
    """From rows (word, n): word, form, root, n, n_near and form_n; see the module."""
    parts = int(vocab.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = vocab.select("word", "n").repartitionByRange(parts, "word").sortWithinPartitions("word")
    # Numbers of sorted pieces, piece after piece: ids in code-point order.
    words = staged(ordered.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    near = neighbours(words)
    kept = F.col("best_n") >= times * F.col("n")
    told = words.join(near, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(kept, F.col("best_id")).alias("form"), F.when(kept, F.col("best_n")).alias("form_n")
    )
    told = staged(told, "variants")
    roots = rooted(told.select("id", "form"))
    named = words.select(F.col("id").alias("form"), F.col("word").alias("form_word"))
    ends = words.select(F.col("id").alias("root"), F.col("word").alias("root_word"))
    out = told.join(named, "form", "left").join(roots, "id").join(ends, "root")
    return out.select("word", F.col("form_word").alias("form"), F.col("root_word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word of the documents, its frequent form, and the root of its variants."""
    return variants(staged(vocabulary(table(spark, sf_dir, "documents")), "vocabulary"))


OP12_SQL = f"""
WITH crc AS MATERIALIZED (SELECT [list_reduce(list_prepend(b::BIGINT, range(8)), lambda c, k:
  CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FOR b IN range(256)] AS tab),
spoken AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[a-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS key, run, count(*) AS k FROM spoken GROUP BY ALL),
hashed AS (SELECT run, k, 4294967295 - list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(key)::BIGINT),
  lambda p: ('0x' || substr(hex(encode(key)), (2 * p + 1)::BIGINT, 2))::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])) AS h
  FROM counted, crc),
slips AS (SELECT k, CASE WHEN h % {SLIPS} = 0
  THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run) + 2)::BIGINT) ELSE run END AS word FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM slips WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(k) >= {LEAST_COUNT}),
cuts AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words),
skips AS MATERIALIZED (SELECT DISTINCT word, substr(word, 1, i - 1) || '_' || substr(word, i + 1) AS hole,
  substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM cuts),
near AS (
  SELECT a.word, b.word AS other FROM skips a JOIN skips b ON a.hole = b.hole AND a.word <> b.word
  UNION SELECT s.word, w.word FROM skips s JOIN words w ON w.word = s.less
  UNION SELECT w.word, s.word FROM skips s JOIN words w ON w.word = s.less),
best AS (SELECT near.word, count(*) AS n_near, max((w.n, -r.place)) AS top FROM near JOIN words w ON w.word = near.other
  JOIN (SELECT word, row_number() OVER (ORDER BY word) AS place FROM words) r ON r.word = near.other GROUP BY near.word),
placed AS (SELECT word, row_number() OVER (ORDER BY word) AS place FROM words),
forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.top[1] >= {TIMES} * w.n THEN p.word END AS form,
  CASE WHEN b.top[1] >= {TIMES} * w.n THEN b.top[1] END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word LEFT JOIN placed p ON p.place = -b.top[2]),
chains AS (
  WITH RECURSIVE walk(word, place, step) AS (
    SELECT word, word, 0 FROM forms
    UNION ALL SELECT walk.word, forms.form, step + 1 FROM walk JOIN forms ON forms.word = walk.place WHERE forms.form IS NOT NULL)
  SELECT word, arg_max(place, step) AS root FROM walk GROUP BY word)
SELECT f.word, form, root, n, n_near, form_n FROM forms f JOIN chains c ON c.word = f.word
"""
