"""A Merkle manifest of a table, and its versions after changed rows by path copying.

Rows are leaves of one tree per group; the groups' roots are the leaves of a tree above
them. A node is the hash of up to eight neighbours. Leaves are numbered by a range sort, and
``8^4`` consecutive ones form an aligned block, which is a whole subtree. Blocks are
hashed where they lie; their roots are leaves of the next, ``8^4`` times smaller level,
until one is left per group. Going back down, every block is told the siblings above it.

The tree is persistent: a changed leaf makes a version that shares every node of the
original but its own ancestors. They are copied within the leaf's block, level by level,
and the copy goes on through the levels above with the siblings told to the block. No
version sees another's change, and no node is ever replaced.

Digests are lower-case hexadecimal SHA-256. A leaf hashes its columns in order, each as
``-`` if null, else as byte count, colon and value. Leaves of a group ascend by key (null
first), then by leaf; repeated rows are leaves of their own with equal digests. A null
group is a group and comes first. Groups may have any size and number: work is dealt by
block, never by group. Texts of any length are hashed where they are read. An empty table
has no rows and no root. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from survloom.llm.common import table
from survloom.settings import staged

#: Neighbours under one node, and levels of a block; it has ``ARITY ** LEVELS`` leaves.
ARITY, LEVELS = 8, 4

#: Characters of a digest.
_HEX = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def node(digests: Sequence[str]) -> str:
    """The hash of neighbouring digests, taken as hexadecimal text."""
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def leaf(columns: Sequence[Column]) -> Column:
    """The digest of one row."""

    def framed(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(framed, columns)), 256)


def _depth(count: Column) -> Column:
    """Levels above ``count`` leaves until one node is left."""
    steps = F.transform(F.sequence(F.lit(1), F.lit(21)), lambda k: (count > F.pow(F.lit(float(ARITY)), k - 1)).cast("int"))
    return F.aggregate(steps, F.lit(0), lambda a, x: a + x)


def placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``place`` (from 0 within ``tree``) and ``depth`` of the tree, by a range sort.

    One summary row per sorted piece and tree passes through a window, by tree. Ties are
    dealt by row number of the staged rows, so equal rows may be any share of all.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = staged(rows.withColumn("_tie", F.monotonically_increasing_id()), "leaves")
    by = ["tree", *order, "_tie"]
    piled = numbered.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    piled = staged(piled.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "sorted")
    piled = piled.withColumn("_piece", F.shiftright("_at", 33))
    pieces = piled.groupBy("tree", "_piece").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("tree").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.sum("_n").over(Window.partitionBy("tree"))
    pieces = pieces.select("tree", "_piece", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"), _depth(whole).alias("depth"))
    joined = piled.join(pieces, ["tree", "_piece"])
    return joined.withColumn("place", F.col("_at") + F.col("_shift")).drop("_at", "_piece", "_shift")


def grow(digests: list[str], levels: int) -> list[list[str]]:
    """The nodes of one block, level by level from the given ones; the last has one node or fewer levels were asked."""
    out = [digests]
    for _ in range(levels):
        below = out[-1]
        out.append([node(below[i : i + ARITY]) for i in range(0, len(below), ARITY)])
    return out


def siblings(levels: list[list[str]], place: int) -> list[tuple[int, list[str]]]:
    """Per level below the top: a node's place among its neighbours, and the neighbours."""
    out = []
    for below in levels[:-1]:
        run = place // ARITY * ARITY
        out.append((place - run, below[run:place] + below[place + 1 : run + ARITY]))
        place //= ARITY
    return out


def written(path: list[tuple[int, list[str]]]) -> str:
    """A path as text: place and neighbours' digests of each level."""
    return ";".join(f"{own}:{''.join(others)}" for own, others in path)


def read(path: str) -> list[tuple[int, list[str]]]:
    """The path that :func:`written` wrote."""
    steps = (step.split(":") for step in path.split(";") if step)
    return [(int(own), [others[i : i + _HEX] for i in range(0, len(others), _HEX)]) for own, others in steps]


def copied(digest: str, path: list[tuple[int, list[str]]]) -> list[str]:
    """The nodes that a version with this leaf has of its own: the leaf, then its copied ancestors."""
    out = [digest]
    for own, others in path:
        out.append(node([*others[:own], out[-1], *others[own:]]))
    return out


def _block(levels: int) -> Column:
    """The number of the block that a node is in."""
    return F.floor(F.col("place") / ARITY**levels).alias("block")


def _block_roots(nodes: DataFrame, done: int, levels: int) -> DataFrame:
    """Rows (tree, place, digest, depth) one block level up, hashed block by block."""

    def up(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        depth = rows.column("depth")[0].as_py()
        top = grow(rows.column("digest").to_pylist(), min(levels, depth - done))[-1][0]
        return pa.table({"tree": [key[0].as_py()], "place": [key[1].as_py()], "digest": [top], "depth": pa.array([depth], pa.int32())})

    dealt = nodes.select("tree", "place", "digest", "depth", _block(levels))
    return dealt.groupBy("tree", "block").applyInArrow(up, "tree string, place long, digest string, depth int")


def _told(nodes: DataFrame, paths: DataFrame, levels: int) -> DataFrame:
    """The rows of ``nodes``, and one leading row per block (place -1) with the path above it."""
    dealt = nodes.withColumn("block", _block(levels))
    heads = paths.select("tree", F.col("place").alias("block"), F.lit(-1).cast("long").alias("place"), "path")
    return dealt.unionByName(heads, allowMissingColumns=True)


def _split(rows: pa.Table, done: int, levels: int) -> tuple[pa.Table, list[list[str]], list[tuple[int, list[str]]]]:
    """A block's rows in order, its nodes level by level, and the path above it."""
    rows = rows.sort_by("place")
    upper, rows = read(rows.column("path")[0].as_py()), rows.slice(1)
    return rows, grow(rows.column("digest").to_pylist(), min(levels, rows.column("depth")[0].as_py() - done)), upper


def _paths(nodes: DataFrame, above: DataFrame, done: int, levels: int) -> DataFrame:
    """Rows (tree, place, path) for ``nodes``; ``above`` has the path of each of their blocks."""

    def down(rows: pa.Table) -> pa.Table:
        rows, nodes, upper = _split(rows, done, levels)
        paths = [written(siblings(nodes, i) + upper) for i in range(len(rows))]
        return pa.table({"tree": rows.column("tree"), "place": rows.column("place"), "path": pa.array(paths, pa.string())})

    told = _told(nodes.select("tree", "place", "digest", "depth"), above, levels)
    return told.groupBy("tree", "block").applyInArrow(down, "tree string, place long, path string")


def forest(leaves: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """From rows (tree, place, digest, depth): (tree, digest) of the roots, and (tree, place, path) of the leaves' blocks.

    ``path`` holds what lies above a block of leaves, up to the tree's root.
    """
    deepest = leaves.agg(F.max("depth")).first()[0] or 0
    stages = [leaves]
    for done in range(0, max(1, deepest), levels):
        stages.append(staged(_block_roots(stages[-1], done, levels), "nodes"))
    roots = stages[-1].select("tree", "digest")
    paths = stages[-1].select("tree", "place", F.lit("").alias("path"))
    for back in range(len(stages) - 2, 0, -1):
        paths = _paths(stages[back], paths, back * levels, levels)
    return roots, paths


def _versions(leaves: DataFrame, paths: DataFrame, carried: Sequence[str], levels: int) -> DataFrame:
    """Each leaf with its proof and, where ``changed`` is not null, the nodes of its version."""
    rows = leaves.select("tree", "place", "depth", "digest", "changed", *carried)
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carried)

    def run(part: pa.Table) -> pa.Table:
        part, nodes, upper = _split(part, 0, levels)
        above = "".join(d for _, others in upper for d in others)
        proofs, copies = [], []
        for i, new in enumerate(part.column("changed").to_pylist()):
            path = siblings(nodes, i)
            proofs.append(hashlib.sha256(("".join(d for _, others in path for d in others) + above).encode()).hexdigest())
            copies.append(None if new is None else copied(new, path + upper))
        made = {c: part.column(c) for c in ("tree", "digest", *carried)}
        return pa.table({**made, "proof": pa.array(proofs, pa.string()), "copies": pa.array(copies, pa.list_(pa.string()))})

    told = _told(rows, paths, levels).groupBy("tree", "block")
    return told.applyInArrow(run, f"tree string, digest string, {fields}, proof string, copies array<string>")


def manifest(df: DataFrame, columns: Sequence[str], key: str, group: str, changed: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """Columns key, leaf, subroot, root, proof_sha256, folded_root and copies, one row per row of ``df``.

    ``changed`` is the digest of the row as it is now (null: unchanged). ``copies`` are the
    nodes that the row's version has of its own, from the leaf to the root; null for an
    unchanged row, which has no version. ``folded_root`` is the root of the row's version.
    ``levels`` is the height of a block.
    """
    mark = F.lit("+")
    digest = leaf([df[c] for c in columns])
    rows = df.select(
        F.coalesce(F.concat(mark, df[group].cast("string")), F.lit("")).alias("tree"),
        df[key].alias("key"),
        digest.alias("digest"),
        (F.lit(None).cast("string") if changed is None else changed).alias("changed"),
    )
    leaves = placed(rows, ["key", "digest"])
    leaves = staged(leaves, "placed")
    subroots, paths = forest(leaves, levels)
    # The tree above: one leaf per group, in the order of the groups' names.
    groups = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    groups = staged(placed(groups, ["name"]), "groups")
    roots, upper = forest(groups, levels)
    ends = staged(_paths(groups, upper, 0, levels).join(groups, ["tree", "place"]).select("name", "digest", F.col("path").alias("top")), "tops")
    top = roots.first()
    paths = paths.join(ends, paths["tree"] == ends["name"]).select("tree", "place", F.concat_ws(";", "path", "top").alias("path"))
    found = _versions(leaves, paths, ["key"], levels)
    named = found.join(ends.select(F.col("name").alias("tree"), F.col("digest").alias("subroot")), "tree")
    whole = named.withColumn("root", F.lit(top["digest"] if top else None).cast("string"))
    folded = F.coalesce(F.element_at("copies", -1), F.col("root"))
    return whole.select(
        F.col("key").alias(key), F.col("digest").alias("leaf"), "subroot", "root",
        F.col("proof").alias("proof_sha256"), folded.alias("folded_root"), "copies",
    )


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and the root that its tampered form folds to.

    Tampered are documents whose decimal id has a crc32 that 3 divides (none without an
    id): the capitals A-Z of their text become small.
    """
    docs = table(spark, sf_dir, "documents")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    small = F.translate(docs["text"], _UPPER, _LOWER)
    tampered = F.when(F.crc32(docs["doc_id"].cast("string")) % 3 == 0, leaf([*(docs[c] for c in columns[:-1]), small]))
    rows = manifest(docs, columns, "doc_id", "lang", tampered)
    return rows.drop("copies").withColumn("verified", F.col("folded_root") == F.col("root"))


_SQL_LEVELS = 9


def _sql() -> str:
    """The manifest by window positions and one aggregate per level, for up to 8^9 rows a group."""

    def climb(name: str, part: str) -> list[str]:
        """Tables name1, name2, ... of (part, i, h, n): the nodes of each level above name0."""
        return [
            f"""{name}{k + 1} AS MATERIALIZED (SELECT {part}, j // 8 AS i, (m + 7) // 8 AS n,
  CASE WHEN m > 1 THEN sha256(string_agg(h, '' ORDER BY j)) ELSE min(h) END AS h
  FROM (SELECT {part}, i AS j, n AS m, h FROM {name}{k}) GROUP BY {part}, j // 8, m)"""
            for k in range(_SQL_LEVELS)
        ]

    def fold(start: str, name: str, nodes: str, match: str) -> list[str]:
        """Tables of (rid, i, folded, proof) per level, from ``start``."""
        made, last = [], start
        for k in range(_SQL_LEVELS):
            made.append(
                f"""{name}{k + 1} AS MATERIALIZED (SELECT rid, any_value(d.lang) AS lang, any_value(d.i) // 8 AS i,
  any_value(proof) || CASE WHEN any_value(s.n) > 1 THEN coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (WHERE s.i <> d.i), '') ELSE '' END AS proof,
  CASE WHEN any_value(s.n) > 1 THEN sha256(string_agg(CASE WHEN s.i = d.i THEN d.folded ELSE s.h END, '' ORDER BY s.i)) ELSE any_value(d.folded) END AS folded
  FROM {last} d JOIN {nodes}{k} s ON {match} s.i // 8 = d.i // 8 GROUP BY rid)"""
            )
            last = f"{name}{k + 1}"
        return made

    framed = lambda e: f"coalesce(strlen(CAST({e} AS VARCHAR)) || ':' || CAST({e} AS VARCHAR), '-')"
    head = " || ".join(framed(c) for c in ("doc_id", "source", "lang", "n_chars"))
    small = f"translate(text, '{_UPPER}', '{_LOWER}')"
    byte = "('0x' || substr(hex(encode(CAST(doc_id AS VARCHAR))), (2 * p + 1)::BIGINT, 2))::BIGINT"
    crc = f"""4294967295 - list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(CAST(doc_id AS VARCHAR))::BIGINT),
  lambda p: {byte})), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))"""
    steps = [
        """crc AS MATERIALIZED (SELECT [list_reduce(list_prepend(b::BIGINT, range(8)), lambda c, k:
  CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FOR b IN range(256)] AS tab)""",
        f"""hashed AS MATERIALIZED (SELECT doc_id, lang, sha256({head} || {framed('text')}) AS leaf,
  CASE WHEN ({crc}) % 3 = 0 THEN sha256({head} || {framed(small)}) END AS changed FROM documents, crc)""",
        """leaves AS MATERIALIZED (SELECT *, row_number() OVER () AS rid, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
  count(*) OVER (PARTITION BY lang) AS n FROM hashed)""",
        "t0 AS (SELECT lang, i, leaf AS h, n FROM leaves)",
        *climb("t", "lang"),
        f"subroots AS MATERIALIZED (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM t{_SQL_LEVELS})",
        "u0 AS (SELECT 0 AS one, g AS i, subroot AS h, (SELECT count(*) FROM subroots) AS n FROM subroots)",
        *climb("u", "one"),
        "d0 AS (SELECT rid, lang, i, '' AS proof, coalesce(changed, leaf) AS folded FROM leaves)",
        *fold("d0", "d", "t", "s.lang IS NOT DISTINCT FROM d.lang AND"),
        f"e0 AS (SELECT d.* EXCLUDE (i), g AS i FROM d{_SQL_LEVELS} d JOIN subroots s ON s.lang IS NOT DISTINCT FROM d.lang)",
        *fold("e0", "e", "u", ""),
    ]
    return "WITH " + ",\n".join(steps) + f"""
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = h AS verified
FROM leaves l JOIN e{_SQL_LEVELS} e ON e.rid = l.rid JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang, u{_SQL_LEVELS} r"""


OP13_SQL = _sql()
