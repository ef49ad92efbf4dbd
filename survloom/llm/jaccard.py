"""Jaccard similarity join on word shingles, over R-trees of shingle counts by hash group.

A document's set is its distinct shingles, as 64-bit hashes. The hash also deals the
shingles to groups; the numbers per group are the document's point. Two sets share at most
the sum of the smaller coordinate in each group, and two boxes of points at most the sum of
the smaller upper edges. A pair links only if this bound, over groups twice as fine for sets
twice as large, reaches the overlap that the similarity asks for. What survives is verified
on the sets themselves.

One tree over all points would prune next to nothing: points of unrelated documents of one
size lie within each other's boxes. So there is a forest, one tree for each shingle that is
among the rarest of several sets. A set of size n is in the trees of its rarest
``n - ceil(t n) + 1`` shingles; two sets that link have one of them in common, whatever the
order, so no link is lost. Rarity is read from counts of all shingles by hash group (a table
of fixed size), so a passage that many documents share grows no tree.

Equal sets are one node, and trees of the same members are one tree. A member stays in a tree
only while a set of another component has about its size there. In each tree one member
is tested against all others and leaves, then another against those that are still apart;
then pairs of what is left in different components are sought in the tree, by blocks of
bounded size. Groups of near copies are joined by the first tests, and need not be expanded
into pairs. Where copies stay apart, about as similar as asked for, a tree can hold many more
pairs than members: such a tree is sent the sets, and its blocks return the links of a forest.

A set of fewer words than a shingle has is the whole sequence; an empty or null text has an
empty set and links with nothing, not even another empty one. Repeated rows repeat in the
result. A component whose documents all lack an id has a null ``component_id``. Texts are
read whole, however long. An empty table has no rows. Other columns are not read. Two sets
of equal 64-bit hashes are told apart by a second hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from survloom.llm.common import batch_of, sliced, table, text_of
from survloom.llm.components import connected
from survloom.settings import staged

#: Words of a shingle, and the least similarity in hundredths.
SHINGLE, PERCENT = 5, 80
#: Characters of texts that a task hashes at a time (a longer text comes alone): hashing takes about 40 bytes for each.
SLICE = 250_000
#: Hash groups whose shingle counts order shingles by rarity, as a power of two.
RARITY_BITS = 16
#: Members of a tree that are joined in one piece, and points of a leaf.
BLOCK, LEAF = 1024, 16
#: Trees of a set that are remembered, so that a pair is not found again in the next.
FIRST_TREES = 16
#: Members of each tree that are tested against all others before the tree is joined.
STARS = 2
#: Pairs for each member that a block may leave to joins; a tree with more is crowded.
PAIRS = 4
#: Bits of the map of wanted texts, as a power of two; texts outside it are not sent to joins.
MAP_BITS = 24
#: Members and shingles that a piece of a crowded tree holds.
CROWD, CROWD_SHINGLES = 256, 1 << 21

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_STEP = _U(0x9E3779B97F4A7C15)
#: One number per byte value (capitals as small letters, white space as nothing) and per place in a shingle.
_BYTE = _mix(np.arange(1, 257, dtype=_U) * _STEP)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE[_SPACE] = 0
_BASE = int(_mix(np.array([7], _U) * _STEP)[0]) | 1
_PLACE = _mix(np.arange(1000, 1000 + 64, dtype=_U) * _STEP) | _U(1)


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, as many as were asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, _U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            inverse = pow(_BASE, -1, 1 << 64)
            self.up, self.down = (np.concatenate(([_U(1)], np.full(size - 1, b, _U))).cumprod(dtype=_U) for b in (_BASE, inverse))
        return self.up, self.down


_powers = _Powers()


def shingle_hashes(texts: list[str], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts, repeats included, and where each text's begin (one more at the end)."""
    raw = [t.encode() for t in texts]
    size = np.array([len(r) + 1 for r in raw], np.int64)
    begins = np.concatenate(([0], np.cumsum(size)))
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    up, down = _powers.upto(max(1, len(data)))
    letter = (~_SPACE)[data]
    edge = np.diff(letter.view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, _U), np.zeros(len(texts) + 1, np.int64)
    with np.errstate(over="ignore"):
        words = np.add.reduceat(_BYTE[data] * up[: len(data)], starts) * down[starts]
        words = _mix(words + (ends - starts).astype(_U) * _STEP)
        first = np.searchsorted(starts, begins)
        count = np.diff(first)
        whole = np.zeros(max(0, len(words) - shingle + 1), _U)
        for k in range(shingle):
            whole += words[k : k + len(whole)] * _PLACE[k]
        whole = _mix(whole)
        n = np.where(count >= shingle, count - shingle + 1, np.minimum(count, 1))
        at = np.concatenate(([0], np.cumsum(n)))
        out = np.empty(at[-1], _U)
        # A place in the result is a place among the words, less what earlier texts lack.
        full = np.repeat(count >= shingle, n)
        source = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], n)
        out[full] = whole[source[full]]
        for i in np.flatnonzero((count > 0) & (count < shingle)):
            part = words[first[i] : first[i + 1]]
            out[at[i]] = _mix((part * _PLACE[: len(part)]).sum(dtype=_U, keepdims=True) + _PLACE[-len(part)])[0]
    return out, at


def least_overlap(a: np.ndarray | int, b: np.ndarray | int, percent: int = PERCENT) -> np.ndarray | int:
    """The smallest intersection of linked sets of these sizes."""
    return -(-percent * (a + b) // (100 + percent))


def group_bits(n: int) -> int:
    """Groups of a set of n shingles, as a power of two: about two shingles to a group."""
    return max(4, (n // 2).bit_length())


def point(hashes: np.ndarray) -> np.ndarray:
    """How many of the distinct hashes are in each group; a group is the top bits of the hash."""
    bits = group_bits(len(hashes))
    return np.bincount((hashes >> _U(64 - bits)).astype(np.int64), minlength=1 << bits).astype("<u2")


def folded(p: np.ndarray, size: int) -> np.ndarray:
    """A point (or an upper edge) over fewer, wider groups: neighbours are added."""
    return p if len(p) == size else p.reshape(size, -1).sum(axis=1, dtype=np.uint32)


def coarse(p: np.ndarray) -> np.ndarray:
    """A point over an eighth of its groups, at least 16: it allows no less, and takes as much less room."""
    return folded(p, max(16, len(p) // 8)).astype("<u2")


def overlap_bound(a: np.ndarray, b: np.ndarray) -> int:
    """No sets at (or below) these points share more."""
    size = min(len(a), len(b))
    return int(np.minimum(folded(a, size), folded(b, size)).sum(dtype=np.int64))


class Tree:
    """An R-tree over points: halves by the widest coordinate, with upper edges and size ranges."""

    def __init__(self, points: list[np.ndarray], sizes: np.ndarray, classes: np.ndarray, rows: np.ndarray):
        self.rows, own = rows, sizes[rows]
        self.least, self.most = int(own.min()), int(own.max())
        self.single = int(classes[rows[0]]) if (classes[rows] == classes[rows[0]]).all() else None
        width = min(len(points[r]) for r in rows)
        stack = np.stack([folded(points[r], width) for r in rows])
        self.upper, self.parts = stack.max(axis=0), []
        self.stack = stack if len(rows) <= LEAF else None
        if len(rows) > LEAF:
            # Sizes first: they bound best while they differ by more than linked sets can.
            if self.most * PERCENT > self.least * 100:
                by = own
            else:
                spread = self.upper.astype(np.int64) - stack.min(axis=0)
                by = stack[:, int(spread.argmax())]
            order = rows[np.argsort(by, kind="stable")]
            half = len(order) // 2
            self.parts = [Tree(points, sizes, classes, order[:half]), Tree(points, sizes, classes, order[half:])]


def tree_join(a: Tree, b: Tree, sizes: np.ndarray, classes: np.ndarray, percent: int = PERCENT) -> Iterator[tuple[int, int]]:
    """Pairs of rows of different classes whose bound reaches the least overlap, one leaf after another; ``a`` may be ``b``."""
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        if x.single is not None and x.single == y.single:
            continue
        if min(x.most, y.most) * 100 < max(x.least, y.least) * percent:
            continue
        if x is not y and overlap_bound(x.upper, y.upper) < least_overlap(x.least, y.least, percent):
            continue
        if x.parts or y.parts:
            if x is y:
                left, right = x.parts
                todo += [(left, left), (left, right), (right, right)]
            elif x.parts and (not y.parts or len(x.rows) >= len(y.rows)):
                todo += [(part, y) for part in x.parts]
            else:
                todo += [(x, part) for part in y.parts]
            continue
        width = min(x.stack.shape[1], y.stack.shape[1])
        left, right = (s.stack if s.stack.shape[1] == width else s.stack.reshape(len(s.rows), width, -1).sum(axis=2, dtype=np.uint32) for s in (x, y))
        bound = np.minimum(left[:, None, :], right[None, :, :]).sum(axis=2, dtype=np.int64)
        near = bound >= least_overlap(sizes[x.rows][:, None], sizes[y.rows][None, :], percent)
        near &= classes[x.rows][:, None] != classes[y.rows][None, :]
        if x is y:
            near &= np.triu(np.ones(near.shape, bool), 1)
        i, j = np.nonzero(near)
        yield from zip(x.rows[i].tolist(), y.rows[j].tolist(), strict=True)


def rarity(docs: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """The rank of each hash group (the low bits) by its number of shingles in all texts."""
    groups = 1 << RARITY_BITS
    arrow = pa.schema([("g", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(groups, np.int64)
        for _, texts in sliced(batches, "text", SLICE):
            hashes, _ = shingle_hashes(texts, shingle)
            total += np.bincount((hashes & _U(groups - 1)).astype(np.int64), minlength=groups)
        held = np.flatnonzero(total)
        yield batch_of(arrow, {"g": pa.array(held.astype(np.int32)), "n": pa.array(total[held])})

    counts = docs.select("text").mapInArrow(run, "g int, n long").groupBy("g").agg(F.sum("n").alias("n"))
    # At most 2^RARITY_BITS rows, whatever the corpus.
    n = np.zeros(groups, np.int64)
    for row in counts.collect():
        n[row["g"]] = row["n"]
    rank = np.empty(groups, _U)
    rank[np.lexsort((np.arange(groups), n))] = np.arange(groups, dtype=_U)
    return rank


def described(docs: DataFrame, rank: np.ndarray, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """From rows (doc_id, text): doc_id, text_hash, n, k1 and k2 (hashes of the set), rare (rarest shingles), point and its coarse form."""
    low, high = _U((1 << RARITY_BITS) - 1), _U(64 - RARITY_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in sliced(batches, "text", SLICE):
            hashes, at = shingle_hashes(texts, shingle)
            n, k1, k2, rare, points, wide = [], [], [], [np.zeros(0, _U)], [], []
            with np.errstate(over="ignore"):
                for i in range(len(texts)):
                    own = np.unique(hashes[at[i] : at[i + 1]])
                    size = len(own)
                    n.append(size)
                    k1.append(_mix(own).sum(dtype=_U) + _U(size))
                    k2.append(_mix(own ^ _STEP).sum(dtype=_U))
                    first = size + (percent * size) // -100 + 1 if size else 0
                    # The rank takes the place of the low bits that it stands for: still one number per shingle.
                    order = (rank[(own & low).astype(np.int64)] << high) | (own >> _U(RARITY_BITS))
                    rare.append(np.partition(order, first - 1)[:first] if size else order)
                    at_own = point(own) if size else np.zeros(0, "<u2")
                    points.append(at_own.tobytes())
                    wide.append(coarse(at_own).tobytes() if size else b"")
            ends = np.concatenate(([0], np.cumsum([len(r) for r in rare[1:]]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rare).view(np.int64)))
            numbers = [pa.array(np.array(k, _U).view(np.int64)) for k in (k1, k2)]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("text_hash"), pa.array(n, pa.int64()), *numbers, lists, pa.array(points, pa.binary()), pa.array(wide, pa.binary())],
                ["doc_id", "text_hash", "n", "k1", "k2", "rare", "point", "coarse"],
            )

    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return hashed.mapInArrow(run, "doc_id long, text_hash long, n long, k1 long, k2 long, rare array<long>, point binary, coarse binary")


def keyed(marked: DataFrame) -> DataFrame:
    """Add ``key``, one number per distinct set; null for the empty set.

    The few sets that share their first hash (about N^2 / 2^65 of N sets) take another.
    """
    twice = marked.groupBy("k1").agg(F.min("k2").alias("a"), F.max("k2").alias("b")).filter("a <> b").select("k1").collect()
    key = F.col("k1")
    if twice:
        key = F.when(key.isin([row["k1"] for row in twice]), F.xxhash64("k1", "k2")).otherwise(key)
    return marked.withColumn("key", F.when(F.col("n") > 0, key))


def _bounded(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose points allow the overlap that a link needs."""
    side = lambda s: points.select(F.col("key").alias(s), F.col("n").alias(f"n_{s}"), F.col("point").alias(f"p_{s}"))
    wide = pairs.join(side("a"), "a").join(side("b"), "b")
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = least_overlap(*(batch.column(c).to_numpy() for c in ("n_a", "n_b")), percent)
            ends = zip(batch.column("p_a").to_pylist(), batch.column("p_b").to_pylist(), strict=True)
            bound = [overlap_bound(np.frombuffer(x, "<u2"), np.frombuffer(y, "<u2")) for x, y in ends]
            kept = pa.array(np.array(bound, np.int64) >= least)
            yield batch.select(["a", "b"]).filter(kept).cast(arrow)

    return wide.select("a", "b", "n_a", "n_b", "p_a", "p_b").mapInArrow(run, "a long, b long")


def _mark() -> Column:
    return F.xxhash64("doc_id", "text_hash")


def _map_of(wanted: DataFrame) -> np.ndarray:
    """A bit for every value of the low bits of the ``mark`` of a row: whether a wanted text has it."""
    place = _mark().bitwiseAND((1 << MAP_BITS) - 1).alias("place")
    bit = F.bit_or(F.expr("shiftleft(1L, CAST(place & 63 AS INT))")).alias("bits")
    # At most 2^(MAP_BITS - 6) numbers, whatever the corpus.
    found = wanted.select(place).groupBy(F.shiftright("place", 6).cast("int").alias("at")).agg(bit).toArrow()
    words = np.zeros(1 << (MAP_BITS - 6), np.int64)
    words[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return words


def _mapped(docs: DataFrame, words: np.ndarray, shingle: int) -> DataFrame:
    """Rows (doc_id, text_hash, hashes) of the sets of all rows in the map, and of the few that share a bit with one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column("mark").to_numpy() & ((1 << MAP_BITS) - 1)
            held = batch.filter(pa.array((words[place >> 6] >> (place & 63)) & 1 == 1))
            for rows, texts in sliced(iter([held]), "text", SLICE):
                hashes, at = shingle_hashes(texts, shingle)
                own = [np.unique(hashes[s:e]).view(np.int64) for s, e in zip(at, at[1:], strict=False)]
                ends = pa.array(np.concatenate(([0], np.cumsum([len(o) for o in own]))).astype(np.int32))
                values = pa.array(np.concatenate([np.zeros(0, np.int64), *own]))
                lists = pa.ListArray.from_arrays(ends, values)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text_hash"), lists], ["doc_id", "text_hash", "hashes"])

    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").withColumn("mark", _mark())
    return texts.mapInArrow(run, "doc_id long, text_hash long, hashes array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """Rows (key, hashes) of the wanted sets, cut anew from one text of each."""
    sets = _mapped(docs, _map_of(wanted), shingle)
    same = sets["doc_id"].eqNullSafe(wanted["doc_id"]) & (sets["text_hash"] == wanted["text_hash"])
    return sets.join(wanted, same).select("key", "hashes").dropDuplicates(["key"])


def _verified(pairs: DataFrame, docs: DataFrame, points: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs (a, b) that link; ``pairs`` are first held against the bound."""
    close = staged(_bounded(pairs.distinct(), points, percent), "close")
    keys = close.select(F.col("a").alias("key")).union(close.select("b")).distinct()
    wanted = points.join(keys, "key", "left_semi").select("key", "doc_id", "text_hash")
    sets = staged(_sets(docs, wanted, shingle), "sets")
    wide = close.join(sets.select(F.col("key").alias("b"), F.col("hashes").alias("right")), "b")
    wide = wide.join(sets.select(F.col("key").alias("a"), F.col("hashes").alias("left")), "a")
    both = F.size(F.array_intersect("left", "right")).cast("long")
    union = F.size("left") + F.size("right") - both
    return staged(wide.filter(100 * both >= percent * union).select("a", "b"), "links")


def _distinct_trees(shared: DataFrame) -> DataFrame:
    """Rows (token, key) of one tree of those that have the same members (by two sums of hashes)."""
    sums = [F.sum(F.xxhash64(*by).cast("decimal(38,0)")).alias(f"s{i}") for i, by in enumerate(((F.col("key"),), (F.lit(1), F.col("key"))))]
    marked = shared.groupBy("token").agg(*sums)
    return shared.join(marked.groupBy("s0", "s1").agg(F.min("token").alias("token")).select("token"), "token", "left_semi")


def _bands(n: Column, percent: int) -> Column:
    """Two neighbouring bands of sizes; sets whose sizes allow a link have one in common."""
    # Slightly wider than linked sizes can differ, so that rounding parts none.
    width = max(math.log(100 / max(percent, 1)), 0.01) * 1.0001
    band = F.floor(F.log(n) / width).cast("int")
    return F.array(band, band + 1)


def _apart(shared: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Rows (token, key, n, c) of the trees, with the component ``c``: those with another component in a band of their size."""
    roots = connected(links)
    lab = shared.join(roots.withColumnRenamed("node", "key"), "key", "left")
    lab = lab.select("token", "key", "n", F.coalesce("root", "key").alias("c"))
    banded = lab.select("token", F.explode(_bands(F.col("n"), percent)).alias("band"), "c")
    mixed = banded.groupBy("token", "band").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi")
    mixed = mixed.groupBy("token").agg(F.collect_set("band").alias("mixed"))
    return staged(lab.join(mixed, "token").filter(F.arrays_overlap("mixed", _bands(F.col("n"), percent))).drop("mixed"), "apart")


def _star(apart: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Per tree, one member of its last component: pairs with the members of all others, and the trees without it.

    No link of that member is missed, since the others are of its own component or too small or large.
    """
    last = apart.groupBy("token").agg(F.max(F.struct("c", (-F.col("key")).alias("back"), "n")).alias("m"))
    paired = apart.join(last.select("token", F.col("m.c").alias("own"), (-F.col("m.back")).alias("a"), F.col("m.n").alias("n_a")), "token")
    close = 100 * F.least("n", "n_a") >= percent * F.greatest("n", "n_a")
    return paired.filter("c <> own").filter(close).select("a", F.col("key").alias("b")), paired.filter("key <> a").select("token", "key", "n")


def _trees_of(apart: DataFrame) -> DataFrame:
    """Rows (key, trees): the first trees that hold a set."""
    return apart.groupBy("key").agg(F.slice(F.sort_array(F.collect_set("token")), 1, FIRST_TREES).alias("trees"))


def _dealt(members: DataFrame, parts: Column) -> DataFrame:
    """Members of trees, once for each pair (i, j) of pieces of their tree that has their own ``part``."""
    sizes = members.groupBy("token").agg(parts.cast("int").alias("parts"))
    dealt = members.join(sizes, "token").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    other = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least("part", j).alias("i"), F.greatest("part", j).alias("j"))))
    return dealt.select(*members.columns, "part", other.alias("pair")).select(*members.columns, "part", "pair.i", "pair.j")


def _block_pairs(rows: pa.Table, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of rows of different components, in one pair of pieces, whose points allow a link.

    Pairs that an earlier tree is known to hold are left to that one. Pairs come as they are
    found: a block can hold a pair for every two members.
    """
    n, c, part = (rows.column(x).to_numpy() for x in ("n", "c", "part"))
    at = [np.frombuffer(p, "<u2") for p in rows.column("point").to_pylist()]
    i, j, token = (rows.column(x)[0].as_py() for x in ("i", "j", "token"))
    trees = [Tree(at, n, c, np.flatnonzero(part == p)) if (part == p).any() else None for p in dict.fromkeys((i, j))]
    found = tree_join(trees[0], trees[-1], n, c, percent) if all(trees) else ()
    earlier, size = [{t for t in own if t < token} for own in rows.column("trees").to_pylist()], n.tolist()
    # Leaves are compared over the groups of their smallest set; here each pair has its own.
    return ((x, y) for x, y in found if earlier[x].isdisjoint(earlier[y]) and overlap_bound(at[x], at[y]) >= least_overlap(size[x], size[y], percent))


def _tree_pairs(apart: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that meet in a tree, by blocks of bounded size and by coarse points.

    A block of more than ``PAIRS`` pairs a member has one row instead: its ``token``, and no pair.
    """
    dealt = _dealt(apart, F.ceil(F.count("*") / BLOCK))
    dealt = dealt.join(points.select("key", F.col("coarse").alias("point")).join(_trees_of(apart), "key"), "key")

    def run(rows: pa.Table) -> pa.Table:
        # One pair too many tells a crowded tree; the others are not looked for here.
        most, none = PAIRS * rows.num_rows, pa.array([None], pa.int64())
        found = list(islice(_block_pairs(rows, percent), most + 1))
        if len(found) > most:
            return pa.table({"a": none, "b": none, "token": pa.array([rows.column("token")[0].as_py()], pa.int64())})
        pair = rows.column("key").to_numpy()[np.array(found, np.int64).reshape(-1, 2)]
        return pa.table({"a": pair.min(axis=1), "b": pair.max(axis=1), "token": pa.nulls(len(pair), pa.int64())})

    return dealt.groupBy("token", "i", "j").applyInArrow(run, "a long, b long, token long")


def forest(pairs: Iterable[tuple[int, int]], sets: list[np.ndarray], classes: list[int], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Those pairs that link, less what the classes and the links before them connect."""
    first: dict[int, int] = {}
    root, out = [first.setdefault(c, x) for x, c in enumerate(classes)], []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for x, y in pairs:
        p, q = find(x), find(y)
        if p != q:
            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                root[q] = p
                out.append((x, y))
    return out


def _crowded_links(crowded: DataFrame, apart: DataFrame, docs: DataFrame, points: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) that connect what meets in the trees ``crowded``; their sets are compared where they meet."""
    members = apart.join(crowded, "token", "left_semi")
    wanted = points.join(members.select("key").distinct(), "key", "left_semi")
    sets = staged(_sets(docs, wanted.select("key", "doc_id", "text_hash"), shingle), "sets")
    dealt = _dealt(members, F.greatest(F.ceil(F.count("*") / CROWD), F.ceil(F.sum("n") / CROWD_SHINGLES)))
    dealt = dealt.join(wanted.select("key", "point").join(_trees_of(apart), "key").join(sets, "key"), "key")

    def run(rows: pa.Table) -> pa.Table:
        lists = rows.column("hashes").combine_chunks()
        at, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        own = [values[s:e] for s, e in zip(at, at[1:], strict=False)]
        links = forest(_block_pairs(rows, percent), own, rows.column("c").to_pylist(), percent)
        pair = rows.column("key").to_numpy()[np.array(links, np.int64).reshape(-1, 2)]
        return pa.table({"a": pair.min(axis=1), "b": pair.max(axis=1)})

    return staged(dealt.groupBy("token", "i", "j").applyInArrow(run, "a long, b long"), "links")


def similar(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(rows, links): doc_id, n_shingles, key and root of every row; links (a, b) between keys of sets.

    ``links`` holds enough links between different sets to connect every component.
    """
    spark = df.sparkSession
    docs = df.select(df[doc_id].cast("long").alias("doc_id"), text_of(df[text]).alias("text"))
    marked = keyed(staged(described(docs, rarity(docs, shingle), shingle, percent), "shingles"))
    lists = marked.filter("n > 0").select(F.explode("rare").alias("token"), "key")
    trees = lists.groupBy("token").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).filter("lo <> hi")
    shared = staged(lists.join(trees.select("token"), "token").distinct(), "shared")
    sizes = marked.filter("n > 0").select("key", "n").distinct()
    shared = staged(_distinct_trees(shared).join(sizes, "key"), "trees")
    # No rows, and no Python workers of their own for that.
    links = spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))
    apart = _apart(shared, links, percent)
    active = apart.select("key").distinct()
    points = marked.join(active, "key", "left_semi").select("key", "n", "point", "coarse", "doc_id", "text_hash")
    points = staged(points.dropDuplicates(["key"]), "points")
    for _ in range(STARS):
        pairs, shared = _star(apart, percent)
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        links = links.union(_verified(pairs, docs, points, shingle, percent))
        apart = _apart(shared, links, percent)
    met = staged(_tree_pairs(apart, points, percent), "met")
    links = links.union(_verified(met.filter("token IS NULL").select("a", "b"), docs, points, shingle, percent))
    crowded = met.filter("token IS NOT NULL").select("token").distinct()
    if not crowded.isEmpty():
        links = links.union(_crowded_links(crowded, apart, docs, points, shingle, percent))
    roots = connected(links).select(F.col("node").alias("key"), "root")
    rows = marked.select("doc_id", F.col("n").alias("n_shingles"), "key").join(roots, "key", "left")
    return rows.withColumn("root", F.coalesce("root", "key")), links


def components(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Columns doc_id, n_shingles and component_id, one row per row of ``df``."""
    rows = staged(similar(df, doc_id, text, shingle, percent)[0].drop("key"), "rooted")
    smallest = rows.groupBy("root").agg(F.min("doc_id").alias("component_id")).filter("root IS NOT NULL")
    found = rows.join(smallest, "root", "left")
    own = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", own.alias("component_id"))


def op11_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set size and component of every document."""
    return components(table(spark, sf_dir, "documents"))


OP11_SQL = f"""
WITH RECURSIVE texts AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' '))) END AS s FROM texts),
parts AS MATERIALIZED (SELECT rid, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS MATERIALIZED (SELECT a.rid AS a, b.rid AS b FROM parts a JOIN parts b ON a.shingle = b.shingle AND a.rid <> b.rid
  GROUP BY a.rid, b.rid, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
reached(rid, other) AS (SELECT rid, rid FROM sets UNION SELECT r.rid, l.b FROM reached r JOIN links l ON l.a = r.other)
SELECT s.doc_id, CAST(len(any_value(s.s)) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
FROM sets s JOIN reached r ON r.rid = s.rid JOIN sets o ON o.rid = r.other GROUP BY s.rid, s.doc_id
"""
