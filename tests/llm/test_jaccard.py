"""The Jaccard join against brute force, and its edge cases."""

from __future__ import annotations

import random
import re
import tracemalloc
from itertools import islice

import numpy as np
import pyarrow as pa
import pytest

from survloom.llm import jaccard
from survloom.llm.common import sliced


def plain_set(text: str | None) -> set[str]:
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if len(words) < 5:
        return {" ".join(words)} if words else set()
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows: list[tuple]) -> list[tuple]:
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least: dict = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def corpus(seed: int, n: int) -> list[tuple]:
    """Copies at all distances around the threshold, with a passage that many share."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    shared = " ".join(rng.choices(words, k=30))
    texts = [" ".join(rng.choices(words, k=rng.choice([3, 4, 5, 6, 12, 60, 200]))) for _ in range(n // 4)]
    while len(texts) < n:
        base = rng.choice(texts).split(" ")
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            base[rng.randrange(len(base))] = rng.choice(words)
        texts.append(" ".join(base) + rng.choice(["", "", " " + shared, " end"]))
    rows = [(i, t.upper() if i % 7 == 0 else t.replace(" ", "\n", 1)) for i, t in enumerate(texts)]
    return [*rows, (9000, None), (9001, ""), (9002, " \t"), (9003, "one"), (9004, "One"), (None, texts[0]), (3, texts[5]), (3, texts[5]), (None, "alone here")]


def found(spark, rows: list[tuple], **options) -> list[tuple]:
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = jaccard.components(df, **options)
    return sorted((tuple(r) for r in out.select("doc_id", "n_shingles", "component_id").collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rows = corpus(seed, 220)
    assert found(spark, rows) == brute(rows)


def test_trees_alone_lose_no_link(spark, monkeypatch):
    """Without the tests of single members every link is found in a tree."""
    monkeypatch.setattr(jaccard, "STARS", 0)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rows = corpus(3, 200)
    assert found(spark, rows) == brute(rows)


def drifting(n: int) -> list[tuple]:
    """Copies of a text that start later and later, so that no copy links with all others."""
    words = [f"w{i}" for i in range(300)]
    return [(i, " ".join([*words[i % 16 * 8 :][:150], f"end{i}"])) for i in range(n)]


@pytest.mark.parametrize("shingles", [1 << 21, 2000])
def test_pairs_of_a_drifting_group_grow_with_its_members(spark, monkeypatch, shingles):
    """Pairs left to joins were a share of all pairs of such a group."""
    monkeypatch.setattr(jaccard, "STARS", 0)
    monkeypatch.setattr(jaccard, "CROWD_SHINGLES", shingles)
    verified, counts = jaccard._verified, []

    def counted(pairs, *rest):
        counts.append(pairs.distinct().count())
        return verified(pairs, *rest)

    monkeypatch.setattr(jaccard, "_verified", counted)
    rows = drifting(240)
    assert found(spark, rows) == brute(rows)
    assert sum(counts) < 8 * len(rows)


def test_sets_of_other_sizes_are_not_paired(spark, monkeypatch):
    """Sets that share a passage were handed to joins, points and all, whatever their sizes."""
    verified, counts = jaccard._verified, []

    def counted(pairs, *rest):
        counts.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(jaccard, "_verified", counted)
    shared = " ".join(f"s{i}" for i in range(30))
    rows = [(i, " ".join([shared, *[f"w{i}_{j}" for j in range(40 * 2**i)]])) for i in range(8)]
    assert found(spark, rows) == brute(rows)
    assert sum(counts) == 0


def test_only_wanted_texts_are_sent_to_joins(spark, monkeypatch):
    """All texts were sent to the join with the wanted ones."""
    mapped, counts = jaccard._mapped, []

    def counted(*args):
        sent = mapped(*args)
        counts.append(sent.count())
        return sent

    monkeypatch.setattr(jaccard, "_mapped", counted)
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(50))) for i in range(200)]
    rows += [(None, rows[0][1] + " end"), (500, rows[1][1] + " end"), (501, rows[0][1])]
    assert found(spark, rows) == brute(rows)
    assert 2 < max(counts) < 10


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_linked_sizes_share_a_band(spark, percent):
    n = spark.range(1, 3000).selectExpr("id AS n", f"CAST(id * 100 / {percent} AS LONG) AS most")
    parted = n.filter(~jaccard.F.arrays_overlap(jaccard._bands(jaccard.F.col("n"), percent), jaccard._bands(jaccard.F.col("most"), percent)))
    assert parted.count() == 0


def test_coarse_points_allow_no_less():
    rng = np.random.default_rng(7)
    for _ in range(100):
        a, b = (jaccard.point(np.unique(rng.integers(0, 1 << 63, rng.integers(1, 900)).astype(np.uint64) << np.uint64(1))) for _ in range(2))
        assert jaccard.overlap_bound(jaccard.coarse(a), jaccard.coarse(b)) >= jaccard.overlap_bound(a, b)
        assert jaccard.overlap_bound(jaccard.coarse(a), b) >= jaccard.overlap_bound(a, b)


def test_bound_is_never_below_the_overlap():
    rng = np.random.default_rng(5)
    for _ in range(200):
        pool = rng.integers(0, 1 << 63, 400).astype(np.uint64)
        a = np.unique(rng.choice(pool, rng.integers(1, 300)))
        b = np.unique(rng.choice(pool, rng.integers(1, 300)))
        assert jaccard.overlap_bound(jaccard.point(a), jaccard.point(b)) >= len(np.intersect1d(a, b))


def test_tree_join_equals_all_pairs():
    rng = np.random.default_rng(6)
    pool = rng.integers(0, 1 << 63, 260).astype(np.uint64)
    sets = [np.unique(rng.choice(pool, rng.integers(120, 260))) for _ in range(90)]
    points, sizes = [jaccard.point(s) for s in sets], np.array([len(s) for s in sets])
    classes = rng.integers(0, 60, len(sets))
    tree = jaccard.Tree(points, sizes, classes, np.arange(len(sets)))
    got = {tuple(sorted(p)) for p in jaccard.tree_join(tree, tree, sizes, classes)}
    want = {
        (i, j)
        for j in range(len(sets))
        for i in range(j)
        if classes[i] != classes[j]
        and jaccard.overlap_bound(points[i], points[j]) >= jaccard.least_overlap(int(sizes[i]), int(sizes[j]))
        and 100 * min(sizes[i], sizes[j]) >= 80 * max(sizes[i], sizes[j])
    }
    assert got == want


def test_pairs_of_a_crowded_block_are_not_all_listed(monkeypatch):
    """A block of equal points was listed whole, a pair for every two members."""
    bound, calls = jaccard.overlap_bound, []

    def counted(*ends):
        calls.append(1)
        return bound(*ends)

    monkeypatch.setattr(jaccard, "overlap_bound", counted)
    n = 128
    numbers = {"key": range(n), "n": [32] * n, "c": range(n), **{x: [0] * n for x in ("token", "part", "i", "j")}}
    same = jaccard.point(np.arange(32, dtype=np.uint64) << np.uint64(59)).tobytes()
    rows = pa.table({**{k: pa.array(v, pa.int64()) for k, v in numbers.items()}, "point": [same] * n, "trees": [[0]] * n})
    assert len(list(islice(jaccard._block_pairs(rows, 80), 4 * n + 1))) == 4 * n + 1
    assert len(calls) < 8 * n
    assert len(list(jaccard._block_pairs(rows, 80))) == n * (n - 1) // 2


def test_texts_of_a_batch_become_strings_slice_by_slice():
    """All texts of a batch were strings at once, whatever the slice."""
    texts = [None, "", *(f"{i:05d}" * 200 for i in range(1000)), "é" * 20_000, "z"]
    batch = pa.RecordBatch.from_pydict({"id": range(len(texts)), "text": texts})
    tracemalloc.start()
    sizes = [(rows.num_rows, sum(map(len, own))) for rows, own in sliced(iter([batch]), "text", 10_000)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300_000
    assert sum(n for n, _ in sizes) == len(texts) and sum(c for _, c in sizes) == 1_020_001
    assert all(c <= 10_000 or n == 1 for n, c in sizes)
    again = [t for rows, own in sliced(iter([batch]), "text", 10_000) for t in zip(rows.column("id").to_pylist(), own, strict=True)]
    assert again == [(i, t or "") for i, t in enumerate(texts)]


def test_long_text_and_one_long_word(spark):
    long = " ".join(f"x{i}" for i in range(60_000))
    rows = [(1, long), (2, long + " more"), (3, "y" * 500_000), (4, "y" * 500_000 + " z"), (5, "Y" * 500_000)]
    assert found(spark, rows) == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    assert found(spark, []) == []
    df = spark.createDataFrame([(1, "a b c d e f", 5, 6), (2, "A b c d e f", 7, 8)], "doc_id long, text string, key long, token long")
    assert sorted(tuple(r) for r in jaccard.components(df).collect()) == [(1, 2, 1), (2, 2, 1)]


def test_equal_first_hashes_stay_apart(spark):
    marked = spark.createDataFrame([(1, 7, 1), (1, 7, 2), (1, 8, 3), (0, 0, 0)], "n long, k1 long, k2 long")
    keys = [r["key"] for r in jaccard.keyed(marked).orderBy("k1", "k2").collect()]
    assert keys[0] is None and len(set(keys[1:])) == 3
