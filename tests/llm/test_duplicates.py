"""Near-duplicates, components and repeated passages against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from survloom.llm import components, simhash, substrings
from survloom.settings import staged


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    groups = {}
    for i, x in enumerate(ids):
        groups.setdefault(find(i), []).append(x)
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(ids))]


TEXTS = ["", None, " \t\n", "One", "one two", "ONE TWO", "a b c d e f", "A  b\nc d e f", "ÀB çd é f x y", "z " * 5000]


def test_fingerprints():
    assert simhash.fingerprints([t or "" for t in TEXTS]).tolist() == [plain_fingerprint(t) for t in TEXTS]


@pytest.mark.parametrize("block", [3, 2048])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "_SMALL", 6)
    draw = random.Random(5)
    prints = [0]
    for _ in range(25):
        seed = draw.getrandbits(64)
        for _ in range(draw.choice([1, 3, 12])):
            prints.append(seed)
            for bit in draw.sample(range(64), draw.randint(0, 3)):
                seed ^= 1 << bit
    prints += [1 << b for b in range(40)]
    ids = list(range(100, 100 + len(prints)))
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    marked = spark.createDataFrame(list(zip(ids, signed, strict=True)), "doc_id long, fp long")
    found = {r.fp: r.component_id for r in simhash.groups(marked).collect()}
    want = dict(zip(signed, plain_components(ids, prints), strict=True))
    assert found == want


def test_grid_cells_are_not_broadcast(spark):
    nodes = staged(spark.range(40).select(F.shiftleft("id", 20).alias("fp")))
    plan = simhash.links(nodes)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_documents_and_the_one_that_stays(spark):
    rows = [(i, t, "c", 7) for i, t in enumerate(TEXTS)] + [(3, "One", "c", 7), (None, "solo solo solo solo", "c", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, root int")
    prints = [plain_fingerprint(r[1]) for r in rows]
    want = sorted(zip([r[0] for r in rows], [f"{p:016x}" for p in prints], plain_components([r[0] for r in rows], prints), strict=True), key=str)
    found = simhash.near_duplicates(df).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in found), key=str) == want
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted({w[2] for w in want}, key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == simhash.keep_one(df.limit(0)).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(50)] + [(5, 5), (None, 3), (5, 4)]
    found = {r.node: r.root for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(50)}}


PASSAGE = "This passage stands here for the first time. It has several sentences of some length. They all come back later on. The end of it comes now."


def test_units_do_not_depend_on_what_stands_before():
    def tails(text):
        return [text[s:e] for s, e, _ in substrings.units(text)]

    assert tails(f"some words and {PASSAGE}")[1:] == tails(PASSAGE)
    assert [n for *_, n in substrings.units("The The The The The\nOf. And. A longer sentence goes here.")] == [5, 2, 5]
    assert substrings.units("") == substrings.units(" \n\n ") == []


def plain_dedup(rows):
    first, out = {}, []
    ranked = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    for i in ranked:
        for n, (s, e, _) in enumerate(substrings.units(rows[i][1] or "")):
            first.setdefault(substrings.digest(rows[i][1][s:e]), (rows[i][0], n))
    for doc_id, text in rows:
        spans, run = [], []
        for n, (s, e, w) in [*enumerate(substrings.units(text or "")), (None, (0, 0, 0))]:
            if n is not None and first[substrings.digest(text[s:e])] != (doc_id, n):
                run.append((s, e, w))
                continue
            if sum(w for *_, w in run) >= substrings.LEAST_WORDS:
                spans.append((run[0][0], run[-1][1]))
            run = []
        out.append((doc_id, None if text is None else substrings.cut_out(text, spans), spans))
    return out


def test_passages_stay_once(spark):
    rows = [
        (5, f"own words in five {PASSAGE} and own words after"), (2, PASSAGE), (9, PASSAGE.upper().replace(" ", "  ")), (4, "Of. The."),
        (6, "Of. The.\nSomething else that is quite unlike the rest."), (7, None), (8, ""), (3, "x " * 30000), (11, "x " * 30000),
        (12, "A line that comes twice in this text.\nA line that comes twice in this text."), (None, PASSAGE),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, key int")
    found = substrings.deduplicate(df)
    assert found.columns == ["doc_id", "text", "key", "removed"]
    got = sorted(((r.doc_id, r.text, [(s.start, s.end) for s in r.removed]) for r in found.collect()), key=str)
    assert got == sorted(plain_dedup(rows), key=str)
    by_id = {r[0]: r[1] for r in got}
    assert by_id[2] == PASSAGE and by_id[9] == by_id[11] == by_id[None] == "" and by_id[4] == "Of. The."
    assert by_id[5] == "own words in five and own words after"


def test_repeated_rows_are_one_document(spark):
    df = spark.createDataFrame([(1, PASSAGE)] * 3 + [(2, "Nothing shared with any other text at all, really.")], "doc_id long, text string")
    assert sorted({(r.doc_id, r.text == PASSAGE) for r in substrings.deduplicate(df).collect()}) == [(1, True), (2, False)]
    assert substrings.deduplicate(df.limit(0)).count() == 0
