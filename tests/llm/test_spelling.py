"""Spelling variants against brute force, and their edge cases."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

from survloom.llm import spelling


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows: list[tuple]) -> list[tuple]:
    counts: Counter = Counter()
    for doc, text in rows:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for run in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    form, n_near = {}, {}
    for w, n in words.items():
        others = [o for o in words if near(w, o)]
        best = min(others, key=lambda o: (-words[o], o), default=None)
        n_near[w] = len(others)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, n_near[w], words[form[w]] if form[w] else None))
    return sorted(out)


def found(spark, rows: list[tuple]) -> list[tuple]:
    df = spark.createDataFrame(rows, "doc_id long, text string")
    vocab = spelling.vocabulary(df)
    out = spelling.variants(vocab).select("word", "form", "root", "n", "n_near", "form_n").collect()
    return sorted((tuple(r) for r in out), key=lambda r: r[0])


def corpus(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    base = ["".join(rng.choices("abéz", k=rng.choice([6, 7, 8, 30]))) for _ in range(12)]
    words = list(base)
    for w in base * 4:
        at = rng.randrange(len(w))
        words.append(rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abéz") + w[at:], w[:at] + "q" + w[at + 1 :], w[:at] + w[at] + w[at:]]))
    weights = [rng.choice([1, 1, 6, 40, 300]) for _ in words]
    rows = [(i, " ".join(rng.choices(words, weights, k=120)).replace(" ", rng.choice([" ", "-", "1"]))) for i in range(60)]
    return [*rows, (None, rows[0][1].upper()), (5, None), (6, ""), (7, rows[3][1]), (7, rows[3][1])]


def test_variants_equal_brute_force(spark):
    for seed in (1, 2, 3):
        rows = corpus(seed)
        want = brute(rows)
        assert len(want) > 20 and any(r[1] for r in want)
        assert found(spark, rows) == want


def test_many_ranges_number_the_same_tries(spark, monkeypatch):
    """With a word or two to a range, most paths belong to the first words of ranges."""
    rows = corpus(4)
    monkeypatch.setattr(spelling, "RANGE_WORDS", 2)
    assert found(spark, rows) == brute(rows)


def test_nodes_are_prefixes():
    rng = random.Random(3)
    words = sorted({"".join(rng.choices("ab", k=rng.randrange(1, 9))) for _ in range(200)})
    cuts = sorted(rng.sample(range(1, len(words)), 11))
    ranges = [words[s:e] for s, e in zip([0, *cuts], [*cuts, len(words)], strict=True)]
    firsts = [r[0] for r in ranges]
    owned = spelling.owners(firsts)
    seen: dict = {}
    for i, part in enumerate(ranges):
        for word, nodes in zip(part, spelling.number_range(i, part, firsts, owned), strict=True):
            for d, node in enumerate(nodes.tolist()):
                assert seen.setdefault(node, word[:d]) == word[:d]
    assert len(seen) == len({w[:d] for w in words for d in range(len(w) + 1)})


def test_repeated_letters_count_once(spark):
    rows = [(1, "aabbcc " * 40 + "aabbc " * 6 + "aaabbcc " * 6)]
    assert found(spark, rows) == brute(rows)


def test_long_word_ties_and_empty(spark):
    long = "a" * 20_000
    rows = [(2, f"{long} {long}b " * 5 + "casaéx casabx casacx " * 5 + "casadx " * 25)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == [] and found(spark, [(1, "one word")]) == []


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "mother " * 5, "x", 3)], "doc_id long, text string, word string, n long")
    assert [tuple(r) for r in spelling.variants(spelling.vocabulary(df)).collect()] == [("mother", None, "mother", 5, 0, None)]
