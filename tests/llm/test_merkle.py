"""The Merkle manifest against a plain tree, and its edge cases."""

from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import functions as F

from survloom.llm import merkle


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row: tuple) -> str:
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], row[1])))


def climb(leaves: list[str]) -> list[list[str]]:
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def brute(rows: list[tuple]) -> list[tuple]:
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of (doc_id, text, lang, source, n_chars)."""
    by_lang: dict = {}
    for row in rows:
        by_lang.setdefault(row[2], []).append(row)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by_lang[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[lang] = climb([plain_leaf(r) for r in by_lang[lang]])
    top = climb([trees[lang][-1][0] for lang in langs])
    out = []
    for g, lang in enumerate(langs):
        for i, row in enumerate(by_lang[lang]):
            text = row[1]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            new, proof = plain_leaf((row[0], text, *row[2:])), ""
            for levels, at in ((trees[lang], i), (top, g)):
                for level in levels[:-1]:
                    run = at // 8 * 8
                    mine = level[run : run + 8]
                    proof += "".join(d for k, d in enumerate(mine) if run + k != at)
                    new = h(*(new if run + k == at else d for k, d in enumerate(mine)))
                    at //= 8
            out.append((row[0], plain_leaf(row), trees[lang][-1][0], top[-1][0], h(proof), new, new == top[-1][0]))
    return sorted(out, key=repr)


def found(spark, tmp_path, rows: list[tuple], extra: bool = False) -> list[tuple]:
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        df = df.withColumns({"tree": F.lit("x"), "digest": F.lit(1), "place": F.lit(2)})
    df.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    out = merkle.op13_merkle(spark, str(tmp_path))
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in out.select(names).collect()), key=repr)


ODD = [
    (None, "No Id", "en", "s", 5), (None, None, None, None, None), (7, "", "en", "s", 0), (7, "", "en", "s", 0), (7, "Other", "en", None, 5),
    (8, "ÀB", "é", "s", 2), (9, "x" * 300_000 + "Q", "z", "s", 300_001), (12, "A", "", "s", 1), (-3, "Minus", "en", "s", 5),
]


def test_manifest_equals_plain_tree(spark, tmp_path):
    rows = [(i, f"Text {i}", ("en", "de", None)[i % 3], f"src{i % 2}", 6) for i in range(10, 200)] + ODD
    assert found(spark, tmp_path, rows, extra=True) == brute(rows)


def test_versions_go_on_above_the_blocks(spark, tmp_path, monkeypatch):
    """Small blocks: most of a version's copies lie in levels above its leaf's block."""
    monkeypatch.setattr(merkle.manifest, "__defaults__", (None, 1))
    rows = [(i, f"Text {i}", f"lang{i % 70}" if i < 140 else "en", "s", 6) for i in range(900)] + ODD
    assert found(spark, tmp_path, rows) == brute(rows)


def test_several_whole_blocks(spark, tmp_path):
    rows = [(i, f"T{i}", "en", "s", 3) for i in range(2 * merkle.ARITY**merkle.LEVELS + 1)] + [(-1, "A", "de", "s", 1)]
    assert found(spark, tmp_path, rows) == brute(rows)


def test_a_version_copies_only_its_ancestors(spark):
    rows = [(i, "a", "en") for i in range(70)]
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    changed = F.when(F.col("id") % 10 == 0, F.sha2(F.lit("new"), 256))
    out = merkle.manifest(df, ["id", "text"], "id", "lang", changed).collect()
    whole = {d for level in climb([r["leaf"] for r in sorted(out, key=lambda r: r["id"])]) for d in level}
    for r in out:
        if r["id"] % 10:
            assert r["copies"] is None and r["folded_root"] == r["root"]
        else:
            assert len(r["copies"]) == 4 and not whole & set(r["copies"]) and r["copies"][-1] == r["folded_root"]


def test_one_row_and_no_row(spark, tmp_path):
    assert found(spark, tmp_path, [(3, "A", "en", "s", 1)]) == brute([(3, "A", "en", "s", 1)])
    assert found(spark, tmp_path, []) == []


def test_one_document_repeated(spark, tmp_path):
    rows = [(1, "Same", "en", "s", 4)] * 100 + [(2, "B", "en", "s", 1)]
    assert found(spark, tmp_path, rows) == brute(rows)
