"""The stages in order, each on what the one before kept."""

from __future__ import annotations

import corpus_pipeline
from survloom.llm import substrings
from survloom.settings import staged
from test_duplicates import PASSAGE, plain_components, plain_fingerprint
from test_tokens import check_packing

import random

from pyspark.sql import functions as F


def test_stages(spark, tmp_path):
    draw = random.Random(8)
    vocabulary = [f"w{draw.getrandbits(40):x}" for _ in range(500)]
    prose = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n)).capitalize() + "."
    rows = [(i, prose(60) + (" idiot scum" if i % 5 == 0 else "")) for i in range(200)]
    rows += [(300, rows[1][1]), (301, rows[1][1] + " again"), (302, prose(30) + "\n" + PASSAGE), (303, prose(30) + " so " + PASSAGE), (304, "write to a@b.co today " + prose(20)), (305, None), (306, "")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, folder = spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)
    texts = {i: t for i, t in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = staged(stage(spark, docs, folder), "test")
        assert docs.columns == df.columns
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "toxicity":
            assert set(after) == {i for i in before if not (i < 200 and i % 5 == 0)}
        elif name == "simhash":
            ids = list(before)
            assert set(after) == set(plain_components(ids, [plain_fingerprint(before[i]) for i in ids]))
        elif name == "substrings":
            assert after[302] == texts[302] and PASSAGE not in after[303] and after[303].startswith(texts[303][:40])
            assert {i: t for i, t in after.items() if i < 200} == {i: t for i, t in before.items() if i < 200}
        else:
            assert after[304].startswith("write to <EMAIL> today") and len(after) == len(before)
        assert all(r.n_chars is None or r.n_chars == len(r.text or "") for r in docs.collect())
    check_packing(corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect(), {r.doc_id: r.text for r in docs.collect()})
    assert corpus_pipeline.run(spark, folder).count() > 0
    assert substrings.LEAST_WORDS == 8


def test_stages_take_clashing_names_nulls_and_no_rows(spark, tmp_path):
    rows = [(1, "plain words that say nothing in particular", 1), (1, "plain words that say nothing in particular", 1), (2, None, None), (None, "", 2), (3, "ask a@b.co", 3), (4, "ask a@b.co " * 4000, 4)]
    names = "id hash key spans base kept_id kept_hash kept_n found_id found_key toxicity removed fp root term share n".split()
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumns({n: F.lit(i) for i, n in enumerate(names) if n != "n_chars"})
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (df, df.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = staged(stage(spark, docs, str(tmp_path)), "test")
            assert out.columns == docs.columns, name
            kept = sorted((tuple(r)[3:] for r in out.collect()), key=repr)
            assert kept == [tuple(range(len(names)))] * len(kept), name
            if name == "simhash":
                # The null and the empty text are one group, and the repeated row another.
                assert sorted((r.doc_id for r in out.collect()), key=repr) == ([1, 2, 3, 4] if docs is df else [])
            else:
                assert out.count() == docs.count()
