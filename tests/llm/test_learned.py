"""Classifiers: gradients, held-out accuracy, and the cases they define."""

from __future__ import annotations

import random

import numpy as np
import pytest

from survloom.llm import language, toxicity

GOOD, BAD = "the river runs past a quiet town and its old mill".split(), ["idiot", "scum", "moron"]


def sentence(draw, extra=()):
    words = [draw.choice(GOOD) for _ in range(12)] + list(extra)
    draw.shuffle(words)
    return " ".join(words)


def test_neutral_mentions_do_not_count():
    """A term that only toxic documents mention gains no weight under the penalty."""
    draw = random.Random(3)
    other = toxicity.swaps()
    texts, labels = [], []
    for i in range(200):
        toxic = i % 2
        texts.append(sentence(draw, [draw.choice(BAD), "muslims"] if toxic else []))
        labels.append(toxic)
    names = sorted({f for t in texts for f in toxicity.features_of(toxicity.words_of(t))} | set(other))
    place = {n: i for i, n in enumerate(names)}

    def matrix(items):
        out = np.zeros((len(items), len(names)), np.float32)
        for i, t in enumerate(items):
            out[i, [place[f] for f in toxicity.features_of(toxicity.words_of(t)) if f in place]] = 1
        return out

    own = matrix(texts)
    copies = [matrix([toxicity.counterfactual(t, other) for t in texts]), matrix([t.replace("muslims", "") for t in texts])]
    label = np.array(labels, np.float32)
    free, fair = (toxicity._minimise(own, copies, label, p)[place["muslims"]] for p in (0.0, 5.0))
    assert free > 0.3 and abs(fair) < free / 5


def test_toxicity_end_to_end(spark):
    draw = random.Random(1)
    docs = [(i, sentence(draw, [draw.choice(BAD)] if i % 4 == 0 else [])) for i in range(400)] + [(1000, None), (1001, ""), (None, "scum idiot")]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(400)] + [(0, 1, 0), (None, 1, 1), (3, 0, None)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, toxic string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, marks)
    scored = toxicity.score(df, model)
    assert scored.columns == [*df.columns, "score"]
    rows = {r.doc_id: r.score for r in scored.collect()}
    assert all((rows[i] >= toxicity.THRESHOLD) == (i % 4 == 0) for i in range(400))
    assert rows[1000] == rows[1001] < toxicity.THRESHOLD < rows[None]
    assert toxicity.fit(df, marks.limit(0)).score("scum") < 1e-9
    assert toxicity.fit(df, marks.filter("toxic = 1")).score("") > 0.99
    assert toxicity.score(df.limit(0), model).count() == 0


def test_gradients_of_the_recurrent_network():
    draw = np.random.default_rng(0)
    h = language.HIDDEN
    a = {"out_b": draw.normal(size=3)}
    for way in "fb":
        a |= {f"{way}_in": draw.normal(size=(256, 3 * h)), f"{way}_gates": draw.normal(size=(h, 2 * h)), f"{way}_cand": draw.normal(size=(h, h)), f"{way}_out": draw.normal(size=(h, 3))}
    codes, valid, label = draw.integers(0, 256, (5, 4)), np.ones((5, 4), bool), draw.integers(0, 3, 4)
    valid[3:, 1] = False

    def loss():
        logits = np.broadcast_to(a["out_b"], (5, 4, 3)).copy()
        for way, order in (("f", range(5)), ("b", range(4, -1, -1))):
            state = np.zeros((4, h))
            for t in order:
                state = language._step(state, a[f"{way}_in"][codes[t]], a[f"{way}_gates"], a[f"{way}_cand"])[0] * valid[t][:, None]
                logits[t] += state @ a[f"{way}_out"]
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        return -(np.log(p[:, np.arange(4), label]) * valid).sum() / valid.sum()

    gradient = language._gradients(a, codes, valid, label)
    for name, array in a.items():
        at = (codes[0, 0], 5) if name.endswith("_in") else tuple(0 for _ in array.shape)
        kept = array[at]
        array[at] = kept + 1e-5
        up = loss()
        array[at] = kept - 1e-5
        down = loss()
        array[at] = kept
        assert gradient[name][at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-7)


def test_scoring_is_the_step_of_training():
    draw = np.random.default_rng(1)
    texts = ["short", "", "a much longer text " * 30]
    model = language.train(["x", "y"], ["aaaa bbb"] * 20 + ["zzz yyy"] * 20, [0] * 20 + [1] * 20)
    p = model.probabilities(texts)
    assert p[1].tolist() == [0, 0] and np.allclose(p[[0, 2]].sum(axis=1), 1, atol=1e-4)
    data = np.frombuffer(b"short", np.uint8)
    logits = np.broadcast_to(model.arrays["out_b"], (5, 2)).copy()
    for way, order in (("f", range(5)), ("b", range(4, -1, -1))):
        state = np.zeros((1, language.HIDDEN), np.float32)
        for t in order:
            state = language._step(state, model.arrays[f"{way}_in"][data[t : t + 1]], model.arrays[f"{way}_gates"], model.arrays[f"{way}_cand"])[0]
            logits[t] += (state @ model.arrays[f"{way}_out"])[0]
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    assert np.allclose(p[0], (e / e.sum(axis=1, keepdims=True)).mean(axis=0), atol=1e-4)
    assert draw is not None


def test_language_end_to_end(spark):
    draw = random.Random(2)
    words = {"en": "the and with this from river".split(), "de": "der und nicht über straße wasser".split()}
    rows = [(i, " ".join(draw.choice(words[lang]) for _ in range(25)), lang) for i in range(300) for lang in [("en", "de")[i % 2]]]
    rows += [(900, None, "en"), (901, "123 !!", "de"), (902, "", None), (None, "the river and the river", None)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    model = language.fit(df)
    out = language.predict(df, model)
    found = {r.doc_id: (r.lang_pred, r.score) for r in out.collect()}
    assert sum(found[i][0] == ("en", "de")[i % 2] for i in range(300)) >= 297
    assert found[900] == found[901] == found[902] == ("und", 0.0) and found[None][0] == "en"
    assert language.fit(df.limit(0)) is None
    assert {r.lang_pred for r in language.predict(df, None).collect()} == {"und"}
