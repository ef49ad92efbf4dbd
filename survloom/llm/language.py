"""Language identification by a bidirectional gated recurrent network over bytes.

The network labels every byte position of a text; a document's probabilities are the
mean of its positions'. Texts are lower-cased, encoded as UTF-8 and cut into runs of
``RUN`` bytes, which are read forwards and backwards, each from a zero state, many
runs at a time. Training is plain numpy (backpropagation through time, Adam) on a
bounded sample of runs from documents with a language that are not held out.

A text that is null or has no letter is ``und`` with score 0. If no language can be
learned, all are ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from survloom.llm.common import held_out, sliced, table, text_of

HIDDEN, RUN = 8, 64
#: Bound of the training sample: documents per language, and runs of each of them.
PER_LANGUAGE, RUNS_OF_DOCUMENT = 400, 6
STEPS, BATCH, RATE = 300, 128, 0.03
#: Runs that are read side by side in scoring.
WIDTH = 4096


@dataclass
class Model:
    """Languages, and arrays by name; a few kilobytes."""

    languages: list[str]
    arrays: dict[str, np.ndarray]

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """Mean over all byte positions of each text; a row of zeros for an empty text."""
        data, runs, owner, length = _runs([t.lower().encode() for t in texts])
        total = np.zeros((len(texts), len(self.languages)))
        for start in range(0, len(runs), WIDTH):
            end = min(start + WIDTH, len(runs))
            at = runs[start:end, None] + np.arange(RUN)
            valid = np.arange(RUN) < length[start:end, None]
            codes = np.where(valid, data[np.minimum(at, len(data) - 1)], 0).T.astype(np.int64, order="C")
            p = _positions(self.arrays, codes, valid.T)
            np.add.at(total, owner[start:end], p)
        return total / np.maximum(1, np.bincount(owner, weights=length, minlength=len(texts)))[:, None]


def _runs(encoded: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, and the start, text number and length of each run."""
    sizes = np.array([len(e) for e in encoded], np.int64)
    starts = np.cumsum(sizes) - sizes
    number = -(-sizes // RUN)
    owner = np.repeat(np.arange(len(encoded)), number)
    within = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
    length = np.minimum(RUN, sizes[owner] - within * RUN)
    return np.frombuffer(b"".join(encoded), np.uint8), starts[owner] + within * RUN, owner, length


def _bend(x: np.ndarray) -> np.ndarray:
    """The activation x / (1 + |x|); its slope is (1 - |value|) squared."""
    return x / (1 + np.abs(x))


def _slope(value: np.ndarray) -> np.ndarray:
    return (1 - np.abs(value)) ** 2


def _step(state: np.ndarray, given: np.ndarray, recurrent: np.ndarray, candidate: np.ndarray) -> tuple[np.ndarray, ...]:
    """One gated step; gates are bent to the range from 0 to 1."""
    gates = _bend(given[:, : 2 * HIDDEN] + state @ recurrent)
    inner = state @ candidate
    update, reset = 0.5 + 0.5 * gates[:, :HIDDEN], 0.5 + 0.5 * gates[:, HIDDEN:]
    new = _bend(given[:, 2 * HIDDEN :] + reset * inner)
    return new + update * (state - new), gates, update, reset, inner, new


def _positions(a: dict[str, np.ndarray], codes: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Per run, the language probabilities of its valid positions, summed.

    The same steps as :func:`_step`, column-wise and in place.
    """
    steps, width = codes.shape
    logits = np.empty((steps, len(a["out_b"]), width), np.float32)
    part, scale = np.empty_like(logits[0]), np.empty((2 * HIDDEN, width), np.float32)
    given, both, inner = (np.empty((k * HIDDEN, width), np.float32) for k in (3, 2, 1))
    gates, new, update, reset = given[: 2 * HIDDEN], given[2 * HIDDEN :], given[:HIDDEN], given[HIDDEN : 2 * HIDDEN]
    masks = valid.astype(np.float32)
    for way, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
        inputs, recurrent, candidate, out = (np.ascontiguousarray(a[f"{way}_{n}"].T) for n in ("in", "gates", "cand", "out"))
        state = np.zeros((HIDDEN, width), np.float32)
        for t in order:
            inputs.take(codes[t], axis=1, out=given, mode="clip")
            np.matmul(recurrent, state, out=both)
            gates += both
            np.abs(gates, out=scale)
            scale += 1
            gates /= scale
            gates *= 0.5
            gates += 0.5
            np.matmul(candidate, state, out=inner)
            inner *= reset
            new += inner
            np.abs(new, out=inner)
            inner += 1
            new /= inner
            state -= new
            state *= update
            state += new
            if way == "f":
                np.matmul(out, state, out=logits[t])
            else:
                state *= masks[t]
                np.matmul(out, state, out=part)
                logits[t] += part
    logits += a["out_b"][:, None]
    classes = range(logits.shape[1])
    top = logits[:, 0].copy()
    for k in classes[1:]:
        np.maximum(top, logits[:, k], out=top)
    total = np.zeros_like(top)
    for k in classes:
        logits[:, k] -= top
        np.exp(logits[:, k], out=logits[:, k])
        total += logits[:, k]
    np.divide(masks, total, out=total)
    return np.stack([np.einsum("tw,tw->w", logits[:, k], total) for k in classes], axis=1)


def _gradients(a: dict[str, np.ndarray], codes: np.ndarray, valid: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean cross entropy of all valid positions, through time."""
    steps, width = codes.shape
    logits = np.broadcast_to(a["out_b"], (steps, width, len(a["out_b"]))).copy()
    tapes = {}
    for way, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
        state, tape = np.zeros((width, HIDDEN), np.float32), []
        for t in order:
            before = state
            state, *rest = _step(before, a[f"{way}_in"][codes[t]], a[f"{way}_gates"], a[f"{way}_cand"])
            state = state * valid[t][:, None]
            tape.append((t, before, state, *rest))
            logits[t] += state @ a[f"{way}_out"]
        tapes[way] = tape
    logits -= logits.max(axis=2, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=2, keepdims=True)
    p[:, np.arange(width), label] -= 1
    error = p * (valid[:, :, None] / np.float32(max(1, valid.sum())))
    g = {n: np.zeros_like(x) for n, x in a.items()}
    g["out_b"] = error.sum(axis=(0, 1))
    for way, tape in tapes.items():
        gates_w, cand, out = a[f"{way}_gates"], a[f"{way}_cand"], a[f"{way}_out"]
        back = np.zeros((width, HIDDEN), np.float32)
        at_input = np.zeros((steps, width, 3 * HIDDEN), np.float32)
        for t, before, after, gates, update, reset, inner, new in reversed(tape):
            g[f"{way}_out"] += after.T @ error[t]
            d = (back + error[t] @ out.T) * valid[t][:, None]
            d_new = d * (1 - update) * _slope(new)
            d_inner = d_new * reset
            d_gates = 0.5 * np.concatenate([d * (before - new), d_new * inner], axis=1) * _slope(gates)
            back = d * update + d_inner @ cand.T + d_gates @ gates_w.T
            g[f"{way}_cand"] += before.T @ d_inner
            g[f"{way}_gates"] += before.T @ d_gates
            at_input[t, :, : 2 * HIDDEN] = d_gates
            at_input[t, :, 2 * HIDDEN :] = d_new
        np.add.at(g[f"{way}_in"], codes.ravel(), at_input.reshape(-1, 3 * HIDDEN))
    return g


def train(languages: list[str], texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Fit on texts with the numbers of their languages."""
    draw = np.random.default_rng(seed)
    data, runs, owner, length = _runs([t.lower().encode() for t in texts])
    chosen = draw.permutation(len(runs))
    nth = np.zeros(len(texts), np.int64)
    keep = np.zeros(len(runs), bool)
    for i in chosen:
        if nth[owner[i]] < RUNS_OF_DOCUMENT:
            nth[owner[i]] += 1
            keep[i] = True
    at = runs[keep][:, None] + np.arange(RUN)
    valid = np.arange(RUN) < length[keep][:, None]
    codes = np.where(valid, data[np.minimum(at, len(data) - 1)], 0)
    target = np.asarray(labels, np.int64)[owner[keep]]
    some = lambda *shape: (draw.normal(0, 0.3, shape)).astype(np.float32)
    a = {"out_b": np.zeros(len(languages), np.float32)}
    for way in "fb":
        a |= {f"{way}_in": some(256, 3 * HIDDEN), f"{way}_gates": some(HIDDEN, 2 * HIDDEN), f"{way}_cand": some(HIDDEN, HIDDEN), f"{way}_out": some(HIDDEN, len(languages))}
    first, second = ({n: np.zeros_like(x) for n, x in a.items()} for _ in range(2))
    share = 1 / np.maximum(1, np.bincount(target, minlength=len(languages)))[target]
    for step in range(1, STEPS + 1):
        pick = draw.choice(len(codes), BATCH, p=share / share.sum())
        for n, g in _gradients(a, codes[pick].T, valid[pick].T, target[pick]).items():
            first[n] = 0.9 * first[n] + 0.1 * g
            second[n] = 0.99 * second[n] + 0.01 * g * g
            rate = RATE * (1 - step / (STEPS + 1))
            a[n] = a[n] - (rate * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Model(languages, a)


def fit(df: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """Learn from rows (doc_id, text, lang) that have a language and are not held out.

    The sample takes from each language the documents whose id hash is below the share
    that ``per_language`` is of them; it is bounded by the number of languages. Sample
    texts are cut to ``RUNS_OF_DOCUMENT`` runs spread over the whole text, so that the
    driver holds a bounded number of bytes.
    """
    usable = df.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"), F.col("lang").cast("string").alias("lang"))
    usable = usable.filter(F.col("lang").isNotNull() & ~held_out("doc_id") & F.col("text").rlike("\\p{L}"))
    counts = {r.lang: r["count"] for r in usable.groupBy("lang").count().toLocalIterator()}
    if not counts:
        return None
    bucket = F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(1_000_000))
    share = F.lit(0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(int(min(1.0, per_language / n) * 1_000_000))).otherwise(share)
    size = F.char_length("text")
    cuts = [F.substring("text", 1 + F.floor(F.lit(k) * size / RUNS_OF_DOCUMENT).cast("int"), F.lit(RUN)) for k in range(RUNS_OF_DOCUMENT)]
    rows = usable.filter(bucket < share).select("lang", F.array(*cuts).alias("cuts"))
    sample = sorted((r.lang, list(r.cuts)) for r in rows.toLocalIterator())
    languages = sorted({lang for lang, _ in sample})
    if not languages:
        return None
    texts, labels = [], []
    for lang, cuts_ in sample:
        for cut in cuts_ if len("".join(cuts_)) > RUN else ["".join(dict.fromkeys(cuts_))]:
            texts.append(cut)
            labels.append(languages.index(lang))
    return train(languages, texts, labels)


def predict(df: DataFrame, model: Model | None, text: str = "text", language: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the language of every text and its probability; other columns stay."""
    kept = [c for c in df.columns if c not in (language, score)]
    df = df.withColumn("_letter", F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False)))
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(language, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in sliced(batches, text, 1_000_000):
            letter = rows.column("_letter").to_pylist()
            if model is None:
                found = [("und", 0.0)] * len(texts)
            else:
                p = model.probabilities([t if has else "" for t, has in zip(texts, letter, strict=True)])
                best = p.argmax(axis=1)
                found = [
                    (model.languages[b], float(min(1.0, x[b]))) if has else ("und", 0.0)
                    for b, x, has in zip(best, p, letter, strict=True)
                ]
            arrays = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), *arrays], schema.names)

    return df.mapInArrow(run, schema)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and probability of every document."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
