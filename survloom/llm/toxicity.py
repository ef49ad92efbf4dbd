"""Toxicity scores from a counterfactual-regularised classifier.

A logistic model over the presence of words and word beginnings. Each training
document that mentions an identity term is paired with a copy whose sentences name
another term of the same kind, and with one that names none; the squared changes of the logit
are part of the loss. A group mention then cannot raise a score by itself, which removes
false positives on neutral mentions.

The model is fitted on a sample of labelled documents of at most ``PER_CLASS`` rows a
class, drawn by a hash of the id; scoring reads every text whole. Labels without a
value are ignored; of repeated labels of a document the largest counts. A null or
empty text, or one without known words, has the score of the model's constant. With
labels of one class only (or none) the score of every document is that class's share
(or 0).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from survloom.llm.common import held_out, sliced, table, text_of
from survloom.settings import staged

#: Bound of the training sample, per class, and of the number of model features.
PER_CLASS, MAX_FEATURES = 4096, 1024
#: Documents of the sample that must hold a feature, and its least |z| between classes.
LEAST_DOCUMENTS, LEAST_Z = 4, 3.0
#: Weight of the counterfactual penalty and of the squared coefficients.
PENALTY, RIDGE, STEPS = 1.0, 5e-4, 400
THRESHOLD = 0.3
#: Letters of a word beginning that is a feature beside the word.
BEGINNING = 4

#: Terms of one line stand for one another in counterfactual copies.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "straight", "bisexual", "queer", "heterosexual"),
    ("black", "white", "asian", "latino", "hispanic", "indigenous"),
    ("african", "european", "american", "mexican", "chinese", "indian", "arab"),
    ("immigrants", "refugees", "citizens", "natives", "foreigners"),
    ("blind", "deaf", "disabled", "autistic", "elderly", "young"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus"),
    ("ausländer", "flüchtlinge", "einheimische", "migranten"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous"),
    ("immigrés", "réfugiés", "citoyens", "étrangers"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "hindúes"),
    ("inmigrantes", "refugiados", "ciudadanos", "extranjeros"),
)

_EDGES = ".,;:!?\"'()[]{}*#$%&|<>-–—…«»„“”¿¡"


def swaps(groups: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> dict[str, str]:
    """The other term that each identity term is exchanged for: the next of its line."""
    out: dict[str, str] = {}
    for group in groups:
        for term, other in zip(group, (*group[1:], group[0]), strict=True):
            out.setdefault(term, other)
    return out


def words_of(text: str) -> set[str]:
    """Distinct lower-case words without the marks around them."""
    return {w.strip(_EDGES) for w in set(text.lower().split())} - {""}


def features_of(words: set[str]) -> set[str]:
    """The words themselves and the beginnings of the longer ones (ending in ``~``)."""
    return words | {w[:BEGINNING] + "~" for w in words if len(w) > BEGINNING}


def counterfactual(text: str, other: dict[str, str]) -> str:
    """Each identity term of the text's sentences exchanged for its counterpart."""
    return re.sub(r"[^\W\d_]+", lambda m: other.get(m[0].lower(), m[0]), text)


@dataclass
class Model:
    """Coefficients by feature; small (at most ``MAX_FEATURES`` entries)."""

    constant: float
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, text: str) -> float:
        """Probability that the text is toxic."""
        words = words_of(text)
        known = self.weights.keys() & features_of(words)
        return float(1 / (1 + np.exp(-(self.constant + sum(self.weights[k] for k in sorted(known))))))


def _sample(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """Ids and labels for fitting: per class the rows that come first by a hash of the id."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(~held_out("doc_id")).select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    drawn = [known.filter(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for t in (0, 1)]
    # At most 2 * per_class short rows.
    return docs.join(F.broadcast(drawn[0].union(drawn[1])), "doc_id").dropDuplicates(["doc_id"])


_VIEWS = ("own", "swapped", "unnamed")


def _listed(sample: DataFrame, other: dict[str, str]) -> DataFrame:
    """Features of each sample document, and those of its counterfactual copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in sliced(batches, "text"):
            own = [features_of(words_of(t)) for t in texts]
            copies = [features_of(words_of(counterfactual(t, other))) if other.keys() & o else None for t, o in zip(texts, own, strict=True)]
            unnamed = [features_of(words_of(t) - other.keys()) if c is not None else None for t, c in zip(texts, copies, strict=True)]
            lists = [[None if x is None else sorted(x) for x in xs] for xs in (own, copies, unnamed)]
            arrays = [pa.array(xs, pa.list_(pa.string())) for xs in lists]
            yield pa.RecordBatch.from_arrays([rows.column("toxic").cast(pa.int32()), *arrays], ["toxic", *_VIEWS])

    return sample.select("toxic", "text").mapInArrow(run, "toxic int" + "".join(f", {v} array<string>" for v in _VIEWS))


def _minimise(own: np.ndarray, copies: list[np.ndarray], label: np.ndarray, penalty: float) -> np.ndarray:
    """Coefficients (the last is the constant) of the regularised logistic loss, by Adam."""
    weight = np.where(label == 1, 0.5 / max(1, label.sum()), 0.5 / max(1, (1 - label).sum())).astype(np.float32)
    gap = np.concatenate([(own - copy)[(own != copy).any(axis=1)] for copy in copies])
    beta = np.zeros(own.shape[1] + 1)
    beta[-1] = -1.0
    first, second = np.zeros_like(beta), np.zeros_like(beta)
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-(own @ beta[:-1].astype(np.float32) + beta[-1])))
        error = weight * (p - label)
        gradient = np.append(own.T @ error.astype(np.float32), error.sum())
        gradient[:-1] += RIDGE * beta[:-1]
        if len(gap):
            gradient[:-1] += 2 * penalty / len(gap) * (gap.T @ (gap @ beta[:-1].astype(np.float32)))
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        beta -= 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return beta


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, penalty: float = PENALTY) -> Model:
    """Fit on ``docs`` (doc_id, text) with ``labels`` (doc_id, toxic) that are not held out."""
    other = swaps()
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs["text"]).alias("text"))
    labels = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
    listed = staged(_listed(_sample(docs, labels, per_class), other), "toxicity")
    n, positive = listed.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < positive < n:
        share = positive / n if n else 0.0
        return Model(60.0 if share else -60.0)
    seen = listed.select("toxic", F.explode("own").alias("feature")).groupBy("feature")
    seen = seen.agg(F.count("*").alias("n"), F.sum("toxic").alias("t"))
    rate = F.col("n") / n
    z = (F.col("t") - positive * rate) / F.sqrt(positive * (1 - positive / n) * rate * (1 - rate) + 1e-9)
    usual = seen.filter((F.col("n") >= LEAST_DOCUMENTS) & (F.abs(z) >= LEAST_Z)).orderBy(F.abs(z).desc(), "feature").limit(MAX_FEATURES)
    named = seen.filter(F.col("feature").isin(*other))
    features = sorted({r.feature for r in usual.union(named).select("feature").toLocalIterator()})
    place = {f: i for i, f in enumerate(features)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = [[[place[f] for f in x if f in place] if x is not None else None for x in rows.column(c).to_pylist()] for c in _VIEWS]
            yield pa.RecordBatch.from_arrays([rows.column("toxic"), *(pa.array(x, pa.list_(pa.int32())) for x in out)], ["toxic", *_VIEWS])

    # At most 2 * per_class rows of at most MAX_FEATURES small numbers.
    rows = listed.mapInArrow(run, "toxic int" + "".join(f", {v} array<int>" for v in _VIEWS)).toPandas()
    rows = rows.iloc[sorted(range(len(rows)), key=lambda i: (rows.toxic.iloc[i], list(rows.own.iloc[i])))]
    own, *copies = (np.zeros((len(rows), len(features)), np.float32) for _ in _VIEWS)
    for i, mine in enumerate(rows["own"]):
        own[i, np.asarray(mine, int)] = 1
        for copy, view in zip(copies, _VIEWS[1:], strict=True):
            known = rows[view].iloc[i]
            copy[i, np.asarray(mine if known is None else known, int)] = 1
    beta = _minimise(own, copies, rows.toxic.to_numpy(np.float32), penalty)
    return Model(float(beta[-1]), {f: float(b) for f, b in zip(features, beta[:-1], strict=True) if abs(b) > 1e-6})


def score(df: DataFrame, model: Model, text: str = "text", output: str = "score") -> DataFrame:
    """Add the score of every text; other columns stay."""
    kept = [c for c in df.columns if c != output]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(output, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in sliced(batches, text):
            scores = pa.array([model.score(t) for t in texts], pa.float64())
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), scores], [*kept, output])

    return df.mapInArrow(run, schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text_of("text").alias("text"))
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
