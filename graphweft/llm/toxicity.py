"""Toxicity: cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.llm.common import settle

WORDS = re.compile(r"\w+")
#: The classifier is fitted on so many labelled documents at most (those with the smallest hash), with so many features.
FIT_DOCS, FEATURES = 20_000, 4_096
#: Grades 1, 2 and 3 of a toxic document: it has at least so many different terms that tell toxic documents.
GRADE_TERMS = (1, 3, 6)
#: A feature must be in so many fitted documents, and tell with so many nats.
MIN_DOCS, MIN_LOG_ODDS = 5, 1.0
#: Beginnings of words also count by how many different words share them, and by their share of all different words in %.
NUMBERS, SHARES = (1, 2, 4), (2, 5)


def features(text: str) -> set[str]:
    """Words in lower case, and first four letters of longer ones with the NUMBERS and SHARES of words that they reach."""
    words = set(WORDS.findall(text.lower()))
    starts = Counter(w[:4] for w in words if len(w) > 4)
    found = words | {f"{s}*{k}" for s, n in starts.items() for k in NUMBERS if n >= k}
    return found | {f"{s}%{k}" for s, n in starts.items() for k in SHARES if 100 * n >= k * len(words)}


@dataclass
class OrdinalModel:
    """P(grade <= j) = sigmoid(thresholds[j] - weights . features); the weights are shared by all thresholds."""

    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def evidence(self, text: str) -> float:
        return math.fsum(map(self.weights.get, self.weights.keys() & features(text)))

    def rejects(self, eta: float) -> bool:
        """Grade 0 is less likely than not, and some feature tells so: the grades' shares alone never reject a text."""
        return eta > max(self.thresholds[0], 0.0)

    def grades(self, eta: float) -> list[float]:
        """Probabilities of the grades from 0."""
        upto = [1 / (1 + math.exp(min(max(eta - t, -700), 700))) for t in self.thresholds]
        return [b - a for a, b in zip([0.0, *upto], [*upto, 1.0], strict=True)]


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, width: int, steps: int = 400, l2: float = 5e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by Adam on the mean log loss; rows, columns: where the sparse features are 1."""
    n, top = len(grades), int(grades.max(initial=0))
    share = np.clip(np.array([(grades <= j).mean() for j in range(top)]), 1e-4, 1 - 1e-4)
    start = np.log(share / (1 - share))
    p = np.concatenate((np.zeros(width), start[:1], np.log(np.maximum(np.diff(start), 1e-3))))
    m, v = np.zeros_like(p), np.zeros_like(p)
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    for step in range(1, steps + 1):
        gaps = np.exp(p[width + 1 :])
        theta = p[width] + np.concatenate(([0], np.cumsum(gaps)))
        eta = np.bincount(rows, weights=p[columns], minlength=n)
        edges = np.concatenate(([-np.inf], theta, [np.inf]))
        hi, lo = sig(edges[grades + 1] - eta), sig(edges[grades] - eta)
        hi[grades == top], lo[grades == 0] = 1, 0
        mass = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / mass, lo * (1 - lo) / mass
        g = np.zeros_like(p)
        g[:width] = np.bincount(columns, weights=(dhi - dlo)[rows], minlength=width) / n + l2 * p[:width]
        at = np.array([(dlo[grades == j + 1].sum() - dhi[grades == j].sum()) / n for j in range(top)])
        g[width] = at.sum()
        g[width + 1 :] = np.cumsum(at[::-1])[::-1][1:] * gaps
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return p[:width], p[width] + np.concatenate(([0], np.cumsum(np.exp(p[width + 1 :]))))


def _counted(batches):
    """How many toxic and how many other documents of a batch have each feature."""
    for batch in batches:
        found = (Counter(), Counter())
        for text, toxic in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            found[toxic].update(features(text.as_py() or ""))
        names = list(found[0] | found[1])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[x] for x in names], pa.int64()) for c in found)], ["feature", "clean", "toxic"])


def _sparse(known: dict[str, int]):
    def run(batches):
        for batch in batches:
            found = [sorted(known[x] for x in known.keys() & features(t.as_py() or "")) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.int32()))], ["h", "toxic", "at"])

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_docs: int = FIT_DOCS) -> OrdinalModel:
    """The model from about fit_docs labelled documents at most, equal texts once; the same one on every run.

    Labels are 0 or 1; a toxic document's grade is by the number of its features that tell toxic documents. Null labels,
    ids and texts are passed over. With no toxic or no other document, the model gives all documents grade 0.
    """
    marks = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("toxic")).where("_id is not null and toxic in (0, 1)").groupBy("_id").agg(F.max("toxic").alias("toxic"))
    chosen = marks.orderBy(F.xxhash64("_id"), "_id").limit(fit_docs)  # fit_docs rows of two numbers: small enough to send
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    sample = texts.join(F.broadcast(chosen), "_id").groupBy(F.xxhash64("text").alias("h")).agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    sample = settle(sample.select("h", "text", "toxic"))
    number = sample.count()
    if number > fit_docs:  # ids with several texts
        sample = sample.where(F.pmod(F.xxhash64("h"), F.lit(1_000_000)) < int(fit_docs / number * 1_000_000))
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not toxic:
        return OrdinalModel({}, (50.0,))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    expected = (F.col("toxic") + F.col("clean")) * toxic / (clean + toxic)
    told = sample.mapInArrow(_counted, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    told = told.where(F.col("clean") + F.col("toxic") >= MIN_DOCS).withColumn("odds", odds).withColumn("weight", F.pow(F.col("toxic") - expected, 2) / expected)
    best = told.where(F.abs("odds") >= MIN_LOG_ODDS).orderBy(F.desc("weight"), "feature").limit(FEATURES).collect()
    known = {r["feature"]: i for i, r in enumerate(best)}
    telling = np.array([r["odds"] > math.log(10) for r in best], bool)
    fitted = sample.mapInArrow(_sparse(known), "h long, toxic int, at array<int>").toPandas().sort_values("h", ignore_index=True)  # fit_docs rows of feature numbers
    lengths = fitted["at"].map(len).to_numpy()
    rows = np.repeat(np.arange(len(fitted)), lengths)
    columns = np.concatenate([np.asarray(x, np.int64) for x in fitted["at"]]) if len(rows) else np.zeros(0, np.int64)
    terms = np.bincount(rows, weights=telling[columns], minlength=len(fitted)) if len(rows) else np.zeros(len(fitted))
    grades = np.where(fitted["toxic"].to_numpy() == 1, np.maximum(1, np.searchsorted(GRADE_TERMS, terms, "right")), 0)
    _, grades = np.unique(grades, return_inverse=True)  # grades that occur, from 0
    weights, thresholds = fit_ordinal(rows, columns, grades, len(known))
    return OrdinalModel({x: float(weights[i]) for x, i in known.items()}, tuple(map(float, thresholds)))


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, severity, grade, p_toxic, rejected) of every row: expected and likeliest grade, and whether it's rejected.

    Null texts are empty; ids may be null or repeated; further columns are ignored. A map over rows with a model of
    FEATURES weights at most.
    """

    def run(batches):
        for batch in batches:
            eta = [model.evidence(t.as_py() or "") for t in batch.column(1)]
            p = [model.grades(e) for e in eta]
            severity = [round(sum(j * x for j, x in enumerate(q)), 9) for q in p]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(severity, pa.float64()), pa.array([int(np.argmax(q)) for q in p], pa.int32()), pa.array([round(1 - q[0], 9) for q in p], pa.float64()), pa.array([model.rejects(e) for e in eta], pa.bool_())], ["doc_id", "severity", "grade", "p_toxic", "rejected"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, severity double, grade int, p_toxic double, rejected boolean")


def keep_clean(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """docs without those that the model rejects; all columns as they are."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([not model.rejects(model.evidence(t.as_py() or "")) for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
