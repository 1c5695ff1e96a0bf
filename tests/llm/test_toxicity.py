"""The ordinal model against a plain version: features chosen by loops, the gradient by complex steps."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from graphweft.llm import toxicity


def plain_features(text):
    words = set(toxicity.WORDS.findall(text.lower()))
    out = set(words)
    for start in {w[:4] for w in words if len(w) > 4}:
        n = sum(len(w) > 4 and w[:4] == start for w in words)
        out |= {f"{start}*{k}" for k in (1, 2, 4) if n >= k} | {f"{start}%{k}" for k in (2, 5) if 100 * n >= k * len(words)}
    return out


def plain_fit(x, grades, steps=400, l2=5e-5):
    """Adam on the mean log loss, whose gradient is taken numerically: exact to the last digits, and no formula of it is used."""
    width, top = x.shape[1], max(grades)

    def loss(p):
        theta = [p[width]]
        for gap in p[width + 1 :]:
            theta.append(theta[-1] + np.exp(gap))
        eta = x @ p[:width]
        sig = lambda z: 1 / (1 + np.exp(-z))
        total = 0
        for j in range(top + 1):
            at = np.array(grades) == j
            total += np.log((sig(theta[j] - eta[at]) if j < top else 1) - (sig(theta[j - 1] - eta[at]) if j else 0)).sum()
        return -total / len(grades) + l2 / 2 * (p[:width] ** 2).sum()

    share = [np.mean([g <= j for g in grades]) for j in range(top)]
    start = [math.log(s / (1 - s)) for s in share]
    p = np.array([0.0] * width + start[:1] + [math.log(max(b - a, 1e-3)) for a, b in zip(start, start[1:], strict=False)])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        g = np.array([loss(p + 1e-30j * np.eye(len(p))[i]).imag / 1e-30 for i in range(len(p))])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    theta = [p[width]]
    for gap in p[width + 1 :]:
        theta.append(theta[-1] + math.exp(gap))
    return p[:width], theta


def plain_model(rows, most):
    """(weights by feature, thresholds) of texts and their labels, equal texts once."""
    texts = {}
    for text, toxic in rows:
        texts[text] = max(texts.get(text, 0), toxic)
    counts = {f: Counter() for f in {f for t in texts for f in plain_features(t)}}
    for text, toxic in texts.items():
        for f in plain_features(text):
            counts[f][toxic] += 1
    bad = sum(texts.values())
    good, ranked = len(texts) - bad, []
    for f, c in counts.items():
        odds = math.log((c[1] + 0.5) / (bad + 1)) - math.log((c[0] + 0.5) / (good + 1))
        expected = (c[0] + c[1]) * bad / len(texts)
        if c[0] + c[1] >= toxicity.MIN_DOCS and abs(odds) >= toxicity.MIN_LOG_ODDS:
            ranked.append((-((c[1] - expected) ** 2) / expected, f, odds > math.log(10)))
    ranked = sorted(ranked)[:most]
    names = [f for _, f, _ in ranked]
    x = np.array([[float(f in plain_features(t)) for f in names] for t in texts])
    grades = []
    for i, toxic in enumerate(texts.values()):
        terms = sum(x[i][k] for k, r in enumerate(ranked) if r[2])
        grades.append(max(1, sum(terms >= g for g in toxicity.GRADE_TERMS)) if toxic else 0)
    grades = [sorted(set(grades)).index(g) for g in grades]
    weights, thresholds = plain_fit(x, grades)
    return dict(zip(names, weights, strict=True)), thresholds


def corpus(seed):
    rnd, rows = random.Random(seed), []
    mild, harsh = [f"word{i}" for i in range(12)], ["nasty", "nastier", "vilest", "vile", "foul"]
    for i in range(90):
        toxic = int(rnd.random() < 0.4)
        words = [rnd.choice(mild) for _ in range(rnd.randrange(3, 12))] + [rnd.choice(harsh) for _ in range(rnd.randrange(1, 6) if toxic else rnd.random() < 0.08)]
        rnd.shuffle(words)
        rows.append((i, " ".join(words), toxic))
    return rows + [(200, rows[0][1], rows[0][2]), (201, None, 1), (None, "word1 nasty", 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_model_equals_a_plain_one(spark, monkeypatch, seed):
    monkeypatch.setattr(toxicity, "FEATURES", 9)
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, 1, x) for i, _, x in rows] + [(999, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    weights, thresholds = plain_model([(t, x) for i, t, x in rows if t is not None and i is not None], 9)
    assert model.weights.keys() == weights.keys()
    assert all(abs(model.weights[f] - w) < 1e-6 for f, w in weights.items()) and np.allclose(model.thresholds, thresholds, atol=1e-6)
    for r in toxicity.score(docs, model).collect():
        text = next((t for i, t, _ in rows if i == r["doc_id"]), "") or ""
        eta = sum(weights[f] for f in plain_features(text) if f in weights)
        upto = [1 / (1 + math.exp(eta - t)) for t in thresholds] + [1.0]
        p = [b - a for a, b in zip([0.0, *upto], upto, strict=False)]
        assert abs(r["severity"] - sum(j * q for j, q in enumerate(p))) < 1e-5 and r["rejected"] == (eta > max(thresholds[0], 0.0))


def test_features_are_the_plain_ones():
    rnd = random.Random(3)
    for _ in range(200):
        text = " ".join("".join(rnd.choice("abÉ_1") for _ in range(rnd.randrange(1, 7))) for _ in range(rnd.randrange(0, 40)))
        assert toxicity.features(text) == plain_features(text)


def test_more_labels_than_are_fitted(spark):
    """One id with a third of all rows, and a bound on the documents fitted: the model is the same on every run."""
    rows = corpus(4)
    texts = [(7, f"{t} word{i}", "s") for i, (_, t, _) in enumerate(rows) if t] + [(i, t, "s") for i, t, _ in rows for _ in range(2)]
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")
    docs = spark.createDataFrame(texts, "doc_id long, text string, s string")
    a, b = (toxicity.fit(d, labels, fit_docs=40) for d in (docs, docs.repartition(5)))
    assert a == b and a.weights
