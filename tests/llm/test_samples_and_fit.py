"""Bounded samples, and the ordinal fit and its scores against plain formulas."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkstream.llm import toxicity
from inkstream.llm.common import first_by_hash, labelled_sample


@pytest.mark.parametrize("count", [0, 1, 40, 900, 1000, 5000])
def test_first_by_hash_is_the_plain_order(spark, count):
    rows = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("t"))
    want = [r["k"] for r in rows.orderBy(F.xxhash64("k"), "k", "t").limit(count).collect()]
    assert [r["k"] for r in first_by_hash(rows, "k", count, "t").collect()] == want


def test_labelled_sample_takes_what_docs_hold(spark, plain):
    docs = plain([(i, f"text {i}") for i in range(900, 1000)] + [(900, "another")] * 5 + [(None, "none")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(1000)] + [(950, 1)], "label_id bigint, label int")
    every = labelled_sample(docs, labels, "doc_id", "text", 500, "label").collect()
    assert Counter(r["label_id"] for r in every) == Counter([*range(900, 1000), *[900] * 5, 950])
    some = labelled_sample(docs, labels, "doc_id", "text", 30, "label").collect()
    assert len(some) == 30 and {r["label_id"] for r in some} <= set(range(900, 1000))
    hot = plain([(7, f"copy {i}") for i in range(200)])
    assert len(labelled_sample(hot, labels, "doc_id", "text", 20, "label").collect()) == 20
    assert labelled_sample(docs.limit(0), labels, "doc_id", "text", 20, "label").collect() == []


def plain_loss(matrix, grades, levels, counts, weights, thresholds, shrink=0.02):
    total = 0.5 * shrink * sum(w * w for w in weights)
    for row, grade, n in zip(matrix, grades, counts):
        for k in range(levels):
            p = 1 / (1 + math.exp(-(sum(w * x for w, x in zip(weights, row)) - thresholds[k])))
            total -= n * math.log(p if grade > k else 1 - p)
    return total


def test_fit_is_at_the_minimum_of_the_plain_loss():
    draw = np.random.default_rng(6)
    matrix = draw.choice([0.0, 1.0, 1.7], (160, 4), p=[0.6, 0.3, 0.1]).astype(np.float32)
    pull = matrix @ np.array([1.5, 0.8, -0.7, 0.0]) + draw.logistic(0, 1, 160)
    grades, counts = np.digitize(pull, [0.3, 1.4, 2.5]), draw.integers(1, 4, 160)
    weights, thresholds = toxicity.fit_ordinal(matrix, grades, 3, counts)
    assert list(thresholds) == sorted(thresholds)
    loss = lambda w, t: plain_loss(matrix, grades, 3, counts, w, t)
    best, step = loss(weights, thresholds), 1e-3
    for at in range(7):
        moved = []
        for sign in (step, -step):
            w, t = weights.copy(), thresholds.copy()
            (w if at < 4 else t)[at if at < 4 else at - 4] += sign
            moved.append(loss(w, t))
        assert abs(moved[0] - moved[1]) / (2 * step) < 0.02 * counts.sum() ** 0.5 and min(moved) > best - 1e-3
    # A plain descent from elsewhere ends at the same place.
    w, t = np.ones(4), np.array([-1.0, 0.0, 1.0])
    for _ in range(4000):
        p = 1 / (1 + np.exp(-((matrix @ w)[:, None] - t)))
        error = (p - (grades[:, None] > np.arange(3))) * counts[:, None]
        w = w - 0.002 * (matrix.T @ error.sum(axis=1) + 0.02 * w)
        t = t + 0.002 * error.sum(axis=0)
    assert np.abs(w - weights).max() < 0.03 and np.abs(t - thresholds).max() < 0.03


def test_scores_are_the_plain_formula(plain):
    names, weights, thresholds = ["bad", "wor*", "ugly"], np.array([1.2, 0.7, -0.4]), np.array([0.5, 1.5, 3.0])
    draw = random.Random(2)
    texts = [" ".join(draw.choice(["bad", "Worst", "worse", "ugly,", "good", "bad-ugly", "x1bad"]) for _ in range(draw.randrange(12))) for _ in range(80)]
    got = {r["doc_id"]: r for r in toxicity.score(plain(list(enumerate(texts))), toxicity.Model(names, weights, thresholds)).collect()}
    for i, text in enumerate(texts):
        counts = Counter(f for token in text.split() for f in toxicity.features_of(token) if f in names)
        total = sum(weights[names.index(f)] * (1 + math.log(n)) for f, n in counts.items())
        above = [1 / (1 + math.exp(t - total)) for t in thresholds]
        assert got[i]["expected_severity"] == pytest.approx(sum(above)) and got[i]["toxic_probability"] == pytest.approx(above[0])
        assert got[i]["severity"] == sum(p >= toxicity.TOXIC_FROM for p in above) and got[i]["toxic"] == (above[0] >= toxicity.TOXIC_FROM)


def test_words_beyond_their_beginnings_fill_the_list(spark, plain, monkeypatch):
    """Every word has three beginnings in the same rows: the bound counts words."""
    monkeypatch.setattr(toxicity, "FEATURES", 6)
    words = [f"{c * 3}evilword" for c in "bcdfghjk"]
    docs = plain([(i, f"plain text {words[i % 8] if i % 2 else 'harmless'} more {words[(i + 3) % 8] if i % 2 else 'words'}") for i in range(400)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    assert len(model.weights) == 6 and all(f in words for f in model.weights)
