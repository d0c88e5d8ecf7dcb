"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Features are whole words and word beginnings, without case. From a bounded sample of labelled rows, those that go with
toxic rows (by a likelihood-ratio test) are selected. Labels only say toxic or not, so grades 1 to GRADES are made of
the toxic rows by how much of their wording carries such features, in equal parts; grade 0 is the rest. One weight
vector is shared by all thresholds: P(grade >= k) = logistic(weights . features - threshold k). The expected severity
is the sum of these probabilities; a document whose P(grade >= 1) reaches TOXIC_FROM is toxic.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, in_batches, labelled_sample, without

#: Labelled rows that the model is made of, at most; the first by a hash of the id.
LABELLED_ROWS = 20_000
#: Features of the model, at most, and half the least likelihood-ratio statistic of one (p of about 1e-6).
FEATURES, LEAST_STATISTIC = 512, 12.0
GRADES = 3
#: Lengths of the word beginnings that are features beside the word.
BEGINNINGS = (4, 5, 6)
#: Probability of grade 1 from which a document is toxic: missing one costs more than looking at one too many.
TOXIC_FROM = 0.25
_WORDS = re.compile(r"[^\W\d_]+")


def features_of(token: str) -> tuple[str, ...]:
    """The features of a blank-separated token: its words, and beginnings of longer words, marked by a star."""
    found: dict[str, None] = {}
    for word in _WORDS.findall(token.lower()):
        found[word] = None
        for length in BEGINNINGS:
            if len(word) > length:
                found[word[:length] + "*"] = None
    return tuple(found)


def distinct_features(ranked: list[tuple[str, int, int]]) -> list[str]:
    """The features of (feature, toxic rows, clean rows) without beginnings that say the same as something longer.

    A word and its beginnings in the same rows would share one weight between them, and outweigh words without any;
    the longest is the most certain of them in other texts.
    """
    kept: dict[tuple[int, int], list[str]] = {}
    for feature, *rows in sorted(ranked, key=lambda r: (-len(r[0]), r[0])):
        alike = kept.setdefault(tuple(rows), [])
        if not any(other.startswith(feature.rstrip("*")) for other in alike):
            alike.append(feature)
    chosen = {f for alike in kept.values() for f in alike}
    return [feature for feature, *_ in ranked if feature in chosen]


def fit_ordinal(matrix: np.ndarray, grades: np.ndarray, levels: int, row_weights: np.ndarray, rounds: int = 1500, shrink: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """(weights, ascending thresholds) of the cumulative-link model, by gradient steps with adapted rates.

    row_weights: how many rows each row stands for. shrink: the weight of half the squared weights beside the rows'
    summed loss. Thresholds are the first one and positive gaps, so they stay ordered.
    """
    above = np.stack([grades >= k for k in range(1, levels + 1)], axis=1).astype(np.float32)
    shrink /= row_weights.sum()
    row_weights = (row_weights / row_weights.sum())[:, None]
    rates = np.clip((above * row_weights).sum(axis=0), 1e-4, 1 - 1e-4)
    starts = np.log(1 / rates - 1)
    state = np.concatenate([np.zeros(matrix.shape[1]), starts[:1], np.log(np.maximum(np.diff(starts), 1e-2))]).astype(np.float64)
    first, second = np.zeros_like(state), np.zeros_like(state)
    n = matrix.shape[1]
    for at in range(1, rounds + 1):
        gaps = np.exp(state[n + 1 :])
        thresholds = state[n] + np.concatenate([[0], np.cumsum(gaps)])
        margin = (matrix @ state[:n].astype(np.float32))[:, None] - thresholds
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - above) * row_weights
        by_threshold = -error.sum(axis=0)
        tail = np.cumsum(by_threshold[::-1])[::-1]
        slope = np.concatenate([matrix.T @ error.sum(axis=1).astype(np.float32) + shrink * state[:n], tail[:1], tail[1:] * gaps])
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope * slope
        state = state - 0.05 * (first / (1 - 0.9**at)) / (np.sqrt(second / (1 - 0.999**at)) + 1e-9)
    return state[:n], state[n] + np.concatenate([[0], np.cumsum(np.exp(state[n + 1 :]))])


class Model:
    """Weights of the selected features and the thresholds between grades."""

    def __init__(self, names: list[str], weights: np.ndarray, thresholds: np.ndarray) -> None:
        self.weights = dict(zip(names, weights.tolist()))
        self.names = {name: at for at, name in enumerate(names)}
        self.thresholds = thresholds

    def probabilities(self, counts: list[Counter]) -> np.ndarray:
        """P(grade >= k) for each row of feature counts."""
        total = np.array([sum(self.weights[f] * (1 + math.log(n)) for f, n in row.items()) for row in counts], float).reshape(-1, 1)
        return 1 / (1 + np.exp(-np.clip(total - self.thresholds, -500, 500)))


def known_features(names: dict[str, int]) -> Remembered:
    """From a token to those of its features that have a name."""
    return Remembered(lambda token: tuple(f for f in features_of(token) if f in names), 400_000, 64)


def counted(texts: list, known: Remembered) -> list[Counter]:
    """How many tokens of each text hold each known feature."""
    found = []
    for text in texts:
        row: Counter = Counter()
        for features in filter(None, map(known.__getitem__, (text or "").split())):
            row.update(features)
        found.append(row)
    return found


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", labelled_rows: int = LABELLED_ROWS) -> Model | None:
    """The model of at most labelled_rows labelled documents; None if they are all of one kind.

    Feature counts are summed on the executors; the driver gets FEATURES names and the rows' counts of these.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("label_id"), (F.col(label_col) > 0).alias("toxic"))
    # Written, for it is read twice.
    sample = labelled_sample(docs, known, id_col, text_col, labelled_rows, "toxic")
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(True, 0), sizes.get(False, 0)
    if not toxic or not clean:
        return None

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Remembered(features_of, 200_000, 64)
        for batch in batches:
            found: dict[bool, Counter] = {True: Counter(), False: Counter()}
            for is_toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found[is_toxic].update({f for token in set((text or "").split()) for f in known[token]})
            names = [f for part in found.values() for f in part]
            rows = [len(found[True]) * [True] + len(found[False]) * [False], [n for part in found.values() for n in part.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(rows[0], pa.bool_()), pa.array(rows[1], pa.int64())], names=["feature", "toxic", "n"])

    counts = sample.select("toxic", "text").mapInArrow(sums, "feature string, toxic boolean, n bigint")
    counts = counts.groupBy("feature").agg(F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(~F.col("toxic"), F.col("n")).otherwise(0)).alias("c"))
    # Only features whose share among toxic rows is above that among clean rows can be selected; the statistic ranks them.
    t, c = F.col("t").cast("double"), F.col("c").cast("double")
    part = lambda n, of: F.when(n > 0, n * F.log(n / of)).otherwise(F.lit(0.0))
    rows = float(toxic + clean)
    statistic = part(t, toxic * (t + c) / rows) + part(c, clean * (t + c) / rows) + part(toxic - t, toxic * (rows - t - c) / rows) + part(clean - c, clean * (rows - t - c) / rows)
    ranked = counts.filter(t * clean > c * toxic).withColumn("statistic", statistic)
    # A word stands with its beginnings, which go afterwards: so many rows hold the FEATURES best of what stays.
    best = ranked.filter(F.col("statistic") >= LEAST_STATISTIC).orderBy(F.desc("statistic"), "feature").limit(FEATURES * (1 + len(BEGINNINGS)))
    names = distinct_features([tuple(r) for r in best.select("feature", "t", "c").collect()])[:FEATURES]
    if not names:
        return None
    places = {name: at for at, name in enumerate(names)}

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        known = known_features(places)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = counted(batch.column(2).to_pylist(), known)
            lists = [[[places[f] for f in row] for row in found], [list(row.values()) for row in found]]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists[0], pa.list_(pa.int32())), pa.array(lists[1], pa.list_(pa.int64()))], names=["label_id", "toxic", "at", "n"])

        return run

    id_type = docs.schema[id_col].dataType.simpleString()
    frame: pd.DataFrame = in_batches(sample, f"label_id {id_type}, toxic boolean, at array<int>, n array<bigint>", make).toPandas()
    frame = frame.sort_values(["label_id", "toxic"], kind="stable")
    matrix = np.zeros((len(frame), len(names)), np.float32)
    for row, (at, n) in enumerate(zip(frame["at"], frame["n"])):
        matrix[row, np.asarray(at, int)] = 1 + np.log(np.asarray(n, float))
    is_toxic = frame["toxic"].to_numpy(bool)
    evidence = matrix.sum(axis=1)[is_toxic]
    grades = np.zeros(len(frame), int)
    grades[is_toxic] = 1 + np.searchsorted(np.quantile(evidence, np.arange(1, GRADES) / GRADES), evidence, side="left")
    # Rows without any feature differ in their grade alone: one row stands for all of a grade.
    empty = ~matrix.any(axis=1)
    alike = np.bincount(grades[empty], minlength=GRADES + 1)
    matrix = np.concatenate([matrix[~empty], np.zeros((GRADES + 1, len(names)), np.float32)])
    grades = np.concatenate([grades[~empty], np.arange(GRADES + 1)])
    weights, thresholds = fit_ordinal(matrix, grades, GRADES, np.concatenate([np.ones(len(matrix) - GRADES - 1), alike]))
    return Model(names, weights, thresholds)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, expected_severity, severity, toxic_probability, toxic) of every whole text.

    severity: the largest grade whose probability reaches TOXIC_FROM. Null and empty texts have no features and
    stay at the thresholds' base. Without a model everything is 0 and not toxic. Repeated rows and null ids stay; an
    empty table gives no rows; extra columns aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        found = shared.value
        known = known_features(found.names if found else {})

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            above = found.probabilities(counted(batch.column(1).to_pylist(), known)) if found else np.zeros((batch.num_rows, GRADES))
            columns = [pa.array(above.sum(axis=1)), pa.array((above >= TOXIC_FROM).sum(axis=1), pa.int32()), pa.array(above[:, 0]), pa.array(above[:, 0] >= TOXIC_FROM)]
            return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, "expected_severity", "severity", "toxic_probability", "toxic"])

        return run

    return in_batches(docs.select(id_col, text_col), f"`{id_col}` {id_type}, expected_severity double, severity int, toxic_probability double, toxic boolean", make)


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """docs without those that the model fitted on `labels` finds toxic; with rows of one id, the toxic ones go together."""
    found = score(docs, fit(docs, labels, id_col, text_col, **options), id_col, text_col)
    return without(docs, found.filter("toxic"), id_col)
