"""Hard negatives: blocks, thresholds and windows against plain scoring of all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkstream.llm import hard_negatives
from inkstream.llm.hard_negatives import Block

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain_mine(rows, is_anchor, positives=5, negatives=10, least=30, most=90, scale=256):
    kept = {}
    for id_, vector, label in rows:
        if id_ is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        v = [math.floor(scale * float(np.float32(x))) for x in vector]
        if id_ not in kept or (label, v) < kept[id_]:
            kept[id_] = (label, v)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for anchor, (label, v) in kept.items():
        if not is_anchor(anchor):
            continue
        scored = sorted((-dot(v, w), id_, m) for id_, (m, w) in kept.items() if id_ != anchor)
        for score, id_, _ in [s for s in scored if s[2] == label][:positives]:
            inside = [s for s in scored if s[2] != label and least * -score <= 100 * -s[0] <= most * -score]
            out += [(anchor, id_, rank, n, -score, -s) for rank, (s, n, _) in enumerate(inside[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, modulus, **options):
    usable = hard_negatives.usable(spark.createDataFrame(rows, SCHEMA))
    return sorted(tuple(r) for r in hard_negatives.mine(usable, F.col("id") % modulus == 0, **options).collect())


def vectors(count, dims, seed, labels=4, spread=0.3):
    draw = np.random.default_rng(seed)
    centres = draw.normal(0, spread, (labels, dims))
    rows = []
    for i in range(count):
        label = int(draw.integers(0, labels)) if i % 3 else 1
        rows.append((i, (centres[label] + draw.normal(0, spread, dims)).astype(np.float32).tolist(), label))
    return rows


@pytest.mark.parametrize("dims, scale", [(20, 0.3), (5, 40.0), (64, 9e5)])
def test_mine_equals_all_pairs(spark, dims, scale):
    rows = vectors(300, dims, dims)
    rows = [(i, (np.array(v, np.float32) * np.float32(scale)).tolist(), label) for i, v, label in rows]
    want = plain_mine(rows, lambda i: i % 9 == 0)
    assert mined(spark, rows, 9, block_rows=40) == want and want


def test_ties_duplicates_and_odd_rows(spark):
    rows = [(i, [1.0, float(i % 3), 0.0], i % 2) for i in range(60)] + [(7, [9.0, 9.0, 9.0], 0), (7, [9.0, 9.0, 9.0], 0), (20, [0.5], 0), (21, [], 1), (40, [1.0, 1.0, 1.0], None), (42, None, 1), (44, [1.0, None, 1.0], 1)]
    rows += [(46, [float("nan"), 1.0, 1.0], 0), (48, [float("inf"), 1.0, 1.0], 0), (None, [1.0, 1.0, 1.0], 1), (-10, [-1.0, -1.0, -1.0], 1), (100, [0.0, 0.0, 0.0], 5), (110, [5.0, 0.0, 0.0], 6)]
    want = plain_mine(rows, lambda i: i % 10 == 0)
    assert mined(spark, rows, 10) == want and {r[0] for r in want} >= {0, 10, 50}


def test_empty_tables_and_lone_labels(spark):
    assert mined(spark, [], 10) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 1)], 10) == []
    assert mined(spark, [(0, [1.0], 1), (2, [1.0], 2)], 10) == []
    assert mined(spark, [(0, [], 1), (2, [], 1)], 2) == []


@pytest.mark.parametrize("threshold", [-5.0e9, 0.0, 3000.0, 40_000.0, 70_000.0, 9.0e9])
def test_block_scores_are_exact_and_lose_nothing(threshold):
    draw = np.random.default_rng(1)
    matrix = (draw.normal(0, 1, (500, 37)) * np.linspace(60, 1, 37)).astype(np.int64)
    matrix[:20] = 0
    packed, width = hard_negatives._narrow(matrix)
    ids = np.arange(500)
    block = Block(ids.astype("<i8").tobytes(), (ids % 5).astype("<i8").tobytes(), packed, width)
    anchors, allowed = matrix[15:30], draw.random((15, 500)) < 0.7
    exact = anchors @ matrix.T
    for i, rows, scores in block.scores(anchors, np.full(15, threshold), allowed):
        found = dict(zip(rows.tolist(), scores.tolist()))
        assert len(found) == len(rows) and all(exact[i, j] == s and allowed[i, j] for j, s in found.items())
        assert {j for j in range(500) if allowed[i, j] and exact[i, j] >= threshold} <= set(found)


def test_thresholds_fall_to_the_lower_end():
    lows = hard_negatives.falling_thresholds(100, 5000, 0.0, 900.0, 1e7, 10)
    assert lows == sorted(set(lows), reverse=True) and lows[-1] == 100 and lows[0] < 5000
    for odd in [(5, 5, 0.0, 1.0, 1e6, 10), (5, 9, float("nan"), 1.0, 10, 10), (5, 9, 0.0, 0.0, 10, 10), (5, 9, 1e9, 1.0, 10, 10)]:
        assert hard_negatives.falling_thresholds(*odd)[-1] == 5


def test_windows_that_need_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "EXPECTED", 0.02)
    monkeypatch.setattr(hard_negatives, "GROWTH", 2)
    rows = vectors(400, 16, 3)
    assert mined(spark, rows, 25, block_rows=60) == plain_mine(rows, lambda i: i % 25 == 0)


def test_blocks_do_not_follow_the_shuffle_partitions(spark, monkeypatch):
    """Anchors go to every block: many partitions must not cut small tables into more blocks."""
    draw = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, i % 3, [int(x) for x in draw.integers(-200, 200, 6)]) for i in range(300)], "id bigint, label bigint, v array<bigint>")
    made, whole = [], hard_negatives.inverted_blocks
    monkeypatch.setattr(hard_negatives, "inverted_blocks", lambda rows, blocks, *a: made.append(blocks) or whole(rows, blocks, *a))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    want = {tuple(r) for r in hard_negatives.mine(rows, F.col("id") % 10 == 0).collect()}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        got = {tuple(r) for r in hard_negatives.mine(rows, F.col("id") % 10 == 0).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == want and want and made[0] == made[1] == 4 * spark.sparkContext.defaultParallelism
