"""Importance resampling: planes, weights and ranks against plain counting."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from inkstream.llm import importance


def plain_words(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def plain_features(text, longest_run=1):
    words = plain_words(text)
    return [" ".join(words[i : i + n]) for n in range(1, longest_run + 1) for i in range(len(words) - n + 1)]


def plain_resample(docs, target, buckets=10_000, longest_run=1, least_words=20, percent=10, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode("utf-8", "surrogatepass")) % buckets
    s, t = (Counter(bucket(f) for text in texts for f in plain_features(text, longest_run)) for texts in ([d[1] for d in docs], target))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(float(t[b] + 1) * float(big_s + buckets) / (float(s[b] + 1) * float(big_t + buckets))))
    rows = []
    for id_, text in docs:
        features = plain_features(text, longest_run)
        weight = sum(gain(bucket(f)) for f in features)
        h = int(hashlib.sha256(f"{seed}:{'' if id_ is None else id_}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((id_, len(features), weight, score, len(plain_words(text)) >= least_words))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = Counter()
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        drawn[(r[0], r[3], rank)] += 1
    return [r[:4] for r in rows], drawn


def held(df):
    rows = [tuple(r) for r in df.collect()]
    return Counter(r[:4] for r in rows), Counter((r[0], r[3], r[4]) for r in rows if r[4] is not None)


def test_planes_give_exact_sums():
    draw = np.random.default_rng(4)
    gains = draw.integers(-9000, 9000, 1000)
    gains[:3] = [0, -(1 << 13), (1 << 13) - 1]
    planes, values = importance.signed_planes(gains)
    documents = [draw.integers(0, 1000, n) for n in (0, 1, 50, 4000)] + [np.full(70_000, 1), draw.choice(3, 200_000)] * 40
    got = importance.weights_of(documents, planes, values, 1000)
    assert got.tolist() == [int(gains[d].sum()) for d in documents]
    assert values[-1] < 0 and all(v > 0 for v in values[:-1])


@pytest.mark.parametrize("gains", [[0, 0, 0], [5, 0, 1], [-1, -7, 0]])
def test_planes_of_one_sign(gains):
    planes, values = importance.signed_planes(np.array(gains))
    got = importance.weights_of([np.array([0, 0, 2]), np.array([1])], planes, values, 3)
    assert got.tolist() == [2 * gains[0] + gains[2], gains[1]]


@pytest.mark.parametrize("options", [{}, {"buckets": 97, "longest_run": 3, "least_words": 5, "percent": 35, "seed": 7}])
def test_resample_equals_plain_counting(spark, plain, options):
    draw = np.random.default_rng(8)
    texts = [" ".join(f"W{w}x" for w in draw.zipf(1.4, draw.integers(0, 90)) % 500) + " ça va" for _ in range(400)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(500, texts[3]), (501, texts[3])]
    target = [" ".join(f"w{w}X" for w in range(40)), None, "", "ça"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id bigint, text string")
    rows, drawn = plain_resample(docs, target, **options)
    assert held(importance.resample(plain(docs), frame, **options)) == (Counter(rows), drawn)
    assert drawn and len({k[2] for k in drawn}) == len(drawn)


def test_resample_of_odd_tables(spark, odd, clashing, nothing):
    target = spark.createDataFrame([(1, "plain words of a small text"), (2, None)], "item_id bigint, text string")
    none = target.limit(0)
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    for frame in (odd, clashing):
        rows, drawn = plain_resample(docs, ["plain words of a small text", None], least_words=2, percent=60)
        assert held(importance.resample(frame, target, least_words=2, percent=60)) == (Counter(rows), drawn)
    rows, drawn = plain_resample(docs, [])
    assert held(importance.resample(odd, none)) == (Counter(rows), drawn)
    assert importance.resample(nothing, target).collect() == []
    kept = importance.draw(clashing, target, least_words=2, percent=60)
    assert kept.columns == clashing.columns and 0 < kept.count() < odd.count()
