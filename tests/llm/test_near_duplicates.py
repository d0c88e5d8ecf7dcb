"""Golay-code search and near-duplicate groups against brute force."""

from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from inkstream.llm import common, simhash_golay
from inkstream.llm.common import components


def brute_groups(pairs):
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {a: find(a) for a in list(parent)}


def brute_fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def near(values, seed, count=40):
    """The values and others 1 to 4 bits away."""
    draw, found = np.random.default_rng(seed), set(values)
    for value in values[:count]:
        for bits in (1, 2, 3, 4, 3):
            found.add(value ^ sum(1 << int(b) for b in draw.choice(64, bits, replace=False)))
    return [v - (1 << 64) if v >> 63 else v for v in sorted(found)]


def far(a, b):
    return bin((a ^ b) & ((1 << 64) - 1)).count("1")


def test_code_is_perfect():
    words = np.random.default_rng(1).integers(0, 1 << 23, 300)
    tables = simhash_golay.error_tables()
    data = np.arange(4096) << 11
    all_words = data ^ simhash_golay.syndrome(data)
    distance = np.bitwise_count(words[:, None] ^ all_words[None, :])
    assert (distance.min(axis=1) <= 3).all()
    for row, found in zip(distance, simhash_golay.codewords(words, tables)):
        assert set(found[found >= 0]) == set(np.flatnonzero(row <= 4)) and row[found[0]] == row.min()


@pytest.mark.parametrize("limit", [0, 3, simhash_golay.BUCKET_LIMIT])
def test_links_equal_brute_force(spark, limit):
    values = near([int(v) for v in np.random.default_rng(2).integers(0, 1 << 63, 60)] + [0, (1 << 64) - 1], 3)
    want = [(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if far(a, b) <= 3]
    frame = spark.createDataFrame([(v,) for v in values], "fp bigint")
    got = {tuple(sorted((r["a"], r["b"]))) for r in simhash_golay.links(frame, bucket_limit=limit).collect()}
    assert all(far(a, b) <= 3 for a, b in got)
    assert brute_groups(got) == brute_groups(want)
    if limit == simhash_golay.BUCKET_LIMIT:
        assert got == {tuple(sorted(p)) for p in want}


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_crowded_buckets_at_every_distance(spark, bits):
    values = near([5, 1 << 40, 123456789], 4)
    want = [(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if far(a, b) <= bits]
    frame = spark.createDataFrame([(v,) for v in values], "fp bigint")
    got = [tuple(r) for r in simhash_golay.links(frame, max_bits=bits, bucket_limit=0).collect()]
    assert brute_groups(got) == brute_groups(want)


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(200)]
    hub = [(1000, 1000 + i) for i in range(1, 300)]
    edges = [*chain, *hub, (5, 5), (2000, 2001), (2001, 2000)]
    frame = spark.createDataFrame([*edges, (None, 1)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in components(frame).collect()}
    assert got == brute_groups([(a, b) for a, b in edges if a != b])
    assert components(frame.limit(0)).collect() == []


def text(i, changed=()):
    words = [f"w{(i * 31 + k * 7) % 997}" for k in range(400)]
    for k in changed:
        words[k] = f"changed{k}"
    return " ".join(words)


def brute_rows(rows):
    prints = {}
    for id_, t in rows:
        prints.setdefault(brute_fingerprint(t), []).append(id_)
    values = sorted(prints)
    groups = brute_groups([(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if far(a, b) <= 3])
    least = {}
    for v in values:
        ids = [i for i in prints[v] if i is not None]
        root = groups.get(v, v)
        least[root] = min([*ids, *([least[root]] if least.get(root) is not None else [])], default=None)
    return Counter((id_, f"{v:016x}", least[groups.get(v, v)]) for v in values for id_ in prints[v])


def rows_of(frame):
    return Counter((r["doc_id"], f"{r['fp'] % (1 << 64):016x}", r["component_id"]) for r in frame.collect())


def test_groups_equal_brute_force(plain):
    rows = [(i, text(i)) for i in range(40)] + [(100 + i, text(3, [i])) for i in range(30)] + [(200, text(7).upper()), (201, text(7).replace(" ", "\n\t "))]
    assert rows_of(simhash_golay.near_duplicates(plain(rows))) == brute_rows(rows)
    assert rows_of(simhash_golay.near_duplicates(plain(rows), bucket_limit=1)) == brute_rows(rows)


def test_odd_tables(odd, clashing, nothing):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    for docs in (odd, clashing):
        assert rows_of(simhash_golay.near_duplicates(docs)) == brute_rows(rows)
    assert simhash_golay.near_duplicates(nothing).collect() == []
    kept = simhash_golay.keep_first(clashing)
    assert kept.columns == clashing.columns
    # Of the texts without words (2, 3, 4) the first stays, of the equal ones (1, 7) too; null ids stay.
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, i) for i in (1, 2, 5, 6, 8, 9)] + [(True, 0)] * 2
    assert simhash_golay.keep_first(nothing).collect() == []


def test_further_rounds_only_join_more(plain):
    rows = [(i, text(i)) for i in range(20)] + [(100 + i, text(i % 20, [3 * i + k for k in range(1 + i % 4)])) for i in range(60)] + [(200, None), (201, "")]
    docs = plain(rows)
    one = {r["doc_id"]: r["component_id"] for r in simhash_golay.near_duplicates(docs).collect()}
    got = {r["doc_id"]: r["component_id"] for r in simhash_golay.near_duplicates(docs, rounds=4).collect()}
    prints = {i: simhash_golay.fingerprint(t, 3, 4) for i, t in rows}
    ids = [i for i, _ in rows]
    want = brute_groups([(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if any(far(x, y) <= 3 for x, y in zip(prints[a], prints[b]))])
    assert got == {i: want.get(i, i) for i in ids}
    assert sum(i != c for i, c in got.items()) > sum(i != c for i, c in one.items())
    assert all(got[i] == got[c] for i, c in one.items()) and got[201] == 200


def test_keys_are_never_broadcast(spark, monkeypatch):
    """Keys and repeated minima are dozens of times the table that Spark takes their size from."""
    fps = spark.range(2000).select(F.xxhash64("id").alias("fp"))
    edges = spark.range(2000).select(F.col("id").alias("a"), (F.col("id") / 2).cast("long").alias("b"))
    plans = [simhash_golay.links(fps), simhash_golay._through_middles(fps.limit(20), 3), common._with_least(edges, edges.select("a", F.col("b").alias("m")))]
    for plan in plans:
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text, text
