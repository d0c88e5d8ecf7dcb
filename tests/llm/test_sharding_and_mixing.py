"""Shards and mixes: laws, balance, brute force."""

import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest

from inkstream.llm import mixing, sharding


def brute_difference(sizes, k):
    """Differencing on plain lists: spread of the result."""
    parts = [sorted([s] + [0] * (k - 1), reverse=True) for s in sizes]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[-1] - p[0])
        a, b = parts.pop(0), parts.pop(0)
        parts.append(sorted((x + y for x, y in zip(a, reversed(b))), reverse=True))
    return parts[0][0] - parts[0][-1]


@pytest.mark.parametrize("k", [2, 3, 40])
def test_difference_is_the_method(k):
    draw = np.random.default_rng(k)
    for count in (1, 2, 5, 60):
        sizes = draw.choice(100_000, count, replace=False) + 1
        table = np.zeros((count, k), np.int64)
        table[:, 0] = sizes
        labels = sharding.difference(table)[:, 0]
        loads = np.bincount(labels, sizes, minlength=k)
        assert loads.max() - loads.min() == brute_difference(sizes.tolist(), k)


def test_difference_of_vectors_permutes_each():
    table = np.random.default_rng(3).integers(0, 50, (30, 7))
    labels = sharding.difference(table)
    assert (np.sort(labels, axis=1) == np.arange(7)).all()


def check_shards(rows, docs, shards):
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((r["doc_id"], 16 + len((r["text"] or "").encode())) for r in docs)
    slots = defaultdict(list)
    for r in rows:
        assert 0 <= r["shard"] < shards and r["law"] == "bytes" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("options", [{}, {"bucket_groups": 20, "block_rows": 7}])
def test_shards_are_even_and_texts_stay_together(plain, options):
    rows = [(i, ("hot text " * 30) if i % 10 == 0 else f"text {i % 300} " * (1 + i * 7 % 40)) for i in range(600)]
    docs = plain(rows)
    got = sharding.shard(docs, 5, **options).collect()
    check_shards(got, docs.collect(), 5)
    texts, homes = dict(rows), defaultdict(set)
    for r in got:
        homes[texts[r["doc_id"]]].add(r["shard"])
        assert r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())
    assert all(len(h) == 1 for h in homes.values())
    loads = Counter()
    for r in got:
        loads[r["shard"]] += r["size"]
    assert max(loads.values()) - min(loads.values()) < 0.01 * sum(loads.values())
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard(docs, 5, **options).collect()}
    assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in got}


def test_shards_of_odd_tables(odd, clashing, nothing):
    for docs in (odd, clashing):
        got = sharding.shard(docs, 4).collect()
        check_shards(got, odd.collect(), 4)
        assert {r["text_crc32"] for r in got if r["doc_id"] == 2} == {None}
    assert sharding.shard(nothing, 4).collect() == []


def sql_takings(docs, **options):
    frame = pd.DataFrame([r.asDict() for r in docs.collect()], columns=docs.columns)
    con = duckdb.connect()
    con.register("documents", frame)
    return con.execute(mixing.takings_sql(**options)).fetchall()


@pytest.mark.parametrize("block_rows", [3, 20_000])
def test_takings_equal_sql(plain, block_rows):
    rows = [(i, " ".join(["w"] * (i % 17)), f"s{i * i % 7}" if i % 3 else "big") for i in range(400)]
    docs = plain(rows)
    got = sorted(tuple(r) for r in mixing.takings(docs, block_rows=block_rows).collect())
    want = sorted(sql_takings(docs, block_rows=block_rows))
    assert [g[:3] + g[4:] for g in got] == [tuple(w[:3] + w[4:]) for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want])
    by_target, longest = defaultdict(int), max(g[1] for g in got)
    for g in got:
        by_target[(g[2], g[3])] += g[4]
        assert g[4] <= 3 * g[1]
    assert all(abs(taken - target) <= 3 * longest for (_, target), taken in by_target.items())


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """Sharing again and again by weight, stopping sources above their most."""
    names = sorted(sizes)
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    left, target = sum(sizes.values()), {}
    while True:
        free = [n for n in names if n not in target]
        share = {n: left * weight[n] / sum(weight[m] for m in free) for n in free}
        over = [n for n in free if share[n] > most * sizes[n]]
        if not over:
            return target | share
        for n in over:
            target[n] = most * sizes[n]
            left -= target[n]


def test_targets_reshare(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 1, "e": 0, "f": 700, "g": 3}
    rows = spark.createDataFrame(list(sizes.items()), "source string, size bigint")
    got = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
    assert got == pytest.approx(brute_targets(sizes))
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_null_source_is_the_last(plain):
    got = mixing.takings(plain([(1, "a b", None), (2, "a", "z"), (3, "a", "y")])).collect()
    assert {r["doc_id"]: r["source_size"] for r in got} == {1: 2, 2: 1, 3: 1}
    # y weighs 5, z 2 and null 1, but y and z stop at three times their size.
    assert {r["doc_id"]: r["target"] for r in got} == pytest.approx({3: 2.5, 2: 1.0, 1: 0.5})


def test_mix_repeats_whole_rows(clashing, odd, nothing):
    takings = mixing.takings(odd).collect()
    got = mixing.mix(clashing)
    assert got.columns == clashing.columns and got.schema == clashing.schema
    rows, size = got.collect(), lambda t: len((t or "").encode().split())
    assert sum(size(r["text"]) for r in rows) == sum(r["taken"] for r in takings)
    wanted = Counter()
    for r in takings:
        wanted[(r["doc_id"], r["size"])] += r["taken"]
    found = Counter()
    for r in rows:
        found[(r["doc_id"], size(r["text"]))] += size(r["text"])
    assert {k: v for k, v in wanted.items() if v} == {k: v for k, v in found.items() if v}
    assert all(r["size"] == "own size" for r in rows)
    assert mixing.takings(nothing).collect() == [] and mixing.mix(nothing).collect() == []
