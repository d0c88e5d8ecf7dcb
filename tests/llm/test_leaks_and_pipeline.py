"""String tiling against a plain version, and the whole pipeline."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from inkstream.llm import decontaminate, mixing
from inkstream.llm.common import written


def brute_tiles(doc, item, least):
    """Words of item that greedy tiling marks: scan for the longest unmarked common run, mark, repeat."""
    doc_marked, item_marked = [False] * len(doc), [False] * len(item)
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                k = 0
                while i + k < len(item) and d + k < len(doc) and item[i + k] == doc[d + k] and not item_marked[i + k] and not doc_marked[d + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, d)
        if best[0] < least or not best[0]:
            return sum(item_marked)
        for k in range(best[0]):
            item_marked[best[1] + k] = doc_marked[best[2] + k] = True


def test_tiling_equals_brute_force():
    draw = random.Random(12)
    for _ in range(150):
        items = [(n, " ".join(draw.choice("abc") for _ in range(draw.randrange(1, 25)))) for n in range(3)]
        pieces = [p for _, t in items for p in [t[: len(t) // 2], t[len(t) // 2 :]]]
        doc = " ".join(draw.choice([*pieces, "a b", "zz"]) for _ in range(draw.randrange(1, 6)))
        got = {item: (marked, words) for item, marked, words in decontaminate.Benchmark(items).covered(doc)}
        for item, text in items:
            words = text.split()
            want = brute_tiles(doc.split(), words, min(decontaminate.SEED_WORDS, len(words)))
            assert got.get(item, (0, len(words))) == (want, len(words))


ITEMS = [(1, "The quick brown fox jumps over the lazy dog near the old river bank today."), (2, "Completely different sentence about seven wise engineers building one wooden bridge in spring"), (3, None), (4, ""), (5, "...")]


def leak_docs(plain):
    fox, bridge = ITEMS[0][1], ITEMS[1][1]
    half = fox.split()
    return plain([
        (1, "before it " + fox + " and after"),
        (2, " ".join(half[8:]).upper() + "; meanwhile, " + " ".join(half[:8])),
        (3, " ".join(half[:6])),
        (4, "nothing of the kind is in here at all, over the lazy hills"),
        (5, (bridge + "\n") * 40 + fox),
        (None, fox),
        (6, None),
        (7, ""),
        (1, "a clean row with the same id"),
    ])


@pytest.mark.parametrize("block_bytes", [10, 4 << 20])
def test_leaks(spark, plain, block_bytes):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string").selectExpr("*", "1 as coverage", "2 as doc_id")
    docs = leak_docs(plain).selectExpr("*", "'own' as gone", "'own' as item_id")
    got = sorted((str(r["doc_id"]), r["item_id"]) for r in decontaminate.leaks(docs, bench, block_bytes=block_bytes).collect())
    assert got == [("1", 1), ("2", 1), ("5", 1), ("5", 2), ("None", 1)]
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 6, 7]
    assert decontaminate.leaks(docs.limit(0), bench).collect() == []
    assert decontaminate.leaks(docs, bench.limit(0)).collect() == []
    assert decontaminate.clean(docs, bench.limit(0)).count() == docs.count()


def test_short_items_are_reported_and_drop_nothing(spark, plain):
    bench = spark.createDataFrame([(1, "yes"), (2, "one two three four"), (3, "one two three four five")], "item_id bigint, text string")
    docs = plain([(1, "yes it is"), (2, "one two three four times"), (3, "say one two three four five")])
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()) == [(1, 1), (2, 2), (3, 2), (3, 3)]
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, bench).collect()) == [1, 2]


def test_leaks_of_odd_tables(spark, odd, clashing):
    bench = spark.createDataFrame([(1, "plain words of a small text in one line")], "item_id bigint, text string")
    for docs in (odd, clashing):
        assert Counter(r["doc_id"] for r in decontaminate.leaks(docs, bench).collect()) == Counter([1, 7, 7])


def stages(spark, docs, folder):
    """What each stage returns, written as the driver does."""
    found = []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, folder), f"test-{name}")
        found.append(docs)
    return found


def test_pipeline_stages_take_effect(spark, plain, tmp_path):
    draw = random.Random(13)
    word = lambda: "".join(draw.choice(["ta", "ri", "on", "es", "mu", "ka"]) for _ in range(draw.randrange(2, 5)))
    rows, labels = [], []
    for i in range(300):
        words = [word() for _ in range(120)]
        if i % 6 == 0:
            words[3] = words[40] = draw.choice(["schuftig", "grobian"])
        rows.append((i, " ".join(words), f"s{i % 4}"))
        labels.append((i, 1, int(i % 6 == 0)))
    rows += [(400 + i, rows[1][1], "s1") for i in range(5)] + [(500, " ".join(word() for _ in range(120)) + " " + ITEMS[1][1], "s2"), (503, rows[7][1] + " added at the end", "s2"), (501, None, None), (502, "", "s0")]
    docs, folder = plain(rows), str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    clean, single, safe, mixed, tokens = stages(spark, docs, folder)
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    assert ids(docs) - ids(clean) == {i for i, _, t in labels if t}
    # Texts are a word's throw apart or far: in id order, a text similar to a kept one goes.
    kept, cut = {}, lambda t: {tuple((t or "").split()[i : i + 5]) for i in range(max(1, len((t or "").split()) - 4))}
    for i, text in sorted((r["doc_id"], r["text"]) for r in clean.collect()):
        own = cut(text)
        if all(5 * len(own & other) < 4 * len(own | other) for other in kept.values()):
            kept[i] = own
    assert ids(single) == set(kept) and not ids(single) & {400, 401, 402, 403, 404, 502, 503}
    assert ids(single) - ids(safe) == {500}
    takings = {r["doc_id"]: r["taken"] for r in mixing.takings(safe).collect()}
    assert Counter(r["doc_id"] for r in mixed.collect() if r["text"]) == Counter({i: t // len(dict((r[0], r[1]) for r in rows)[i].split()) for i, t in takings.items() if t})
    for stage in (clean, single, safe, mixed):
        assert stage.schema == docs.schema
    assert tokens.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert Counter(ids_ for (ids_,) in tokens.select("doc_id").collect()) == Counter(r["doc_id"] for r in mixed.collect())
    again = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, tokens.collect()))


def test_pipeline_of_odd_and_empty_tables(spark, clashing, nothing, labels, tmp_path):
    folder = str(tmp_path)
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    for docs in (clashing, nothing):
        found = stages(spark, docs, folder)
        assert all(f.columns == docs.columns for f in found[:4])
        assert found[4].count() == found[3].count()
    assert found[0].count() == 0


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_files"]
