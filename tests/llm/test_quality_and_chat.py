"""Quality rules, neighbour votes, chat formatting and toxicity."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from inkstream.llm import chat_format, quality_knn, quality_rules, toxicity


def brute_measures(text):
    text = text or ""
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often, marked = Counter(windows), set()
    for i, window in enumerate(windows):
        if often[window] > 1:
            marked |= set(range(i, i + 5))
    lines = [line for line in text.split("\n") if line.strip(" \t\x0b\x0c\r")]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked))


def test_measures_equal_brute_force():
    draw = random.Random(5)
    for _ in range(1500):
        text = "".join(draw.choice(["a ", "b ", "c\n", "d d\n", "é", "#", "\xa0", "\x85", "\t", "|"]) for _ in range(draw.randrange(80)))
        if draw.random() < 0.3:
            text += text
        assert quality_rules.measure(text)[:5] == brute_measures(text), repr(text)


def test_list_learns_conjunctions_and_order():
    draw = np.random.default_rng(6)
    table = {"a": draw.random(3000), "b": draw.random(3000), "c": draw.random(3000)}
    low = ((table["a"] > 0.7) & (table["b"] < 0.4)) | (table["c"] > 0.95)
    rules = quality_rules.learn(table, low)
    hit = np.zeros(3000, bool)
    for rule in rules:
        hit |= quality_rules.covered(rule, table, np.ones(3000, bool))
    assert (hit == low).mean() > 0.97 and len(rules) >= 2
    assert rules == quality_rules.learn(table, low)
    assert quality_rules.learn(table, np.zeros(3000, bool)) == []
    assert quality_rules.learn({"a": np.zeros(0)}, np.zeros(0, bool)) == []


def test_emitted_list_equals_the_rules(spark):
    rules = [(quality_rules.Condition("a", True, 0.5), quality_rules.Condition("b", False, 0.2)), (quality_rules.Condition("b", True, 0.9),)]
    rows = [(x / 10, y / 10) for x in range(11) for y in range(11)]
    frame = spark.createDataFrame(rows, "a double, b double")
    table = {"a": np.array([r[0] for r in rows]), "b": np.array([r[1] for r in rows])}
    dropped = np.any([quality_rules.covered(r, table, np.ones(len(rows), bool)) for r in rules], axis=0)
    got = {(r["a"], r["b"]): r["kept"] for r in frame.withColumn("kept", quality_rules.verdict(rules)).collect()}
    assert got == {row: not bool(d) for row, d in zip(rows, dropped)}


def test_judge_odd_tables(odd, clashing, nothing, labels):
    for docs in (odd, clashing):
        got = quality_rules.judge(docs, labels).collect()
        want = Counter((r["doc_id"], *brute_measures(r["text"])) for r in odd.collect())
        assert Counter(tuple(r)[:6] for r in got) == want
        for r in got:
            assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
            assert not (r["base_failed"] and r["kept"])
    assert quality_rules.judge(nothing, labels).collect() == []
    assert all(r["kept"] for r in quality_rules.judge(odd, labels.limit(0)).collect() if not r["base_failed"])


def quality_rows():
    draw = random.Random(8)
    word = lambda: "".join(draw.choice(["ta", "ri", "on", "es", "mu"]) for _ in range(draw.randrange(1, 4)))
    rows, labels = [], []
    for i in range(300):
        words = [word() for _ in range(draw.randrange(20, 80))]
        bad = i % 4 == 0
        if bad:
            words = [w + draw.choice(["###", "$$$", "***"]) for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(i % 5 == 0)))
    return rows, labels


def test_votes_equal_brute_force_and_classify(spark, plain):
    rows, labels = quality_rows()
    docs, known = plain(rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = quality_knn.fit(docs, known.filter("doc_id % 3 <> 0"))
    got = {r["doc_id"]: r["score"] for r in quality_knn.score(docs, model).collect()}
    held = [(got[i], q) for i, q, _ in labels if i % 3 == 0]
    assert sum((s >= 0.7) == bool(q) for s, q in held) / len(held) > 0.95
    vectors = quality_knn.project(*(lambda s: (s[0], s[1], quality_knn.scaled(*s, model.idf)))(quality_knn.sparse_vectors([t for _, t in rows])), model.axes)
    cosines = vectors.astype(float) @ model.vectors.astype(float).T
    for at in range(0, 300, 17):
        nearest = np.argsort(-cosines[at], kind="stable")[: quality_knn.NEIGHBOURS]
        weight = np.maximum(cosines[at][nearest], 0)
        assert got[at] == pytest.approx((weight * model.labels[nearest]).sum() / weight.sum(), abs=0.05)


def test_blocks_do_not_change_votes(monkeypatch):
    draw = np.random.default_rng(9)
    starts, dims = np.arange(0, 1001, 5), draw.integers(0, 4608, 1000).astype(np.int32)
    model = quality_knn.Model(starts, dims, np.ones(1000, np.float32), draw.integers(0, 2, 200))
    vectors = draw.standard_normal((50, model.vectors.shape[1])).astype(np.float32)
    whole = model.vote(vectors)
    monkeypatch.setattr(quality_knn, "LABEL_BLOCK", 7)
    assert np.allclose(whole, model.vote(vectors))


def test_scores_of_odd_tables(odd, clashing, nothing, labels):
    for docs in (odd, clashing):
        model = quality_knn.fit(docs, labels)
        got = quality_knn.score(docs, model).collect()
        assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in odd.collect())
        assert all(0 <= r["score"] <= 1 for r in got)
        assert {r["score"] for r in got if r["doc_id"] in (2, 3, 4)} == {model.prior}
    assert quality_knn.fit(odd, labels.limit(0)) is None
    assert {r["score"] for r in quality_knn.score(odd, None).collect()} == {quality_knn.NO_LABELS}
    assert quality_knn.score(nothing, quality_knn.fit(odd, labels)).collect() == []


def brute_chat(rows):
    """n_turns, digest of all turns, loss text, by conversation."""
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        found[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in found.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


CHAT = "conv_id bigint, turn bigint, role string, text string"


def test_chat_reads_back(spark):
    draw = random.Random(10)
    parts = ["<|im_end|>", "<|im_start|>", "<|im_sep|>", "<|", "<\\|", "\\", "<\\n", "<", "|", "\n", "a", "漢😀", "assistant"]
    text = lambda: "".join(draw.choice(parts) for _ in range(draw.randrange(8)))
    rows = [(c, t, draw.choice(["user", "assistant", "assistant", "system", text()]), text()) for c in range(60) for t in range(draw.randrange(1, 7))]
    rows += [(100, 1, None, None), (100, None, "user", "x"), (100, 1, "user", "y"), (100, 1, "user", "y"), (None, 0, "assistant", "z"), (101, 0, "assistant", "")]
    got = chat_format.digests(chat_format.format_conversations(spark.createDataFrame(rows, CHAT))).collect()
    assert {r["conv_id"]: tuple(r)[1:5] for r in got} == brute_chat(rows)


def test_chat_merges_neighbours_of_one_role(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "assistant", "c<|"), (1, 3, "user", "d")]
    extra = spark.createDataFrame(rows, CHAT).selectExpr("*", "'x' as turns", "'y' as formatted", "1 as conversation")
    row = chat_format.format_conversations(extra).collect()[0]
    assert row["formatted"] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_sep|>c<\\|<|im_end|>\n<|im_start|>user\nd<|im_end|>\n"
    assert [row["formatted"][s["start"] : s["start"] + s["length"]] for s in row["loss_spans"]] == ["b", "c<\\|"]
    assert chat_format.format_conversations(extra.limit(0)).collect() == []


def toxic_rows():
    draw = random.Random(11)
    word = lambda: "".join(draw.choice(["ta", "ri", "on", "es", "mu"]) for _ in range(draw.randrange(2, 4)))
    rows, labels = [], []
    for i in range(800):
        words = [word() for _ in range(draw.randrange(20, 80))]
        bad = i % 5 == 0
        for _ in range(draw.randrange(1, 8) if bad else 0):
            words.insert(draw.randrange(len(words)), draw.choice(["Grobkopf", "schuftig!", "grobian", "(lump)"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_is_ordered_and_right(spark, plain):
    rows, labels = toxic_rows()
    docs, known = plain(rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs, known.filter("doc_id % 3 <> 0"))
    assert (np.diff(model.thresholds) > 0).all()
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [(got[i]["toxic"], bool(t)) for i, _, t in labels if i % 3 == 0]
    assert sum(a == b for a, b in held) / len(held) > 0.98
    assert all(r["severity"] == 0 or r["toxic"] for r in got.values())
    assert got[0]["toxic"] and got[0]["expected_severity"] > got[1]["expected_severity"]
    kept = {r["doc_id"] for r in toxicity.without_toxic(docs, known).collect()}
    assert not [i for i, _, t in labels if bool(t) == (i in kept)]


def test_toxicity_of_odd_tables(odd, clashing, nothing, labels):
    model = toxicity.Model(["words", "plai*"], np.array([3.0, 3.0]), np.array([2.0, 4.0, 9.0]))
    for docs in (odd, clashing):
        got = toxicity.score(docs, model).collect()
        assert Counter(r["doc_id"] for r in got if r["toxic"]) == Counter([1, 7, 7])
        assert {r["severity"] for r in got if r["toxic"]} == {2}
        toxicity.fit(docs, labels)
    assert toxicity.fit(odd, labels.limit(0)) is None
    assert toxicity.score(nothing, model).collect() == []
    assert Counter(r["doc_id"] for r in toxicity.without_toxic(clashing, labels.limit(0)).collect()) == Counter(r["doc_id"] for r in odd.collect())
