import random

import pytest
from pyspark.sql import functions as F

from inkstream.operators import attachments as A
from inkstream.operators import bootstrap as B
from inkstream.operators import delivery as V
from inkstream.operators import matching as M
from inkstream.operators import sequences as Q
from inkstream.operators.near_duplicates import ball1, ball2, band_masks, mark_crawl_duplicates, near_pairs
from inkstream.operators.sinks import absent
from inkstream.sources.files import promote, recover, stage


def signed(value):
    return value - (1 << 64) if value >= 1 << 63 else value


def clustered(rng, n):
    """Fingerprints in tight clusters, with copies, so buckets are crowded."""
    centres = [rng.getrandbits(64) for _ in range(4)]
    out = []
    for _ in range(n):
        value = rng.choice(centres)
        for bit in rng.sample(range(64), rng.choice([0, 0, 1, 2, 3, 5])):
            value ^= 1 << bit
        out.append(signed(value))
    return out


def distance(a, b):
    return ((a ^ b) & ((1 << 64) - 1)).bit_count()


def test_masks_cover_every_pair():
    rng = random.Random(1)
    for _ in range(500):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 3):
            b ^= 1 << bit
        assert any(signed(a) & m == signed(b) & m for m in band_masks())
    assert len(band_masks()) == 20


def test_balls(spark):
    row = spark.createDataFrame([(12345,)], "fp bigint").select(ball1(F.col("fp")).alias("one"), ball2(F.col("fp")).alias("two")).first()
    assert len(set(row.one)) == 65 and max(distance(12345, z) for z in row.one) == 1
    assert len(set(row.two)) == 2081 and max(distance(12345, z) for z in row.two) == 2


@pytest.mark.parametrize("hot_rows", [3, 4096])
def test_crawl_duplicates_match_brute_force(spark, hot_rows):
    rng = random.Random(hot_rows)
    rows = [(i, fp, "FAILED" if i % 7 == 5 else "EXTRACTED") for i, fp in enumerate(clustered(rng, 120))]
    expected = {
        i: min((j for j, g, s in rows if j < i and s != "FAILED" and distance(fp, g) <= 3), default=None) for i, fp, _ in rows
    }
    frame = spark.createDataFrame(rows, "id bigint, fp bigint, status string")
    got = {r.id: r.duplicate_of for r in mark_crawl_duplicates(frame, hot_rows=hot_rows, hot_copies=2).collect()}
    assert got == expected


@pytest.mark.parametrize("hot_rows", [2, 4096])
def test_near_pairs_match_brute_force(spark, hot_rows):
    rng = random.Random(9)
    fps = sorted(set(clustered(rng, 40)))
    bases = fps[::5]
    expected = {(f, b) for f in fps for b in bases if distance(f, b) <= 3}
    nodes = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    base_rows = spark.createDataFrame([(b, i) for i, b in enumerate(bases)], "fp bigint, first_id bigint")
    got = near_pairs(nodes, base_rows, hot_rows=hot_rows).collect()
    assert {(r.fp, r.base_fp) for r in got} == expected and len(got) == len(expected)


def sequential_dedupe(planned, fps, existing, cutoff):
    stored = {(s, t, a) for s, t, a, _, _ in existing}
    out, bases = {}, {}
    for s, t, a in sorted(planned, key=lambda r: (r[0], r[1], r[2])):
        if (s, t, a) in stored:
            continue
        old = [(at, x, fps[x]) for s2, t2, x, st, at in existing if (s2, t2) == (s, t) and st in ("pending", "sent") and at >= cutoff]
        found = [x for x, f in bases.get((s, t), []) if distance(f, fps[a]) <= 3]
        older = [(at, x) for at, x, f in old if distance(f, fps[a]) <= 3]
        hit = max(found) if found else (max(older)[1] if older else None)
        out[(s, t, a)] = hit
        if hit is None:
            bases.setdefault((s, t), []).append((a, fps[a]))
    return out


@pytest.mark.parametrize("hot_rows", [3, 4096])
def test_delivery_dedupe_is_greedy(spark, hot_rows):
    rng = random.Random(5)
    fps = dict(enumerate(clustered(rng, 60)))
    # A chain: 1000 ~ 1001 ~ 1002 but 1000 and 1002 are four bits apart, so 1002 is delivered again.
    fps.update({1000: 0, 1001: 0b11, 1002: 0b1111})
    planned = [(s, t, a) for s in (1, 2) for t in (1, 2) for a in fps if rng.random() < 0.7 or a >= 1000]
    day = 86400
    existing = [(1, 1, a, rng.choice(["pending", "sent", "skipped", "failed"]), (100 - rng.randrange(12)) * day) for a in rng.sample(range(60), 12)]
    expected = sequential_dedupe(planned, fps, existing, 93 * day)
    frame = spark.createDataFrame(planned, "subscription_id bigint, target_id bigint, article_id bigint")
    prints = spark.createDataFrame(list(fps.items()), "article_id bigint, fp bigint")
    stored = spark.createDataFrame(existing, "subscription_id bigint, target_id bigint, article_id bigint, status string, at bigint")
    stored = stored.withColumn("based_at", F.timestamp_seconds("at")).drop("at")
    done = V.suppress_duplicates(frame, prints, stored, at=F.timestamp_seconds(F.lit(100 * day)), hot_rows=hot_rows).collect()
    got = {(r.subscription_id, r.target_id, r.article_id): r.duplicate_of for r in done}
    assert got == expected
    assert expected[(2, 2, 1001)] == 1000 and expected[(2, 2, 1002)] is None
    assert all((r.status == "skipped") == (r.duplicate_of is not None) for r in done)


def test_dedupe_window_off(spark):
    frame = spark.createDataFrame([(1, 1, 1), (1, 1, 2)], "subscription_id bigint, target_id bigint, article_id bigint")
    prints = spark.createDataFrame([(1, 7), (2, 7)], "article_id bigint, fp bigint")
    done = V.suppress_duplicates(frame, prints, at=F.current_timestamp(), window_days=0).collect()
    assert {r.status for r in done} == {"pending"}


def events(rng, n, keys=3, span=40_000):
    return [(i, rng.randrange(keys), rng.randrange(span) * 1_000_000, rng.choice(["success", "failure", "failure", "quota"])) for i in range(n)]


@pytest.mark.parametrize("rows_per_segment", [7, 100_000])
def test_state_machines_do_not_depend_on_segments(spark, rows_per_segment):
    rng = random.Random(2)
    rows = events(rng, 300)
    frame = spark.createDataFrame(rows, "id bigint, k bigint, micros bigint, outcome string")
    per_key = {k: sorted((m, i, o) for i, kk, m, o in rows if kk == k) for k in range(3)}

    sent = {(r.k, r.second) for r in Q.throttle(frame, "k", "micros", "id", gap_seconds=600, rows_per_segment=rows_per_segment).collect()}
    expected = set()
    for k, seq in per_key.items():
        last = None
        for m, _, _ in seq:
            if last is None or m // 10**6 >= last + 600:
                last = m // 10**6
                expected.add((k, last))
    assert sent == expected

    limited = {r.id: r.accepted for r in Q.rate_limit(frame, "k", "micros", "id", limit=2, window_seconds=900, rows_per_segment=rows_per_segment).collect()}
    expected = {}
    for seq in per_key.values():
        log = []
        for m, i, _ in seq:
            log = [x for x in log if x > m - 900 * 10**6]
            expected[i] = len(log) < 2
            if expected[i]:
                log.append(m)
    assert limited == expected

    for half_open in (True, False):
        states = Q.circuit_breaker(
            frame, "k", "micros", "id", threshold=3, cooldown_seconds=1500, half_open_probe=half_open, rows_per_segment=rows_per_segment
        ).collect()
        expected = {}
        for seq in per_key.values():
            failures, until = 0, None
            for m, i, o in seq:
                cooling = until is not None and until * 10**6 > m
                if not cooling:
                    if until is not None and not half_open:
                        failures, until = 0, None
                    failures = 0 if o == "success" else failures + 1
                    until = m // 10**6 + 1500 if o == "quota" or (o == "failure" and failures >= 3) else None
                expected[i] = (not cooling, failures, until)
        assert {r.id: (r.executed, r.failures, r.cooldown_until) for r in states} == expected


def test_running_failures(spark):
    rng = random.Random(3)
    rows = [(i, i % 2, rng.random() < 0.8) for i in range(200)]
    frame = spark.createDataFrame(rows, "id bigint, k bigint, failed boolean")
    got = {r.id: r.failures for r in Q.running_failures(frame, ["k"], ["id"], F.col("failed"), F.floor(F.col("id") / 10), F.lit(4)).collect()}
    expected, count = {}, {0: 4, 1: 4}
    for i, k, failed in rows:
        count[k] = count[k] + 1 if failed else 0
        expected[i] = count[k]
    assert got == expected


def test_quota_matches_arrival_order(spark):
    rng = random.Random(8)
    rows = [(i, f"h{rng.randrange(60)}") for i in range(200)]
    size = {h: rng.choice([1, 5, 40, 200]) for _, h in rows}
    used, kept, expected = 30, {"h3"}, {}
    for i, h in rows:
        if h in kept:
            expected[i] = "reused"
        elif used + size[h] > 700:
            expected[i] = "skipped"
        else:
            used, expected[i] = used + size[h], "downloaded"
            kept.add(h)
    downloads = spark.createDataFrame([(i, h, size[h]) for i, h in rows], "id bigint, sha256 string, size_bytes bigint")
    stored = spark.createDataFrame([(900, "h3", 20), (901, None, 10)], "id bigint, sha256 string, size_bytes bigint")
    got = {r.id: r.outcome for r in A.store_within_quota(downloads, stored, quota=700).collect()}
    assert got == expected


def test_merge_follows_the_key_table(spark):
    rng = random.Random(4)
    rows = [(i, f"s{rng.randrange(25)}", f"N{rng.randrange(18)}", [rng.randrange(9)], rng.randrange(5)) for i in range(120)]
    merged, keys = [], {}
    for i, slug, name, ids, coverage in rows:
        labels = (("slug", slug), ("name", name.casefold()))
        at = next((keys[x] for x in labels if x in keys), None)
        if at is None:
            at = len(merged)
            merged.append([slug, set(ids), coverage, 0])
        else:
            tag = merged[at]
            tag[1] |= set(ids)
            tag[2], tag[3] = max(tag[2], coverage, len(tag[1])), tag[3] + 1
        for x in labels:
            keys[x] = at
    frame = spark.createDataFrame(
        [(i, s, n, "d", ["k"], ids, c, ["t"]) for i, s, n, ids, c in rows],
        "position bigint, slug string, name string, description string, keywords array<string>, article_ids array<bigint>, coverage bigint, titles array<string>",
    )
    got = {(r.slug, r.coverage, r.n_merged) for r in B.merge_candidates(frame).collect()}
    assert got == {(s, c, n) for s, _, c, n in merged}


def test_stable_ids_continue_after_the_largest(spark):
    stored = spark.createDataFrame([(41, 1, "a"), (7, 2, "b")], "id bigint, group_id int, slug string")
    document = spark.createDataFrame([(1, "x", 0), (1, "a", 1), (1, "y", 2)], "group_id int, slug string, position bigint")
    got = {r.slug: r.id for r in B.assign_ids(document, stored).collect()}
    assert got == {"a": 41, "x": 42, "y": 43}


def test_staged_replacement_survives_a_crash(spark, tmp_path):
    path = str(tmp_path / "tags")
    spark.range(3).write.parquet(path)
    stage(spark.range(5), path)
    assert spark.read.parquet(path).count() == 3
    assert recover(spark, path, committed=False) is False and spark.read.parquet(path).count() == 3
    stage(spark.range(5), path)
    assert recover(spark, path, committed=True) is True and spark.read.parquet(path).count() == 5
    assert promote(spark, path) is False


def test_outcomes_promote_only_exhausted_retries(spark):
    schema = "delivery_id bigint, attempts int, ok boolean, error string, retry_after double, rejected boolean, disables_target boolean"
    rows = [
        (1, 0, True, None, None, False, False), (2, 4, False, "NotifyTransient: x", None, False, False), (3, 0, False, "TargetRejected: x", None, False, False),
        (4, 0, False, "NotifyTransient: http://secret/x", 12.0, False, False), (5, 4, False, "NotifyTransient: x", None, False, True),
    ]
    done = V.record_outcomes(spark.createDataFrame(rows, schema), at=F.timestamp_seconds(F.lit(0)), max_attempts=5, base_sec=30).collect()
    got = {r.delivery_id: (r.status, r.promotes) for r in done}
    assert got == {1: ("sent", False), 2: ("failed", True), 3: ("failed", False), 4: ("pending", False), 5: ("failed", False)}
    assert next(r.last_error for r in done if r.delivery_id == 4) == "NotifyTransient: [redacted-url]"




def test_segments_cut_inside_a_busy_slot(spark):
    # One key and one hour: 300 rows in three seconds, 60 of them in one microsecond.
    rows = [("k", 1_000_000 * (i % 3) + (7 if i < 60 else i), i) for i in range(300)]
    frame = spark.createDataFrame(rows, "k string, micros bigint, id bigint")
    got = Q.with_segments(frame, ["k"], "micros", rows_per_segment=40).collect()
    sizes = {}
    for r in got:
        sizes[r.segment] = sizes.get(r.segment, 0) + 1
    assert sum(sizes.values()) == 300 and len(sizes) >= 5 and max(sizes.values()) <= 80
    ordered = sorted(got, key=lambda r: r.micros)
    assert [r.segment for r in ordered] == sorted(r.segment for r in got)
    for per in (40, 500_000):
        plain = Q.rate_limit(frame, "k", "micros", "id", limit=5, window_seconds=1, rows_per_segment=per)
        accepted = {r.id for r in plain.where("accepted").collect()}
        if per == 40:
            split = accepted
    assert accepted == split
    failed = F.col("id") % 7 != 0
    parts = Q.with_segments(frame, ["k"], "micros", rows_per_segment=40)
    by_part = {r.id: r.failures for r in Q.running_failures(parts, ["k"], ["micros", "id"], failed, F.col("segment")).collect()}
    whole = {r.id: r.failures for r in Q.running_failures(frame, ["k"], ["micros", "id"], failed, F.lit(0)).collect()}
    assert by_part == whole


@pytest.mark.parametrize("seed", range(3))
def test_quota_equals_one_file_after_the_other(spark, seed):
    """Sizes from tiny to larger than the quota, contents that come again, some kept already."""
    import random

    draw = random.Random(seed)
    files = [(i * 3, f"h{draw.randrange(220)}", draw.choice([0, 1, draw.randrange(1, 30), draw.randrange(30, 400), draw.randrange(400, 3000)])) for i in range(400)]
    size = {}
    for _, h, s in files:
        size.setdefault(h, s)
    files = [(i, h, size[h]) for i, h, _ in files]
    stored = [(-k, f"h{k}", 7) for k in range(1, 20)]
    kept, space, want = {h for _, h, _ in stored}, 4000 - 7 * len(stored), {}
    for i, h, s in files:
        if h in kept:
            want[i] = "reused"
        elif s <= space:
            space, want[i] = space - s, "downloaded"
            kept.add(h)
        else:
            want[i] = "skipped"
    schema = "id bigint, sha256 string, size_bytes bigint"
    got = A.store_decisions(spark.createDataFrame(files, schema), spark.createDataFrame(stored, schema), quota=4000).collect()
    assert {r.id: r.outcome for r in got} == want and set(want.values()) == {"reused", "downloaded", "skipped"}
    assert all((r.path is None) == (r.outcome == "skipped") == (r.skip_reason is not None) for r in got)


def test_running_sum_blocks_follow_the_rows(spark, monkeypatch):
    from inkstream.operators import attachments as A

    monkeypatch.setattr(A, "BLOCK_ROWS", 10)
    ids = [*range(100), 10**15, 10**15 + 7, -(10**12)]
    rows = spark.createDataFrame([(i, i % 5) for i in ids], "id bigint, size bigint")
    total, expected = 0, {}
    for i in sorted(ids):
        total += i % 5
        expected[i] = total
    assert {r.id: r.total for r in A.running_sum(rows, "id", "size").collect()} == expected
    assert not A.running_sum(rows.limit(0), "id", "size").collect()


def test_segments_of_full_slots(spark):
    from inkstream.operators.sequences import with_segments

    # One key with a full hour, a full second and a full microsecond; one with few rows.
    rows = [("a", 1_000_000 * s, n) for s in range(3) for n in range(4)] + [("a", 5_000_000 + u, n) for u in range(4) for n in range(3)] + [("a", 3_600_000_000 * 2, 0), ("b", 7, 0)]
    found = with_segments(spark.createDataFrame(rows, "k string, at bigint, n int"), ["k"], "at", rows_per_segment=5).collect()
    assert sorted((r.k, r.at, r.n) for r in found) == sorted(rows)
    mine = sorted((r.at, r.segment) for r in found if r.k == "a")
    assert [s for _, s in mine] == sorted(s for _, s in mine)
    sizes = {}
    for at, segment in mine:
        sizes[segment] = sizes.get(segment, 0) + 1
    assert len(sizes) > 3 and max(sizes.values()) < 10


def test_new_deliveries_of_single_texts_take_little_room(spark, tmp_path, monkeypatch):
    """Planned rows are stored narrow; those whose text has no copy and no neighbour aren't grouped again."""
    written = {}
    for name in ("as_table", "cut_lineage"):
        kept = getattr(V, name, None)
        if kept is not None:
            monkeypatch.setattr(V, name, lambda df, *rest, kept=kept, name=name: written.setdefault(name, []).append(df.columns) or kept(df, *rest))
    rng = random.Random(3)
    fps = {a: signed(rng.getrandbits(64)) for a in range(40)}
    fps.update({40: fps[0], 41: None})
    frame = spark.createDataFrame([(s, 1, a) for s in range(20) for a in fps], "subscription_id bigint, target_id bigint, article_id bigint")
    prints = spark.createDataFrame(list(fps.items()), "article_id bigint, fp bigint")
    stored = spark.createDataFrame([(3, 1, 40, "sent", 100), (4, 1, 7, "failed", 100)], "subscription_id bigint, target_id bigint, article_id bigint, status string, at bigint")
    stored = stored.withColumn("based_at", F.timestamp_seconds("at")).drop("at")
    done = V.suppress_duplicates(frame, prints, stored, at=F.timestamp_seconds(F.lit(200))).collect()
    got = {(r.subscription_id, r.article_id): r.duplicate_of for r in done}
    expected = {(s, a): None for s in range(20) for a in fps if (s, a) not in ((3, 40), (4, 7))}
    expected.update({(s, 40): 0 for s in range(20) if s != 3} | {(3, 0): 40})
    assert got == expected and len(done) == len(got)
    assert written["as_table"] and not any("target_id" in c and "article_id" in c for c in written["cut_lineage"])


def test_absent_rows(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 3), (3, 3)], "a int, b int")
    stored = spark.createDataFrame([(1, 1), (1, 1), (2, 2), (9, 9)], "a int, b int")
    found = absent(rows, stored, ["a", "b"], by="b")
    assert found.columns == ["a", "b"] and sorted(map(tuple, found.collect())) == [(1, 2), (2, 1), (3, 3), (3, 3)]


def test_fan_out_makes_tasks_for_its_rows(spark, monkeypatch):
    """Many rows may come out of few; the tasks follow from the rows that come out, and no key makes too many of them."""
    matches = spark.createDataFrame([(a, p, 60 if p == "x" else 3) for p, n in (("x", 50), ("y", 2)) for a in range(n)], "article_id bigint, profile string, n bigint")
    plan = spark.createDataFrame([(s, p, 60 if p == "x" else 3) for p, n in (("x", 60), ("y", 3)) for s in range(n)], "subscription_id bigint, profile string, n bigint")
    for name, value in (("CHUNK_ROWS", 7), ("BLOCK_MATCHES", 10), ("ROWS_PER_TASK", 100)):
        monkeypatch.setattr(M, name, value, raising=False)
    made = M.expand_profiles(matches, plan, "n")
    assert sorted(made.select("profile", "article_id", "subscription_id").collect()) == sorted((p, a, s) for p, n, m in (("x", 50, 60), ("y", 2, 3)) for a in range(n) for s in range(m))
    sizes = made.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 8 and max(r["count"] for r in sizes) < 1000


def test_planned_rows_know_stored_articles_before_the_fan_out(spark):
    articles = spark.createDataFrame([(1, 7), (2, 7), (3, 7)], "id bigint, site_id bigint")
    tags = spark.createDataFrame([(i, 5, 90) for i in (1, 2, 3)], "article_id bigint, tag_id bigint, confidence int")
    subs = spark.createDataFrame([(s, s, True, "any", 60, None, None) for s in range(4)], "id bigint, user_id bigint, enabled boolean, match_mode string, min_confidence int, site_filter string, quiet_hours string")
    picks = spark.createDataFrame([(s, 5) for s in range(4)], "subscription_id bigint, tag_id bigint")
    targets = spark.createDataFrame([(10 + s, s, True) for s in range(4)], "id bigint, user_id bigint, enabled boolean")
    links = spark.createDataFrame([], "subscription_id bigint, target_id bigint")
    plan = lambda **k: M.plan_deliveries(articles, tags, subs, picks, targets, links, at=F.timestamp_seconds(F.lit(0)), **k)
    rows = plan(marked=spark.createDataFrame([(2,), (9,), (None,)], "article_id bigint"))
    assert sorted((r.subscription_id, r.article_id, r.target_id, r.marked) for r in rows.collect()) == [(s, a, 10 + s, a == 2) for s in range(4) for a in (1, 2, 3)]
    assert rows.drop("marked").exceptAll(plan()).isEmpty() and plan().count() == 12
    # Times are put into words per subscription, below the join that makes the rows.
    shown = plan(shown=lambda t: F.date_format(t, "yyyy"))
    assert shown.count() == 12 and {r.next_attempt_at for r in shown.collect()} == {"1970"}
    text = shown._jdf.queryExecution().optimizedPlan().toString()
    assert text.rindex("date_format") > text.index("Join")
