"""Retention and provider health against row-by-row reference loops."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from inkstream.operators import housekeeping as K

AT = datetime(2024, 1, 15)


def plain_release(files, pending, cutoff, broken):
    """One attachment after the other, as a single process would."""
    paths, rows = Counter(p for _, _, p, _ in files if p), {}
    for i, article, path, created in sorted(files):
        rows[i] = path
        if path and created < cutoff and article not in pending:
            if paths[path] <= 1 and not path.startswith(("/", "../")) and path in broken:
                continue
            rows[i] = None
            paths[path] -= 1
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_release_equals_a_loop(spark, seed):
    draw = random.Random(seed)
    files = [(i, draw.randrange(30), draw.choice([None, "../up", "/abs", *(f"b/{k}" for k in range(12))]), AT - timedelta(days=draw.randrange(20))) for i in range(80)]
    pending, broken, cutoff = {1, 2, 3}, {"b/1", "b/2", "../up"}, AT - timedelta(days=4)
    attachments = spark.createDataFrame(files, "id bigint, article_id bigint, local_path string, created_at timestamp").withColumn("name", F.lit("n"))
    deliveries = spark.createDataFrame([(a, "pending") for a in pending] + [(9, "sent")], "article_id bigint, status string")

    def delete(path):
        assert not path.startswith(("/", ".."))
        if path in ("b/1", "b/2"):
            raise PermissionError(path)
        if path == "b/3":
            raise FileNotFoundError(path)

    released = K.files_to_release(attachments, deliveries, F.lit(cutoff))
    after = K.after_release(attachments, released, K.delete_files(released, delete))
    assert after.columns == attachments.columns
    assert {r.id: r.local_path for r in after.collect()} == plain_release(files, pending, cutoff, {"b/1", "b/2"})
    assert released.where("delete").count() == released.where("delete").select("local_path").distinct().count()


def test_sessions_and_counts(spark):
    tables = {
        "sessions": spark.createDataFrame([(1, AT), (2, AT + timedelta(seconds=1)), (3, None)], "id int, expires_at timestamp"),
        "articles": spark.createDataFrame([(1, "NOTIFIED", AT - timedelta(days=9), AT, "x"), (2, "TAGGED", AT - timedelta(days=9), AT, "x"), (3, "NOTIFIED", None, AT - timedelta(days=9), None)], "id int, status string, published_at timestamp, discovered_at timestamp, content_html string"),
        "attachments": spark.createDataFrame([(1, 1, "a", AT - timedelta(days=9))], "id int, article_id int, local_path string, created_at timestamp"),
        "deliveries": spark.createDataFrame([], "article_id int, status string"),
        "audit_log": spark.createDataFrame([(1, AT - timedelta(days=9)), (2, AT), (3, None)], "id int, created_at timestamp"),
    }
    after, counts = K.housekeeping(tables, at=F.lit(AT), article_days=5, attachment_days=5, audit_days=5, delete=lambda p: None)
    assert {r.table: r.affected for r in counts.collect()} == {"sessions": 1, "articles": 1, "attachments": 1, "audit_log": 1}
    assert {r.id for r in after["sessions"].collect()} == {2, 3} and {r.id for r in after["audit_log"].collect()} == {2, 3}
    assert {r.id: r.content_html for r in after["articles"].collect()} == {1: None, 2: "x", 3: None}
    empty = {n: t.limit(0) for n, t in tables.items()}
    assert {r.affected for r in K.housekeeping(empty, at=F.lit(AT), article_days=5, attachment_days=5, audit_days=5, delete=lambda p: None)[1].collect()} == {0}


@pytest.mark.parametrize("threshold", [1, 3])
def test_provider_health_equals_a_loop(spark, threshold):
    draw, calls, want = random.Random(threshold), [], {}
    for i in range(300):
        calls.append((f"p{draw.randrange(7)}", AT + timedelta(seconds=draw.randrange(50), milliseconds=draw.randrange(1000)), i, draw.choice(["success", "failure", "quota"]), f"e{i}", draw.random() < 0.1))
    for provider, at, i, outcome, error, fatal in sorted(calls, key=lambda c: (c[1], c[2])):
        row = want.setdefault(provider, [0, 0, 0, None, None])
        row[0] += 1
        if outcome == "success":
            row[2:] = [0, None, None]
        else:
            row[1], row[2] = row[1] + 1, row[2] + 1
            row[3] = at.replace(microsecond=0) + timedelta(seconds=60) if fatal or row[2] >= threshold else None
            row[4] = error
    frame = spark.createDataFrame(calls, "provider string, called_at timestamp, id int, outcome string, error string, fatal boolean")
    got = {r.provider: [r.total_calls, r.total_failures, r.consecutive_failures, r.cooldown_until, r.last_error] for r in K.provider_health(frame, threshold=threshold, cooldown_sec=60).collect()}
    assert got == want
