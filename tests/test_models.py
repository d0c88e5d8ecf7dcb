import pytest
from pyspark.sql import functions as F

from inkstream.operators import bootstrap as B
from inkstream.operators import tagging as G
from inkstream.sources.files import promote


def test_tag_response_ties_keep_acceptance_order(spark):
    text = '```json\n{"tags":[{"slug":"exam","confidence":0.8},{"slug":"invented","confidence":0.9},{"slug":"course","confidence":0.8},{"slug":"low","confidence":0.2}]}\n```'
    rows = spark.createDataFrame([(1, 1, text)], "article_id bigint, group_id int, response string")
    tags = spark.createDataFrame([(1, s, 0.35) for s in ("course", "exam", "low")], "group_id int, slug string, threshold double")
    row = G.parse_tag_responses(rows, tags, k=5).first()
    assert row.valid and [(t.slug, t.confidence) for t in row.tags] == [("exam", 0.8), ("course", 0.8)]


def test_local_tags_need_every_centroid(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0])], "article_id bigint, vector array<float>")
    schema = "slug string, threshold double, centroid array<double>"
    full = spark.createDataFrame([("a", 0.35, [2.0, 0.0]), ("b", 0.35, [5.0, 0.0]), ("c", 0.35, [0.0, 1.0]), ("d", 0.1, [1.0, 0.0, 0.0])], schema)
    got = [(r.slug, r.confidence) for r in G.local_tags(vectors, full).orderBy("rank").collect()]
    assert got == [("b", 1.0), ("a", 1.0)]
    partial = full.unionByName(spark.createDataFrame([("e", 0.1, None)], schema))
    assert G.local_tags(vectors, partial).count() == 0


def test_freeze_refuses_to_drop_subscribed_tags(spark, tmp_path):
    stored = spark.createDataFrame([(41, 1, "a"), (40, 1, "b"), (5, 2, "z")], "id bigint, group_id int, slug string")
    links = spark.createDataFrame([(1, 41)], "subscription_id bigint, tag_id bigint")
    path = str(tmp_path / "tags")
    good = spark.createDataFrame([(1, "new", 0, "New"), (1, "a", 1, "A")], "group_id int, slug string, position bigint, name string")
    B.freeze(good, stored, links, path, version="v2")
    assert promote(spark, path)
    frozen = {(r.group_id, r.slug): (r.id, r.tagset_version) for r in spark.read.parquet(path).collect()}
    assert frozen == {(1, "a"): (41, "v2"), (1, "new"): (42, "v2"), (2, "z"): (5, None)}
    bad = good.where(F.col("slug") != "a")
    with pytest.raises(ValueError, match="subscribed"):
        B.freeze(bad, stored, links, path, version="v3")


def test_local_tags_are_the_same_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(G, "VECTOR_PART", 3)
    vectors = spark.range(11).selectExpr("id AS article_id", "transform(sequence(1, IF(id = 4, 3, 2)), i -> CAST((id * 7 + i * 5) % 11 - 5 AS DOUBLE)) AS vector")
    tags = spark.range(9).selectExpr("concat('t', id) AS slug", "0.1D AS threshold", "transform(sequence(1, 2), i -> CAST((id * 3 + i * i) % 7 - 3 AS DOUBLE)) AS centroid")
    key = lambda rows: sorted((r.article_id, r.slug, round(r.score, 9)) for r in rows.collect())
    assert key(G.cosine_scores(vectors, tags, block_rows=2)) == key(G.cosine_scores(vectors, tags))
    best = lambda rows: set(key(rows))
    whole, cut = best(G.cosine_scores(vectors, tags, k=3)), best(G.cosine_scores(vectors, tags, k=3, block_rows=2))
    assert whole and whole <= cut
    assert not G.cosine_scores(vectors, tags.limit(0), k=3).collect()
    assert not G.cosine_scores(vectors.limit(0), tags, block_rows=2).collect()
