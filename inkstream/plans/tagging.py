"""Tagging queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.errors import http_error_class
from ..functions.text import head_tail
from ..functions.vectors import l2_normalize
from ..operators import tagging as T
from .bridge import NOW, cte, read, read_spread, table
from .catalogue import query

N_TAGS = "(SELECT count(*) FROM part)"


def _answer(d: str) -> str:
    """Model answers in every shape a model produces, from article and tag ids."""
    def entry(shift: int, mult: int) -> str:
        return (
            f"concat('{{\"slug\":\"tag-', CAST((doc_id * {mult} + {shift}) % 200 AS STRING), '\",\"confidence\":0.', lpad(CAST((doc_id * 7 + {shift} * 29) % 100 AS STRING), 2, '0'), '}}')"
        )

    items = ", ',', ".join([entry(0, 5), entry(5, 5), entry(1, 3), entry(0, 5).replace("* 7", "* 11"), entry(35, 5), entry(65, 5)])
    plain = f"concat('{{\"tags\":[', {items}, ']}}')"
    return f"""CASE doc_id % 10 WHEN 0 THEN concat('```json\n', {plain}, '\n```') WHEN 1 THEN concat('Sure: ', {plain}, ' done')
  WHEN 2 THEN 'no object here' WHEN 3 THEN '{{"tags":5}}' WHEN 4 THEN concat('{{"tags":[', {entry(0, 5)}, ',{{"slug":"tag-1","confidence":true}}]}}')
  WHEN 5 THEN concat('{{"tags":[', {entry(0, 5)}, ',{{"slug":"tag-1","confidence":1.5}}]}}') WHEN 6 THEN '{{"tags":[]}}' ELSE {plain} END"""


def responses(spark, d):
    return read_spread(spark, d, "documents", "doc_id", "source").select(
        F.col("doc_id").alias("article_id"), (F.expr("CAST(substr(source, 4) AS INT)") % 5).alias("group_id"), F.expr(_answer("spark")).alias("response")
    )


PARSED = f""",
answers AS (SELECT doc_id AS article_id, CAST(substr(source, 4) AS INT) % 5 AS group_id, doc_id % 10 AS k, {_answer('duckdb')} AS response FROM documents),
bodies AS (SELECT *, k NOT IN (2, 3, 4, 5) AS valid, CASE WHEN k IN (0, 1) THEN regexp_extract(response, '\\{{.*\\}}', 0, 's') ELSE response END AS body FROM answers),
entries AS (SELECT article_id, group_id, i AS pos, json_extract_string(body, '$.tags[' || CAST(i AS STRING) || '].slug') AS slug,
  CAST(json_extract_string(body, '$.tags[' || CAST(i AS STRING) || '].confidence') AS DOUBLE) AS confidence FROM bodies, range(6) r(i) WHERE valid AND k <> 6),
accepted AS (SELECT e.* FROM entries e JOIN tags t ON t.slug = e.slug AND t.group_id = e.group_id WHERE e.slug IS NOT NULL AND e.confidence >= greatest(0.2, t.threshold)),
best AS (SELECT article_id, slug, max(confidence) AS confidence, min(pos) AS pos FROM accepted GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY confidence DESC, pos) AS rank FROM best)"""


@query("jsn1_jsn2_agg11_top4_tag_responses", cte("tags") + PARSED + "SELECT article_id, slug, round(confidence, 6) AS confidence, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 3")
def tag_responses(spark, d):
    parsed = T.parse_tag_responses(responses(spark, d), table(spark, d, "tags").select("group_id", "slug", "threshold"), k=3, min_confidence=0.2)
    rows = parsed.select("article_id", F.posexplode("tags").alias("rank", "t"))
    return rows.select("article_id", "t.slug", F.round("t.confidence", 6).alias("confidence"), (F.col("rank") + 1).alias("rank"))


@query("jsn2_response_validity", cte("tags") + PARSED + "SELECT article_id, valid FROM bodies")
def response_validity(spark, d):
    parsed = T.parse_tag_responses(responses(spark, d), table(spark, d, "tags").select("group_id", "slug", "threshold"), k=3)
    return parsed.select("article_id", "valid")


@query("snk6_replace_tags", cte("articles", "article_tags", "tags") + """
, results AS (SELECT id AS article_id, CASE WHEN id % 13 = 0 THEN (group_id + 1) % 4 ELSE group_id END AS group_id, status, group_id AS own,
   'tag-' || CAST(id % 200 * 5 + group_id + CASE WHEN id % 13 = 0 THEN 1 ELSE 0 END AS STRING) AS slug FROM articles),
judged AS (SELECT r.*, t.id AS tag_id, CASE WHEN r.status <> 'EXTRACTED' THEN 'wrong_status' WHEN r.own <> r.group_id THEN 'wrong_group' WHEN t.id IS NULL THEN 'unknown_tag' ELSE 'tagged' END AS outcome
   FROM results r LEFT JOIN tags t ON t.slug = r.slug AND t.group_id = r.group_id)
SELECT article_id, tag_id, conf_pct / 100 AS confidence, 'old' AS backend FROM article_tags WHERE article_id NOT IN (SELECT article_id FROM judged WHERE outcome = 'tagged')
UNION ALL SELECT article_id, tag_id, 0.5, 'm1' FROM judged WHERE outcome = 'tagged'""")
def replace_tags(spark, d):
    articles = table(spark, d, "articles").select("id", "status", "group_id")
    group = F.when(F.col("id") % 13 == 0, (F.col("group_id") + 1) % 4).otherwise(F.col("group_id"))
    number = F.col("id") % 200 * 5 + F.col("group_id") + F.when(F.col("id") % 13 == 0, 1).otherwise(0)
    results = articles.select(
        F.col("id").alias("article_id"), group.alias("group_id"),
        F.array(F.struct(F.concat(F.lit("tag-"), number.cast("string")).alias("slug"), F.lit(0.5).alias("confidence"))).alias("tags"),
    )
    stored = table(spark, d, "article_tags").select("article_id", F.col("tag_id").cast("bigint").alias("tag_id"), (F.col("conf_pct") / 100).alias("confidence"), F.lit("old").alias("backend"), F.timestamp_seconds(F.lit(NOW)).alias("created_at"))
    fresh, _ = T.replace_tags(stored, results, articles, table(spark, d, "tags").select("id", "group_id", "slug"), backend="m1", at=F.timestamp_seconds(F.lit(NOW)))
    return fresh.select("article_id", "tag_id", "confidence", "backend")


CENTROIDS = """
WITH dims AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, range(1, 65) r(i) GROUP BY label, i),
raw AS (SELECT label, list(x ORDER BY i) AS v FROM dims GROUP BY label),
centroids AS (SELECT label, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-12)) AS centroid FROM raw)"""


def members(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))


@query("agg12_bst7_tag_centroids", CENTROIDS + "SELECT label, CAST(i - 1 AS INT) AS dim, round(centroid[i], 6) + 0.0 AS x FROM centroids, range(1, 65) r(i)")
def tag_centroids(spark, d):
    rows = T.tag_centroids(members(spark, d)).select("label", F.posexplode("centroid").alias("dim", "x"))
    return rows.select("label", "dim", (F.round("x", 6) + F.lit(0.0)).alias("x"))


SCORE = "list_inner_product(CAST(e.embedding AS DOUBLE[]), c.centroid)"


@query("top6_bst2_representatives", CENTROIDS + f"""
SELECT label, id, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM (SELECT e.label, e.vec_id AS id, {SCORE} AS score, row_number() OVER (PARTITION BY e.label ORDER BY {SCORE} DESC, vec_id) AS rank
FROM embeddings e JOIN centroids c ON c.label = e.label) x WHERE rank <= 3""")
def representatives(spark, d):
    rows = members(spark, d)
    return T.representatives(rows, T.tag_centroids(rows)).select("label", "id", "rank", F.round("score", 6).alias("score"))


@query("jn16_mth2_mdl4_top5_local_tags", CENTROIDS + f"""
, scored AS (SELECT e.vec_id AS article_id, 'tag-' || CAST(c.label AS STRING) AS slug, {SCORE} / greatest(sqrt(list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))), 1e-12) AS score FROM embeddings e CROSS JOIN centroids c)
SELECT article_id, slug, CAST(rank AS INT) AS rank, round(least(greatest(score, 0), 1), 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY score DESC, slug DESC) AS rank FROM scored WHERE score >= 0.1) x WHERE rank <= 3""")
def local_tags(spark, d):
    rows = members(spark, d)
    tags = T.tag_centroids(rows).select(F.concat(F.lit("tag-"), F.col("label").cast("string")).alias("slug"), F.lit(0.1).alias("threshold"), "centroid")
    tagged = T.local_tags(rows.select(F.col("id").alias("article_id"), "vector"), tags, k=3)
    return tagged.select("article_id", "slug", "rank", F.round("confidence", 6).alias("confidence"))


@query("mth1_l2_normalize", """
SELECT vec_id, CAST(i - 1 AS INT) AS dim, round(CAST(embedding[i] AS DOUBLE) * (vec_id % 7) / greatest(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * (vec_id % 7), 1e-12), 6) + 0.0 AS x FROM embeddings, range(1, 65) r(i)""")
def normalize(spark, d):
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 7))
    rows = read(spark, d, "embeddings").select("vec_id", F.posexplode(l2_normalize(scaled)).alias("dim", "x"))
    return rows.select("vec_id", "dim", (F.round("x", 6) + F.lit(0.0)).alias("x"))


@query("mdl2_tag_prompts", cte("articles") + """
SELECT id AS article_id, group_id, md5('Title: ' || title || chr(10) || chr(10) ||
  CASE WHEN length(content_text) <= 500 THEN content_text ELSE substr(content_text, 1, 300) || right(content_text, 200) END) AS prompt_md5 FROM articles""")
def tag_prompts(spark, d):
    prompts = T.tag_prompts(table(spark, d, "articles"), max_chars=500)
    return prompts.select("article_id", "group_id", F.md5("user").alias("prompt_md5"))


@query("mdl2_label_lines", cte("tags") + "SELECT group_id, id, '* ' || slug || ' (' || name || '): ' || description AS line FROM tags")
def label_lines(spark, d):
    return T.label_lines(table(spark, d, "tags"))


@query("mdl5_summary_candidates", cte("articles") + """
SELECT id, CASE WHEN length(content_text) <= 2000 THEN content_text ELSE substr(content_text, 1, 1200) || right(content_text, 800) END AS input FROM articles WHERE summary_backend IS NULL AND status = 'EXTRACTED'""")
def summary_candidates(spark, d):
    return T.summary_candidates(table(spark, d, "articles"), enabled=True).select("id", head_tail(F.col("content_text"), 2000).alias("input"))


@query("mdl6_http_error_class", """
SELECT event_id, CASE WHEN status = 429 AND (event_id % 100 >= 60 OR event_type = 'click') THEN 'quota' WHEN status IN (408, 429) OR status >= 500 THEN 'transient' ELSE 'fatal' END AS error_class
FROM (SELECT *, CASE user_id % 6 WHEN 0 THEN 429 WHEN 1 THEN 408 WHEN 2 THEN 503 WHEN 3 THEN 404 WHEN 4 THEN 302 ELSE 401 END AS status FROM events) x""")
def http_errors(spark, d):
    status = F.expr("CASE user_id % 6 WHEN 0 THEN 429 WHEN 1 THEN 408 WHEN 2 THEN 503 WHEN 3 THEN 404 WHEN 4 THEN 302 ELSE 401 END")
    detail = F.when(F.col("event_type") == "click", F.lit("Billing hard limit")).otherwise(F.col("event_type"))
    rows = read(spark, d, "events")
    return rows.select("event_id", http_error_class(status, detail, F.col("event_id") % 100).alias("error_class"))
