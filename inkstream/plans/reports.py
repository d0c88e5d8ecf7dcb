"""Selections, joins, aggregates and rankings over the content tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import to_iso
from ..operators import filters as S
from ..operators import reports as R
from ..operators.sinks import append_audit
from ..session import new_shared_path
from .bridge import NOW, cte, read, table
from .catalogue import query
from .dialect import DUCK

AT = DUCK.ts(str(NOW))
ISO = "'%Y-%m-%dT%H:%M:%S+00:00'"


def now():
    return F.timestamp_seconds(F.lit(NOW))


def iso(column: str) -> str:
    return f"strftime({column}, {ISO})"


@query("flt1_due_sites", cte("sites") + f"""
SELECT id, slug FROM sites WHERE enabled AND (last_crawled_at IS NULL OR last_crawled_at + to_seconds(crawl_interval_sec) <= {AT})""")
def due_sites(spark, d):
    return S.due_sites(table(spark, d, "sites"), now()).select("id", "slug")


@query("flt2_retryable_articles", cte("articles") + f"""
SELECT site_id, id, attempts, status FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY attempts, id) AS rk FROM articles
  WHERE status IN ('DISCOVERED', 'FETCHED') OR (status = 'FAILED' AND next_attempt_at <= {AT})) x WHERE rk <= 100""")
def retryable(spark, d):
    return S.retryable_articles(table(spark, d, "articles"), now()).select("site_id", "id", "attempts", "status")


@query("flt3_crawl_skip", cte("articles") + f"""
SELECT id, status IN ('EXTRACTED', 'TAGGED', 'NOTIFIED', 'SKIPPED') OR (status = 'FAILED' AND (next_attempt_at IS NULL OR next_attempt_at > {AT})) AS unchanged
FROM articles""")
def crawl_skip(spark, d):
    return table(spark, d, "articles").select("id", S.unchanged(now()).alias("unchanged"))


@query("flt4_due_deliveries", cte("deliveries") + f"""
SELECT id, subscription_id, target_id, {iso('next_attempt_at')} AS next_attempt_at FROM deliveries
WHERE status = 'pending' AND (next_attempt_at IS NULL OR next_attempt_at <= {AT}) AND (claim_until IS NULL OR claim_until <= {AT})
ORDER BY deliveries.next_attempt_at NULLS FIRST, id LIMIT 100""")
def due_deliveries(spark, d):
    return S.due_deliveries(table(spark, d, "deliveries"), now()).select(
        "id", "subscription_id", "target_id", to_iso(F.col("next_attempt_at")).alias("next_attempt_at")
    )


@query("flt5_site_filter", cte("subscriptions", "sites") + """
SELECT s.id AS subscription_id, t.id AS site_id FROM subscriptions s JOIN sites t ON
  CASE WHEN site_filter IS NULL OR site_filter = '' THEN true WHEN NOT json_valid(site_filter) THEN false
    WHEN json_type(site_filter) <> 'ARRAY' THEN false ELSE list_contains(CAST(CAST(site_filter AS JSON) AS BIGINT[]), t.id) END""")
def site_filter(spark, d):
    from ..operators.matching import allowed_pairs, site_rule

    rules = table(spark, d, "subscriptions").select(F.col("id").alias("subscription_id"), site_rule(F.col("site_filter")).alias("rule"))
    pairs = allowed_pairs(rules, table(spark, d, "sites").select(F.col("id").alias("site_id")))
    return pairs.select("subscription_id", F.col("site_id").cast("int").alias("site_id"))


TITLE_PATTERNS, TEXT_PATTERNS = ["^the\\b", "lorem"], ["license", "token\\s*="]


@query("flt6_flt7_content_verdict", cte("articles") + """
SELECT id, CASE WHEN regexp_matches(title, '^the\\b', 'i') OR regexp_matches(title, 'lorem', 'i')
   OR regexp_matches(content_text, 'license', 'i') OR regexp_matches(content_text, 'token\\s*=', 'i') THEN 'rejected'
  WHEN length(content_text) < 200 AND id % 3 <> 0 THEN 'too_short' ELSE 'accepted' END AS verdict FROM articles""")
def content_verdict(spark, d):
    n_attachments = F.when(F.col("id") % 3 == 0, 1).otherwise(0)
    verdict = S.content_verdict(
        F.col("title"), F.col("content_text"), n_attachments,
        title_patterns=TITLE_PATTERNS, text_patterns=TEXT_PATTERNS, min_length=200,
    )
    return table(spark, d, "articles").select("id", verdict.alias("verdict"))


@query("agg9_crawl_statistics", cte("articles") + """
, judged AS (SELECT site_id, CASE WHEN status IN ('EXTRACTED','TAGGED','NOTIFIED') THEN 'extracted' WHEN status = 'SKIPPED' AND id % 2 = 0 THEN 'duplicate'
   WHEN status = 'SKIPPED' THEN 'skipped' WHEN status = 'FAILED' THEN 'failed' ELSE 'unchanged' END AS outcome FROM articles)
SELECT site_id, count(*) AS n_discovered, count(*) FILTER (outcome = 'extracted') AS n_extracted, count(*) FILTER (outcome = 'duplicate') AS n_duplicate,
  count(*) FILTER (outcome = 'unchanged') AS n_unchanged, count(*) FILTER (outcome = 'skipped') AS n_skipped, count(*) FILTER (outcome = 'failed') AS n_failed
FROM judged GROUP BY site_id""")
def crawl_statistics(spark, d):
    status = F.col("status")
    outcome = (
        F.when(status.isin("EXTRACTED", "TAGGED", "NOTIFIED"), "extracted")
        .when((status == "SKIPPED") & (F.col("id") % 2 == 0), "duplicate")
        .when(status == "SKIPPED", "skipped").when(status == "FAILED", "failed").otherwise("unchanged")
    )
    return R.crawl_statistics(table(spark, d, "articles").select("site_id", outcome.alias("outcome")))


@query("agg10_attachment_statistics", cte("attachments") + """
SELECT count(*) FILTER (status = 'downloaded' AND id % 2 = 0) AS n_downloaded, count(*) FILTER (status = 'downloaded' AND id % 2 <> 0) AS n_reused,
  count(*) FILTER (status = 'pending') AS n_skipped, count(*) FILTER (status = 'failed') AS n_failed FROM attachments""")
def attachment_statistics(spark, d):
    status = F.col("status")
    outcome = F.when((status == "downloaded") & (F.col("id") % 2 != 0), "reused").when(status == "pending", "skipped").otherwise(status)
    return R.attachment_statistics(table(spark, d, "attachments").select(outcome.alias("outcome")))


ARTICLE_COLUMNS = f"a.id, a.title, a.status, s.name AS site, {iso('a.published_at')} AS published_at"


def article_columns(df):
    return df.select("id", "title", "status", "site", to_iso(F.col("published_at")).alias("published_at"))


@query("flt8_article_search_admin", cte("articles", "sites", "article_tags") + f"""
SELECT {ARTICLE_COLUMNS} FROM articles a JOIN sites s ON s.id = a.site_id
WHERE a.published_at >= TIMESTAMP '2024-01-10 00:00:00' AND EXISTS (SELECT 1 FROM article_tags x WHERE x.article_id = a.id AND x.tag_id IN (5, 9, 13))
ORDER BY a.published_at DESC NULLS LAST, a.id DESC LIMIT 200""")
def search_admin(spark, d):
    wanted = spark.createDataFrame([(5,), (9,), (13,)], "tag_id int")
    return article_columns(S.search_articles(
        table(spark, d, "articles"), table(spark, d, "sites"), article_tags=table(spark, d, "article_tags"),
        tag_ids=wanted, since=F.lit("2024-01-10 00:00:00").cast("timestamp"),
    ))


@query("flt8_top2_article_search_user", cte("articles", "sites", "deliveries", "subscriptions") + f"""
SELECT {ARTICLE_COLUMNS} FROM articles a JOIN sites s ON s.id = a.site_id
WHERE s.slug <> '' AND EXISTS (SELECT 1 FROM deliveries v JOIN subscriptions u ON u.id = v.subscription_id WHERE v.article_id = a.id AND u.user_id = 7 AND v.status = 'sent')
ORDER BY a.published_at DESC NULLS LAST, a.id DESC LIMIT 200""")
def search_user(spark, d):
    return article_columns(S.search_articles(
        table(spark, d, "articles"), table(spark, d, "sites"), user_id=7,
        deliveries=table(spark, d, "deliveries"), subscriptions=table(spark, d, "subscriptions"),
    ))


@query("jn6_articles_with_tag", cte("articles", "article_tags") + """
SELECT id FROM articles a WHERE EXISTS (SELECT 1 FROM article_tags x WHERE x.article_id = a.id AND x.tag_id = 6)""")
def with_tag(spark, d):
    tagged = table(spark, d, "article_tags").where("tag_id = 6").select(F.col("article_id").alias("id"))
    return table(spark, d, "articles").select("id").join(tagged, "id", "left_semi")


@query("flt9_mime_allowed", cte("attachments") + """
SELECT id, source_url, lower(mime_type) LIKE 'image/%' OR lower(mime_type) = 'application/pdf' AS allowed FROM attachments""")
def mime_allowed(spark, d):
    return table(spark, d, "attachments").select("id", "source_url", S.mime_allowed(F.col("mime_type"), ["image/*", "Application/PDF"]).alias("allowed"))


@query("flt10_pending_attachments", cte("attachments", "articles", "sites") + """
SELECT t.id, t.source_url, a.url AS article_url, s.slug AS site_slug FROM attachments t JOIN articles a ON a.id = t.article_id JOIN sites s ON s.id = a.site_id
WHERE t.status IN ('pending', 'failed') AND t.attempts < 3 ORDER BY t.id, t.source_url LIMIT 20""")
def pending_attachments(spark, d):
    found = S.pending_attachments(table(spark, d, "attachments"), table(spark, d, "articles"), table(spark, d, "sites"), max_attempts=3)
    return found.select("id", "source_url", "article_url", "site_slug")


SESSIONS = """
sessions AS (SELECT o_orderkey AS id, o_custkey AS user_id, sha256(CAST(o_orderkey AS STRING)) AS token_hash, o_orderdate + INTERVAL 900 DAY AS expires_at,
  CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate END AS revoked_at FROM orders)"""
SESSION_NOW = "TIMESTAMP '2000-06-01 00:00:00'"


def sessions(spark, d):
    orders = read(spark, d, "orders")
    dated = F.col("o_orderdate").cast("timestamp")
    return orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("token_hash"),
        F.timestamp_seconds(F.unix_timestamp(dated) + 900 * 86400).alias("expires_at"), F.when(F.col("o_orderkey") % 5 == 0, dated).alias("revoked_at"),
    )


@query("flt11_live_sessions", cte("users", extra=SESSIONS.strip()) + f"""
SELECT s.id, s.token_hash, u.username, u.role FROM sessions s JOIN users u ON u.id = s.user_id
WHERE s.revoked_at IS NULL AND s.expires_at > {SESSION_NOW} AND u.is_active""")
def live_sessions(spark, d):
    at = F.lit("2000-06-01 00:00:00").cast("timestamp")
    return S.live_sessions(sessions(spark, d), table(spark, d, "users"), at).select("id", "token_hash", "username", "role")


@query("flt22_user_sessions", cte("users", extra=SESSIONS.strip()) + f"""
SELECT id, {iso('expires_at')} AS expires_at FROM sessions WHERE user_id = 17 AND revoked_at IS NULL AND expires_at > {SESSION_NOW}""")
def user_sessions(spark, d):
    at = F.lit("2000-06-01 00:00:00").cast("timestamp")
    own = sessions(spark, d).where(F.col("user_id") == 17)
    return own.where(F.col("revoked_at").isNull() & (F.col("expires_at") > at)).orderBy(F.col("expires_at").desc()).select("id", to_iso(F.col("expires_at")).alias("expires_at"))


@query("flt12_agg18_unknown_ids", """
SELECT DISTINCT l_partkey % 3000 AS id FROM lineitem WHERE l_partkey % 3000 NOT IN (SELECT p_partkey FROM part)
UNION SELECT DISTINCT l_partkey + 1500 FROM lineitem WHERE l_partkey + 1500 NOT IN (SELECT p_partkey FROM part)""")
def unknown_ids(spark, d):
    lines = read(spark, d, "lineitem")
    asked = lines.select((F.col("l_partkey") % 3000).alias("id")).union(lines.select((F.col("l_partkey") + 1500).alias("id")))
    return S.unknown_ids(asked, read(spark, d, "part").select(F.col("p_partkey").alias("id")), "id")


@query("flt13_single_group", cte("subscription_tags") + """
SELECT subscription_id, count(DISTINCT (tag_id % CASE WHEN subscription_id % 5 = 0 THEN 8 ELSE 4 END)) = 1 AS single_group
FROM subscription_tags GROUP BY subscription_id""")
def single_group(spark, d):
    width = F.when(F.col("subscription_id") % 5 == 0, 8).otherwise(4)
    picked = table(spark, d, "subscription_tags").select("subscription_id", (F.col("tag_id") % width).alias("group_id"))
    return S.single_group(picked)


@query("flt14_current_tags", cte("tags", "tagset_groups") + """
SELECT t.id, t.slug, t.group_id FROM tags t JOIN tagset_groups g ON g.id = t.group_id AND g.tagset_version = t.tagset_version WHERE g.status = 'frozen'""")
def current_tags(spark, d):
    return S.current_tags(table(spark, d, "tags"), table(spark, d, "tagset_groups")).select("id", "slug", "group_id")


@query("flt16_same_site_links", """
SELECT page_id, link, coalesce(regexp_matches(link, '^https?://', 'i') AND lower(regexp_extract(link, '^https?://([^/:?#]+)', 1, 'i')) = lower(regexp_extract(url, '^https?://([^/:?#]+)', 1, 'i')), false) AS same_site
FROM (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^" ]+)"', 1)) AS href FROM pages) x,
 LATERAL (SELECT CASE WHEN page_id % 4 = 0 THEN 'https://elsewhere.example.org' || href ELSE regexp_extract(url, '^https?://[^/]+') || href END AS link) y""")
def same_site_links(spark, d):
    hrefs = read(spark, d, "pages").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('href="([^" ]+)"'), F.lit(1))).alias("href"))
    origin = F.when(F.col("page_id") % 4 == 0, F.lit("https://elsewhere.example.org")).otherwise(F.regexp_extract("url", "^https?://[^/]+", 0))
    links = hrefs.withColumn("link", F.concat(origin, "href"))
    return links.select("page_id", "link", S.same_site(F.col("link"), F.col("url")).alias("same_site"))


@query("flt18_target_urls", """
SELECT s_suppkey, length(u) BETWEEN 4 AND 4096 AND NOT regexp_matches(u, '\\s') AND lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) IN
  ('dingtalk','discord','feishu','gchat','guilded','line','msteams','opsgenie','pagerduty','pbul','pover','slack','tgram','wecombot','whatsapp','wxteams') AS allowed
FROM (SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'tgram://a/' WHEN 1 THEN 'https://x/' WHEN 2 THEN 'Slack://b/' WHEN 3 THEN 'discord://c d/' WHEN 4 THEN 'json://e/' ELSE 'LINE://f/' END || s_name AS u FROM supplier) x""")
def target_urls(spark, d):
    prefix = F.expr("CASE s_suppkey % 6 WHEN 0 THEN 'tgram://a/' WHEN 1 THEN 'https://x/' WHEN 2 THEN 'Slack://b/' WHEN 3 THEN 'discord://c d/' WHEN 4 THEN 'json://e/' ELSE 'LINE://f/' END")
    return read(spark, d, "supplier").select("s_suppkey", S.target_url_allowed(F.concat(prefix, "s_name")).alias("allowed"))


@query("flt21_content_length", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE l_suppkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN l_quantity * 1000 <= 30000 ELSE false END AS allowed FROM lineitem""")
def content_length(spark, d):
    declared = F.expr("CASE l_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'many' WHEN 2 THEN CAST(CAST(l_quantity * 1000 AS BIGINT) AS STRING) ELSE '-1' END")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", S.content_length_allowed(declared, 30000).alias("allowed"))


@query("jn2_group_scoped_tags", cte("article_tags", "tags", "articles", "sites") + """
SELECT x.article_id, x.tag_id FROM article_tags x JOIN articles a ON a.id = x.article_id JOIN tags t ON t.id = x.tag_id JOIN sites s ON s.id = a.site_id AND s.tagset_group_id = t.group_id""")
def group_scoped_tags(spark, d):
    from ..operators.matching import group_tags_only

    names = ("article_tags", "tags", "articles", "sites")
    return group_tags_only(*[table(spark, d, n) for n in names]).select("article_id", "tag_id")


@query("jn1_article_site_group", cte("articles", "sites", "tagset_groups") + """
SELECT a.id, s.slug AS site, g.slug AS tagset_group FROM articles a JOIN sites s ON s.id = a.site_id JOIN tagset_groups g ON g.id = s.tagset_group_id WHERE a.status = 'EXTRACTED'""")
def article_site_group(spark, d):
    sites = table(spark, d, "sites").select(F.col("id").alias("site_id"), F.col("slug").alias("site"), "tagset_group_id")
    groups = table(spark, d, "tagset_groups").select(F.col("id").alias("tagset_group_id"), F.col("slug").alias("tagset_group"))
    return table(spark, d, "articles").where("status = 'EXTRACTED'").join(sites.join(groups, "tagset_group_id"), "site_id").select("id", "site", "tagset_group")


@query("jn3_delivery_details", cte("deliveries", "subscriptions", "articles", "sites", "notify_targets") + f"""
SELECT d.id, s.user_id, s.include_attachments, a.title, a.url, {iso('a.published_at')} AS published_at, si.name AS site_name, t.url_fingerprint, t.enabled AS target_enabled, t.consecutive_failures AS target_failures
FROM deliveries d JOIN subscriptions s ON s.id = d.subscription_id JOIN articles a ON a.id = d.article_id JOIN sites si ON si.id = a.site_id JOIN notify_targets t ON t.id = d.target_id""")
def delivery_details(spark, d):
    names = ("deliveries", "subscriptions", "articles", "sites", "notify_targets")
    return R.delivery_details(*[table(spark, d, n) for n in names]).select(
        "id", "user_id", "include_attachments", "title", "url", to_iso(F.col("published_at")).alias("published_at"),
        "site_name", "url_fingerprint", "target_enabled", "target_failures",
    )


@query("jn4_agg3_tags_per_group", cte("tagset_groups", "tags") + """
SELECT g.id, g.slug, count(t.id) AS tags FROM tagset_groups g LEFT JOIN tags t ON t.group_id = g.id AND t.tagset_version = g.tagset_version GROUP BY g.id, g.slug""")
def tags_per_group(spark, d):
    return R.tags_per_group(table(spark, d, "tagset_groups"), table(spark, d, "tags")).select("id", "slug", "tags")


@query("jn5_top3_newest_audit", cte("audit_log", "users") + f"""
SELECT a.id, a.user_id, u.username, a.action, a.detail, {iso('a.created_at')} AS created_at FROM audit_log a LEFT JOIN users u ON u.id = a.user_id ORDER BY a.id DESC LIMIT 500""")
def newest_audit(spark, d):
    return R.newest_audit(table(spark, d, "audit_log"), table(spark, d, "users")).select("id", "user_id", "username", "action", "detail", to_iso(F.col("created_at")).alias("created_at"))


CUTOFF = "TIMESTAMP '2001-01-01 00:00:00'"


def cutoff():
    return F.lit("2001-01-01 00:00:00").cast("timestamp")


@query("jn7_expired_attachments", cte("attachments", "deliveries") + f"""
SELECT a.id, a.local_path FROM attachments a WHERE a.local_path IS NOT NULL AND a.created_at < {CUTOFF}
  AND NOT EXISTS (SELECT 1 FROM deliveries v WHERE v.article_id = a.article_id AND v.status = 'pending')""")
def expired_attachments(spark, d):
    return R.expired_attachments(table(spark, d, "attachments"), table(spark, d, "deliveries"), cutoff()).select("id", "local_path")


@query("agg13_path_references", cte("attachments") + f"""
SELECT local_path, count(*) AS n_refs, count(*) FILTER (created_at < {CUTOFF}) AS n_expired, count(*) = count(*) FILTER (created_at < {CUTOFF}) AS removable
FROM attachments WHERE local_path IS NOT NULL GROUP BY local_path""")
def path_references(spark, d):
    return R.path_references(table(spark, d, "attachments"), F.col("created_at") < cutoff())


@query("jn12_slug_lookup", cte("article_tags", "tags") + """
SELECT 'tag-' || CAST(x.tag_id * 37 AS STRING) AS slug, count(*) AS n_uses, any_value(t.id) AS tag_id FROM article_tags x LEFT JOIN tags t ON t.slug = 'tag-' || CAST(x.tag_id * 37 AS STRING) GROUP BY 1""")
def slug_lookup(spark, d):
    used = table(spark, d, "article_tags").groupBy(F.concat(F.lit("tag-"), (F.col("tag_id") * 37).cast("string")).alias("slug")).agg(F.count(F.lit(1)).alias("n_uses"))
    return used.join(table(spark, d, "tags").select("slug", F.col("id").alias("tag_id")), "slug", "left")


STORED_PROVIDERS = """
stored AS (SELECT name, min(s_suppkey) AS position, max(setting) AS setting FROM (SELECT s_suppkey, s_name AS setting,
  CASE WHEN s_suppkey % 3 = 0 THEN 'NATION_' || CAST(s_nationkey AS STRING) ELSE s_name END AS name FROM supplier) x GROUP BY name),
configured AS (SELECT n_name AS name, n_nationkey AS position, 'configured' AS setting FROM nation)"""


def providers(spark, d):
    name = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string"))).otherwise(F.col("s_name"))
    stored = read(spark, d, "supplier").groupBy(name.alias("name")).agg(F.min("s_suppkey").alias("position"), F.max("s_name").alias("setting"))
    configured = read(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("bigint").alias("position"), F.lit("configured").alias("setting"))
    return configured, stored


@query("jn13_provider_override", "WITH" + STORED_PROVIDERS + """
SELECT coalesce(c.name, s.name) AS name, coalesce(s.setting, c.setting) AS setting, CASE WHEN c.name IS NOT NULL THEN 0 ELSE 1 END AS segment, coalesce(c.position, s.position) AS position
FROM configured c FULL JOIN stored s ON s.name = c.name""")
def provider_override(spark, d):
    return R.override_providers(*providers(spark, d))


@query("jn17_provider_list", cte("provider_calls", extra=STORED_PROVIDERS.strip()) + """,
health AS (SELECT replace(provider, 'provider-', 'NATION_') AS provider, count(*) AS total_calls, count(*) FILTER (outcome <> 'success') AS total_failures FROM provider_calls GROUP BY 1)
SELECT p.name, p.source, coalesce(h.total_calls, 0) AS total_calls, coalesce(h.total_failures, 0) AS total_failures FROM
 (SELECT name, 'configuration' AS source FROM configured WHERE name NOT IN (SELECT name FROM stored) UNION ALL SELECT name, 'web' FROM stored) p LEFT JOIN health h ON h.provider = p.name""")
def provider_list(spark, d):
    configured, stored = providers(spark, d)
    health = R.provider_totals(table(spark, d, "provider_calls")).withColumn("provider", F.replace(F.col("provider"), F.lit("provider-"), F.lit("NATION_")))
    return R.provider_list(configured, stored, health).select("name", "source", "total_calls", "total_failures")


@query("jn15_agg4_agg5_site_health", cte("sites", "articles") + """
SELECT s.id, s.slug, (SELECT count(*) FROM articles a WHERE a.site_id = s.id AND a.status = 'FAILED') AS article_failures,
  f.last_error AS article_last_error FROM sites s LEFT JOIN (SELECT site_id, max_by(last_error, id) AS last_error FROM articles WHERE status = 'FAILED' GROUP BY site_id) f ON f.site_id = s.id""")
def site_health(spark, d):
    return R.site_health(table(spark, d, "sites"), table(spark, d, "articles")).select("id", "slug", "article_failures", "article_last_error")


@query("jn18_alert_recipients", cte("notify_targets", "users") + """
SELECT n.id, n.url_fingerprint FROM notify_targets n JOIN users u ON u.id = n.user_id WHERE u.role = 'admin' AND u.is_active AND n.enabled""")
def alert_recipients(spark, d):
    return R.alert_recipients(table(spark, d, "notify_targets"), table(spark, d, "users")).select("id", "url_fingerprint")


@query("jn19_deleted_site_files", cte("attachments", "articles") + """
, owned AS (SELECT t.local_path, a.site_id FROM attachments t JOIN articles a ON a.id = t.article_id WHERE t.local_path IS NOT NULL)
SELECT DISTINCT local_path FROM owned WHERE site_id = 3 AND local_path NOT IN (SELECT local_path FROM owned WHERE site_id <> 3)""")
def deleted_site_files(spark, d):
    return R.deleted_site_files(table(spark, d, "attachments"), table(spark, d, "articles"), 3)


@query("agg1_article_status", cte("articles") + "SELECT status, count(*) AS n FROM articles GROUP BY status")
def article_status(spark, d):
    return R.histogram(table(spark, d, "articles"), "status")


@query("agg1_delivery_status", cte("deliveries") + "SELECT status, count(*) AS n FROM deliveries GROUP BY status")
def delivery_status(spark, d):
    return R.histogram(table(spark, d, "deliveries"), "status")


@query("agg2_attachment_bytes", cte("attachments") + """
SELECT CAST(coalesce(sum(size), 0) AS BIGINT) AS attachment_bytes FROM (SELECT max(size_bytes) AS size FROM attachments WHERE status = 'downloaded'
  GROUP BY CASE WHEN sha256 IS NULL THEN 'id:' || CAST(id AS STRING) ELSE sha256 END) x""")
def attachment_bytes(spark, d):
    return R.stored_bytes(table(spark, d, "attachments"))


_COUNTED = ("articles", "sites", "tags", "subscriptions", "deliveries", "attachments", "audit_log", "users")


@query("agg6_row_counts", cte(*_COUNTED) + " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in _COUNTED))
def row_counts(spark, d):
    return R.row_counts({n: table(spark, d, n) for n in _COUNTED})


HEALTH = """, health AS (SELECT provider, make_timestamp(epoch_us(max(called_at) FILTER (outcome = 'quota')) + 300000000) AS cooldown_until FROM provider_calls GROUP BY provider)"""


@query("agg7_all_providers_cooling", cte("provider_calls") + HEALTH + """
SELECT count(*) FILTER (cooldown_until > TIMESTAMP '2024-01-28 00:00:00') AS cooling, count(*) AS configured,
  count(*) > 0 AND count(*) FILTER (cooldown_until > TIMESTAMP '2024-01-28 00:00:00') = count(*) AS all_down FROM health""")
def all_cooling(spark, d):
    calls = table(spark, d, "provider_calls")
    health = calls.groupBy("provider").agg(F.max(F.when(F.col("outcome") == "quota", F.col("called_at"))).alias("quota_at"))
    health = health.withColumn("cooldown_until", F.timestamp_micros(F.unix_micros("quota_at") + 300_000_000))
    return R.all_cooling(health, health.select("provider"), F.lit("2024-01-28 00:00:00").cast("timestamp"))


@query("agg8_provider_success_rate", cte("provider_calls") + """
SELECT provider, count(*) AS total_calls, count(*) FILTER (outcome <> 'success') AS total_failures,
  round_even((count(*) - count(*) FILTER (outcome <> 'success')) / count(*), 4) AS success_rate FROM provider_calls GROUP BY provider""")
def provider_success(spark, d):
    return R.provider_totals(table(spark, d, "provider_calls"))


@query("agg17_active_admins", cte("users") + "SELECT count(*) FILTER (role = 'admin' AND is_active) AS active_admins, count(*) > 0 AS has_users FROM users")
def active_admins(spark, d):
    return R.active_admins(table(spark, d, "users"))


@query("ded4_top1_dashboard", cte("articles", "sites", "deliveries", "subscriptions") + f"""
SELECT id, title, {iso('moment')} AS published_at, site FROM (SELECT DISTINCT a.id, a.title, a.published_at AS moment, si.name AS site FROM articles a JOIN sites si ON si.id = a.site_id JOIN deliveries d ON d.article_id = a.id
JOIN subscriptions s ON s.id = d.subscription_id WHERE s.user_id = 42 AND d.status = 'sent') x ORDER BY moment DESC NULLS LAST, id DESC LIMIT 10""")
def dashboard(spark, d):
    names = ("articles", "sites", "deliveries", "subscriptions")
    seen = R.recent_articles(*[table(spark, d, n) for n in names], user_id=42)
    return seen.select("id", "title", to_iso(F.col("published_at")).alias("published_at"), "site")


@query("prj2_visible_articles", cte("articles", "sites", "deliveries", "subscriptions") + """
SELECT DISTINCT a.id, a.content_text, si.name AS site FROM articles a JOIN sites si ON si.id = a.site_id JOIN deliveries d ON d.article_id = a.id
JOIN subscriptions s ON s.id = d.subscription_id WHERE s.user_id = 11 AND d.status = 'sent'""")
def visible(spark, d):
    names = ("articles", "sites", "deliveries", "subscriptions")
    return S.visible_articles(*[table(spark, d, n) for n in names], user_id=11).select("id", "content_text", "site")


@query("prj1_user_list", cte("users") + "SELECT id, username, role, totp_secret IS NOT NULL AS totp_enabled FROM users")
def user_list(spark, d):
    return table(spark, d, "users").select("id", "username", "role", F.col("totp_secret").isNotNull().alias("totp_enabled"))


@query("prj3_findings_to_review", """
SELECT * FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 2 THEN 'failed' ELSE 'medium' END AS confidence FROM pages) f
WHERE confidence IN ('low', 'failed')""")
def findings(spark, d):
    level = F.expr("CASE page_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 2 THEN 'failed' ELSE 'medium' END")
    return read(spark, d, "pages").select("page_id", level.alias("confidence")).where(F.col("confidence").isin("low", "failed"))


@query("snk10_audit_append", cte("audit_log") + """
SELECT id, user_id, action, CASE WHEN id % 3 = 0 THEN 'Cookie: ***' WHEN id % 3 = 1 THEN 'https://h.example/p?token=***&x=' || CAST(id AS STRING) ELSE detail END AS detail FROM audit_log""")
def audit_append(spark, d):
    """Two appends to one audit table, whose details hold secrets; what was written is read back."""
    path = new_shared_path(spark, "audit")
    k, number = F.col("id") % 3, F.col("id").cast("string")
    detail = F.when(k == 0, F.concat(F.lit("Cookie: sid="), number)).when(k == 1, F.concat(F.lit("https://h.example/p?token="), number, F.lit("&x="), number)).otherwise(F.col("detail"))
    entries = table(spark, d, "audit_log").select("id", "user_id", "action", detail.alias("detail"), "created_at")
    for part in (0, 1):
        append_audit(entries.where(F.pmod("id", F.lit(2)) == part), path)
    return spark.read.parquet(path).select("id", "user_id", "action", "detail")


@query("top7_ordered_tags", cte("article_tags", "tags") + """
SELECT article_id, string_agg(t.name || ':' || CAST(x.conf_pct AS STRING), '|' ORDER BY x.conf_pct DESC, t.id) AS tags FROM article_tags x JOIN tags t ON t.id = x.tag_id GROUP BY article_id""")
def ordered_tags(spark, d):
    tags = table(spark, d, "article_tags").withColumnRenamed("conf_pct", "confidence")
    listed = R.ordered_tags(tags, table(spark, d, "tags"))
    shown = F.transform("tags", lambda t: F.concat(t["name"], F.lit(":"), t["confidence"].cast("string")))
    return listed.select("article_id", F.array_join(shown, "|").alias("tags"))


@query("top8_articles_of_tag", cte("article_tags") + """
SELECT tag_id, article_id, conf_pct FROM (SELECT *, row_number() OVER (PARTITION BY tag_id ORDER BY conf_pct DESC, article_id) AS rk FROM article_tags) x WHERE rk <= 20""")
def articles_of_tag(spark, d):
    from ..operators.tagging import top_articles_per_tag

    return top_articles_per_tag(table(spark, d, "article_tags"), "conf_pct").select("tag_id", "article_id", "conf_pct")


@query("top11_tag_batch", cte("articles", "sites") + """
SELECT group_id, id FROM (SELECT a.group_id, a.id, row_number() OVER (PARTITION BY a.group_id ORDER BY a.id) AS rk FROM articles a WHERE a.status = 'EXTRACTED') x WHERE rk <= 40""")
def tag_batch(spark, d):
    return R.per_group_batch(table(spark, d, "articles").where("status = 'EXTRACTED'"), "group_id", limit=40).select("group_id", "id")


@query("ded11_tagset_differences", """
WITH file AS (SELECT 'tag-' || CAST(p_partkey AS STRING) AS slug, p_name AS name, p_size AS size FROM part WHERE p_size > 2),
db AS (SELECT 'tag-' || CAST(p_partkey AS STRING) AS slug, CASE WHEN p_partkey % 19 = 0 THEN 'renamed' ELSE p_name END AS name, p_size AS size FROM part WHERE p_size < 48)
SELECT coalesce(f.slug, s.slug) AS slug, f.slug IS NOT NULL AS in_file, s.slug IS NOT NULL AS in_db FROM file f FULL JOIN db s ON s.slug = f.slug
WHERE f.slug IS NULL OR s.slug IS NULL OR f.name IS DISTINCT FROM s.name OR f.size IS DISTINCT FROM s.size""")
def tagset_differences(spark, d):
    part = read(spark, d, "part").select("p_partkey", F.concat(F.lit("tag-"), F.col("p_partkey").cast("string")).alias("slug"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    file = part.where("size > 2")
    db = part.where("size < 48").withColumn("name", F.when(F.col("p_partkey") % 19 == 0, F.lit("renamed")).otherwise(F.col("name")))
    return R.tagset_differences(file, db, "slug", ["name", "size"])
