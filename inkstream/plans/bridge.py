"""Content tables expressed over the supplied tables.

Every bridge is a projection with the same arithmetic in both engines; `cte` renders it as a WITH
clause for the check, `table` as a DataFrame for Spark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import spread
from .dialect import DUCK, SPARK

# Fixed evaluation time of all "now"-dependent queries: 2024-01-15 00:00:00 UTC.
NOW = 1705276800
EPOCH = 1704067200


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_spread(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Selected columns for a stage that is heavy per row."""
    return spread(read(spark, sf_dir, name).select(*columns))


def _articles(d) -> str:
    return f"""
SELECT doc_id AS id,
  CAST(substr(source, 4) AS INT) AS site_id,
  CAST(substr(source, 4) AS INT) % 4 AS group_id,
  concat('https://', source, '.example.com/a/', CAST(doc_id AS STRING)) AS url,
  substr(text, 1, 60) AS title,
  CASE WHEN doc_id % 3 = 0 THEN substr(text, 1, 100) END AS summary,
  CASE WHEN doc_id % 6 = 0 THEN 'p1:m1' END AS summary_backend,
  text AS content_text, lang,
  CASE doc_id % 7 WHEN 0 THEN 'DISCOVERED' WHEN 1 THEN 'FETCHED' WHEN 2 THEN 'EXTRACTED' WHEN 3 THEN 'TAGGED'
    WHEN 4 THEN 'NOTIFIED' WHEN 5 THEN 'FAILED' ELSE 'SKIPPED' END AS status,
  CAST(doc_id % 5 AS INT) AS attempts,
  CASE WHEN doc_id % 3 = 0 THEN NULL ELSE {d.ts(f"{EPOCH} + (doc_id * 7919) % 2592000")} END AS next_attempt_at,
  CASE WHEN doc_id % 11 = 0 THEN NULL ELSE {d.ts(f"{EPOCH} + (doc_id % 30) * 86400")} END AS published_at,
  {d.ts(f"{EPOCH} + (doc_id % 28) * 86400 + 3600")} AS discovered_at,
  CASE WHEN doc_id % 7 = 5 THEN concat('HttpStatusError: status ', CAST(400 + doc_id % 100 AS STRING)) END AS last_error
FROM documents"""


def _sites(d) -> str:
    return f"""
SELECT CAST(substr(source, 4) AS INT) AS id, source AS slug, concat('Site ', source) AS name,
  CAST(substr(source, 4) AS INT) % 4 AS tagset_group_id,
  CAST(substr(source, 4) AS INT) % 5 <> 4 AS enabled,
  1800 + CAST(substr(source, 4) AS INT) * 60 AS crawl_interval_sec,
  CASE WHEN CAST(substr(source, 4) AS INT) % 6 = 0 THEN NULL
    ELSE {d.ts(f"{NOW} - (CAST(substr(source, 4) AS INT) * 337) % 4000")} END AS last_crawled_at
FROM (SELECT DISTINCT source FROM documents) s"""


def _article_tags(d) -> str:
    if d is SPARK:
        source = "(SELECT doc_id, source, explode(sequence(0, 9)) AS k FROM documents) x"
    else:
        source = "(SELECT doc_id, source, k FROM documents CROSS JOIN range(10) r(k)) x"
    return f"""
SELECT doc_id AS article_id, CAST(substr(source, 4) AS INT) % 4 + 4 * CAST(k AS INT) AS tag_id,
  CAST((doc_id * 31 + (CAST(substr(source, 4) AS INT) % 4 + 4 * CAST(k AS INT)) * 17) % 100 AS INT) AS conf_pct
FROM {source}
WHERE (doc_id * 31 + (CAST(substr(source, 4) AS INT) % 4 + 4 * CAST(k AS INT)) * 17) % 100 >= 60"""


def _subscriptions(d) -> str:
    return """
SELECT c_custkey AS id, c_custkey AS user_id, c_name AS name,
  CASE WHEN c_custkey % 3 > 0 THEN 'any' ELSE 'all' END AS match_mode,
  CAST(60 + 10 * (c_custkey % 3) AS INT) AS min_pct,
  CASE WHEN c_nationkey = 7 THEN '[]' WHEN c_nationkey = 11 THEN '{"a":1}' WHEN c_nationkey = 13 THEN 'oops'
    WHEN c_nationkey = 17 THEN '' WHEN c_nationkey % 5 = 0 THEN NULL
    ELSE concat('[', CAST(c_nationkey % 20 AS STRING), ', ', CAST((c_nationkey + 3) % 20 AS STRING), ']') END AS site_filter,
  CASE c_custkey % 4 WHEN 0 THEN '23:00-07:00' WHEN 1 THEN '00:00-06:30' WHEN 2 THEN '09:00-09:00' END AS quiet_hours,
  c_custkey % 10 <> 3 AS enabled,
  c_custkey % 2 = 0 AS include_attachments
FROM customer"""


def _subscription_tags(d) -> str:
    if d is SPARK:
        source = "(SELECT c_custkey, explode(sequence(0, 9)) AS k FROM customer) x"
    else:
        source = "(SELECT c_custkey, k FROM customer CROSS JOIN range(10) r(k)) x"
    return f"""
SELECT c_custkey AS subscription_id, c_custkey % 4 + 4 * k AS tag_id
FROM {source} WHERE (c_custkey + k) % 3 = 0"""


def _targets(d) -> str:
    if d is SPARK:
        source = "(SELECT c_custkey, explode(sequence(0, 1)) AS k FROM customer) x"
    else:
        source = "(SELECT c_custkey, k FROM customer CROSS JOIN range(2) r(k)) x"
    return f"""
SELECT c_custkey * 2 + k AS id, c_custkey AS user_id, (c_custkey * 2 + k) % 5 <> 0 AS enabled,
  CAST((c_custkey + k) % 12 AS INT) AS consecutive_failures,
  CASE (c_custkey + k) % 5 WHEN 0 THEN 'tgram://a1b2' WHEN 1 THEN 'discord://c3d4' WHEN 2 THEN 'slack://e5f6'
    WHEN 3 THEN 'feishu://a7b8' ELSE 'line://c9d0' END AS url_fingerprint
FROM {source}"""


def _subscription_targets(d) -> str:
    return "SELECT c_custkey AS subscription_id, c_custkey * 2 AS target_id FROM customer WHERE c_nationkey < 9"


def _deliveries(d) -> str:
    at = d.instant("ts")
    if d is SPARK:
        later = f"timestamp_micros(unix_micros({at}) + ((event_id % 13) - 6) * 3600000000)"
        lease = f"timestamp_micros(unix_micros({at}) + 3600000000)"
    else:
        later = "make_timestamp(epoch_us(ts) + ((event_id % 13) - 6) * 3600000000)"
        lease = "make_timestamp(epoch_us(ts) + 3600000000)"
    return f"""
SELECT event_id AS id, user_id AS subscription_id, event_id % 997 AS article_id, user_id * 2 + event_id % 2 AS target_id,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'sent' WHEN 'view' THEN 'skipped' ELSE 'pending' END AS status,
  CAST(event_id % 5 AS INT) AS attempts,
  CASE WHEN event_id % 9 = 0 THEN NULL ELSE {later} END AS next_attempt_at,
  CASE WHEN event_type = 'view' THEN concat('duplicate_of:', CAST((event_id * 7) % 997 AS STRING))
    WHEN event_type = 'error' THEN 'NotifyTransient: not confirmed' END AS last_error,
  {at} AS created_at,
  CASE WHEN event_type = 'purchase' THEN {at} END AS sent_at,
  CASE WHEN event_id % 4 = 0 THEN concat('lease-', CAST(user_id AS STRING)) END AS claim_token,
  CASE WHEN event_id % 4 = 0 THEN {lease} END AS claim_until
FROM events"""


def _attachments(d) -> str:
    return f"""
SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey AS article_id,
  concat('https://files.example.com/', CAST(l_partkey AS STRING), CASE WHEN l_suppkey % 3 = 0 THEN '.pdf' ELSE '.docx' END) AS source_url,
  concat('file-', CAST(l_partkey AS STRING)) AS filename,
  CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE concat('h', CAST(l_partkey AS STRING)) END AS sha256,
  CAST(l_quantity * 1024 AS BIGINT) AS size_bytes,
  CASE l_returnflag WHEN 'A' THEN 'downloaded' WHEN 'N' THEN 'pending' ELSE 'failed' END AS status,
  CASE WHEN l_returnflag = 'A' THEN concat('blobs/', CAST(l_partkey AS STRING)) END AS local_path,
  CAST(l_linenumber % 4 AS INT) AS attempts,
  CASE WHEN l_suppkey % 3 = 0 THEN 'application/pdf' WHEN l_suppkey % 3 = 1 THEN 'image/png' ELSE 'application/zip' END AS mime_type,
  {d.instant("l_shipdate")} AS created_at
FROM lineitem"""


def _audit_log(d) -> str:
    return f"""
SELECT o_orderkey AS id, CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE o_custkey END AS user_id,
  o_orderpriority AS action, o_orderstatus AS detail, {d.instant("o_orderdate")} AS created_at
FROM orders"""


def _users(d) -> str:
    return f"""
SELECT c_custkey AS id, c_name AS username, CASE WHEN c_custkey % 50 = 0 THEN 'admin' ELSE 'user' END AS role,
  c_custkey % 7 <> 0 AS is_active, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS totp_secret,
  CAST(c_custkey % 11 AS INT) AS failed_logins
FROM customer"""


def _provider_calls(d) -> str:
    return f"""
SELECT event_id AS id, concat('provider-', CAST(user_id % 8 AS STRING)) AS provider, {d.instant("ts")} AS called_at,
  CASE WHEN event_type IN ('error', 'view') THEN 'failure' WHEN event_type = 'purchase' AND value > 45 THEN 'quota' ELSE 'success' END AS outcome
FROM events"""


def _tagset_groups(d) -> str:
    return """
SELECT r_regionkey AS id, concat('group-', CAST(r_regionkey AS STRING)) AS slug, r_name AS name,
  CASE WHEN r_regionkey = 3 THEN 'draft' ELSE 'frozen' END AS status,
  CASE WHEN r_regionkey = 4 THEN 'v9' ELSE 'v1' END AS tagset_version
FROM region"""


def _tags(d) -> str:
    return """
SELECT p_partkey AS id, CAST(p_partkey % 5 AS INT) AS group_id, concat('tag-', CAST(p_partkey AS STRING)) AS slug, p_name AS name,
  concat(p_brand, ' ', p_type) AS description, CAST(35 + p_size % 10 AS DOUBLE) / 100 AS threshold,
  CASE WHEN p_partkey % 10 = 9 THEN 'v0' ELSE 'v1' END AS tagset_version
FROM part"""


BRIDGES: dict[str, Callable] = {
    "articles": _articles,
    "sites": _sites,
    "article_tags": _article_tags,
    "subscriptions": _subscriptions,
    "subscription_tags": _subscription_tags,
    "notify_targets": _targets,
    "subscription_targets": _subscription_targets,
    "deliveries": _deliveries,
    "attachments": _attachments,
    "audit_log": _audit_log,
    "users": _users,
    "provider_calls": _provider_calls,
    "tagset_groups": _tagset_groups,
    "tags": _tags,
}

_BASES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Bridge table as a DataFrame; only the columns a query uses reach the parquet scan."""
    text = BRIDGES[name](SPARK)
    used = [base for base in _BASES if f"FROM {base}" in text]
    # Named arguments bind the DataFrames without leaving temporary views behind.
    for base in used:
        text = text.replace(f"FROM {base}", f"FROM {{{base}}}")
    text = text.replace("{\"a\":1}", "{{\"a\":1}}")
    return spark.sql(text, **{base: read(spark, sf_dir, base) for base in used})


def cte(*names: str, extra: str = "") -> str:
    """WITH clause holding the named bridges for the checking engine."""
    parts = [f"{name} AS ({BRIDGES[name](DUCK)}\n)" for name in names]
    if extra:
        parts.append(extra)
    return "WITH " + ",\n".join(parts) + "\n"
