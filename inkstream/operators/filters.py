"""Selections: what is due, visible, allowed or rejected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Notification schemes with a fixed destination host.
TARGET_SCHEMES = (
    "dingtalk discord feishu gchat guilded line msteams opsgenie pagerduty pbul pover slack tgram wecombot whatsapp wxteams"
).split()
FINISHED = ("EXTRACTED", "TAGGED", "NOTIFIED", "SKIPPED")
RETRY_BATCH = 100
SEND_BATCH = 100
ATTACHMENT_BATCH = 20
ARTICLE_PAGE = 200


def due_sites(sites: DataFrame, now: Column) -> DataFrame:
    next_crawl = F.timestamp_seconds(F.unix_timestamp("last_crawled_at") + F.col("crawl_interval_sec"))
    return sites.where(F.col("enabled") & (F.col("last_crawled_at").isNull() | (next_crawl <= now)))


def is_retryable_article(now: Column) -> Column:
    failed_due = (F.col("status") == "FAILED") & (F.col("next_attempt_at") <= now)
    return F.col("status").isin("DISCOVERED", "FETCHED") | F.coalesce(failed_due, F.lit(False))


def retryable_articles(articles: DataFrame, now: Column, *, limit: int = RETRY_BATCH) -> DataFrame:
    """The oldest unfinished articles of every site, fewest attempts first."""
    order = Window.partitionBy("site_id").orderBy("attempts", "id")
    return (
        articles.where(is_retryable_article(now))
        .withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= limit)
        .drop("_rank")
    )


def unchanged(now: Column) -> Column:
    """True for a known article that this crawl leaves alone."""
    waiting = (F.col("status") == "FAILED") & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") > now))
    return F.col("status").isin(*FINISHED) | waiting


def is_due(now: Column) -> Column:
    """Pending, due (a past or missing time counts as due) and not leased to another sender."""
    return (
        (F.col("status") == "pending")
        & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now))
        & (F.col("claim_until").isNull() | (F.col("claim_until") <= now))
    )


def due_deliveries(deliveries: DataFrame, now: Column, *, limit: int = SEND_BATCH) -> DataFrame:
    return deliveries.where(is_due(now)).orderBy(F.col("next_attempt_at").asc_nulls_first(), "id").limit(limit)


def content_verdict(
    title: Column, text: Column, attachments: Column, *, title_patterns: Sequence[str], text_patterns: Sequence[str], min_length: int
) -> Column:
    """rejected (pattern hit), too_short (no attachments to make up for it) or accepted."""
    def hit(value: Column, patterns: Sequence[str]) -> Column:
        found = F.lit(False)
        for pattern in patterns:
            found = found | value.rlike(f"(?i){pattern}")
        return found

    return (
        F.when(hit(title, title_patterns) | hit(text, text_patterns), F.lit("rejected"))
        .when((F.char_length(text) < min_length) & (attachments == 0), F.lit("too_short"))
        .otherwise(F.lit("accepted"))
    )


def search_articles(
    articles: DataFrame,
    sites: DataFrame,
    *,
    user_id: int | None = None,
    deliveries: DataFrame | None = None,
    subscriptions: DataFrame | None = None,
    article_tags: DataFrame | None = None,
    site: str | None = None,
    tag_ids: DataFrame | None = None,
    since: Column | None = None,
    limit: int = ARTICLE_PAGE,
) -> DataFrame:
    """Newest articles with optional site, tag and date filters.

    `user_id` None is the administrator's view; otherwise only articles sent to this user count.
    """
    found = articles.join(sites.select(F.col("id").alias("site_id"), "slug", F.col("name").alias("site")), "site_id")
    if site:
        found = found.where(F.col("slug") == site)
    if since is not None:
        found = found.where(F.col("published_at") >= since)
    if tag_ids is not None:
        tagged = article_tags.join(tag_ids, "tag_id", "left_semi")
        found = found.join(tagged.select(F.col("article_id").alias("id")), "id", "left_semi")
    if user_id is not None:
        found = found.join(sent_to(user_id, deliveries, subscriptions), "id", "left_semi")
    return found.orderBy(F.col("published_at").desc_nulls_last(), F.col("id").desc()).limit(limit)


def sent_to(user_id: int, deliveries: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Ids of articles that reached a user."""
    own = subscriptions.where(F.col("user_id") == user_id).select(F.col("id").alias("subscription_id"))
    return deliveries.where("status = 'sent'").join(own, "subscription_id", "left_semi").select(F.col("article_id").alias("id"))


def visible_articles(articles: DataFrame, sites: DataFrame, deliveries: DataFrame, subscriptions: DataFrame, user_id: int) -> DataFrame:
    """Article details a non-administrator may open."""
    named = articles.join(sites.select(F.col("id").alias("site_id"), F.col("name").alias("site")), "site_id")
    return named.join(sent_to(user_id, deliveries, subscriptions), "id", "left_semi")


def glob_regex(pattern: str) -> str:
    """Shell glob (*, ?, [set]) as an anchored regular expression."""
    out, i = "", 0
    while i < len(pattern):
        c, close = pattern[i], pattern.find("]", i + 2)
        if c == "[" and close > 0:
            body = pattern[i + 1 : close].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] == "!" else body) + "]", close
        else:
            out += {"*": ".*", "?": "."}.get(c) or (c if c.isalnum() else "\\" + c)
        i += 1
    return f"(?s)^{out}$"


def mime_allowed(mime: Column, allow: Sequence[str]) -> Column:
    allowed = F.lit(False)
    for pattern in allow:
        allowed = allowed | F.lower(mime).rlike(glob_regex(pattern.lower()))
    return allowed


def pending_attachments(attachments: DataFrame, articles: DataFrame, sites: DataFrame, *, max_attempts: int, limit: int = ATTACHMENT_BATCH) -> DataFrame:
    origin = articles.select(F.col("id").alias("article_id"), F.col("url").alias("article_url"), "site_id").join(
        sites.select(F.col("id").alias("site_id"), F.col("slug").alias("site_slug")), "site_id"
    )
    open_rows = attachments.where(F.col("status").isin("pending", "failed") & (F.col("attempts") < max_attempts))
    return open_rows.join(origin, "article_id").orderBy("id", "source_url").limit(limit)


def live_sessions(sessions: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    active = users.where("is_active").select(F.col("id").alias("user_id"), "username", "role")
    return sessions.where(F.col("revoked_at").isNull() & (F.col("expires_at") > now)).join(active, "user_id")


def unknown_ids(requested: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Requested ids that do not exist; an empty result accepts the request."""
    return requested.select(key).distinct().join(known.select(key), key, "left_anti")


def single_group(selections: DataFrame) -> DataFrame:
    """Per subscription: do all chosen tags and sites lie in one tag-set group?

    Input: subscription_id, group_id (one row per chosen tag or site).
    """
    counted = selections.groupBy("subscription_id").agg(F.min("group_id").alias("_lo"), F.max("group_id").alias("_hi"))
    return counted.select("subscription_id", (F.col("_lo") == F.col("_hi")).alias("single_group"))


def current_tags(tags: DataFrame, groups: DataFrame) -> DataFrame:
    """Tags of the frozen, current version of their group."""
    frozen = groups.where("status = 'frozen'").select(F.col("id").alias("group_id"), "tagset_version")
    return tags.join(frozen, ["group_id", "tagset_version"])


def target_url_allowed(url: Column) -> Column:
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    clean = ~url.rlike(r"(?U)[\s\x00-\x1f]")
    return F.char_length(url).between(4, 4096) & clean & scheme.isin(TARGET_SCHEMES)


def content_length_allowed(value: Column, max_bytes: int) -> Column:
    """A missing declaration is fine; an unreadable or too large one is not."""
    declared = F.trim(value).try_cast("bigint")
    return F.when(value.isNull() | (value == ""), F.lit(True)).otherwise(
        F.coalesce(declared.between(0, max_bytes), F.lit(False))
    )


def same_site(link: Column, page_url: Column) -> Column:
    """Absolute web link on the host of the page."""
    host = F.lower(F.try_parse_url(link, F.lit("HOST")))
    on_host = host == F.lower(F.try_parse_url(page_url, F.lit("HOST")))
    return F.coalesce(F.lower(F.try_parse_url(link, F.lit("PROTOCOL"))).isin("http", "https") & on_host, F.lit(False))
