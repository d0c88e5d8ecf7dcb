"""Aggregates, joins and rankings behind the dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window



def histogram(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def stored_bytes(attachments: DataFrame) -> DataFrame:
    """Physical bytes: one size per content hash, rows without a hash counted singly."""
    identity = F.coalesce("sha256", F.concat(F.lit("id:"), F.col("id").cast("string")))
    per_blob = attachments.where("status = 'downloaded'").groupBy(identity.alias("blob")).agg(F.max("size_bytes").alias("size"))
    return per_blob.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("attachment_bytes"))


def tags_per_group(groups: DataFrame, tags: DataFrame) -> DataFrame:
    """Tags at the group's current version, 0 for groups without any."""
    current = tags.groupBy(F.col("group_id").alias("id"), "tagset_version").agg(F.count(F.lit(1)).alias("tags"))
    return groups.join(current, ["id", "tagset_version"], "left").withColumn("tags", F.coalesce("tags", F.lit(0)))


def site_health(sites: DataFrame, articles: DataFrame) -> DataFrame:
    """Failed articles per site and the error of the newest one."""
    failed = articles.where("status = 'FAILED'").groupBy(F.col("site_id").alias("id")).agg(
        F.count(F.lit(1)).alias("article_failures"), F.max_by("last_error", "id").alias("article_last_error")
    )
    return sites.join(failed, "id", "left").withColumn("article_failures", F.coalesce("article_failures", F.lit(0)))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table with its number of rows."""
    counts = [df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("table_name", F.lit(name)) for name, df in tables.items()]
    result = counts[0]
    for part in counts[1:]:
        result = result.unionByName(part)
    return result


def provider_totals(calls: DataFrame) -> DataFrame:
    """Calls, failures and success rate per provider from the call log."""
    failed = F.count_if(F.col("outcome") != "success")
    counted = calls.groupBy("provider").agg(F.count(F.lit(1)).alias("total_calls"), failed.alias("total_failures"))
    return counted.withColumn("success_rate", success_rate(F.col("total_calls"), F.col("total_failures")))


def success_rate(calls: Column, failures: Column) -> Column:
    return F.bround(F.try_divide((calls - failures).cast("double"), calls.cast("double")), 4)


def all_cooling(health: DataFrame, configured: DataFrame, now: Column) -> DataFrame:
    """Are all configured providers cooling down at once? Input configured: provider."""
    joined = configured.join(health.select("provider", "cooldown_until"), "provider", "left")
    cooling = F.count_if(F.col("cooldown_until") > now)
    return joined.agg(cooling.alias("cooling"), F.count(F.lit(1)).alias("configured")).withColumn(
        "all_down", (F.col("configured") > 0) & (F.col("cooling") == F.col("configured"))
    )


def crawl_statistics(outcomes: DataFrame) -> DataFrame:
    """Per site counters over an `outcome` column."""
    names = ("extracted", "duplicate", "unchanged", "skipped", "failed")
    counters = [F.count_if(F.col("outcome") == n).alias(f"n_{n}") for n in names]
    return outcomes.groupBy("site_id").agg(F.count(F.lit(1)).alias("n_discovered"), *counters)


def attachment_statistics(outcomes: DataFrame) -> DataFrame:
    names = ("downloaded", "reused", "skipped", "failed")
    return outcomes.agg(*[F.count_if(F.col("outcome") == n).alias(f"n_{n}") for n in names])


def path_references(attachments: DataFrame, expired: Column) -> DataFrame:
    """Files by number of references; a file may go once every reference has expired."""
    return (
        attachments.where("local_path IS NOT NULL")
        .groupBy("local_path")
        .agg(F.count(F.lit(1)).alias("n_refs"), F.count_if(expired).alias("n_expired"))
        .withColumn("removable", F.col("n_refs") == F.col("n_expired"))
    )


def active_admins(users: DataFrame) -> DataFrame:
    is_admin = (F.col("role") == "admin") & F.col("is_active")
    return users.agg(
        F.count_if(is_admin).alias("active_admins"), (F.count(F.lit(1)) > 0).alias("has_users")
    )


def delivery_details(deliveries: DataFrame, subscriptions: DataFrame, articles: DataFrame, sites: DataFrame, targets: DataFrame) -> DataFrame:
    """A delivery with everything its message needs."""
    subs = subscriptions.select(F.col("id").alias("subscription_id"), "user_id", "include_attachments")
    arts = articles.select(F.col("id").alias("article_id"), "title", "url", "published_at", "site_id")
    origin = sites.select(F.col("id").alias("site_id"), F.col("name").alias("site_name"))
    where_to = targets.select(
        F.col("id").alias("target_id"), "url_fingerprint", F.col("enabled").alias("target_enabled"),
        F.col("consecutive_failures").alias("target_failures"),
    )
    return deliveries.join(subs, "subscription_id").join(arts, "article_id").join(origin, "site_id").join(where_to, "target_id")


def newest_audit(audit: DataFrame, users: DataFrame, *, limit: int = 500) -> DataFrame:
    """The limit applies before the join: only its rows need a user name."""
    newest = audit.orderBy(F.col("id").desc()).limit(limit)
    return newest.join(users.select(F.col("id").alias("user_id"), "username"), "user_id", "left")


def expired_attachments(attachments: DataFrame, deliveries: DataFrame, cutoff: Column) -> DataFrame:
    """Stored files past retention whose article has no pending delivery."""
    waiting = deliveries.where("status = 'pending'").select("article_id")
    return attachments.where(F.col("local_path").isNotNull() & (F.col("created_at") < cutoff)).join(waiting, "article_id", "left_anti")


def override_providers(configured: DataFrame, stored: DataFrame) -> DataFrame:
    """Runtime order: configured ones, replaced in place by stored namesakes, then the other stored ones.

    Input: name, position, setting on both sides.
    """
    c = configured.select("name", F.col("position").alias("_c"), F.col("setting").alias("_cs"))
    s = stored.select("name", F.col("position").alias("_s"), F.col("setting").alias("_ss"))
    return c.join(s, "name", "full").select(
        "name", F.coalesce("_ss", "_cs").alias("setting"),
        F.when(F.col("_c").isNotNull(), 0).otherwise(1).alias("segment"), F.coalesce("_c", "_s").alias("position"),
    )


def provider_list(configured: DataFrame, stored: DataFrame, health: DataFrame) -> DataFrame:
    """Configured providers that are not overridden, then stored ones, each with its health."""
    kept = configured.join(stored.select("name"), "name", "left_anti").withColumn("source", F.lit("configuration"))
    listed = kept.unionByName(stored.withColumn("source", F.lit("web")))
    status = health.select(F.col("provider").alias("name"), "total_calls", "total_failures")
    return listed.join(status, "name", "left").fillna(0, ["total_calls", "total_failures"])


def alert_recipients(targets: DataFrame, users: DataFrame) -> DataFrame:
    admins = users.where("role = 'admin' AND is_active").select(F.col("id").alias("user_id"))
    return targets.where("enabled").join(admins, "user_id", "left_semi")


def deleted_site_files(attachments: DataFrame, articles: DataFrame, site_id: int) -> DataFrame:
    """Files of a deleted site that no other site still references."""
    owned = attachments.where("local_path IS NOT NULL").join(
        articles.select(F.col("id").alias("article_id"), "site_id"), "article_id"
    )
    gone = owned.groupBy("local_path").agg(
        F.bool_or(F.col("site_id") == site_id).alias("_here"), F.bool_or(F.col("site_id") != site_id).alias("_elsewhere")
    )
    return gone.where("_here AND NOT _elsewhere").select("local_path")


def recent_articles(articles: DataFrame, sites: DataFrame, deliveries: DataFrame, subscriptions: DataFrame, user_id: int, *, limit: int = 10) -> DataFrame:
    from .filters import visible_articles

    seen = visible_articles(articles, sites, deliveries, subscriptions, user_id)
    return seen.orderBy(F.col("published_at").desc_nulls_last(), F.col("id").desc()).limit(limit)


def per_group_batch(rows: DataFrame, group: str, *, limit: int) -> DataFrame:
    """The first rows of every group by id; the rank limit is applied before the shuffle."""
    order = Window.partitionBy(group).orderBy("id")
    return rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= limit).drop("_rank")


def ordered_tags(article_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """Tag names of an article, strongest first, ties by tag id."""
    named = article_tags.join(tags.select(F.col("id").alias("tag_id"), "name"), "tag_id")
    entry = F.struct((-F.col("confidence")).alias("_c"), F.col("tag_id").alias("_id"), "name", "confidence")
    listed = named.groupBy("article_id").agg(F.array_sort(F.collect_list(entry)).alias("_tags"))
    return listed.select("article_id", F.transform("_tags", lambda t: F.struct(t["name"], t["confidence"])).alias("tags"))


def tagset_differences(frozen: DataFrame, stored: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys that exist on one side only or carry different values; empty when the sets agree."""
    f = frozen.select(key, F.struct(*columns).alias("_f"), F.lit(True).alias("_in_file"))
    s = stored.select(key, F.struct(*columns).alias("_s"), F.lit(True).alias("_in_db"))
    return f.join(s, key, "full").where(~F.col("_f").eqNullSafe(F.col("_s"))).select(
        key, F.coalesce("_in_file", F.lit(False)).alias("in_file"), F.coalesce("_in_db", F.lit(False)).alias("in_db")
    )
