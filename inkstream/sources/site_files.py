"""Site configuration files: whole texts to typed rows, with the errors of each file kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sinks import insert_if_absent

# What a configuration may ask for, and what it gets when it doesn't say.
MODES = ("html_list", "rss", "sitemap", "json_api")
BUILD_MODES = ("llm", "embedding", "manual")
DEFAULT_INTERVAL_SEC, LEAST_INTERVAL_SEC = 1800, 60
SLUG = r"^[a-z0-9](?:[a-z0-9-]{0,62})$"


def read_site_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, document) of every file; a file is one JSON document (which is YAML as well)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("document"))


def _kind(v: Column, field: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, field, "variant")), F.lit("VOID"))


def _text(v: Column, field: str) -> Column:
    return F.when(_kind(v, field) == "STRING", F.trim(F.try_variant_get(v, field, "string")))


def _flag(v: Column, field: str, default: bool) -> Column:
    return F.when(_kind(v, field) == "BOOLEAN", F.try_variant_get(v, field, "boolean")).when(_kind(v, field) == "VOID", F.lit(default))


def parse_site_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, sites): rows of every file in order, with `error` where a row or its file is unusable.

    A document has `tagset_groups` (slug, name, description, build_mode) and `sites` (slug, name, base_url, discovery_mode,
    tagset_group, enabled, render_js, crawl_interval_sec, config). A file that is no object, or whose lists are none, is one
    row with an error in both results; every other row is checked by itself. `config` stays JSON text.
    """
    parsed = files.withColumn("_v", F.try_parse_json("document"))
    top = F.coalesce(F.schema_of_variant("_v"), F.lit("VOID"))
    v = F.col("_v")
    listed = lambda f: _kind(v, f).startswith("ARRAY") | (_kind(v, f) == "VOID")
    broken = F.when(~top.startswith("OBJECT"), "unreadable").when(~listed("$.tagset_groups") | ~listed("$.sites"), "not_a_list")
    parsed = parsed.withColumn("_broken", broken)

    def rows(field: str) -> DataFrame:
        items = F.when(F.col("_broken").isNull(), F.coalesce(F.try_variant_get(v, f"$.{field}", "array<variant>"), F.array().cast("array<variant>"))).otherwise(F.array(F.lit(None).cast("variant")))
        return parsed.select("path", "_broken", F.posexplode(items).alias("position", "_i"))

    i = F.col("_i")
    shape = F.when(F.col("_broken").isNotNull(), F.col("_broken")).when(~F.coalesce(F.schema_of_variant(i), F.lit("VOID")).startswith("OBJECT"), "not_an_object")
    build = F.coalesce(_text(i, "$.build_mode"), F.when(_kind(i, "$.build_mode") == "VOID", "llm"))
    groups = rows("tagset_groups").select("path", "position", _text(i, "$.slug").alias("slug"), _text(i, "$.name").alias("name"), _text(i, "$.description").alias("description"), build.alias("build_mode"), shape.alias("_shape"))
    bad_group = F.coalesce("_shape", F.when(~F.coalesce(F.col("slug").rlike(SLUG), F.lit(False)), "slug").when(F.coalesce("name", F.lit("")) == "", "name").when(~F.coalesce(F.col("build_mode").isin(*BUILD_MODES), F.lit(False)), "build_mode"))
    groups = groups.withColumn("error", bad_group).drop("_shape")

    seconds = F.when(_kind(i, "$.crawl_interval_sec") == "VOID", F.lit(DEFAULT_INTERVAL_SEC)).when(_kind(i, "$.crawl_interval_sec") == "BIGINT", F.try_variant_get(i, "$.crawl_interval_sec", "int"))
    config = F.when(_kind(i, "$.config").startswith("OBJECT"), F.to_json(F.try_variant_get(i, "$.config", "variant"))).when(_kind(i, "$.config") == "VOID", "{}")
    sites = rows("sites").select(
        "path", "position", _text(i, "$.slug").alias("slug"), _text(i, "$.name").alias("name"), _text(i, "$.base_url").alias("base_url"), _text(i, "$.discovery_mode").alias("discovery_mode"),
        _text(i, "$.tagset_group").alias("tagset_group"), _flag(i, "$.enabled", True).alias("enabled"), _flag(i, "$.render_js", False).alias("render_js"), seconds.alias("crawl_interval_sec"), config.alias("config"), shape.alias("_shape"),
    )
    wrong = lambda ok: ~F.coalesce(ok, F.lit(False))
    bad_site = F.coalesce("_shape", F.when(wrong(F.col("slug").rlike(SLUG)), "slug").when(wrong(F.col("name") != ""), "name").when(wrong(F.col("base_url").rlike(r"^(?i)https?://[^/\s]+")), "base_url")
        .when(wrong(F.col("discovery_mode").isin(*MODES)), "discovery_mode").when(wrong(F.col("tagset_group") != ""), "tagset_group").when(F.col("enabled").isNull() | F.col("render_js").isNull(), "flag")
        .when(wrong(F.col("crawl_interval_sec") >= LEAST_INTERVAL_SEC), "crawl_interval_sec").when(F.col("config").isNull(), "config"))
    return groups, sites.withColumn("error", bad_site).drop("_shape")


def import_sites(groups: DataFrame, sites: DataFrame, stored_groups: DataFrame, stored_sites: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new groups, new sites, refused): what is stored already stays as it is; of a repeated slug the first file's row counts.

    stored_groups: slug. stored_sites: slug. A site whose group is neither stored nor among the usable ones is refused with
    `tagset_group`; refused rows are (path, position, slug, error) of groups and sites.
    """
    good = groups.where("error IS NULL")
    fresh_groups = insert_if_absent(good.select("slug", "name", "description", "build_mode", "path", "position"), stored_groups, ["slug"], order=["path", "position"]).drop("path", "position")
    known = stored_groups.select("slug").unionByName(good.select("slug")).distinct().withColumnRenamed("slug", "tagset_group")
    usable = sites.where("error IS NULL")
    homeless = usable.join(known, "tagset_group", "left_anti")
    rows = usable.join(known, "tagset_group", "left_semi").drop("error")
    fresh_sites = insert_if_absent(rows, stored_sites, ["slug"], order=["path", "position"]).drop("path", "position")
    bad = lambda df: df.where("error IS NOT NULL").select("path", "position", "slug", "error")
    refused = bad(groups).unionByName(bad(sites)).unionByName(homeless.select("path", "position", "slug", F.lit("tagset_group").alias("error")))
    return fresh_groups, fresh_sites, refused
