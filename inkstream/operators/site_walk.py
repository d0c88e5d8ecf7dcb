"""Walking a site's list pages within a budget, and previewing its articles with isolated failures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import html as H
from ..session import cut_lineage
from .extraction import ExtractConfig, extract_articles

START = "input page"


def walk(start: DataFrame, fetched: DataFrame, edges: DataFrame, *, depth: int = 2, budget: int = 40) -> DataFrame:
    """Breadth-first walk of every site in queue order: site, position, depth, url, page_id, evidence.

    start: site, url. fetched: url, page_id, one row per address. edges: page_id, target_url, rank, evidence (the order in
    which a page offers its links). An address joins the queue behind all that were offered before it, once per
    site, with the evidence of its first offer. Every address asked for counts against the site's budget, also one that
    was not fetched (page_id NULL); what lies beyond the budget is not visited. A level is one join with the edges, and
    no site's queue is longer than its budget times the links of a page.
    """
    pages = fetched.select("url", "page_id")
    level = start.select("site", "url").distinct().join(pages, "url", "left")
    level = cut_lineage(level.select("site", F.lit(0).cast("long").alias("position"), F.lit(0).alias("depth"), "url", "page_id", F.lit(START).alias("evidence")))
    visited = level
    for step in range(1, depth + 1):
        offered = level.join(edges, "page_id").select("site", F.col("target_url").alias("url"), F.struct(F.col("position").alias("p"), F.col("rank").alias("r")).alias("_at"), edges["evidence"].alias("evidence"))
        first = offered.groupBy("site", "url").agg(F.min_by("evidence", "_at").alias("evidence"), F.min("_at").alias("_at"))
        new = first.join(visited.select("site", "url"), ["site", "url"], "left_anti")
        seen = visited.groupBy("site").agg(F.count(F.lit(1)).alias("_seen"))
        queue = Window.partitionBy("site").orderBy("_at", "url")
        placed = new.join(seen, "site").withColumn("position", F.col("_seen") + F.row_number().over(queue) - 1).where(F.col("position") < budget)
        level = placed.join(pages, "url", "left").select("site", "position", F.lit(step).alias("depth"), "url", "page_id", "evidence")
        level = cut_lineage(level)
        if level.isEmpty():
            break
        visited = visited.unionByName(level)
    return visited


def preview(items: DataFrame, fetched: DataFrame, config: ExtractConfig, *, sample_size: int = 10, summary_chars: int = 240, parse: Callable[[str], list[dict]] = H.tree) -> DataFrame:
    """The first items of each site as they would be stored: one row per item, failed or not.

    items: site, position, url, title, published_at, content_html. fetched: url, html, one row per address. An item with
    its own markup needs no page. Result: site, position, url, success, title, published_at, content_length, summary,
    n_attachments, error. Whatever `parse` raises on a page becomes that item's error, as `Type: message`, and the
    other items of the batch are not touched; so does a page that was not fetched and an extraction that is rejected.
    """
    order = Window.partitionBy("site").orderBy("position")
    sample = items.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= sample_size).drop("_n")
    rows = sample.join(fetched.select("url", "html"), "url", "left")
    rows = rows.select(
        F.struct("site", "position").alias("_item"), "url", F.coalesce("content_html", "html").alias("html"),
        F.col("title").alias("title_hint"), F.col("published_at").alias("published_hint"),
    )
    parsed = rows.withColumn("_parsed", H.isolated(parse)("html"))
    parsed = parsed.select("*", F.col("_parsed.nodes").alias("_nodes"), F.when(F.col("html").isNull(), "PageMissing").otherwise(F.col("_parsed.error")).alias("_failure")).drop("_parsed")
    keyed = parsed.withColumn("_item", F.struct("_item", "_failure"))
    found = extract_articles(keyed, config, key="_item")
    error = F.coalesce(F.col("_item._failure"), "error")
    kept = lambda c: F.when(error.isNull(), c)
    return found.select(
        "_item._item.*", "url", error.isNull().alias("success"), kept(F.col("title")).alias("title"), kept(F.col("published_at")).alias("published_at"),
        kept(F.char_length("content_text")).alias("content_length"), kept(F.substring("content_text", 1, summary_chars)).alias("summary"),
        kept(F.size("attachments")).alias("n_attachments"), error.alias("error"),
    )


def preview_report(items: DataFrame, previews: DataFrame) -> DataFrame:
    """site, discovered, succeeded, failed."""
    discovered = items.groupBy("site").agg(F.count(F.lit(1)).alias("discovered"))
    tried = previews.groupBy("site").agg(F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"))
    return discovered.join(tried, "site", "left").fillna(0, ["succeeded", "failed"])
