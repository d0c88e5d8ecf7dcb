"""Discovery sources: HTML lists, feeds, sitemaps, JSON endpoints and their pagination.

Every source takes a DataFrame of fetched documents and yields item rows; a document stays one row
until its items are known, so nothing document-sized is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import html as H
from ..functions.dates import parse_flexible, parse_http_date
from ..functions.urls import absolute_urls, set_query_param
from ..session import cut_lineage

MIN_FEED_CONTENT = 500
MAX_SITEMAPS = 100
MAX_INDEX_DEPTH = 5
ITEM_COLUMNS = ("url", "title", "published_at", "summary", "content_html")


@dataclass(frozen=True)
class ListConfig:
    item_selector: str
    fields: Mapping[str, str] = field(default_factory=dict)
    url_allow_pattern: str | None = None
    date_format: str | None = None


def _resolved(documents: DataFrame, page_url: Column, keep: list[str]) -> DataFrame:
    """Resolve `_found[].url` against the page and keep the first item per address, in order."""
    urls = absolute_urls(page_url, F.col("_found.url"))
    joined = documents.withColumn("_urls", urls).withColumn(
        "_items", F.zip_with("_found", "_urls", lambda i, u: i.withField("url", u))
    )
    unique = F.filter("_items", lambda i, k: F.array_position("_urls", i["url"]) == k + 1)
    return joined.select(*keep, unique.alias("_items"))


def _exploded(documents: DataFrame, keep: list[str]) -> DataFrame:
    return documents.select(*keep, F.posexplode("_items").alias("position", "item")).select(
        *keep, "position", *[F.col(f"item.{c}").alias(c) for c in ITEM_COLUMNS]
    )


def _item(url: Column, title: Column, published: Column, summary: Column, content: Column) -> Column:
    return F.struct(
        url.alias("url"), title.alias("title"), published.alias("published_at"), summary.alias("summary"), content.alias("content_html")
    )


def _nothing(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def html_list(pages: DataFrame, config: ListConfig, *, key: str = "page_id") -> DataFrame:
    """Items of list pages (key, url, html). `error` is set, without items, where nothing matched."""
    nodes = F.col("_nodes")

    def read(scope: Column, name: str) -> Column:
        return H.value_of(nodes, scope, config.fields[name]) if name in config.fields else _nothing()

    def item(scope: Column) -> Column:
        link = F.coalesce(H.value_of(nodes, scope, config.fields.get("url", "@href")), F.nullif(scope["attrs"]["href"], F.lit("")))
        date = read(scope, "published_at")
        when = F.try_to_timestamp(date, F.lit(config.date_format)) if config.date_format else parse_flexible(date)
        return _item(link, read(scope, "title"), when, read(scope, "summary"), _nothing())

    parsed = pages.withColumn("_nodes", H.dom("html")).withColumn("_hits", H.select(nodes, config.item_selector))
    found = parsed.withColumn("_found", F.filter(F.transform("_hits", item), lambda i: i["url"].isNotNull()))
    found = found.withColumn("error", F.when(F.size("_hits") == 0, F.lit("SelectorMiss")))
    resolved = _resolved(found, F.col("url"), [key, F.col("url").alias("source_page"), "error"])
    if config.url_allow_pattern:
        resolved = resolved.withColumn("_items", F.filter("_items", lambda i: i["url"].rlike(config.url_allow_pattern)))
    rows = resolved.select(key, "source_page", "error", F.posexplode_outer("_items").alias("position", "item"))
    return rows.select(key, "source_page", "error", "position", *[F.col(f"item.{c}").alias(c) for c in ITEM_COLUMNS]).where(
        "error IS NOT NULL OR url IS NOT NULL"
    )


def _children(nodes: Column, parent: Column, *names: str) -> Column:
    return F.filter(nodes, lambda n: (n["up"] == parent["id"]) & n["tag"].isin(*names))


def _child_text(nodes: Column, parent: Column, name: str) -> Column:
    """Text of the first child of that name; NULL when it is blank."""
    return F.get(F.transform(F.slice(_children(nodes, parent, name), 1, 1), lambda n: n["text"]), 0)


def feed_items(feeds: DataFrame, *, content_mode: str = "auto", key: str = "page_id") -> DataFrame:
    """RSS and Atom entries of (key, url, xml); malformed documents give one row with `error`."""
    nodes = F.col("_nodes")

    def link(entry: Column) -> Column:
        plain = _child_text(nodes, entry, "link")
        alternates = F.filter(
            _children(nodes, entry, "link"),
            lambda n: n["attrs"]["href"].isNotNull() & (F.coalesce(n["attrs"]["rel"], F.lit("alternate")) == "alternate"),
        )
        return F.coalesce(plain, F.get(F.transform(alternates, lambda n: n["attrs"]["href"]), 0))

    def date(entry: Column) -> Column:
        names = (("pubDate", "published", "issued"), ("updated", "modified", "date"), ("created",))
        texts = [_child_text(nodes, entry, n) for group in names for n in group]
        given = F.filter(F.array(*texts), lambda t: t.isNotNull())
        read = F.transform(given, lambda t: F.coalesce(parse_http_date(t), parse_flexible(t)))
        return F.get(F.filter(read, lambda t: t.isNotNull()), 0)

    def content(entry: Column) -> Column:
        if content_mode == "never":
            return _nothing()
        text = F.coalesce(_child_text(nodes, entry, "content"), _child_text(nodes, entry, "encoded"))
        return text if content_mode == "always" else F.when(F.char_length(text) >= MIN_FEED_CONTENT, text)

    def item(entry: Column) -> Column:
        summary = F.coalesce(_child_text(nodes, entry, "description"), _child_text(nodes, entry, "summary"))
        return _item(link(entry), _child_text(nodes, entry, "title"), date(entry), summary, content(entry))

    parsed = feeds.withColumn("_nodes", H.xml_dom("xml"))
    entries = F.filter(nodes, lambda n: n["tag"].isin("item", "entry"))
    found = parsed.withColumn("_found", F.filter(F.transform(entries, item), lambda i: i["url"].isNotNull()))
    found = found.withColumn("error", F.when(nodes.isNull(), F.lit("FeedUnreadable")))
    resolved = _resolved(found, F.col("url"), [key, F.col("url").alias("source_page"), "error"])
    rows = resolved.select(key, "source_page", "error", F.posexplode_outer("_items").alias("position", "item"))
    return rows.select(key, "source_page", "error", "position", *[F.col(f"item.{c}").alias(c) for c in ITEM_COLUMNS]).where(
        "error IS NOT NULL OR url IS NOT NULL"
    )


def xml_kind(documents: DataFrame, column: str = "xml") -> DataFrame:
    """Adds `feed_kind` (rss, atom) and `sitemap_kind` (urlset, sitemapindex) from the root element."""
    root = F.lower(F.get(F.transform(F.slice(H.xml_dom(column), 1, 1), lambda n: n["tag"]), 0))
    return (
        documents.withColumn("_root", root)
        .withColumn("feed_kind", F.when(F.col("_root").isin("rss", "rdf"), "rss").when(F.col("_root") == "feed", "atom"))
        .withColumn("sitemap_kind", F.when(F.col("_root").isin("urlset", "sitemapindex"), F.col("_root")))
        .drop("_root")
    )


def sitemap_entries(sitemaps: DataFrame, *, keep: list[str]) -> DataFrame:
    """Rows (keep..., url, kind, position, loc, lastmod) of sitemaps and sitemap indexes."""
    nodes = F.col("_nodes")
    root = F.get(nodes, 0)
    members = F.filter(nodes, lambda n: (n["up"] == 0) & (n["tag"] == F.when(root["tag"] == "urlset", "url").otherwise("sitemap")))
    found = F.transform(
        members, lambda m: F.struct(_child_text(nodes, m, "loc").alias("url"), parse_flexible(_child_text(nodes, m, "lastmod")).alias("lastmod"))
    )
    parsed = sitemaps.withColumn("_nodes", H.xml_dom("xml")).withColumn("kind", root["tag"])
    usable = parsed.where(F.col("kind").isin("urlset", "sitemapindex")).withColumn("_found", F.filter(found, lambda i: i["url"].isNotNull()))
    urls = absolute_urls(F.col("url"), F.col("_found.url"))
    return usable.withColumn("_urls", urls).select(
        *keep, F.col("url"), "kind", F.posexplode(F.arrays_zip("_urls", "_found")).alias("position", "_e")
    ).select(*keep, "url", "kind", "position", F.col("_e._urls").alias("loc"), F.col("_e._found.lastmod").alias("lastmod"))


def sitemap_walk(
    roots: DataFrame, sitemaps: DataFrame, *, allow: str | None = None, cutoff: Column | None = None,
    max_documents: int = MAX_SITEMAPS, max_depth: int = MAX_INDEX_DEPTH,
) -> DataFrame:
    """Items reachable from root sitemaps (site, url) through indexes, over fetched (url, xml).

    Level by level down to max_depth; per site at most max_documents are visited, in the order a queue
    would visit them. Entries without a modification date are always kept.
    """
    # Parsed once: every level of the walk reads the entries.
    entries = cut_lineage(sitemap_entries(sitemaps, keep=[]))
    children = entries.where("kind = 'sitemapindex'").select(F.col("url").alias("parent"), F.col("loc").alias("url"), "position")
    level = roots.select("site", "url", F.array(F.lit(0).cast("long")).alias("path"))
    visits = level
    for _ in range(max_depth):
        level = level.join(children.withColumnRenamed("url", "_child"), F.col("url") == F.col("parent")).select(
            "site", F.col("_child").alias("url"), F.concat("path", F.array(F.col("position").cast("long"))).alias("path")
        )
        visits = visits.unionByName(level)
    # Queue order is by depth, then by the positions on the way down.
    order = F.struct(F.size("path").alias("depth"), "path")
    once = visits.groupBy("site", "url").agg(F.min(order).alias("_order"))
    queue = Window.partitionBy("site").orderBy("_order", "url")
    visited = once.withColumn("visit", F.row_number().over(queue)).where(F.col("visit") <= max_documents).drop("_order")
    items = visited.join(entries.where("kind = 'urlset'"), "url")
    if allow:
        items = items.where(F.col("loc").rlike(allow))
    if cutoff is not None:
        items = items.where(F.col("lastmod").isNull() | (F.col("lastmod") >= cutoff))
    first = F.min_by(F.struct(F.col("lastmod").alias("published_at"), F.col("url").alias("source_page")), F.struct("visit", "position"))
    return items.groupBy("site", F.col("loc").alias("url")).agg(first.alias("_i")).select("site", "url", "_i.*")


def dot_path(value: Column, path: str) -> Column:
    """Variant at a dot path; a numeric part is a list index or an object key."""
    if not path:
        return value
    steps = []
    for part in path.split("."):
        key = "['" + part.replace("'", "\\'") + "']"
        steps.append((f"[{int(part)}]", key) if part.isdigit() else (key,))
    return F.coalesce(*[F.try_variant_get(value, "$" + "".join(p), "variant") for p in product(*steps)])


def _as_text(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    return F.when(kind == "BOOLEAN", F.initcap(text)).when(kind != "VOID", text)


def json_items(responses: DataFrame, items_path: str, field_map: Mapping[str, str], *, key: str = "page_id") -> DataFrame:
    """Items of JSON responses (key, url, body); a path that is no array gives one row with `error`."""
    values = F.try_variant_get(dot_path(F.col("_json"), items_path), "$", "array<variant>")

    def read(value: Column, name: str) -> Column:
        return _as_text(dot_path(value, field_map[name])) if name in field_map else _nothing()

    def item(value: Column) -> Column:
        return _item(
            _as_text(dot_path(value, field_map.get("url", ""))), read(value, "title"), parse_flexible(read(value, "published_at")),
            read(value, "summary"), read(value, "content"),
        )

    parsed = responses.withColumn("_json", F.try_parse_json("body")).withColumn("_values", values)
    objects = F.filter("_values", lambda v: F.schema_of_variant(v).startswith("OBJECT"))
    found = parsed.withColumn("_found", F.filter(F.transform(objects, item), lambda i: F.trim(i["url"]) != ""))
    found = found.withColumn("error", F.when(F.col("_values").isNull(), F.lit("ItemsPathMiss")))
    urls = absolute_urls(F.col("url"), F.col("_found.url"))
    joined = found.withColumn("_urls", urls).withColumn("_items", F.zip_with("_found", "_urls", lambda i, u: i.withField("url", u)))
    rows = joined.select(key, F.col("url").alias("source_page"), "error", F.posexplode_outer("_items").alias("position", "item"))
    return rows.select(key, "source_page", "error", "position", *[F.col(f"item.{c}").alias(c) for c in ITEM_COLUMNS]).where(
        "error IS NOT NULL OR url IS NOT NULL"
    )


def first_seen(items: DataFrame, order: list[str], *, scope: str = "site_id") -> DataFrame:
    """One item per (scope, url): the earliest by page and position. Partial aggregation, no ranking."""
    rest = [c for c in items.columns if c not in (scope, "url")]
    picked = F.min_by(F.struct(*rest), F.struct(*order))
    return items.groupBy(scope, "url").agg(picked.alias("_i")).select(scope, "url", "_i.*")


def not_yet_seen(pending: DataFrame, discovered: DataFrame) -> DataFrame:
    """Discovered items plus unfinished ones that this crawl did not find again."""
    missing = pending.join(discovered.select("site_id", "url"), ["site_id", "url"], "left_anti")
    return discovered.unionByName(missing)


def page_urls(entries: DataFrame) -> DataFrame:
    """Pages to read per entry: entry_url, mode, max_pages, template, param, page_order, max_page.

    Page 0 is the entry itself. `next_link` needs page bodies, see `follow_next`.
    """
    steps = F.when(F.col("mode").isin("url_template", "query_param"), F.col("max_pages") - 1).otherwise(F.lit(0))
    paged = entries.withColumn("page_index", F.explode(F.sequence(F.lit(0), steps)))
    descending = (F.col("mode") == "url_template") & (F.col("page_order") == "desc_index")
    number = F.when(descending, F.coalesce("max_page", F.lit(1)) - F.col("page_index")).otherwise(F.col("page_index") + 1)
    numbered = paged.withColumn("page_number", number).where((F.col("page_index") == 0) | ~descending | (F.col("page_number") >= 1))
    by_param = set_query_param("entry_url", F.coalesce("param", F.lit("page")), F.col("page_number").cast("string"))
    url = (
        F.when(F.col("page_index") == 0, F.col("entry_url"))
        .when(F.col("mode") == "url_template", F.replace(F.col("template"), F.lit("{page}"), F.col("page_number").cast("string")))
        .otherwise(by_param)
    )
    return numbered.withColumn("page_url", url)


def follow_next(entries: DataFrame, links: DataFrame, *, max_pages: int) -> DataFrame:
    """Chains of next links: entries (entry_url), links (url, next_url); at most `max_pages` each."""
    step = entries.select("entry_url", F.lit(0).alias("page_index"), F.col("entry_url").alias("page_url"))
    chain = step
    for index in range(1, max_pages):
        step = step.join(links, F.col("page_url") == F.col("url")).where("next_url IS NOT NULL").select(
            "entry_url", F.lit(index).alias("page_index"), F.col("next_url").alias("page_url")
        )
        chain = chain.unionByName(step)
    return chain
