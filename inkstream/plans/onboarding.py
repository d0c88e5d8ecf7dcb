"""Site inspection queries over `pages`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..operators import onboarding as O
from ..operators import selectors as S
from ..operators import site_walk as W
from ..operators.extraction import ExtractConfig, extract_articles
from ..session import cut_lineage
from .bridge import read, read_spread
from .catalogue import query
from .discovery import EXTRACT, ORIGIN


def parsed(spark, d):
    return O.parse(read_spread(spark, d, "pages", "page_id", "url", "html"))


LINKS = f"""
WITH links AS (SELECT page_id, url, {ORIGIN} || unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS target FROM pages)"""


@query("src1_page_links", LINKS + " SELECT page_id, target, count(*) AS n FROM links GROUP BY 1, 2")
def page_links(spark, d):
    return O.links(parsed(spark, d)).groupBy("page_id", "target").agg(F.count(F.lit(1)).alias("n"))


@query("htm4_mth3_selector_candidates")
def selectors(spark, d):
    return O.selector_candidates(O.links(parsed(spark, d), with_items=True))


PAGER_SQL = f"""
WITH n AS (SELECT page_id, url, CAST(page_id % 5 + 2 AS BIGINT) AS n FROM pages)
SELECT page_id, 'next_link' AS mode, 'a[rel="next"]' AS argument, CAST(NULL AS BIGINT) AS max_page, 0.95::DOUBLE AS confidence, {ORIGIN} || '/more' AS sample_url, 1 AS rank FROM n
UNION ALL SELECT page_id, 'query_param', 'p', NULL, 0.78, regexp_extract(url, '^[^?#]+') || '?p=1', 2 FROM n WHERE page_id % 2 = 0
UNION ALL SELECT page_id, 'url_template', {ORIGIN} || '/list/{{page}}.htm', n, 0.74, {ORIGIN} || '/list/1.htm', 2 FROM n WHERE page_id % 2 <> 0"""


@query("htm5_ded8_pagination_candidates", PAGER_SQL)
def pagination(spark, d):
    """Every page gets a pager of numeric links built from its own address."""
    pages = read_spread(spark, d, "pages", "page_id", "url", "html")
    base = F.regexp_extract("url", "^https?://[^/]+", 0)
    n = F.col("page_id") % 5 + 2
    by_query = F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: F.concat(F.lit('<a href="?p='), i.cast("string"), F.lit('">'), i.cast("string"), F.lit("</a>")))
    by_path = F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: F.concat(F.lit('<a href="'), base, F.lit("/list/"), i.cast("string"), F.lit('.htm">'), i.cast("string"), F.lit("</a>")))
    pager = F.array_join(F.when(F.col("page_id") % 2 == 0, by_query).otherwise(by_path), " ")
    html = F.concat("html", F.lit("<div>"), pager, F.lit('<a rel="next" href="/more">more</a></div>'))
    rows = O.pagination_candidates(O.links(O.parse(pages.withColumn("html", html))))
    return rows.select("page_id", "mode", "argument", "max_page", "confidence", "sample_url", "rank")


@query("htm6_agg14_pagination_direction", """
WITH n AS (SELECT page_id, CAST(page_id % 9 AS INT) AS k FROM pages)
SELECT page_id, CASE WHEN k = 4 OR k = 8 THEN 0.74::DOUBLE ELSE 0.86 END AS confidence,
 CASE WHEN k = 4 OR k = 8 THEN NULL WHEN k > 4 AND page_id % 2 = 0 THEN 'desc_index' ELSE 'asc' END AS page_order,
 CASE WHEN k = 4 OR k = 8 THEN NULL WHEN k > 4 THEN 'newer_to_older' ELSE 'older_to_newer' END AS direction FROM n""")
def direction(spark, d):
    """Median dates of an entry page (year from the id) against a sample page of 2014."""
    k = F.col("page_id") % 9
    year = (F.lit(2010) + k).cast("string")
    dates = F.when(k == 8, F.lit("no dates")).otherwise(F.concat(F.lit("a 2001-02-03 "), year, F.lit("-05-06 "), year, F.lit("年05月06日 2099.01.01 ")))
    pages = read(spark, d, "pages").select("page_id", "url", F.concat(F.lit("<p>"), dates, F.lit("</p>")).alias("html"))
    medians = O.page_median_day(O.parse(pages)).withColumnRenamed("median_day", "entry_day")
    rows = medians.withColumn("sample_day", F.unix_date(F.lit("2014-05-06").cast("date")).cast("double")).select(
        "page_id", F.when(F.col("page_id") % 2 == 0, "url_template").otherwise("query_param").alias("mode"), F.lit(5).alias("max_page"),
        F.lit(0.74).alias("confidence"), "entry_day", "sample_day",
    )
    return O.pagination_direction(rows).select("page_id", "confidence", "page_order", "direction")


@query("htm7_navigation_candidates", f"""
WITH p AS (SELECT page_id, {ORIGIN} AS o FROM pages)
SELECT page_id, o || '/news/' || CAST(page_id AS STRING) || '?x=1' AS target_url, 0.35::DOUBLE AS score FROM p
UNION ALL SELECT page_id, o || '/plain', 0.65 FROM p UNION ALL SELECT page_id, o || '/archive', 1.0 FROM p WHERE page_id % 2 = 0""")
def navigation(spark, d):
    """Every page gets links with the list words in the address, the text, or both."""
    extra = F.concat(
        F.lit('<p><a href="/news/'), F.col("page_id").cast("string"), F.lit('?x=1#top">x</a><a href="/plain">Blog posts</a><a href="https://other.example/news">news</a>'),
        F.when(F.col("page_id") % 2 == 0, '<a href="/archive">x</a><a href="/archive" title="News">y</a>').otherwise(""),
    )
    pages = read(spark, d, "pages").withColumn("html", F.concat("html", extra))
    return O.navigation_candidates(O.links(O.parse(pages))).select("page_id", "target_url", "score")


@query("src16_feed_candidates", f"""
WITH p AS (SELECT page_id, {ORIGIN} AS o FROM pages)
SELECT page_id, o || '/feeds/' || CAST(page_id AS STRING) || '.xml' AS target_url, CASE WHEN page_id % 2 = 0 THEN 'atom' ELSE 'rss' END AS kind, 0.98::DOUBLE AS confidence FROM p
UNION ALL SELECT page_id, o || f, 'feed', 0.35 FROM p, (VALUES ('/feed'), ('/rss.xml'), ('/atom.xml'), ('/feed.xml')) v(f)""")
def feeds(spark, d):
    declared = F.concat(
        F.lit('<head><link rel="alternate home" type="application/'), F.when(F.col("page_id") % 2 == 0, "atom").otherwise("rss"),
        F.lit('+xml; charset=x" href="/feeds/'), F.col("page_id").cast("string"), F.lit('.xml">'),
    )
    pages = read(spark, d, "pages").withColumn("html", F.replace(F.col("html"), F.lit("<head>"), declared))
    return O.feed_candidates(O.parse(pages)).select("page_id", "target_url", "kind", "confidence")


@query("src16_sitemap_candidates", f"""
SELECT page_id, {ORIGIN} || '/maps/' || CAST(page_id AS STRING) || '.xml' AS target_url, 0.98::DOUBLE AS confidence FROM pages UNION ALL SELECT page_id, {ORIGIN} || '/sitemap.xml', 0.4 FROM pages""")
def sitemaps(spark, d):
    text = F.concat(F.lit("User-agent: *\nDisallow:\nSITEMAP : /maps/"), F.col("page_id").cast("string"), F.lit(".xml # main\nsitemap:\nsitemap: ftp://x/y\n"))
    return O.sitemap_candidates(read(spark, d, "pages").select("page_id", "url", text.alias("robots_text"))).select("page_id", "target_url", "confidence")


@query("str14_attachment_patterns", r"""
WITH urls AS (SELECT DISTINCT l_partkey, l_suppkey % 4 AS k FROM lineitem)
SELECT CASE k WHEN 0 THEN '\.pdf(?:$|[?#])' WHEN 1 THEN '\.docx(?:$|[?#])' WHEN 2 THEN 'download\.jsp' END AS pattern, CASE WHEN k < 2 THEN 0.9::DOUBLE ELSE 0.7 END AS confidence, count(*) AS matches
FROM urls WHERE k < 3 GROUP BY 1, 2""")
def attachment_patterns(spark, d):
    part = F.col("l_partkey").cast("string")
    k = F.col("l_suppkey") % 4
    base = F.lit("https://x.example.com/")
    target = F.when(k == 0, F.concat(base, part, F.lit(".PDF?v=1"))).when(k == 1, F.concat(base, part, F.lit(".docx"))).when(
        k == 2, F.concat(base, F.lit("download.jsp?id="), part)).otherwise(F.concat(base, F.lit("page/"), part))
    links = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("n_id"), target.alias("target"))
    return O.attachment_patterns(links).select("pattern", "confidence", "matches")


@query("jn14_str12_dual_form_pairs", f"""
WITH forms AS (SELECT page_id * 2 AS id, {ORIGIN} || '/info/' || CAST(page_id % 50 AS STRING) || '/' || CAST(page_id AS STRING) || '.htm' AS path_url,
  page_id * 2 + 1 AS qid, {ORIGIN} || '/content.jsp?tree=' || CAST(page_id % 50 AS STRING) || '&id=' || CAST(page_id AS STRING) AS query_url FROM pages)
SELECT id AS left_id, qid AS right_id, path_url, query_url FROM forms WHERE (qid // 2) % 50 <> qid // 2
UNION SELECT id, qid, path_url, query_url FROM forms WHERE (qid // 2) % 50 = qid // 2""")
def dual_forms(spark, d):
    o = F.regexp_extract("url", "^https?://[^/]+", 0)
    tree, page = (F.col("page_id") % 50).cast("string"), F.col("page_id").cast("string")
    pages = read(spark, d, "pages")
    path = pages.select((F.col("page_id") * 2).alias("id"), F.concat(o, F.lit("/info/"), tree, F.lit("/"), page, F.lit(".htm")).alias("url"))
    query_form = pages.select((F.col("page_id") * 2 + 1).alias("id"), F.concat(o, F.lit("/content.jsp?tree="), tree, F.lit("&id="), page).alias("url"))
    return O.dual_form_pairs(path.unionByName(query_form)).select("left_id", "right_id", "path_url", "query_url")


@query("str13_confirm_dual_forms", """
SELECT page_id * 2 AS left_id, page_id * 2 + 1 AS right_id, 0.99::DOUBLE AS confidence FROM pages WHERE length(trim(regexp_replace(html, '<[^>]*>', ' ', 'g'))) >= 80""")
def confirm_dual_forms(spark, d):
    """Each page against its print form (a query address with the same article)."""
    pages = read(spark, d, "pages")
    o = F.regexp_extract("url", "^https?://[^/]+", 0)
    plain = pages.select((F.col("page_id") * 2).alias("page_id"), F.concat(o, F.lit("/a/"), F.col("page_id").cast("string")).alias("url"), "html")
    printed = pages.select((F.col("page_id") * 2 + 1).alias("page_id"), F.concat(o, F.lit("/print?id="), F.col("page_id").cast("string")).alias("url"), F.replace("html", F.lit("<p>"), F.lit("<div>")).alias("html"))
    both = plain.unionByName(printed)
    pairs = O.dual_form_pairs(both.select(F.col("page_id").alias("id"), "url"))
    return O.confirm_dual_forms(pairs, O.article_text(O.parse(both))).select("left_id", "right_id", "confidence")


@query("mth4_page_types")
def page_types(spark, d):
    pages = parsed(spark, d)
    return O.page_types(pages, O.selector_candidates(O.links(pages, with_items=True)))


@query("htm9_onb1_onb3_config_candidates")
def config_candidates(spark, d):
    pages = read_spread(spark, d, "pages", "page_id", "url", "html")
    return configs(pages)


def configs(pages):
    """Pages are parsed once for their links, which are stored, and once for their types."""
    tree = O.parse(pages)
    links = cut_lineage(O.links(tree, with_items=True))
    selectors = cut_lineage(O.selector_candidates(links))
    resources = pages.select("page_id", F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit("/feed"))).alias("feed_url"), F.when(F.col("page_id") % 3 == 1, F.concat("url", F.lit("/sitemap.xml"))).alias("sitemap_url"))
    return O.emit_config(O.config_candidates(O.page_types(tree, selectors), selectors, O.pagination_candidates(links), resources), "campus")


@query("url4_site_slug", """
SELECT page_id, substr(trim(regexp_replace(regexp_replace(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '^www[.]', ''), '[^a-z0-9]+', '-', 'g'), '-'), 1, 63) AS slug FROM pages""")
def site_slug(spark, d):
    from ..functions.urls import site_slug as slug

    return read(spark, d, "pages").select("page_id", slug(F.col("url")).alias("slug"))


@query("onb2_dry_run")
def dry_run(spark, d):
    """Preview: extraction with the error of each item instead of a failed batch."""
    return extract_articles(read(spark, d, "pages"), EXTRACT).select("page_id", "title", F.char_length("content_text").alias("n_chars"), F.size("attachments").alias("n_attachments"), "error")


@query("ded6_last_by_url", """
SELECT user_id AS page_id, 'https://x.example.com/' || event_type AS url, min(event_id) AS position, arg_max(value, event_id) AS confidence FROM events GROUP BY 1, 2""")
def last_by_url(spark, d):
    url = F.concat(F.lit("https://x.example.com/"), "event_type")
    rows = read(spark, d, "events").select(F.col("user_id").alias("page_id"), url.alias("url"), F.col("event_id").alias("position"), F.col("value").alias("confidence"))
    return O.last_by_url(rows)


@query("top12_list_pages", """
SELECT site, position, CAST(rank AS INT) AS rank FROM (SELECT l_suppkey AS site, l_orderkey * 8 + l_linenumber AS position,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY CASE WHEN l_returnflag = 'A' THEN 0 ELSE 1 END, l_discount DESC, l_quantity DESC, l_orderkey * 8 + l_linenumber) AS rank FROM lineitem) x WHERE rank <= 8""")
def list_pages(spark, d):
    kind = F.when(F.col("l_returnflag") == "A", "html_list").otherwise("article")
    rows = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("site"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("position"), kind.alias("page_type"), F.col("l_discount").alias("confidence"), F.col("l_quantity").alias("matches"))
    return O.rank_list_pages(rows).select("site", "position", "rank")


def list_page(n, k, site):
    """A notice list of n items whose classes follow k: the first leads away, the last repeats the second."""
    p = F.col("page_id").cast("string")
    place = lambda i: F.when(i == 0, F.concat(F.lit("https://away.example/"), p)).otherwise(F.concat(F.lit("/a/"), p, F.lit("/"), F.when(i == n - 1, 1).otherwise(i).cast("string"), F.lit(".htm?x=1&amp;y=2")))
    item = lambda i: F.concat(
        F.lit('<li class="row r'), k, F.lit('"><a class="t t'), k, F.lit(' z" href="'), place(i), F.lit('">Title number '), i.cast("string"), F.lit(" of "), p,
        F.lit('</a><a href="mailto:x@y.example">mail</a><span class="d">2024-0'), (i + 1).cast("string"), F.lit("-01</span></li>"),
    )
    items = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), item), "\n")
    return F.concat(F.lit('<title>'), site, F.lit('</title><div id="nav"><a class="t" href="/home">Home</a></div><ul class="list">'), items, F.lit("</ul>"))


def built_lists(spark, d):
    n, k = (F.col("page_id") % 5 + 3).cast("int"), (F.col("page_id") % 3).cast("string")
    return read(spark, d, "pages").select("page_id", "url", list_page(n, k, F.col("url")).alias("html"))


BUILT = f"""
WITH p AS (SELECT page_id, {ORIGIN} AS o, CAST(page_id % 5 + 3 AS INT) AS n, CAST(page_id % 3 AS STRING) AS k FROM pages),
items AS (SELECT *, unnest(range(0, n)) AS i FROM p)"""


@query("htm8_article_urls", BUILT + """, targets AS (
SELECT page_id, i, CASE WHEN i = 0 THEN 'https://away.example/' || CAST(page_id AS STRING) ELSE o || '/a/' || CAST(page_id AS STRING) || '/' || CAST(i AS STRING) || '.htm?x=1&y=2' END AS target FROM items WHERE i < n - 1 OR i = 1)
SELECT page_id, CAST(i + 1 AS INT) AS position, target FROM targets""")
def article_urls(spark, d):
    """Where the best selector found on each list page leads; the selector is data of the page."""
    pages = O.parse(built_lists(spark, d))
    best = O.selector_candidates(O.links(pages, with_items=True)).where("rank = 1")
    return S.article_urls(pages, best)


@query("htm4_mth3_built_lists", BUILT + """
SELECT page_id, 'li.row.r' || k AS item_selector, 'a.t.t' || k || '@href' AS link_selector, 'a.t.t' || k AS title_selector, 'span.d' AS published_at_selector, CAST(n AS BIGINT) AS matches,
 round_even(0.30::DOUBLE * n / 8 + 0.25 + 0.20 * ((n - 1)::DOUBLE / n) + 0.15 + 0.10, 3) AS confidence,
 array_to_string([('Title number ' || CAST(j AS STRING) || ' of ' || CAST(page_id AS STRING)) FOR j IN range(0, 3)], '; ') AS samples,
 printf('%d repeated items; 100%% contain dates; %.0f%% links stay on site', n, (n - 1)::DOUBLE / n * 100) AS evidence
FROM p""")
def built_selectors(spark, d):
    found = O.selector_candidates(O.links(O.parse(built_lists(spark, d)), with_items=True)).where("item_selector LIKE 'li%' AND link_selector LIKE 'a.t%'")
    return found.select("page_id", "item_selector", "link_selector", "title_selector", "published_at_selector", "matches", "confidence", F.array_join("samples", "; ").alias("samples"), "evidence")


@query("htm9_onb1_onb3_built_configs", BUILT + """
SELECT page_id, trim(regexp_replace(regexp_replace(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '^www[.]', ''), '[^a-z0-9]+', '-', 'g'), '-') AS slug, 'Site ' || CAST(page_id AS STRING) AS name, o || '/' AS base_url, false AS enabled, false AS render_js,
 CASE page_id % 3 WHEN 0 THEN 'rss' WHEN 1 THEN 'sitemap' ELSE 'html_list' END AS discovery_mode, url || CASE page_id % 3 WHEN 0 THEN '/feed' WHEN 1 THEN '/sitemap.xml' ELSE '' END AS entry_url,
 CASE WHEN page_id % 3 = 2 THEN 'li.row.r' || k END AS item_selector, CASE WHEN page_id % 3 = 2 THEN 'a.t.t' || k || '@href' END AS link_selector, CASE WHEN page_id % 3 = 2 THEN 'a.t.t' || k END AS title_selector,
 CASE WHEN page_id % 3 = 2 THEN 'span.d' END AS published_at_selector, CASE WHEN page_id % 3 = 2 AND page_id % 2 = 0 THEN 'next_link' END AS pagination_mode,
 CASE WHEN page_id % 3 = 2 AND page_id % 2 = 0 THEN 'a[rel="next"]' END AS pagination_argument, 'campus' AS tagset_group FROM (SELECT p.*, url FROM p JOIN pages USING (page_id)) q""")
def built_configs(spark, d):
    """Feeds before sitemaps before lists; every second page has a next link."""
    return configs(paged_lists(spark, d))


def paged_lists(spark, d, least=3):
    n, k = (F.col("page_id") % 5 + least).cast("int"), (F.col("page_id") % 3).cast("string")
    more = F.when(F.col("page_id") % 2 == 0, '<p><a rel="next" href="/more">more</a></p>').otherwise("")
    html = F.concat(list_page(n, k, F.concat(F.lit("Site "), F.col("page_id").cast("string"))), more)
    return read(spark, d, "pages").select("page_id", "url", html.alias("html"))


@query("mth4_built_pages", """
WITH p AS (SELECT page_id, page_id % 6 AS k, page_id % 5 + 3 AS n FROM pages), c AS (SELECT *, round_even(0.3::DOUBLE * n / 8 + 0.25 + 0.2 + 0.04, 3) AS c FROM p)
SELECT page_id, CASE k WHEN 0 THEN 'likely_spa' WHEN 1 THEN 'navigation' WHEN 2 THEN 'article' WHEN 3 THEN 'article' WHEN 4 THEN 'possible_list' ELSE 'unknown' END AS page_type,
 CASE k WHEN 0 THEN 0.8::DOUBLE WHEN 1 THEN 0.75 WHEN 2 THEN 0.7 WHEN 3 THEN 0.7 WHEN 4 THEN round_even(c * 0.8, 6) ELSE 0.35 END AS confidence, k = 0 AS likely_needs_js FROM c""")
def built_page_types(spark, d):
    """One kind of page for each branch of the decision."""
    p, k = F.col("page_id").cast("string"), F.col("page_id") % 6
    item = lambda i: F.concat(F.lit('<li><a href="/x/'), i.cast("string"), F.lit('">Entry number '), i.cast("string"), F.lit("</a></li>"))
    entries = lambda n: F.array_join(F.transform(F.sequence(F.lit(1), n.cast("int")), item), "")
    body = (
        F.when(k == 0, F.lit('<div id="root"></div><script>a</script>'))
        .when(k == 1, F.concat(F.lit("<ul>"), entries(F.lit(9)), F.lit("</ul>")))
        .when(k == 2, F.concat(F.lit("<div>"), F.repeat(F.lit("some words "), 60), F.lit("</div>")))
        .when(k == 3, F.lit("<p>one</p><p>two</p><p>three</p>"))
        .when(k == 4, F.concat(F.lit("<ul>"), entries(F.col("page_id") % 5 + 3), F.lit("</ul>")))
        .otherwise(F.lit("<div>short</div>"))
    )
    html = F.concat(F.lit("<html><head><title>Page "), p, F.lit("</title></head><body>"), body, F.lit("</body></html>"))
    pages = read(spark, d, "pages").select("page_id", F.concat(F.lit("https://x.example.com/p/"), p).alias("url"), html.alias("html"))
    tree = O.parse(pages)
    return O.page_types(tree, O.selector_candidates(O.links(tree, with_items=True))).select("page_id", "page_type", "confidence", "likely_needs_js")


@query("prj3_onb1_site_findings", """
WITH p AS (SELECT page_id, CAST(page_id % 5 + 1 AS INT) AS n, page_id % 2 = 0 AS paged, url FROM pages), c AS (SELECT *, round_even(0.30::DOUBLE * n / 8 + 0.25 + 0.20 * ((n - 1)::DOUBLE / n) + 0.15 + 0.10, 3) AS c FROM p)
SELECT page_id, 'item_selector' AS key, 'failed' AS confidence, 'no repeated link structure found' AS evidence FROM c WHERE n < 3
UNION ALL SELECT page_id, 'list_pages', 'failed', 'no likely list page found' FROM c WHERE n < 3
UNION ALL SELECT page_id, 'pagination', 'low', 'no pagination links found' FROM c WHERE NOT paged
UNION ALL SELECT page_id, 'feed', 'low', 'no declared or common feed validated' FROM c WHERE page_id % 3 <> 0
UNION ALL SELECT page_id, 'sitemap', 'low', 'no robots/common sitemap validated' FROM c WHERE page_id % 3 <> 1""")
def findings_to_review(spark, d):
    """What the inspection of each page found, and of that what a person has to look at."""
    return O.needs_review(inspected(spark, d)).select("page_id", "key", "confidence", "evidence")


@query("onb1_confident_findings", """
WITH p AS (SELECT page_id, CAST(page_id % 5 + 1 AS INT) AS n, CAST(page_id % 3 AS STRING) AS k, page_id % 2 = 0 AS paged, url FROM pages), c AS (SELECT *, round_even(0.30::DOUBLE * n / 8 + 0.25 + 0.20 * ((n - 1)::DOUBLE / n) + 0.15 + 0.10, 3) AS c FROM p)
SELECT page_id, 'page_type' AS key, CASE WHEN n >= 3 THEN 'html_list' ELSE 'unknown' END AS value, CASE WHEN n >= 3 AND c >= 0.8 THEN 'high' ELSE 'medium' END AS confidence FROM c
UNION ALL SELECT page_id, 'render_js', 'false', 'high' FROM c
UNION ALL SELECT page_id, 'item_selector', 'li.row.r' || k, 'medium' FROM c WHERE n >= 3
UNION ALL SELECT page_id, 'list_pages', url, 'medium' FROM c WHERE n >= 3
UNION ALL SELECT page_id, 'pagination', 'next_link', 'medium' FROM c WHERE paged
UNION ALL SELECT page_id, 'feed', url || '/feed', 'high' FROM c WHERE page_id % 3 = 0
UNION ALL SELECT page_id, 'sitemap', url || '/sitemap.xml', 'high' FROM c WHERE page_id % 3 = 1""")
def confident_findings(spark, d):
    rows = inspected(spark, d)
    return rows.where(F.col("confidence").isin("high", "medium")).select("page_id", "key", "value", "confidence")


def inspected(spark, d):
    pages = paged_lists(spark, d, least=1).withColumn("html", F.regexp_replace("html", "<title>[^<]*</title>", ""))
    tree = O.parse(pages)
    links = cut_lineage(O.links(tree, with_items=True))
    selectors = cut_lineage(O.selector_candidates(links))
    types = cut_lineage(O.page_types(tree, selectors))
    best = selectors.where("rank = 1")
    paging = O.pagination_candidates(links).where("rank = 1")
    k = F.col("page_id") % 3
    return O.site_findings(pages, {
        **O.type_findings(types),
        "item_selector": best.select("page_id", F.col("item_selector").alias("value"), "evidence"),
        "list_pages": types.where("page_type IN ('html_list', 'possible_list')").select("page_id", F.col("url").alias("value"), F.lit("ranked static list/navigation candidates").alias("evidence")),
        "pagination": paging.select("page_id", F.col("mode").alias("value"), F.lit("pagination links").alias("evidence")),
        "feed": pages.where(k == 0).select("page_id", F.concat("url", F.lit("/feed")).alias("value"), F.lit("validated RSS/Atom XML").alias("evidence")),
        "sitemap": pages.where(k == 1).select("page_id", F.concat("url", F.lit("/sitemap.xml")).alias("value"), F.lit("validated sitemap XML").alias("evidence")),
    })


@query("onb1_site_walk", """
WITH p AS (SELECT page_id, page_id % 7 AS site FROM pages),
edges AS (SELECT page_id, page_id + 14 AS t, 1 AS r, 'list keyword in link text, URL' AS evidence FROM p UNION ALL SELECT page_id, page_id + 7, 2, 'list keyword in URL' FROM p UNION ALL SELECT page_id, page_id + 35, 3, 'list keyword in URL' FROM p),
l0 AS (SELECT site, page_id AS id, 0::BIGINT AS position, 'input page' AS evidence FROM p WHERE page_id < 7),
o1 AS (SELECT site, t AS id, min(position * 10 + r) AS place, arg_min(edges.evidence, position * 10 + r) AS evidence FROM l0 JOIN edges ON id = page_id GROUP BY ALL),
l1 AS (SELECT * FROM (SELECT site, id, 1 + row_number() OVER (PARTITION BY site ORDER BY place) - 1 AS position, evidence FROM o1 WHERE id NOT IN (SELECT id FROM l0)) x WHERE position < 8),
o2 AS (SELECT l1.site, t AS id, min(position * 10 + r) AS place, arg_min(edges.evidence, position * 10 + r) AS evidence FROM l1 JOIN edges ON id = page_id GROUP BY ALL),
l2 AS (SELECT * FROM (SELECT site, id, 4 + row_number() OVER (PARTITION BY site ORDER BY place) - 1 AS position, evidence FROM o2 WHERE id NOT IN (SELECT id FROM l0 UNION SELECT id FROM l1)) x WHERE position < 8),
seen AS (SELECT *, 0 AS depth FROM l0 UNION ALL SELECT *, 1 FROM l1 UNION ALL SELECT *, 2 FROM l2)
SELECT seen.site, position, depth, 'https://s' || CAST(seen.site AS STRING) || '.example/news/' || CAST(id AS STRING) AS url, p.page_id, evidence FROM seen LEFT JOIN p ON p.page_id = id""")
def site_walk(spark, d):
    """Seven sites whose pages link to each other; some linked pages were never fetched."""
    place = lambda add: F.concat(F.lit("/news/"), (F.col("page_id") + add).cast("string"))
    html = F.concat(
        F.lit('<a href="'), place(0), F.lit('">self</a><a href="'), place(7), F.lit('">x</a><a href="'), place(14), F.lit('">Campus news</a><a href="'), place(35), F.lit('">y</a><a href="'),
        place(7), F.lit('#again">x</a><a href="https://other.example/news/1">z</a>'),
    )
    site = F.col("page_id") % 7
    url = F.concat(F.lit("https://s"), site.cast("string"), F.lit(".example"), place(0))
    pages = read(spark, d, "pages").select("page_id", site.alias("site"), url.alias("url"), html.alias("html"))
    edges = O.navigation_candidates(O.links(O.parse(pages))).select("page_id", "target_url", "rank", "evidence")
    return W.walk(pages.where("page_id < 7").select("site", "url"), pages, edges, budget=8)


def preview_items(spark, d):
    """Items of 20 sites. Every fourth page is malformed, another fourth has no title, another was not fetched."""
    p, kind = F.col("page_id").cast("string"), F.col("page_id") % 4
    text = F.concat(F.lit("Text of page "), p, F.lit(" "), F.repeat(F.lit("word "), (F.col("page_id") % 70).cast("int")))
    title = F.when(kind != 2, F.concat(F.lit("<h1>Title "), p, F.lit("</h1>"))).otherwise("")
    html = F.concat(F.lit("<html><body>"), title, F.when(kind == 1, "<b>").otherwise(""), F.lit("<p>"), text, F.lit("</p></body></html>"))
    pages = read(spark, d, "pages").select("page_id", F.concat("url", F.lit("/"), p).alias("url"), html.alias("html"))
    items = pages.select((F.col("page_id") % 20).alias("site"), F.col("page_id").alias("position"), "url", F.lit(None).cast("string").alias("title"), F.lit(None).cast("timestamp").alias("published_at"), F.lit(None).cast("string").alias("content_html"))
    return items, pages.where("page_id % 4 <> 3")


PREVIEW = ExtractConfig(selectors={"title": "h1", "content": "p"})
PREVIEW_SQL = """
WITH p AS (SELECT page_id % 20 AS site, page_id AS position, page_id % 4 AS kind, trim('Text of page ' || CAST(page_id AS STRING) || ' ' || repeat('word ', CAST(page_id % 70 AS INT))) AS t,
  row_number() OVER (PARTITION BY page_id % 20 ORDER BY page_id) AS n FROM pages)"""


@query("onb2_preview", PREVIEW_SQL + """
SELECT site, position, kind = 0 AS success, CASE WHEN kind = 0 THEN 'Title ' || CAST(position AS STRING) END AS title, CASE WHEN kind = 0 THEN CAST(length(t) AS INT) END AS content_length, CASE WHEN kind = 0 THEN substr(t, 1, 240) END AS summary,
 CASE kind WHEN 1 THEN 'ParseError' WHEN 2 THEN 'SelectorMiss' WHEN 3 THEN 'PageMissing' END AS error FROM p WHERE n <= 4""")
def preview(spark, d):
    """A strict parser throws on malformed pages; their items fail alone."""
    items, pages = preview_items(spark, d)
    found = W.preview(items, pages, PREVIEW, sample_size=4, parse=H.strict_tree)
    return found.select("site", "position", "success", "title", "content_length", "summary", F.substring_index("error", ":", 1).alias("error"))


@query("onb2_preview_report", PREVIEW_SQL + """
SELECT site, count(*) AS discovered, count(*) FILTER (n <= 4 AND kind = 0) AS succeeded, count(*) FILTER (n <= 4 AND kind <> 0) AS failed FROM p GROUP BY 1""")
def preview_report(spark, d):
    items, pages = preview_items(spark, d)
    return W.preview_report(items, W.preview(items, pages, PREVIEW, sample_size=4, parse=H.strict_tree))
