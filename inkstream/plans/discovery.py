"""Discovery, URL and extraction queries over `pages`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.dates import to_iso
from ..functions.urls import CanonicalConfig, canonical_url, url_hash
from ..operators import bootstrap as B
from ..operators.extraction import AttachmentConfig, ExtractConfig, extract_articles
from ..sources import discovery as D
from .bridge import EPOCH, read, read_spread
from .catalogue import query

ORIGIN = "regexp_extract(url, '^https?://[^/]+')"
# Page text in the sample is escaped with these entities only.
UNESCAPE = "replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', ''''), '&nbsp;', chr(160)), '&amp;', '&')"


@query("src1_html_list", f"""
WITH found AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<li><a href="([^"]+)"', 1)) AS href, unnest(regexp_extract_all(html, '<li><a href="[^"]+">([^<]*)</a>', 1)) AS name,
  generate_subscripts(regexp_extract_all(html, '<li><a href="([^"]+)"', 1), 1) AS k FROM pages),
named AS (SELECT page_id, {ORIGIN} || href AS url, trim({UNESCAPE.format('name')}) AS title, k FROM found)
SELECT page_id, url, CASE WHEN arg_min(title, k) <> '' THEN arg_min(title, k) END AS title FROM named GROUP BY page_id, url""")
def html_list(spark, d):
    config = D.ListConfig(item_selector="nav li", fields={"url": "a@href", "title": "a"})
    return D.html_list(read_spread(spark, d, "pages", "page_id", "url", "html"), config).where("error IS NULL").select("page_id", "url", "title")


def _canonical_sql(strip: str) -> str:
    return f"""
WITH parts AS (SELECT page_id, url, regexp_replace(url, '#.*$', '') AS clean FROM pages),
pieces AS (SELECT page_id, url, lower(regexp_extract(clean, '^(https?)://', 1)) AS scheme, lower(regexp_extract(clean, '^https?://([^/?]+)', 1)) AS host,
  regexp_replace(regexp_extract(clean, '^https?://[^/?]+([^?]*)', 1), '/+', '/', 'g') AS path, regexp_extract(clean, '[?](.*)$', 1) AS q FROM parts),
canon AS (SELECT page_id, url, scheme || '://' || host || CASE WHEN path IN ('', '/') THEN '/' ELSE regexp_replace(path, '/+$', '') END ||
  CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(kept, '&') END AS canonical
 FROM (SELECT *, list_sort(list_filter(string_split(q, '&'), lambda p: p <> '' AND split_part(p, '=', 1) <> '{strip}')) AS kept FROM pieces) p)"""


def canonical_pages(spark, d):
    canonical = canonical_url(CanonicalConfig(strip_params=frozenset({"utm_source"})))
    return read(spark, d, "pages").select("page_id", "url", canonical("url", "url").alias("canonical"))


@query("url1_canonical_url", _canonical_sql("utm_source") + "SELECT page_id, canonical, sha256(canonical) AS url_hash FROM canon")
def url_canonical(spark, d):
    return canonical_pages(spark, d).select("page_id", "canonical", url_hash(F.col("canonical")).alias("url_hash"))


@query("ded1_snk1_new_articles", _canonical_sql("utm_source") + """
SELECT sha256(canonical) AS url_hash, min(page_id) AS page_id, count(*) AS n_seen FROM canon WHERE sha256(canonical) NOT IN
 (SELECT sha256(canonical) FROM canon WHERE url LIKE '%.html') GROUP BY 1""")
def new_articles(spark, d):
    from ..operators.sinks import insert_if_absent

    items = canonical_pages(spark, d).withColumn("url_hash", url_hash(F.col("canonical")))
    stored = items.where(F.col("url").endswith(".html")).select("url_hash").distinct()
    fresh = insert_if_absent(items.select("page_id", "url_hash"), stored, ["url_hash"], order=["page_id"], count_as="n_seen")
    return fresh.select("url_hash", "page_id", "n_seen")


@query("url2_src6_page_urls", f"""
WITH entries AS (SELECT page_id, url AS entry_url, page_id % 4 AS k, 5 AS max_page FROM pages),
steps AS (SELECT *, i AS page_index FROM entries CROSS JOIN range(4) r(i) WHERE k IN (1, 2, 3) OR i = 0)
SELECT page_id, CAST(page_index AS INT) AS page_index, CASE WHEN page_index = 0 THEN entry_url
  WHEN k = 1 THEN {ORIGIN.replace('url', 'entry_url')} || '/list/' || CAST(page_index + 1 AS STRING) || '.html'
  WHEN k = 2 THEN {ORIGIN.replace('url', 'entry_url')} || '/list/' || CAST(max_page - page_index AS STRING) || '.html'
  WHEN regexp_matches(entry_url, '[?&]page=') THEN regexp_replace(entry_url, '([?&]page=)[^&#]*', '\\1' || CAST(page_index + 1 AS STRING))
  ELSE regexp_replace(entry_url, '^([^#?]*)([?][^#]*)?(#.*)?$', '\\1\\2' || CASE WHEN entry_url LIKE '%?%' THEN '&' ELSE '?' END || 'page=' || CAST(page_index + 1 AS STRING) || '\\3') END AS page_url
FROM steps""")
def page_urls(spark, d):
    k = F.col("page_id") % 4
    entries = read(spark, d, "pages").select(
        "page_id", F.col("url").alias("entry_url"),
        F.when(k == 0, "none").when(k == 3, "query_param").otherwise("url_template").alias("mode"), F.lit(4).alias("max_pages"),
        F.concat(F.regexp_extract("url", "^https?://[^/]+", 0), F.lit("/list/{page}.html")).alias("template"), F.lit("page").alias("param"),
        F.when(k == 2, "desc_index").otherwise("asc").alias("page_order"), F.lit(5).alias("max_page"),
    )
    return D.page_urls(entries).select("page_id", "page_index", "page_url")


HISTORY_SQL = f"""
WITH e AS (SELECT page_id, url, {ORIGIN} AS o, CASE page_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'query_param' ELSE 'url_template' END AS mode,
 CASE WHEN page_id % 5 = 0 THEN NULL ELSE page_id % 700 END AS asked, CASE WHEN page_id % 3 = 0 THEN NULL ELSE 3 END AS max_page FROM pages),
j AS (SELECT *, coalesce(asked, max_page) AS n FROM e)"""


def history(spark, d):
    k = F.col("page_id") % 4
    entries = read(spark, d, "pages").select(
        "page_id", F.regexp_replace("url", "[?#].*", "").alias("entry_url"), F.when(k == 0, "none").when(k == 1, "query_param").otherwise("url_template").alias("mode"),
        F.concat(F.regexp_extract("url", "^https?://[^/]+", 0), F.lit("/old/{page}.html")).alias("template"), F.lit("p").alias("param"), F.lit("asc").alias("page_order"),
        F.when(F.col("page_id") % 3 != 0, 3).alias("max_page"), F.when(F.col("page_id") % 5 != 0, F.col("page_id") % 700).alias("asked"),
    )
    return B.history_entries(entries, F.col("asked"))


@query("bst8_history_pages", HISTORY_SQL + """
SELECT page_id, CAST(i AS INT) AS page_index, CASE WHEN i = 0 THEN regexp_replace(url, '[?#].*', '') WHEN mode = 'url_template' THEN o || '/old/' || CAST(i + 1 AS STRING) || '.html'
 ELSE regexp_replace(url, '[?#].*', '') || '?p=' || CAST(i + 1 AS STRING) END AS page_url FROM (SELECT *, unnest(range(0, n)) AS i FROM j WHERE mode <> 'none' AND n BETWEEN 1 AND 500) x""")
def history_pages(spark, d):
    return D.page_urls(history(spark, d)[0]).select("page_id", "page_index", "page_url")


@query("bst8_refused_history", HISTORY_SQL + """
SELECT page_id, CASE WHEN mode = 'none' THEN 'no pagination' ELSE 'pages must be in 1..500' END AS reason FROM j WHERE mode = 'none' OR n IS NULL OR n NOT BETWEEN 1 AND 500""")
def refused_history(spark, d):
    return history(spark, d)[1].select("page_id", "reason")


PAGE_DAY = f"{EPOCH} + (page_id % 30) * 86400"


@query("src3_feed_items", f"""
SELECT page_id, url, 'Item ' || CAST(page_id AS STRING) AS title, strftime(make_timestamp(CAST({PAGE_DAY} AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') AS published_at,
 CASE WHEN length(html) % 4000 >= 500 THEN length(html) % 4000 END AS content_chars FROM pages WHERE page_id % 5 <> 4""")
def feed_items(spark, d):
    day = F.timestamp_seconds(F.expr(PAGE_DAY))
    rss = F.concat(
        F.lit("<rss><channel><item><title>Item "), F.col("page_id").cast("string"), F.lit("</title><link>"), F.replace("url", F.lit("&"), F.lit("&amp;")),
        F.lit("</link><pubDate>"), F.date_format(day, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate><x:encoded xmlns:x='u'>"),
        F.repeat(F.lit("y"), (F.length("html") % 4000).cast("int")), F.lit("</x:encoded></item><item><title>no link</title></item></channel></rss>"),
    )
    atom = F.concat(
        F.lit("<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>Item "), F.col("page_id").cast("string"), F.lit("</title><link rel='self' href='/self'/><link href='"),
        F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("'/><updated>"), F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</updated><content>"),
        F.repeat(F.lit("z"), (F.length("html") % 4000).cast("int")), F.lit("</content></entry></feed>"),
    )
    k = F.col("page_id") % 5
    feeds = read(spark, d, "pages").select("page_id", "url", F.when(k == 4, "<rss><broken>").when(k < 2, rss).otherwise(atom).alias("xml"))
    items = D.feed_items(feeds).where("error IS NULL")
    return items.select("page_id", "url", "title", to_iso(F.col("published_at")).alias("published_at"), F.length("content_html").cast("bigint").alias("content_chars"))


@query("src17_document_kind", """
SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'rss' WHEN 1 THEN 'atom' WHEN 2 THEN 'rss' END AS feed_kind, CASE page_id % 6 WHEN 3 THEN 'urlset' WHEN 4 THEN 'sitemapindex' END AS sitemap_kind FROM pages""")
def document_kind(spark, d):
    body = F.expr("""CASE page_id % 6 WHEN 0 THEN '<?xml version="1.0"?><rss><channel/></rss>' WHEN 1 THEN '<feed xmlns="http://www.w3.org/2005/Atom"/>'
      WHEN 2 THEN '<r:RDF xmlns:r="x"/>' WHEN 3 THEN '<urlset xmlns="s"><url/></urlset>' WHEN 4 THEN '  <sitemapindex/>' ELSE html END""")
    return D.xml_kind(read(spark, d, "pages").select("page_id", body.alias("xml"))).select("page_id", "feed_kind", "sitemap_kind")


# Pages of one root, below the visit limit of a site with its two indexes.
ROOT_PAGES = 90


@query("src4_sitemap_walk", f"""
WITH leaf AS (SELECT page_id, url AS loc, regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) || '-' || CAST(page_id // {ROOT_PAGES} AS STRING) AS site, page_id % 30 AS age FROM pages)
SELECT site, loc AS url, CASE WHEN min(page_id) % 7 = 0 THEN NULL ELSE strftime(make_timestamp(CAST({EPOCH} + (min(page_id) % 30) * 86400 AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') END AS published_at
FROM leaf WHERE page_id % 7 = 0 OR age >= 10 GROUP BY site, loc""")
def sitemap_walk(spark, d):
    """All pages: root index -> index of at most ROOT_PAGES pages -> one urlset per page."""
    site = F.concat(F.regexp_extract("url", "^https?://[^/]+/([a-z]+)/", 1), F.lit("-"), F.expr(f"CAST(page_id div {ROOT_PAGES} AS STRING)"))
    pages = read(spark, d, "pages").select("page_id", "url", site.alias("site"))
    base = F.concat(F.lit("https://maps.example.com/"), "site")
    leaf_url = F.concat(base, F.lit("/"), F.lpad(F.col("page_id").cast("string"), 12, "0"), F.lit(".xml"))
    day = F.date_format(F.timestamp_seconds(F.expr(PAGE_DAY)), "yyyy-MM-dd")
    lastmod = F.when(F.col("page_id") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("<lastmod>"), day, F.lit("</lastmod>")))
    leaves = pages.select(
        leaf_url.alias("url"),
        F.concat(F.lit("<urlset xmlns='s'><url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc>"), lastmod, F.lit("</url></urlset>")).alias("xml"),
    )
    entry = F.concat(F.lit("<sitemap><loc>"), leaf_url, F.lit("</loc></sitemap>"))
    middle = pages.groupBy("site").agg(F.array_join(F.array_sort(F.collect_list(entry)), "").alias("_l"))
    indexes = middle.select(F.concat(base, F.lit("/index.xml")).alias("url"), F.concat(F.lit("<sitemapindex>"), "_l", F.lit("</sitemapindex>")).alias("xml"))
    tops = middle.select(F.concat(base, F.lit("/root.xml")).alias("url"), F.lit("<sitemapindex><sitemap><loc>index.xml</loc></sitemap></sitemapindex>").alias("xml"))
    roots = middle.select("site", F.concat(base, F.lit("/root.xml")).alias("url"))
    items = D.sitemap_walk(roots, leaves.unionByName(indexes).unionByName(tops), cutoff=F.timestamp_seconds(F.lit(EPOCH + 10 * 86400)))
    return items.select("site", "url", to_iso(F.col("published_at")).alias("published_at"))


@query("src5_jsn5_json_items", f"""
SELECT page_id, {ORIGIN} || '/item/' || CAST(page_id AS STRING) AS url, CAST(page_id * 2 AS STRING) AS title, '2024-01-' || lpad(CAST(1 + page_id % 28 AS STRING), 2, '0') || 'T00:00:00+00:00' AS published_at FROM pages WHERE page_id % 6 < 4""")
def json_items(spark, d):
    item = "concat('{\"link\":\"/item/', page_id, '\",\"meta\":{\"names\":[', page_id * 2, ']},\"day\":\"2024-01-', lpad(1 + page_id % 28, 2, '0'), '\"}')"
    body = F.expr(f"""CASE WHEN page_id % 6 = 4 THEN '{{"data":{{"list":5}}}}' WHEN page_id % 6 = 5 THEN 'not json'
      ELSE concat('{{"data":{{"list":[7,{{"link":" "}},', {item}, ']}}}}') END""")
    responses = read(spark, d, "pages").select("page_id", "url", body.alias("body"))
    items = D.json_items(responses, "data.list", {"url": "link", "title": "meta.names.0", "published_at": "day"})
    return items.where("error IS NULL").select("page_id", "url", "title", to_iso(F.col("published_at")).alias("published_at"))


@query("ded12_first_seen_items", f"""
WITH found AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS section, unnest(regexp_extract_all(html, '<li><a href="([^"]+)"', 1)) AS href FROM pages)
SELECT section AS site_id, 'https://lists.example.com' || href AS url, min(page_id) AS page_id FROM found GROUP BY 1, 2""")
def first_seen(spark, d):
    pages = read(spark, d, "pages").select("page_id", "html", F.regexp_extract("url", "^https?://[^/]+/([a-z]+)/", 1).alias("site_id"), F.lit("https://lists.example.com/").alias("url"))
    items = D.html_list(pages, D.ListConfig("nav li", {"url": "a@href"}))
    with_site = items.join(pages.select("page_id", "site_id"), "page_id").select("site_id", "url", "page_id", "position")
    return D.first_seen(with_site, ["page_id", "position"]).select("site_id", "url", "page_id")


@query("ded7_pending_union", """
WITH found AS (SELECT doc_id AS id, source FROM documents WHERE n_chars > 400), pend AS (SELECT doc_id AS id, source FROM documents WHERE n_chars < 800)
SELECT id, source FROM found UNION ALL SELECT id, source FROM pend WHERE id NOT IN (SELECT id FROM found)""")
def pending_union(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("url"), F.col("doc_id").alias("id"), F.col("source").alias("site_id"), "n_chars")
    merged = D.not_yet_seen(docs.where("n_chars < 800").drop("n_chars"), docs.where("n_chars > 400").drop("n_chars"))
    return merged.select("id", F.col("site_id").alias("source"))


EXTRACT = ExtractConfig(
    selectors={"content": "article", "title": "article h1", "published_at_regex": r"(20\d{2}-\d{2}-\d{2})"}, strip_selectors=("div.ad",),
    attachments=AttachmentConfig(link_patterns=(r"\.pdf$", "/th"), text_patterns=("the",), max_per_article=5),
)


@query("htm1_extract_articles", f"""
SELECT page_id, nullif(trim({UNESCAPE.format("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")}), '') AS title, regexp_extract(html, '<html lang="([a-z]+)', 1) AS lang,
 CAST(NULL AS VARCHAR) AS author, nullif(regexp_extract(regexp_replace(regexp_replace(html, '<(script|style|template)[^>]*>.*?</(script|style|template)>', ' ', 'gs'), '<[^>]*>', ' ', 'g'), '(20\\d{{2}}-\\d{{2}}-\\d{{2}})', 1), '') || 'T00:00:00+00:00' AS published_at FROM pages""")
def extract(spark, d):
    found = extract_articles(read_spread(spark, d, "pages", "page_id", "url", "html"), EXTRACT)
    return found.select("page_id", "title", "lang", "author", to_iso(F.col("published_at")).alias("published_at"))


@query("htm1_article_text", f"""
WITH body AS (SELECT page_id, regexp_replace(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), '<!--.*?-->', '', 'gs') AS inner_html FROM pages),
pieces AS (SELECT page_id, list_filter(list_transform(regexp_split_to_array(inner_html, '<[^>]*>'), lambda x: trim({UNESCAPE.format('x')}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))), lambda x: x <> '') AS parts FROM body)
SELECT page_id, array_to_string(parts, chr(10)) AS content_text FROM pieces""")
def article_text(spark, d):
    return extract_articles(read_spread(spark, d, "pages", "page_id", "url", "html"), ExtractConfig(selectors={"content": "article", "title": "title"})).select("page_id", "content_text")


@query("arr2_attachments", f"""
WITH found AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<li><a href="([^"]+)"', 1)) AS href, unnest(regexp_extract_all(html, '<li><a href="[^"]+">([^<]*)</a>', 1)) AS name,
  generate_subscripts(regexp_extract_all(html, '<li><a href="([^"]+)"', 1), 1) AS k FROM pages),
hits AS (SELECT page_id, {ORIGIN} || href AS source_url, nullif(trim({UNESCAPE.format('name')}), '') AS filename, k FROM found WHERE regexp_matches(href, '[.]pdf$|/th', 'i')),
uniq AS (SELECT page_id, source_url, arg_min(filename, k) AS filename, min(k) AS k FROM hits GROUP BY 1, 2)
SELECT page_id, CAST(rk - 1 AS INT) AS position, source_url, filename, false AS is_body FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY k) AS rk FROM uniq) x WHERE rk <= 5""")
def attachments(spark, d):
    found = extract_articles(read_spread(spark, d, "pages", "page_id", "url", "html"), EXTRACT).select("page_id", F.posexplode("attachments").alias("position", "a"))
    return found.select("page_id", "position", "a.source_url", "a.filename", "a.is_body")


ESCAPED = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query("htm3_sanitize_html", f"""
SELECT doc_id, md5('<div><p>' || t || '</p><a href="https://e.example.com/doc?id=1&amp;copy=2" rel="noopener noreferrer">' || t || '</a><img alt="i">' || t || '</div>') AS clean_md5
FROM (SELECT doc_id, {ESCAPED.format("text")} AS t FROM documents) x""")
def sanitize(spark, d):
    """Whole texts inside allowed, forbidden and unknown elements, with harmful attributes and addresses."""
    t = H.escaped(F.col("text"))
    html = F.concat(
        F.lit('<div class="c"><p onclick="x()">'), t, F.lit('</p><script>alert("'), F.lit('1")</script><![odd[section]]><a href="/doc?id=1&amp;copy=2" target="_blank">'), t,
        F.lit('</a><img src="javascript:x" alt="i"><blink>'), t, F.lit("</blink></div>"),
    )
    rows = read(spark, d, "documents").select("doc_id", html.alias("html"), F.lit("https://e.example.com/a/").alias("base"))
    return rows.select("doc_id", F.md5(H.sanitize_html("html", "base")).alias("clean_md5"))


@query("htm2_attachment_fallback", """
WITH p AS (SELECT page_id, CAST(page_id AS STRING) AS p, CAST(page_id % 4 AS INT) AS n, 'Body ' || CAST(page_id AS STRING) || repeat(' word', CAST(page_id % 20 AS INT)) AS t FROM pages),
j AS (SELECT *, [('https://f.example.com/' || p || '-' || CAST(i AS STRING) || '.pdf?a=1&b=2') FOR i IN range(0, n)] AS urls, [CASE WHEN i = 1 THEN '附件' ELSE 'File <' || CAST(i AS STRING) || '>' END FOR i IN range(0, n)] AS names FROM p)
SELECT page_id, CASE WHEN length(t) < 60 AND n > 0 THEN t || chr(10) || '正文见附件：' || array_to_string(names, '、') ELSE t END AS content_text,
 CASE WHEN length(t) < 60 AND n = 0 THEN 'ContentTooShort' END AS error,
 CASE WHEN length(t) < 60 AND n > 0 THEN array_to_string([('<li><a href="' || replace(urls[i], '&', '&amp;') || '">' || replace(replace(names[i], '<', '&lt;'), '>', '&gt;') || '</a></li>') FOR i IN range(1, n + 1)], '') ELSE '' END AS listed FROM j""")
def attachment_fallback(spark, d):
    """Short texts name their files, whose links follow the text; long ones and pages without files stay as they are."""
    p = F.col("page_id").cast("string")
    link = lambda i: F.concat(F.lit('<a href="https://f.example.com/'), p, F.lit("-"), i.cast("string"), F.lit('.pdf?a=1&amp;b=2">'), F.when(i == 1, "").otherwise(F.concat(F.lit("File &lt;"), i.cast("string"), F.lit("&gt;"))), F.lit("</a>"))
    n = (F.col("page_id") % 4).cast("int")
    links = F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), link), " ")).otherwise("")
    html = F.concat(F.lit("<html><body><h1>Title</h1><article><p>Body "), p, F.repeat(F.lit(" word"), (F.col("page_id") % 20).cast("int")), F.lit("</p></article><div>"), links, F.lit("</div></body></html>"))
    config = ExtractConfig(selectors={"title": "h1", "content": "article"}, min_content_length=60, attachments=AttachmentConfig(link_patterns=(r"\.pdf",)))
    found = extract_articles(read(spark, d, "pages").select("page_id", "url", html.alias("html")), config)
    items = F.regexp_extract_all(F.regexp_replace("content_html", ' rel="[^"]*"', ""), F.lit("<li>.*?</li>"), F.lit(0))
    return found.select("page_id", "content_text", "error", F.array_join(items, "").alias("listed"))


@query("htm1_main_text", """
WITH p AS (SELECT page_id, CAST(page_id % 4 + 2 AS INT) AS n FROM pages)
SELECT page_id, array_to_string([('Paragraph ' || CAST(i AS STRING) || ' of page ' || CAST(page_id AS STRING) || repeat(' and more words', CAST((page_id + i) % 9 + 3 AS INT)) || '.') FOR i IN range(0, n)], chr(10)) AS content_text,
 'Page ' || CAST(page_id AS STRING) AS title FROM p""")
def main_text(spark, d):
    """Pages without article, main or a selector: link lists, a menu and short notes around the paragraphs."""
    p = F.col("page_id").cast("string")
    paragraph = lambda i: F.concat(F.lit("<p>Paragraph "), i.cast("string"), F.lit(" of page "), p, F.repeat(F.lit(" and more words"), ((F.col("page_id") + i) % 9 + 3).cast("int")), F.lit(".</p>"))
    links = F.array_join(F.transform(F.sequence(F.lit(1), (F.col("page_id") % 13 + 4).cast("int")), lambda i: F.concat(F.lit('<li><a href="/l/'), i.cast("string"), F.lit('">A headline of another page that is long enough</a></li>'))), "")
    html = F.concat(
        F.lit("<html><head><title>Page "), p, F.lit("</title><style>p { margin: 0 }</style></head><body><nav>Menu of the site with quite a few words in it, which is no main text at all</nav><div><ul>"), links,
        F.lit("</ul></div><div><div>"), F.array_join(F.transform(F.sequence(F.lit(0), (F.col("page_id") % 4 + 1).cast("int")), paragraph), "\n"), F.lit("</div><div><ul>"), links,
        F.lit('</ul></div></div><div>Contact</div><script>var s = "words words words words words words";</script></body></html>'),
    )
    found = extract_articles(read(spark, d, "pages").select("page_id", "url", html.alias("html")), ExtractConfig())
    return found.select("page_id", "content_text", "title")
