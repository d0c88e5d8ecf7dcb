"""Site inspection: repeated link structures, pagination, resources and page types.

Links and their surroundings are exploded once; everything after that is grouping by page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import html as H
from ..functions import urls as U
from ..functions.alignment import similarity
from ..functions.dates import PAGE_DATE, let, page_date_days
from ..session import cut_lineage

# Fixed words, types and extensions of the inspection rules.
SAFE_CLASS = r"^-?[_a-zA-Z][_a-zA-Z0-9-]*$"
NEXT_TEXT = r"(?i)^(?:next|next page|下一页|下页|后一页|后页|›|»|>)$"
PAGE_WORDS = r"(?i)通知|公告|新闻|列表|blog|posts?|news|archive"
NAVIGATION_WORDS = r"(?i)通知|公告|新闻|动态|资讯|列表|博客|文章|news|notice|blog|posts?|archive|updates?"
FEED_TYPES = ("application/atom+xml", "application/rss+xml")
COMMON_FEEDS = ("feed", "rss.xml", "atom.xml", "feed.xml")
ATTACHMENT_EXTENSIONS = "csv doc docx gz pdf ppt pptx rar tar xls xlsx zip".split()
DOWNLOAD_NAME = r"(?i)(?:attach|download|file)"
MIN_ROWS, MAX_ROWS = 3, 100


def parse(pages: DataFrame) -> DataFrame:
    """Adds `nodes`; keep the result when several inspections follow."""
    return pages.withColumn("nodes", H.dom("html"))


def _classes(node: Column) -> Column:
    return F.filter(F.split(F.coalesce(node["attrs"]["class"], F.lit("")), r"\s+"), lambda c: c.rlike(SAFE_CLASS))


def _wanted(node: Column) -> Column:
    return F.slice(_classes(node), 1, 2)


def css_part(node: Column) -> Column:
    """Tag with its first two plain classes."""
    return F.concat(node["tag"], F.array_join(F.transform(_wanted(node), lambda c: F.concat(F.lit("."), c)), ""))


def links(parsed: DataFrame, *, with_items: bool = False) -> DataFrame:
    """One row per link: page_id, url, n_id, up, href, title, text, spaced_text, rel, css, target.

    `with_items` adds `above`: the up to three elements around the link that could be its list item.
    """
    nodes = F.col("nodes")

    def facts(a: Column, page: Column | None) -> Column:
        fields = [
            a["id"].alias("n_id"), a["up"].alias("up"), a["attrs"]["href"].alias("href"), a["attrs"]["title"].alias("title"),
            H.text_of(nodes, a, "").alias("text"), H.text_of(nodes, a, " ").alias("spaced_text"),
            F.split(F.lower(F.coalesce(a["attrs"]["rel"], F.lit(""))), r"\s+").alias("rel"), css_part(a).alias("css"),
        ]
        if page is not None:
            fields.append(_items_above(nodes, a, page).alias("above"))
        return F.struct(*fields)

    anchors = H.select(nodes, "a[href]")
    if with_items:
        # What concerns the whole page is bound once, so that no link computes it again.
        page = F.struct(_dated_elements(nodes).alias("dated"), _item_kinds(nodes).alias("kinds"))
        per_link = let(page, lambda p: F.transform(anchors, lambda a: facts(a, p)))
    else:
        per_link = F.transform(anchors, lambda a: facts(a, None))
    found = parsed.withColumn("_links", per_link)
    found = found.withColumn("_abs", U.absolute_urls(F.col("url"), F.col("_links.href")))
    rows = found.select("page_id", "url", F.explode(F.arrays_zip("_links", "_abs")).alias("l"))
    return rows.select("page_id", "url", "l._links.*", F.col("l._abs").alias("target"))


def _same_host(target: Column, url: Column) -> Column:
    scheme = F.lower(F.try_parse_url(target, F.lit("PROTOCOL")))
    return F.coalesce(scheme.isin("http", "https") & (U.host_of(target) == U.host_of(url)), F.lit(False))


def _dated_elements(nodes: Column) -> Column:
    """Innermost elements with a date in their own text."""
    dated_texts = F.filter(nodes, lambda n: (n["tag"] == "#text") & n["text"].rlike(PAGE_DATE))
    holders = F.transform(dated_texts, lambda t: F.get(nodes, t["up"]))
    return let(holders, lambda all_: F.filter(all_, lambda e: ~F.exists(all_, lambda o: (o["id"] > e["id"]) & (o["id"] <= e["last"]))))


def _chain(nodes: Column, a: Column) -> Column:
    """The up to three elements around a link that could be its list item, innermost first."""
    first = F.get(nodes, a["up"])
    second = F.get(nodes, first["up"])
    chain = F.array(first, second, F.get(nodes, second["up"]))

    def outside(p: Column) -> Column:
        return p.isNull() | p["tag"].isin("html", "body")

    return let(chain, lambda c: F.filter(c, lambda p, i: ~F.exists(F.slice(c, F.lit(1), i + 1), outside)))


def _item_kinds(nodes: Column) -> Column:
    """Selector of every kind of element around links -> number of elements of the page that it selects.

    Kinds are few on a page, so each is counted once however many links it surrounds.
    """
    kind = lambda p: F.struct(css_part(p).alias("css"), p["tag"].alias("tag"), _wanted(p).alias("wanted"))
    around = F.flatten(F.transform(H.select(nodes, "a[href]"), lambda a: F.transform(_chain(nodes, a), kind)))
    slim = F.transform(nodes, lambda n: F.struct(n["tag"].alias("tag"), F.split(F.coalesce(n["attrs"]["class"], F.lit("")), r"\s+").alias("classes")))

    def counted(kinds: Column, all_: Column) -> Column:
        # A tag with dots in its name can spell another kind's selector; the first one stands.
        first = F.filter(kinds, lambda k, i: ~F.exists(F.slice(kinds, F.lit(1), i), lambda o: o["css"] == k["css"]))
        selects = lambda k, n: (n["tag"] == k["tag"]) & (F.size(F.array_except(k["wanted"], n["classes"])) == 0)
        return F.map_from_entries(F.transform(first, lambda k: F.struct(k["css"], F.size(F.filter(all_, lambda n: selects(k, n))))))

    return let(slim, lambda all_: let(F.array_distinct(around), lambda kinds: counted(kinds, all_)))


def _items_above(nodes: Column, a: Column, page: Column) -> Column:
    """Candidate items around a link: item_css, item_id, level, n_matching, date_css."""

    def describe(p: Column, level: Column) -> Column:
        dates = F.filter(page["dated"], lambda d: (d["id"] > p["id"]) & (d["id"] <= p["last"]))
        css = css_part(p)
        return F.struct(
            css.alias("item_css"), p["id"].alias("item_id"), level.alias("level"), F.try_element_at(page["kinds"], css).alias("n_matching"),
            F.array_distinct(F.transform(dates, css_part)).alias("date_css"),
        )

    return F.transform(_chain(nodes, a), describe)


def selector_candidates(link_rows: DataFrame, *, top: int = 5) -> DataFrame:
    """Ranked repeated link-bearing structures of every page; needs links with their items."""
    facts = link_rows.select(
        "page_id", "n_id", F.col("css").alias("link_css"), "text", "title", _same_host(F.col("target"), F.col("url")).alias("same_site"),
        F.explode("above").alias("_item"),
    )
    joined = facts.select("*", "_item.*").drop("_item")
    group = ["page_id", "item_css", "link_css"]
    # An item that holds several links of this kind is represented by its last one.
    fact = F.struct("text", "title", "same_site", "date_css", "n_matching", "level")
    items = joined.groupBy(*group, "item_id").agg(F.max_by(fact, "n_id").alias("f"), F.min("n_id").alias("pos")).select(*group, "pos", "f.*")
    shown = F.substring(F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("text")), 1, 100)
    title_length, text_length = F.char_length(F.coalesce("title", F.lit(""))), F.char_length("text")
    longer = (title_length > text_length) & (F.col("text").rlike(r"(\.\.\.|…)$") | (title_length >= text_length * 1.2))
    sampled = items.withColumn("_shown", shown)
    grouped = sampled.groupBy(*group).agg(
        F.count(F.lit(1)).alias("matches"), F.any_value("n_matching").alias("n_matching"), F.min(F.struct("pos", "level")).alias("_first"),
        F.count_if(F.col("_shown") != "").alias("_texts"), F.count_if(F.char_length("_shown").between(4, 120)).alias("_useful"),
        F.count_if("same_site").alias("_same"), F.count_if(longer).alias("_longer"),
        F.slice(F.array_sort(F.collect_list(F.when(F.col("_shown") != "", F.struct("pos", "_shown")))), 1, 3).alias("_samples"),
        F.flatten(F.collect_list("date_css")).alias("_css"),
    ).where((F.col("matches").between(MIN_ROWS, MAX_ROWS)) & (F.col("matches") == F.col("n_matching")) & (F.col("_texts") > 0))
    # All rows of a group lie on one page, so the gathered selectors are bounded by the page.
    most_frequent = F.array_min(
        F.transform(F.array_distinct("_css"), lambda c: F.struct((-F.size(F.filter("_css", lambda x: x == c))).alias("_n"), c.alias("date_css")))
    )
    full = grouped.withColumn("_d", most_frequent)
    n = F.col("matches")
    date_ratio = F.coalesce(-F.col("_d._n") / n, F.lit(0.0))
    same = F.col("_same") / n
    confidence = F.bround(
        F.lit(0.30) * F.least(n / 8, F.lit(1.0)) + F.lit(0.25) * (F.col("_useful") / F.col("_texts")) + F.lit(0.20) * same
        + F.lit(0.15) * date_ratio + F.lit(0.10) * F.when(F.col("item_css").contains("."), 1.0).otherwise(0.4),
        3,
    )
    title_css = F.when(F.col("_longer") > n / 2, F.concat("link_css", F.lit("@title"))).otherwise(F.col("link_css"))
    evidence = F.format_string("%d repeated items; %.0f%% contain dates; %.0f%% links stay on site", n, date_ratio * 100, same * 100)
    ranked = full.select(
        "page_id", F.col("item_css").alias("item_selector"), F.concat("link_css", F.lit("@href")).alias("link_selector"), title_css.alias("title_selector"),
        F.col("_d.date_css").alias("published_at_selector"), confidence.alias("confidence"), "matches",
        F.transform("_samples", lambda s: s["_shown"]).alias("samples"), evidence.alias("evidence"), "_first",
    )
    return top_per_page(ranked, [F.col("confidence").desc(), F.col("matches").desc(), F.col("_first")], top).drop("_first")


def top_per_page(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def pagination_candidates(link_rows: DataFrame, *, top: int = 5) -> DataFrame:
    """Explicit next links, and numeric links that vary a query parameter or a path number."""
    is_next = F.array_contains("rel", "next")
    explicit = link_rows.where(is_next | F.col("text").rlike(NEXT_TEXT)).select(
        "page_id", F.lit("next_link").alias("mode"),
        F.when(is_next, F.lit('a[rel="next"]')).otherwise(F.col("css")).alias("argument"), F.lit(None).cast("bigint").alias("max_page"),
        F.when(is_next, 0.95).otherwise(0.82).alias("confidence"), F.col("target").alias("sample_url"), F.col("n_id").alias("_pos"),
    )
    numbered = link_rows.where(F.col("text").rlike(r"^\d+$")).withColumn("_page", F.col("text").try_cast("bigint")).where("_page IS NOT NULL")
    sample = F.min_by("target", F.struct("_page", "n_id"))
    pairs = numbered.select("*", F.explode(U.query_pairs(F.col("target"))).alias("_p"))
    by_param = (
        pairs.where(F.col("_p.value").rlike(r"^\d+$") & (F.col("_p.value").try_cast("bigint") == F.col("_page")))
        .groupBy("page_id", F.col("_p.key").alias("argument"))
        .agg(F.countDistinct("_page").alias("_pages"), sample.alias("sample_url"), F.min("n_id").alias("_pos"))
        .select("page_id", F.lit("query_param").alias("mode"), "argument", F.lit(None).cast("bigint").alias("max_page"), F.lit(0.78).alias("confidence"), "sample_url", "_pos", "_pages")
    )
    path = F.try_parse_url("target", F.lit("PATH"))
    pattern = F.concat(F.lit(r"^(.*?)(?<!\d)"), F.col("_page").cast("string"), F.lit(r"(?!\d)"))
    origin = F.regexp_extract("target", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    query = F.try_parse_url("target", F.lit("QUERY"))
    template = F.concat(origin, F.regexp_replace(path, pattern, F.lit("$1{page}")), F.coalesce(F.concat(F.lit("?"), query), F.lit("")))
    by_path = (
        numbered.withColumn("argument", template)
        .where(F.col("argument").contains("{page}"))
        .groupBy("page_id", "argument")
        .agg(F.countDistinct("_page").alias("_pages"), F.max("_page").alias("max_page"), sample.alias("sample_url"), F.min("n_id").alias("_pos"))
        .select("page_id", F.lit("url_template").alias("mode"), "argument", "max_page", F.lit(0.74).alias("confidence"), "sample_url", "_pos", "_pages")
    )
    numeric = by_param.unionByName(by_path).where("_pages >= 2").drop("_pages")
    # Per configuration the most confident suggestion stays, ties keep the first.
    best = explicit.unionByName(numeric).groupBy("page_id", "mode", "argument", "max_page").agg(
        F.min_by(F.struct("confidence", "sample_url", "_pos"), F.struct((-F.col("confidence")).alias("_c"), "_pos")).alias("_b")
    )
    kind = F.when(F.col("mode") == "next_link", 0).when(F.col("mode") == "query_param", 1).otherwise(2)
    rows = best.select("page_id", "mode", "argument", "max_page", "_b.*")
    return top_per_page(rows, [F.col("confidence").desc(), kind, F.col("_pos")], top).drop("_pos")


def median_of(days: Column) -> Column:
    ordered, n = F.array_sort(days), F.size(days)
    upper, lower = F.get(ordered, (n / 2).cast("int")), F.get(ordered, ((n - 1) / 2).cast("int"))
    return F.when(n > 0, (upper + lower) / 2.0)


def page_median_day(parsed: DataFrame) -> DataFrame:
    nodes = F.col("nodes")
    return parsed.select("page_id", median_of(page_date_days(H.text_of(nodes, H.page_of(nodes)))).alias("median_day"))


def pagination_direction(candidates: DataFrame) -> DataFrame:
    """Adds page_order and direction from the median dates of the entry and the sample page.

    Input: mode, max_page, confidence, entry_day, sample_day.
    """
    known = F.col("entry_day").isNotNull() & F.col("sample_day").isNotNull() & (F.col("entry_day") != F.col("sample_day"))
    newest_first = F.col("entry_day") > F.col("sample_day")
    descending = (F.col("mode") == "url_template") & (F.coalesce("max_page", F.lit(0)) > 0) & newest_first
    return candidates.select(
        "*",
        F.when(known, F.when(descending, "desc_index").otherwise("asc")).alias("page_order"),
        F.when(known, F.when(newest_first, "newer_to_older").otherwise("older_to_newer")).alias("direction"),
    ).withColumn("confidence", F.when(known, F.bround(F.least(F.lit(0.98), F.col("confidence") + 0.12), 3)).otherwise(F.col("confidence")))


def navigation_candidates(link_rows: DataFrame, *, top: int = 16) -> DataFrame:
    """Same-site links whose text or address looks like a list page, best score per address."""
    query = F.coalesce(F.try_parse_url("target", F.lit("QUERY")), F.lit(""))
    path = F.coalesce(F.try_parse_url("target", F.lit("PATH")), F.lit(""))
    address = F.concat(
        F.regexp_extract("target", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.when(path == "", "/").otherwise(path),
        F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)),
    )
    title = F.substring(F.coalesce(F.nullif("title", F.lit("")), "spaced_text"), 1, 100)
    rows = (
        link_rows.where(_same_host(F.col("target"), F.col("url")))
        .select("page_id", address.alias("target_url"), title.alias("title"), "n_id", F.concat(path, F.lit("?"), query).alias("_place"))
        .withColumn("_text_hit", F.col("title").rlike(NAVIGATION_WORDS))
        .withColumn("_url_hit", F.col("_place").rlike(NAVIGATION_WORDS))
        .where("_text_hit OR _url_hit")
    )
    score = F.bround(F.when(F.col("_text_hit"), 0.65).otherwise(0.0) + F.when(F.col("_url_hit"), 0.35).otherwise(0.0), 2)
    evidence = F.concat(F.lit("list keyword in "), F.concat_ws(", ", F.when(F.col("_text_hit"), "link text"), F.when(F.col("_url_hit"), "URL")))
    scored = rows.select("page_id", "target_url", "title", "n_id", score.alias("score"), evidence.alias("evidence"))
    best = scored.groupBy("page_id", "target_url").agg(
        F.min_by(F.struct("title", "score", "evidence"), F.struct((-F.col("score")).alias("_s"), "n_id")).alias("_b"), F.min("n_id").alias("_pos")
    )
    return top_per_page(best.select("page_id", "target_url", "_b.*", "_pos"), [F.col("score").desc(), F.col("_pos")], top).drop("_pos")


def feed_candidates(parsed: DataFrame) -> DataFrame:
    """Declared feeds (0.98), then conventional addresses (0.35)."""
    nodes = F.col("nodes")
    media = lambda n: F.trim(F.substring_index(F.lower(F.coalesce(n["attrs"]["type"], F.lit(""))), ";", 1))
    declared = F.filter(
        H.select(nodes, "link[href]"),
        lambda n: F.array_contains(F.split(F.lower(F.coalesce(n["attrs"]["rel"], F.lit(""))), r"\s+"), "alternate") & media(n).isin(*FEED_TYPES),
    )
    found = F.transform(declared, lambda n: F.struct(
        n["attrs"]["href"].alias("href"), F.when(media(n).contains("atom"), "atom").otherwise("rss").alias("kind"), F.lit(0.98).alias("confidence"),
        F.concat(F.lit("declared as "), media(n)).alias("evidence"),
    ))
    common = F.array(*[
        F.struct(F.lit("/" + p).alias("href"), F.lit("feed").alias("kind"), F.lit(0.35).alias("confidence"), F.lit(f"common /{p} path").alias("evidence"))
        for p in COMMON_FEEDS
    ])
    both = parsed.withColumn("_f", F.concat(found, common))
    both = both.withColumn("_u", U.absolute_urls(F.col("url"), F.col("_f.href")))
    rows = both.select("page_id", F.posexplode(F.arrays_zip("_u", "_f")).alias("_pos", "_x")).select("page_id", "_pos", F.col("_x._u").alias("target_url"), "_x._f.*")
    web = rows.where(F.col("target_url").rlike("(?i)^https?:"))
    first = F.min_by(F.struct("kind", "confidence", "evidence"), "_pos")
    return web.groupBy("page_id", "target_url").agg(first.alias("_b")).select("page_id", "target_url", "_b.*")


def sitemap_candidates(robots: DataFrame) -> DataFrame:
    """Sitemap directives of (page_id, url, robots_text), and the conventional address."""
    lines = F.split("robots_text", r"\r\n|\r|\n")
    directive = F.filter(lines, lambda x: F.lower(F.trim(F.substring_index(x, ":", 1))) == "sitemap")
    values = F.transform(directive, lambda x: F.trim(F.substring_index(F.regexp_replace(x, "^[^:]*:", ""), "#", 1)))
    declared = F.transform(F.filter(values, lambda v: v != ""), lambda v: F.struct(v.alias("href"), F.lit(0.98).alias("confidence"), F.lit("robots.txt Sitemap directive").alias("evidence")))
    common = F.array(F.struct(F.lit("/sitemap.xml").alias("href"), F.lit(0.4).alias("confidence"), F.lit("common /sitemap.xml path").alias("evidence")))
    both = robots.withColumn("_f", F.concat(declared, common))
    both = both.withColumn("_u", U.absolute_urls(F.col("url"), F.col("_f.href")))
    rows = both.select("page_id", F.posexplode(F.arrays_zip("_u", "_f")).alias("_pos", "_x")).select("page_id", "_pos", F.col("_x._u").alias("target_url"), "_x._f.*")
    first = F.min_by(F.struct("confidence", "evidence"), "_pos")
    web = rows.where(F.col("target_url").rlike("(?i)^https?:"))
    return web.groupBy("page_id", "target_url").agg(first.alias("_b")).select("page_id", "target_url", "_b.*")


def attachment_patterns(link_rows: DataFrame) -> DataFrame:
    """File extensions and download-like endpoint names over all sampled pages."""
    name = F.regexp_extract(F.coalesce(F.try_parse_url("target", F.lit("PATH")), F.lit("")), r"([^/]*)$", 1)
    suffix = F.lower(F.regexp_extract("_name", r"\.([^.]*)$", 1))
    quoted = F.regexp_replace("_name", r"([^\w])", r"\\$1")
    pattern = F.when(suffix.isin(ATTACHMENT_EXTENSIONS), F.concat(F.lit(r"\."), suffix, F.lit("(?:$|[?#])"))).when(
        F.col("_name").rlike(DOWNLOAD_NAME), quoted
    )
    hits = link_rows.withColumn("_name", name).withColumn("pattern", pattern).where("pattern IS NOT NULL")
    per_url = hits.groupBy("pattern", "target").agg(F.min(F.struct("page_id", "n_id")).alias("_at"))
    # Only the three earliest addresses survive the aggregate, however many match.
    order = F.struct("_at", "target")
    grouped = per_url.groupBy("pattern").agg(F.count(F.lit(1)).alias("matches"), F.min(order).alias("_first"))
    by_extension = F.col("pattern").startswith("\\.")
    return grouped.select(
        "pattern", F.when(by_extension, 0.9).otherwise(0.7).alias("confidence"), "matches", F.col("_first.target").alias("sample"),
        F.when(by_extension, "file extension").otherwise("download-like endpoint name").alias("evidence"),
    )


def dual_form_pairs(urls: DataFrame) -> DataFrame:
    """Pairs of a path form and a query form that carry the same numbers on one host.

    Input: id, url (distinct urls). The numbers of the path must equal, in order, the query values
    that occur among them. Candidates meet on (host, first path number), so an address gives a row per
    numeric value; the whole sequence is compared afterwards.
    """
    base = urls.select("id", "url", U.host_of(F.col("url")).alias("host"), U.path_numbers(F.col("url")).alias("numbers"), U.query_pairs(F.col("url")).alias("pairs"),
                       (F.coalesce(F.try_parse_url("url", F.lit("QUERY")), F.lit("")) == "").alias("_plain"))
    values = F.transform("pairs", lambda p: p["value"])
    path_form = base.where(F.size("numbers") > 0).select("host", F.get("numbers", 0).alias("first"), F.col("numbers").alias("key"), F.col("id").alias("path_id"), F.col("url").alias("path_url"), F.col("_plain").alias("path_plain"))
    numeric = F.filter(values, lambda v: v.rlike(r"^\d+$"))
    query_form = (
        base.where(~F.col("_plain")).withColumn("_v", numeric).where(F.size("_v") > 0)
        .select("host", F.explode(F.array_distinct("_v")).alias("first"), F.col("_v").alias("values"), F.col("id").alias("query_id"), F.col("url").alias("query_url"))
    )
    joined = path_form.join(query_form, ["host", "first"]).where(F.col("path_id") != F.col("query_id"))
    same = F.filter("values", lambda v: F.array_contains("key", v)) == F.col("key")
    # With two query forms the earlier one is read as the query side.
    proper = F.col("path_plain") | (F.col("path_id") > F.col("query_id"))
    found = joined.where(same & proper)
    return found.select("host", F.least("path_id", "query_id").alias("left_id"), F.greatest("path_id", "query_id").alias("right_id"), "path_url", "query_url").distinct()


MIN_SIMILARITY = 0.85


@F.udf(T.DoubleType(), useArrow=False)
def text_similarity(left: str, right: str) -> float:
    """Ratio of matching text; 0 for pairs that stay below the minimum. Pairs of whole texts pass row by row."""
    return similarity(left or "", right or "", MIN_SIMILARITY)


def article_text(parsed: DataFrame) -> DataFrame:
    """(page_id, url, title, text) used to compare two forms of one article, the text whole."""
    nodes = F.col("nodes")
    title = F.coalesce(H.value_of(nodes, None, "h1"), H.value_of(nodes, None, "title"), F.lit(""))
    root = F.coalesce(H.first(nodes, "article, main"), H.body_of(nodes))
    return parsed.select("page_id", "url", title.alias("title"), H.text_of(nodes, root).alias("text"))


def confirm_dual_forms(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Keeps pairs with equal titles and at least 85 % equal text of 80 or more characters."""
    left = texts.select(F.col("page_id").alias("left_id"), F.col("title").alias("left_title"), F.col("text").alias("left_text"))
    right = texts.select(F.col("page_id").alias("right_id"), F.col("title").alias("right_title"), F.col("text").alias("right_text"))
    eligible = pairs.join(left, "left_id").join(right, "right_id").where(
        (F.col("left_title") != "") & (F.col("left_title") == F.col("right_title"))
        & (F.least(F.char_length("left_text"), F.char_length("right_text")) >= 80)
    )
    # Alignment dominates the cost, so the pairs are spread before it.
    scored = eligible.repartition("left_id", "right_id").withColumn("similarity", text_similarity("left_text", "right_text")).where(F.col("similarity") >= MIN_SIMILARITY)
    return scored.withColumn("confidence", F.bround(F.least(F.lit(0.99), F.lit(0.75) + F.col("similarity") * 0.24), 3)).drop(
        "left_title", "right_title", "left_text", "right_text"
    )


def page_types(parsed: DataFrame, selectors: DataFrame) -> DataFrame:
    """Type of every page: html_list, likely_spa, navigation, article, possible_list or unknown."""
    nodes = F.col("nodes")
    title = F.coalesce(H.value_of(nodes, None, "title"), U.host_of(F.col("url")))
    # Bound once, so that no node of the page looks for the body again.
    text = let(H.body_of(nodes), lambda body: H.text_of(nodes, body))
    facts = parsed.select(
        "page_id", "url", title.alias("title"), text.alias("_text"),
        F.size(H.select(nodes, "script")).alias("_scripts"), F.size(H.select(nodes, "[id=root], [id=app], [data-reactroot]")).alias("_roots"),
        F.size(H.select(nodes, "a[href]")).alias("_links"), F.size(H.select(nodes, "article, main, p")).alias("_blocks"),
    )
    facts = facts.withColumn("text_length", F.char_length("_text")).withColumn("_dates", F.regexp_count("_text", F.lit(PAGE_DATE)))
    best = selectors.where("rank = 1").select("page_id", F.col("confidence").alias("_c"))
    named = F.concat("title", F.lit(" "), F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit(""))).rlike(PAGE_WORDS)
    js = (F.col("text_length") < 120) & ((F.col("_scripts") >= 2) | (F.col("_roots") > 0))
    has = F.col("_c").isNotNull()
    rules = [
        (has & ((F.col("_dates") >= 3) | named), "html_list", F.col("_c")),
        (js, "likely_spa", F.lit(0.8)),
        ((F.col("_links") >= 8) & (F.col("_dates") == 0), "navigation", F.lit(0.75)),
        ((F.col("text_length") >= 500) | (F.col("_blocks") >= 3), "article", F.lit(0.7)),
        (has, "possible_list", F.col("_c") * 0.8),
    ]
    kind, confidence = F.lit("unknown"), F.lit(0.35)
    for condition, name, score in reversed(rules):
        kind, confidence = F.when(condition, name).otherwise(kind), F.when(condition, score).otherwise(confidence)
    return facts.join(best, "page_id", "left").select(
        "page_id", "url", "title", kind.alias("page_type"), F.bround(confidence, 6).alias("confidence"), js.alias("likely_needs_js"), "text_length"
    )


def config_candidates(types: DataFrame, selectors: DataFrame, paginations: DataFrame, resources: DataFrame) -> DataFrame:
    """One disabled configuration per page: feed before sitemap before HTML list.

    Resources: page_id, feed_url, sitemap_url (verified ones, NULL when absent).
    """
    best = selectors.where("rank = 1").select("page_id", "item_selector", "link_selector", "title_selector", "published_at_selector")
    paging = paginations.where("rank = 1").select("page_id", F.col("mode").alias("pagination_mode"), F.col("argument").alias("pagination_argument"))
    joined = types.join(best, "page_id", "left").join(paging, "page_id", "left").join(resources, "page_id", "left")
    listed = F.col("feed_url").isNull() & F.col("sitemap_url").isNull()
    mode = F.when(F.col("feed_url").isNotNull(), "rss").when(F.col("sitemap_url").isNotNull(), "sitemap").otherwise("html_list")
    list_only = ["item_selector", "link_selector", "title_selector", "published_at_selector", "pagination_mode", "pagination_argument"]
    return joined.select(
        "page_id", U.site_slug(F.col("url")).alias("slug"), F.col("title").alias("name"), U.origin_root(F.col("url")).alias("base_url"),
        F.lit(False).alias("enabled"), F.col("likely_needs_js").alias("render_js"), mode.alias("discovery_mode"),
        F.coalesce("feed_url", "sitemap_url", "url").alias("entry_url"), *[F.when(listed, F.col(c)).alias(c) for c in list_only],
    )


def emit_config(candidates: DataFrame, tagset_group: str | None = None) -> DataFrame:
    return candidates.withColumn("tagset_group", F.lit(tagset_group).cast("string"))


# For every key of a site report the confidence of a finding, that of a missing one, and what is then said.
FINDINGS = {
    "page_type": ("medium", "failed", "page not read"),
    "render_js": ("high", "failed", "page not read"),
    "feed": ("high", "low", "no declared or common feed validated"),
    "sitemap": ("high", "low", "no robots/common sitemap validated"),
    "list_pages": ("medium", "failed", "no likely list page found"),
    "item_selector": ("medium", "failed", "no repeated link structure found"),
    "pagination": ("medium", "low", "no pagination links found"),
    "url_canonical.rules": ("medium", "low", "no confirmed dual forms"),
    "attachments.link_patterns": ("medium", "low", "no attachment patterns found"),
}
SURE_TYPE = 0.8


def site_findings(pages: DataFrame, found: dict[str, DataFrame]) -> DataFrame:
    """(page_id, key, value, confidence, evidence): one row for each page and each key of `found`, missing ones included.

    pages: page_id. found: key of FINDINGS -> (page_id, value, evidence) with at most one row a page and optionally
    `confidence`, which then stands instead of the fixed one. Rows are tagged with their key and meet the pages once.
    """
    tagged = None
    for key, rows in found.items():
        given = F.col("confidence") if "confidence" in rows.columns else F.lit(None)
        part = rows.select("page_id", F.lit(key).alias("key"), F.col("value").cast("string").alias("value"), given.cast("string").alias("_given"), "evidence", F.lit(True).alias("_hit"))
        tagged = part if tagged is None else tagged.unionByName(part)
    rules = F.array(*[F.struct(F.lit(k).alias("key"), *[F.lit(v).alias(n) for n, v in zip(("_yes", "_no", "_missing"), FINDINGS[k])]) for k in found])
    wanted = pages.select("page_id", F.explode(rules).alias("_r")).select("page_id", "_r.*")
    hit = F.col("_hit").isNotNull()
    confidence = F.when(hit, F.coalesce("_given", "_yes")).otherwise(F.col("_no"))
    evidence = F.when(hit, F.col("evidence")).otherwise(F.col("_missing"))
    return wanted.join(tagged, ["page_id", "key"], "left").select("page_id", "key", "value", confidence.alias("confidence"), evidence.alias("evidence"))


def type_findings(types: DataFrame) -> dict[str, DataFrame]:
    """The findings about type and rendering that follow from `page_types`."""
    sure = F.when(F.col("confidence") >= SURE_TYPE, "high").otherwise("medium")
    length = F.concat(F.lit("static text length "), F.col("text_length").cast("string"))
    needs = F.col("likely_needs_js")
    return {
        "page_type": types.select("page_id", F.col("page_type").alias("value"), sure.alias("confidence"), length.alias("evidence")),
        "render_js": types.select("page_id", needs.alias("value"), F.when(needs, "medium").otherwise("high").alias("confidence"), F.lit("static HTML heuristic only").alias("evidence")),
    }


def needs_review(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("confidence").isin("low", "failed"))


def last_by_url(resources: DataFrame, scope: str = "page_id", position: str = "position") -> DataFrame:
    """Feeds or sitemaps of a site that were found more than once: the last finding stands, at the first one's place."""
    rest = [c for c in resources.columns if c not in (scope, "url", position)]
    found = resources.groupBy(scope, "url").agg(F.min(position).alias(position), F.max_by(F.struct(*rest), position).alias("_last"))
    return found.select(scope, "url", position, "_last.*")


# Fixed value: list pages that a site report names.
MAX_LIST_PAGES = 8


def rank_list_pages(pages: DataFrame, scope: str = "site", position: str = "position", *, limit: int = MAX_LIST_PAGES) -> DataFrame:
    """Likely list pages of each site: HTML lists first, then by confidence and matches; ties in order of discovery."""
    order = Window.partitionBy(scope).orderBy((F.col("page_type") == "html_list").desc(), F.col("confidence").desc(), F.col("matches").desc(), position)
    return pages.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
