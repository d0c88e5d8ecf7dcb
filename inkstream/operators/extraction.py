"""Article extraction from fetched pages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.dates import parse_flexible
from ..functions.urls import absolute_urls

PDF_WIDGET = r"""(?i)showVsbpdfIframe\(\s*(['"])([^'"]+?)\1"""
PDF_BODY_NAME = "正文.pdf"
ATTACHMENT_NAME = "附件"
BODY_IN_ATTACHMENTS = "正文见附件："
# Elements around an article.
ASIDE = ("nav", "header", "footer", "aside", "form")


@dataclass(frozen=True)
class AttachmentConfig:
    link_patterns: Sequence[str] = ()
    text_patterns: Sequence[str] = ()
    inline_image_patterns: Sequence[str] = ()
    max_per_article: int = 10


@dataclass(frozen=True)
class ExtractConfig:
    selectors: Mapping[str, str] = field(default_factory=dict)
    strip_selectors: Sequence[str] = ()
    min_content_length: int = 0
    reject_title_patterns: Sequence[str] = ()
    reject_content_patterns: Sequence[str] = ()
    attachments: AttachmentConfig | None = None


def _any(value: Column, patterns: Sequence[str]) -> Column:
    found = F.lit(False)
    for pattern in patterns:
        found = found | F.coalesce(value.rlike(f"(?i){pattern}"), F.lit(False))
    return found


def _with_attachments(pages: DataFrame, config: AttachmentConfig) -> DataFrame:
    """`attachments`: body documents of a viewer script, pattern links, then links named as attachments."""
    nodes = F.col("_nodes")

    def ref(kind: int, href: Column, name: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), href.alias("href"), name.alias("filename"))

    def anchor(kind: int):
        return lambda a: ref(kind, F.trim(a["attrs"]["href"]), F.nullif(H.text_of(nodes, a), F.lit("")))

    none = F.array().cast("array<struct<kind:int,href:string,filename:string>>")
    body = F.col("_content")
    scripts = F.array_join(F.transform(H.select_in(nodes, body, "script"), lambda s: H.text_of(nodes, s)), "\n")
    widget = F.transform(F.regexp_extract_all(scripts, F.lit(PDF_WIDGET), F.lit(2)), lambda u: ref(0, u, F.lit(PDF_BODY_NAME)))
    linked = F.filter(F.transform(H.select(nodes, "a[href]"), anchor(1)), lambda r: _any(r["href"], config.link_patterns))
    named = F.filter(F.transform(H.select_in(nodes, body, "a[href]"), anchor(2)), lambda r: _any(r["filename"], config.text_patterns))
    refs = F.filter(F.concat(F.coalesce(widget, none), F.coalesce(linked, none), F.coalesce(named, none)), lambda r: r["href"] != "")
    found = pages.withColumn("_refs", refs).withColumn("_abs", absolute_urls(F.col("url"), F.col("_refs.href")))
    located = F.zip_with("_refs", "_abs", lambda r, u: F.struct(u.alias("source_url"), r["filename"].alias("filename"), r["kind"].alias("kind")))
    usable = F.filter(located, lambda r: (r["kind"] != 1) | ~_any(r["source_url"], config.inline_image_patterns))
    found = found.withColumn("_usable", usable)
    unique = F.filter(
        "_usable", lambda r, i: F.array_position(F.transform("_usable", lambda x: x["source_url"]), r["source_url"]) == i + 1
    )
    shaped = F.transform(
        F.slice(unique, 1, config.max_per_article),
        lambda r: F.struct(r["source_url"], r["filename"], r["filename"].alias("link_text"), (r["kind"] == 0).alias("is_body")),
    )
    return found.withColumn("attachments", shaped).drop("_refs", "_abs", "_usable")


def extract_articles(pages: DataFrame, config: ExtractConfig, *, key: str = "page_id") -> DataFrame:
    """(key, title, author, published_at, lang, content_text, content_html, attachments, error).

    Input: key, url, html and optionally title_hint, published_hint, last_modified. Selectors come
    first. Without a content selector, or where it finds nothing, the main region is the first
    article or main element, or else the stretch of the page that scores as main text (see
    html.main_block), or else the body, read without navigation, header, footer and side elements. Links
    named as attachments are sought in the selected region, or in the body without a selector. A
    rejected page keeps its row with `error` set.
    """
    nodes = F.col("_nodes")
    chosen = config.selectors.get("content")
    unread = ", ".join([*config.strip_selectors, "script", "style", "template"])
    named, body = F.coalesce(H.first(nodes, "article"), H.first(nodes, "main")), H.body_of(nodes)
    selected = H.first(nodes, chosen) if chosen else F.get(nodes, F.lit(-1))
    parsed = pages if "_nodes" in pages.columns else pages.withColumn("_nodes", H.dom("html"))
    parsed = parsed.withColumn("_selected", selected)
    parsed = parsed.withColumn("_content", F.col("_selected") if chosen else body)
    if config.attachments:
        parsed = _with_attachments(parsed, config.attachments)
    else:
        empty = "array<struct<source_url:string,filename:string,link_text:string,is_body:boolean>>"
        parsed = parsed.withColumn("attachments", F.array().cast(empty))

    missed = F.col("_selected").isNull()
    aside = H.select(nodes, f"{unread}, {', '.join(ASIDE)}")
    parsed = parsed.withColumn("_named", F.coalesce(F.col("_selected"), named))
    # Only pages without such an element are scored.
    scored = F.when(F.col("_named").isNull(), H.main_block(nodes, ASIDE))
    parsed = parsed.withColumn("_content", F.coalesce("_named", scored, body))
    parsed = parsed.withColumn("_strip", F.when(missed, aside).otherwise(H.select(nodes, unread)))

    def hint(name: str, kind: str) -> Column:
        return F.col(name) if name in pages.columns else F.lit(None).cast(kind)

    body = F.col("_content")
    pieces = F.filter(
        nodes,
        lambda n: (n["tag"] == "#text") & H.inside(body, n) & ~F.exists("_strip", lambda s: H.inside(s, n)),
    )
    text = F.coalesce(F.array_join(F.transform(pieces, lambda n: n["text"]), "\n"), F.lit(""))
    source = F.coalesce(H.cut_source(F.col("html"), body, F.col("_strip")), F.lit(""))

    def chosen_value(name: str) -> Column:
        return H.value_of(nodes, None, config.selectors[name]) if name in config.selectors else F.lit(None).cast("string")

    fallback_title = F.when(missed, F.coalesce(H.value_of(nodes, None, "h1"), H.value_of(nodes, None, "title")))
    published = chosen_value("published_at")
    if regex := config.selectors.get("published_at_regex"):
        page_text = H.text_of(nodes, H.page_of(nodes))
        group = 1 if "(" in regex.replace("(?:", "").replace("\\(", "") else 0
        published = F.coalesce(F.nullif(F.regexp_extract(page_text, regex, group), F.lit("")), published)
    extracted = parsed.select(
        key, "url", "attachments",
        F.coalesce(chosen_value("title"), fallback_title, hint("title_hint", "string")).alias("title"),
        chosen_value("author").alias("author"),
        F.coalesce(
            F.when(published.isNotNull(), parse_flexible(published)).otherwise(hint("published_hint", "timestamp")),
            hint("last_modified", "timestamp"),
        ).alias("published_at"),
        F.nullif(F.substring_index(H.value_of(nodes, None, "html@lang"), "-", 1), F.lit("")).alias("lang"),
        text.alias("_text"), source.alias("_source"),
    )
    return finish_articles(extracted, config, key)


def finish_articles(extracted: DataFrame, config: ExtractConfig, key: str) -> DataFrame:
    """Attachment fallback text, rejection rules and the sanitised body."""
    has_files = F.size("attachments") > 0
    short = F.char_length("_text") < config.min_content_length
    names = F.array_join(F.transform("attachments", lambda a: F.coalesce(a["filename"], F.lit(ATTACHMENT_NAME))), "、")
    links = F.array_join(
        F.transform(
            "attachments",
            lambda a: F.concat(F.lit('<li><a href="'), H.escaped(a["source_url"]), F.lit('">'), H.escaped(F.coalesce(a["filename"], F.lit(ATTACHMENT_NAME))), F.lit("</a></li>")),
        ),
        "",
    )
    filled = extracted.withColumn("_fill", short & has_files)
    text = F.when(F.col("_fill"), F.concat("_text", F.lit("\n" + BODY_IN_ATTACHMENTS), names)).otherwise(F.col("_text"))
    markup = F.when(
        F.col("_fill"), F.concat("_source", F.lit(f"<p>{BODY_IN_ATTACHMENTS}</p><ul>"), links, F.lit("</ul>"))
    ).otherwise(F.col("_source"))
    rejected = _any(F.col("title"), config.reject_title_patterns) | _any(F.col("content_text"), config.reject_content_patterns)
    error = (
        F.when(F.col("title").isNull(), F.lit("SelectorMiss"))
        .when(rejected, F.lit("ContentRejected"))
        .when((F.char_length("content_text") < config.min_content_length) & ~has_files, F.lit("ContentTooShort"))
    )
    return (
        filled.withColumn("content_text", text)
        .withColumn("_markup", markup)
        # Read twice, the markup stays a column of its own: arguments of Python functions must not
        # contain lambdas, which the optimiser fails to extract behind an aggregate.
        .withColumn("content_html", F.when(F.col("_markup") != "", H.sanitize_html("_markup", "url")).otherwise(F.lit("")))
        .withColumn("error", error)
        .select(key, "url", "title", "author", "published_at", "lang", "content_text", "content_html", "attachments", "error")
    )
