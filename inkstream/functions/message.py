"""Notification texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dates import format_local, strip
from .text import human_size, truncate_unicode

# Fixed labels of the message body.
TAGS, ORIGIN, LINK, SUMMARY, FILES = "标签", "来源", "原文", "AI 总结", "附件"
NO_TAGS, NO_DATE, NO_TITLE = "无", "未知时间", "无标题"


def html_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def tag_text(tags: Column) -> Column:
    """`name (0.80) · name (0.40)`; tags is array<struct<name,confidence>>."""
    shown = F.transform(tags, lambda t: F.concat(t["name"], F.lit(" ("), F.format_string("%.2f", F.bround(t["confidence"].cast("double"), 2)), F.lit(")")))
    return F.coalesce(F.nullif(F.array_join(shown, " · "), F.lit("")), F.lit(NO_TAGS))


def attachment_lines(attachments: Column) -> Column:
    """One line per attachment; attachments is array<struct<filename,size_bytes,url>>."""
    line = lambda a: F.concat(
        F.lit("- "), a["filename"], human_size(a["size_bytes"]), F.coalesce(F.concat(F.lit(": "), F.nullif(a["url"], F.lit(""))), F.lit(""))
    )
    return F.array_join(F.transform(attachments, line), "\n")


def message_title(site_name: Column, title: Column) -> Column:
    return F.concat(F.lit("["), site_name, F.lit("] "), F.coalesce(F.nullif(title, F.lit("")), F.lit(NO_TITLE)))


def message_body(
    *,
    site_name: Column,
    url: Column,
    published_at: Column,
    tags: Column,
    content: Column,
    summary: Column,
    attachments: Column,
    body_format: str,
    tz: str = "UTC",
) -> Column:
    """Header, summary, attachments and content in the requested format; see `cut_to_limit`."""
    names = tag_text(tags)
    date = F.coalesce(format_local(published_at, tz), F.lit(NO_DATE))
    summary = F.nullif(strip(F.coalesce(summary, F.lit(""))), F.lit(""))
    content = F.nullif(F.coalesce(content, F.lit("")), F.lit(""))
    count = F.size(attachments)
    files = F.when(count > 0, attachment_lines(attachments))
    number = count.cast("string")

    def part(*pieces) -> Column:
        # A missing optional piece removes its whole section.
        joined = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])
        return F.coalesce(joined, F.lit(""))

    if body_format == "html":
        e = html_escape
        body = F.concat(
            part(f"<b>{TAGS}</b>：", e(names), f"<br><b>{ORIGIN}</b>：", e(site_name), " · ", e(date), f'<br><b>{LINK}</b>：<a href="', e(url), '">', e(url), "</a>"),
            part(f"<hr><b>{SUMMARY}</b>：<br>", F.replace(e(summary), F.lit("\n"), F.lit("<br>"))),
            part(f"<hr>{FILES}（", F.when(count > 0, number), "）：<br>", e(files)),
            part("<hr><pre>", e(content), "</pre>"),
        )
    else:
        bold, rule = ("**", "\n\n---\n") if body_format == "markdown" else ("", "\n\n")
        body = F.concat(
            part(f"{bold}{TAGS}{bold}：", names, f"\n{bold}{ORIGIN}{bold}：", site_name, " · ", date, f"\n{bold}{LINK}{bold}：", url),
            part(f"{rule}{bold}{SUMMARY}{bold}：\n", summary),
            part(f"{rule}{FILES}（", F.when(count > 0, number), "）：\n", files),
            part(rule, content),
        )
    return body


def cut_to_limit(messages: DataFrame, limit: Column, column: str = "body") -> DataFrame:
    """Truncate bodies to the channel limit; only overlong ones change."""
    cut = F.when(F.char_length(column) <= limit, F.col(column)).otherwise(truncate_unicode(column, limit))
    return messages.withColumn(column, cut)
