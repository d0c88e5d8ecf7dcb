"""Selectors that are data: one or more per page, compiled to rows and matched against the pages' elements.

A compiled selector is a row per step. Elements are slim rows of one parse; a step joins them by page, and what a step
asks of its ancestors is decided by running maxima over the element ranges in document order, so nothing pairs the
elements of a page with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import urls as U
from ..functions.dates import let
from ..session import cut_lineage

_STEP = r"(\s*>\s*|\s+)?((?:\[[^\]]*\]|[^\s>\[])+)"
_BRACKETS = r"\[[^\]]*\]"
_ATTRIBUTE = r"""\[\s*([\w:-]+)\s*(?:=\s*["']?([^"'\]]*)["']?\s*)?\]"""
_PLAIN = r"""^(?:[\w-]+|\*)?(?:[.#][\w-]+|\[\s*[\w:-]+\s*(?:=\s*(?:"[^"]*"|'[^']*'|[^"'\]\s]*)\s*)?\])*$"""


def compile_selectors(selectors: DataFrame, column: str, *keys: str) -> DataFrame:
    """A row per step: keys, option, step, steps, direct, tag, classes, ident, needs (name, value), in document order.

    Read are comma lists of compounds of a tag, classes, an id and [name] or [name=value] tests, joined by descendant
    or child combinators. Anything else compiles to no rows, and so matches nothing; an empty selector likewise.
    """
    option = F.posexplode(F.transform(F.split(column, ","), lambda t: F.trim(t))).alias("option", "_text")
    rows = selectors.select(*keys, option).where("_text <> ''")
    steps = F.arrays_zip(
        F.regexp_extract_all("_text", F.lit(_STEP), F.lit(1)).alias("link"), F.regexp_extract_all("_text", F.lit(_STEP), F.lit(2)).alias("own"),
    )
    rows = rows.withColumn("_steps", steps).where(F.forall("_steps", lambda s: s["own"].rlike(_PLAIN)))
    rows = rows.select(*keys, "option", F.size("_steps").alias("steps"), F.posexplode("_steps").alias("step", "_s"))
    own, bare = F.col("_s.own"), F.regexp_replace("_s.own", _BRACKETS, "")
    needs = F.zip_with(
        F.regexp_extract_all(own, F.lit(_ATTRIBUTE), F.lit(1)), F.regexp_extract_all(own, F.lit(_ATTRIBUTE), F.lit(2)),
        lambda n, v: F.struct(F.lower(n).alias("name"), F.trim(v).alias("value")),
    )
    has_value = F.transform(F.regexp_extract_all(own, F.lit(_BRACKETS), F.lit(0)), lambda t: t.contains("="))
    return rows.select(
        *keys, "option", "step", "steps", F.col("_s.link").contains(">").alias("direct"),
        F.lower(F.nullif(F.regexp_extract(bare, r"^([\w-]+)", 1), F.lit(""))).alias("tag"),
        F.array_distinct(F.regexp_extract_all(bare, F.lit(r"\.([\w-]+)"), F.lit(1))).alias("classes"),
        F.nullif(F.regexp_extract(bare, r"#([\w-]+)", 1), F.lit("")).alias("ident"),
        F.zip_with(needs, has_value, lambda n, given: F.struct(n["name"].alias("name"), F.when(given, n["value"]).alias("value"))).alias("needs"),
    )


def elements(parsed: DataFrame) -> DataFrame:
    """One row per element of the pages' nodes: page_id, n_id, up, last, tag, attrs, link (page address and href)."""
    rows = parsed.select("page_id", "url", F.explode(F.filter("nodes", lambda n: n["tag"] != "#text")).alias("n"))
    href = F.col("n.attrs")["href"]
    return rows.select(
        "page_id", F.col("n.id").alias("n_id"), "n.up", "n.last", "n.tag", "n.attrs",
        F.when(href.isNotNull(), F.struct("url", href.alias("href"))).alias("link"),
    )


def _fits(step: str) -> Column:
    own = lambda name: F.col(f"{step}.{name}")
    classes = F.split(F.coalesce(F.col("attrs")["class"], F.lit("")), r"\s+")
    needs = F.forall(own("needs"), lambda n: let(F.element_at(F.col("attrs"), n["name"]), lambda v: v.isNotNull() & (n["value"].isNull() | (v == n["value"]))))
    tag = own("tag").isNull() | (own("tag") == F.col("e.tag"))
    ident = own("ident").isNull() | F.coalesce(F.col("attrs")["id"] == own("ident"), F.lit(False))
    return tag & ident & (F.size(F.array_except(own("classes"), classes)) == 0) & needs


def enclosed(rows: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """rows that lie inside one of ranges (n_id, last) of the same keys: the furthest end so far reaches them."""
    both = rows.select("*", F.lit(False).alias("_outer")).unionByName(ranges.select(*keys, "n_id", "last", F.lit(True).alias("_outer")), allowMissingColumns=True)
    # A range that begins at an element doesn't hold that element: elements come before it.
    before = Window.partitionBy(*keys).orderBy("n_id", "_outer").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.when(F.col("_outer"), F.col("last"))).over(before)
    return both.withColumn("_reach", reach).where(~F.col("_outer") & (F.col("_reach") >= F.col("n_id"))).drop("_outer", "_reach")


def match(found: DataFrame, compiled: DataFrame) -> DataFrame:
    """Elements that a page's compiled selector matches, once each: page_id, n_id, last, link.

    compiled: from compile_selectors with the key page_id. Selectors of several steps run step by step.
    """
    keys = ["page_id", "option"]
    most = compiled.agg(F.coalesce(F.max("steps"), F.lit(1))).first()[0]
    above, done = None, None
    for k in range(most):
        step = compiled.where(F.col("step") == k).alias("s")
        own = step.join(found.alias("e"), F.col("s.page_id") == F.col("e.page_id")).where(_fits("s"))
        own = own.select("e.page_id", "s.option", "s.steps", "s.direct", "e.n_id", "e.up", "e.last", "e.link")
        if above is not None:
            parents = above.select(*keys, F.col("n_id").alias("up"))
            direct = own.where("direct").join(parents, [*keys, "up"], "left_semi")
            own = direct.unionByName(enclosed(own.where("NOT direct"), above, keys).select(*own.columns))
        ready = own.where(F.col("steps") == k + 1)
        done = ready if done is None else done.unionByName(ready)
        above = cut_lineage(own.where(F.col("steps") > k + 1)) if k + 1 < most else None
    return done.groupBy("page_id", "n_id").agg(F.any_value("last").alias("last"), F.any_value("link").alias("link"))


def article_urls(parsed: DataFrame, selectors: DataFrame) -> DataFrame:
    """Addresses that a page's list selector leads to: page_id, position, target.

    selectors: page_id, item_selector, link_selector (`css@href`, or `@href` for the item itself), one row per page at
    most. Addresses are absolute, of http or https, in document order, each once. Pages without a selector, and those whose
    link selector asks for another attribute, give no rows.
    """
    css = F.regexp_extract("link_selector", "^(.*)@href$", 1)
    usable = selectors.where(F.col("link_selector").rlike("@href$")).select("page_id", "item_selector", css.alias("css"))
    found = cut_lineage(elements(parsed.join(usable.select("page_id"), "page_id", "left_semi")))
    items = cut_lineage(match(found, compile_selectors(usable, "item_selector", "page_id")))
    anchors = match(found.where("link IS NOT NULL"), compile_selectors(usable, "css", "page_id"))
    inner = enclosed(anchors, items, ["page_id"])
    itself = items.join(usable.where("css = ''").select("page_id"), "page_id", "left_semi")
    links = inner.unionByName(itself).where("link.href <> ''").select("page_id", "n_id", "link.url", "link.href")
    target = F.get(U.absolute_urls(F.col("url"), F.array("href")), 0)
    rows = links.withColumn("target", target).where(F.col("target").rlike("(?i)^https?://")).groupBy("page_id", "target").agg(F.min("n_id").alias("_at"))
    position = F.row_number().over(Window.partitionBy("page_id").orderBy("_at"))
    return rows.select("page_id", position.alias("position"), "target")
