"""Selectors as data against the same selectors as constants; walks and previews."""

import pytest
from pyspark.sql import functions as F

from inkstream.functions import html as H
from inkstream.operators import onboarding as O
from inkstream.operators import selectors as S
from inkstream.operators import site_walk as W
from inkstream.operators.extraction import ExtractConfig

PAGE = """<div id="top" class="a b"><ul class="list"><li class="row"><a class="t" href="/1">one</a><div class="row"><a href="2" class="t u">two</a></div></li>
<li class="row last"><p><a class="t" href="/1">again</a></p></li><li><a class="t" href="https://o.example/x">out</a></li></ul></div>
<div class="b"><a class="t" data-k="v" href="mailto:x@y.z">mail</a><a href="">empty</a><a class="t">none</a></div>"""
SELECTORS = ["a", "a.t", ".row", "li.row", "li.row.last", "#top", "div.b a", "ul > li", "ul > li a.t", "#top li > a", "div .row > a, p a", "a[href]", "a[data-k=v]", '[data-k="v"]', "div div a", "*.t", "li li", "b"]


def frame(spark, *rows, schema="page_id bigint, url string, html string"):
    return spark.createDataFrame(list(rows), schema)


def test_selectors_as_data_equal_constants(spark):
    pages = O.parse(frame(spark, *[(i, "https://h.example/d/", PAGE) for i in range(len(SELECTORS))]))
    rows = frame(spark, *enumerate(SELECTORS), schema="page_id bigint, selector string")
    got = {}
    for r in S.match(S.elements(pages), S.compile_selectors(rows, "selector", "page_id")).collect():
        got.setdefault(r.page_id, set()).add(r.n_id)
    one = pages.where("page_id = 0")
    for i, selector in enumerate(SELECTORS):
        want = one.select(F.transform(H.select(F.col("nodes"), selector), lambda n: n["id"]).alias("ids")).first().ids
        assert got.get(i, set()) == set(want), selector


@pytest.mark.parametrize("odd", ["", " ", ",", "a:hover", "a + b", "[", "a[x^=y]", ">", None])
def test_other_selectors_match_nothing(spark, odd):
    rows = frame(spark, (1, odd), schema="page_id bigint, selector string")
    assert S.compile_selectors(rows, "selector", "page_id").where("tag IS NULL AND size(classes) = 0").collect() == []
    pages = O.parse(frame(spark, (1, "https://h.example/", PAGE)))
    assert S.match(S.elements(pages), S.compile_selectors(rows, "selector", "page_id")).collect() == []


def test_article_urls(spark):
    url = "https://h.example/d/"
    pages = O.parse(frame(spark, *[(i, url, PAGE) for i in range(1, 7)]))
    rows = [(1, "li.row", "a.t@href"), (2, "ul > li", "a@href"), (3, "a.t", "@href"), (4, "li", "a@title"), (5, "nav", "a@href")]
    found = S.article_urls(pages, frame(spark, *rows, schema="page_id bigint, item_selector string, link_selector string"))
    got = {}
    for r in found.orderBy("page_id", "position").collect():
        got.setdefault(r.page_id, []).append(r.target)
    one, two, out = "https://h.example/1", "https://h.example/d/2", "https://o.example/x"
    assert got == {1: [one, two], 2: [one, two, out], 3: [one, two, out]}


def plain_walk(start, ids, edges, depth, budget):
    out = []
    for site, url in start:
        queue, seen = [(url, 0, W.START)], set()
        while queue and len(seen) < budget:
            url, level, why = queue.pop(0)
            if url in seen:
                continue
            seen.add(url)
            out.append((site, len(seen) - 1, level, url, ids.get(url), why))
            if level < depth and url in ids:
                queue += [(t, level + 1, w) for _, t, w in sorted(edges.get(ids[url], []))]
    return sorted(out)


@pytest.mark.parametrize("depth, budget", [(2, 40), (2, 4), (3, 9), (1, 1), (0, 5)])
def test_walk_equals_a_queue(spark, depth, budget):
    ids = {f"u{i}": i for i in range(30) if i % 7}
    edges = {i: [(k, f"u{(i * (k + 2) + 3 * k) % 33}", f"e{k}") for k in range(4)] for i in range(30)}
    start = [("a", "u1"), ("b", "u2"), ("c", "u14"), ("d", "gone")]
    walked = W.walk(
        frame(spark, *start, schema="site string, url string"), frame(spark, *ids.items(), schema="url string, page_id bigint"),
        frame(spark, *[(p, t, k, w) for p, ts in edges.items() for k, t, w in ts], schema="page_id bigint, target_url string, rank int, evidence string"), depth=depth, budget=budget,
    )
    got = sorted((r.site, r.position, r.depth, r.url, r.page_id, r.evidence) for r in walked.collect())
    assert got == plain_walk(start, ids, edges, depth, budget)


def test_preview_isolates_what_throws(spark):
    def parse(page):
        if "boom" in page:
            raise RuntimeError("bad page")
        return H.tree(page)

    good = "<h1>T</h1><p>some text</p>"
    items = frame(
        spark, ("s", 1, "u1", None, None, None), ("s", 2, "u2", None, None, None), ("s", 3, "u3", None, None, good), ("s", 4, "u4", "hint", None, None), ("s", 5, "u1", None, None, None), ("t", 1, "u5", None, None, "boom"),
        schema="site string, position int, url string, title string, published_at timestamp, content_html string",
    )
    fetched = frame(spark, ("u1", good), ("u2", "boom"), ("u4", "<p>x</p>"), schema="url string, html string")
    found = W.preview(items, fetched, ExtractConfig(selectors={"title": "h1", "content": "p"}), sample_size=4, parse=parse)
    got = {(r.site, r.position): (r.success, r.title, r.content_length, r.error) for r in found.collect()}
    ok = (True, "T", 9, None)
    assert got == {("s", 1): ok, ("s", 2): (False, None, None, "RuntimeError: bad page"), ("s", 3): ok, ("s", 4): (True, "hint", 1, None), ("t", 1): (False, None, None, "RuntimeError: bad page")}
    assert {tuple(r) for r in W.preview_report(items, found).collect()} == {("s", 5, 3, 1), ("t", 1, 0, 1)}
