import random
from datetime import datetime
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from inkstream.functions import alignment
from inkstream.functions import html as H
from inkstream.operators import onboarding as O
from inkstream.operators.extraction import AttachmentConfig, ExtractConfig, extract_articles
from inkstream.operators.run_once import crawl
from inkstream.session import cut_lineage
from inkstream.sources import discovery as D

LIST = """<ul class="list"><li id="line_0"><a class="title tt1" href="/info/1/1.htm" title="First notice title">First...</a><p class="date">2026-07-21</p></li>
<li id="line_1"><a class="title tt1" href="2.htm" title="Second notice title">Second...</a><p class="date">2026-07-20</p>
<li id="line_2"><a class="title tt1" href="https://other.example/3" title="Away">Away</a></li></ul>"""

ARTICLE = """<html lang="zh-CN"><body><h1 class="title">A &amp; B</h1><p class="meta">日期：2026-07-21</p>
<div class="body">First part<div class="related">related</div><p>second <a href="/x.pdf">Form</a><img src="/i.png" onerror="bad()"></p><script>showVsbpdfIframe('/doc.pdf')</script></div>
<a href="/y.pdf">other file</a></body></html>"""


def pages(spark, *rows):
    return spark.createDataFrame(list(rows), "page_id bigint, url string, html string")


def test_list_page(spark):
    config = D.ListConfig("li[id^=line_]", {"url": "a.title.tt1@href", "title": "a.title.tt1@title", "published_at": "p.date"}, r"^https://jwc\.example/")
    found = D.html_list(pages(spark, (1, "https://jwc.example/list/index.htm", LIST), (2, "https://jwc.example/", "<p>none</p>")), config).orderBy("page_id", "position").collect()
    assert [(r.url, r.title, r.published_at) for r in found if r.error is None] == [
        ("https://jwc.example/info/1/1.htm", "First notice title", datetime(2026, 7, 21)), ("https://jwc.example/list/2.htm", "Second notice title", datetime(2026, 7, 20)),
    ]
    assert [r.error for r in found if r.page_id == 2] == ["SelectorMiss"]


def test_pagination_modes(spark):
    schema = "entry_url string, mode string, max_pages int, template string, param string, page_order string, max_page int"
    rows = [
        ("https://h/a", "url_template", 3, "https://h/a/{page}.htm", None, "desc_index", 5), ("https://h/b", "url_template", 3, "https://h/b/{page}", None, "desc_index", 2),
        ("https://h/c?x=1", "query_param", 2, None, "p", "asc", None), ("https://h/d", "none", 9, None, None, "asc", None),
    ]
    got = {}
    for r in D.page_urls(spark.createDataFrame(rows, schema)).orderBy("entry_url", "page_index").collect():
        got.setdefault(r.entry_url, []).append(r.page_url)
    assert got == {
        "https://h/a": ["https://h/a", "https://h/a/4.htm", "https://h/a/3.htm"], "https://h/b": ["https://h/b", "https://h/b/1"],
        "https://h/c?x=1": ["https://h/c?x=1", "https://h/c?x=1&p=2"], "https://h/d": ["https://h/d"],
    }
    links = spark.createDataFrame([("u0", "u1"), ("u1", "u2"), ("u2", None)], "url string, next_url string")
    chain = D.follow_next(spark.createDataFrame([("u0",)], "entry_url string"), links, max_pages=5).collect()
    assert sorted(r.page_url for r in chain) == ["u0", "u1", "u2"]


def test_feeds(spark):
    long = "x" * 500
    rss = f"<rss><channel><item><link>/a</link><title>T</title><description>S</description><pubDate>Tue, 21 Jul 2026 08:00:00 GMT</pubDate><e:encoded xmlns:e='e'>{long}</e:encoded></item><item><link>/a</link></item></channel></rss>"
    atom = "<feed xmlns='http://www.w3.org/2005/Atom'><entry><link rel='self' href='/s'/><link href='/b'/><updated>2026-07-21T08:00:00Z</updated><content>short</content></entry></feed>"
    rows = [(1, "https://h/f", rss), (2, "https://h/f", atom), (3, "https://h/f", "<rss><oops>"), (4, "https://h/f", "<!DOCTYPE x [<!ENTITY a 'b'>]><rss/>")]
    feeds = spark.createDataFrame(rows, "page_id bigint, url string, xml string")
    got = {(r.page_id, r.url, r.error, r.published_at, r.content_html) for r in D.feed_items(feeds).collect()}
    at = datetime(2026, 7, 21, 8)
    assert got == {(1, "https://h/a", None, at, long), (2, "https://h/b", None, at, None), (3, None, "FeedUnreadable", None, None), (4, None, "FeedUnreadable", None, None)}
    assert {r.content_html for r in D.feed_items(feeds.where("page_id = 2"), content_mode="always").collect()} == {"short"}


def test_sitemaps(spark):
    index = "<sitemapindex xmlns='s'><sitemap><loc>a.xml</loc></sitemap><sitemap><loc>a.xml</loc></sitemap><sitemap><loc>missing.xml</loc></sitemap></sitemapindex>"
    leaf = "<urlset><url><loc>/news/1</loc><lastmod>2020-01-01</lastmod></url><url><loc>/news/2</loc></url><url><loc>/other/3</loc><lastmod>2026-01-01</lastmod></url><url><loc>/news/4</loc><lastmod>2026-01-01</lastmod></url></urlset>"
    maps = spark.createDataFrame([("https://h/i.xml", index), ("https://h/a.xml", leaf)], "url string, xml string")
    roots = spark.createDataFrame([("s", "https://h/i.xml")], "site string, url string")
    cutoff = F.lit("2025-01-01 00:00:00").cast("timestamp")
    found = D.sitemap_walk(roots, maps, allow="/news/", cutoff=cutoff).collect()
    assert {(r.url, r.published_at) for r in found} == {("https://h/news/2", None), ("https://h/news/4", datetime(2026, 1, 1))}


def test_json(spark):
    body = '{"d":[{"items":[{"u":"/1","n":{"t":true},"when":"2026-07-21"},{"u":" "},5,{"u":null},{"u":7}]}]}'
    rows = spark.createDataFrame([(1, "https://h/x", body), (2, "https://h/x", "[]"), (3, "https://h/x", "nope")], "page_id bigint, url string, body string")
    got = D.json_items(rows, "d.0.items", {"url": "u", "title": "n.t", "published_at": "when"}).collect()
    assert {(r.page_id, r.url, r.title, r.error) for r in got} == {
        (1, "https://h/1", "True", None), (1, "https://h/7", None, None), (2, None, None, "ItemsPathMiss"), (3, None, None, "ItemsPathMiss"),
    }


def test_article(spark):
    config = ExtractConfig(
        selectors={"title": "h1.title", "content": "div.body", "published_at_regex": r"日期：(\d{4}-\d{2}-\d{2})"}, strip_selectors=(".related",),
        attachments=AttachmentConfig(link_patterns=(r"\.pdf$",), text_patterns=("form",)),
    )
    row = extract_articles(pages(spark, (1, "https://h/p/1.htm", ARTICLE)), config).first()
    assert (row.title, row.lang, row.published_at, row.error) == ("A & B", "zh", datetime(2026, 7, 21), None)
    assert row.content_text == "First part\nsecond\nForm"
    assert "related" not in row.content_html and "onerror" not in row.content_html and "script" not in row.content_html
    assert 'href="https://h/x.pdf"' in row.content_html and 'src="https://h/i.png"' in row.content_html
    assert [(a.source_url, a.filename, a.is_body) for a in row.attachments] == [
        ("https://h/doc.pdf", "正文.pdf", True), ("https://h/x.pdf", "Form", False), ("https://h/y.pdf", "other file", False),
    ]


def test_short_and_rejected_articles(spark):
    html = '<h1>{}</h1><div class="b">{}</div>'
    rows = [(1, "https://h/1", html.format("Ok", "tiny")), (2, "https://h/2", html.format("Spam offer", "long enough text")), (3, "https://h/3", '<div class="b">long enough text</div>'),
            (4, "https://h/4", html.format("Ok", 'tiny <a href="/f.pdf">F</a>'))]
    config = ExtractConfig(selectors={"title": "h1", "content": ".b"}, min_content_length=10, reject_title_patterns=("spam",), attachments=AttachmentConfig(link_patterns=(r"\.pdf$",)))
    got = {r.page_id: r for r in extract_articles(pages(spark, *rows), config).collect()}
    assert {k: r.error for k, r in got.items()} == {1: "ContentTooShort", 2: "ContentRejected", 3: "SelectorMiss", 4: None}
    assert got[4].content_text == "tiny\nF\n正文见附件：F" and "<ul><li><a href=\"https://h/f.pdf\"" in got[4].content_html


def test_sanitiser(values):
    got = values(
        ['<p onclick="x">a<script>b</script><iframe>c</iframe><a href="javascript:1">d</a><a href="q?x=1&y">e</a><u>f', "<!-- c --><b>x</b> &lt;"], H.sanitize_html("v", F.lit("https://h/p/"))
    )
    assert got == ['<p>a<a rel="noopener noreferrer">d</a><a href="https://h/p/q?x=1&amp;y" rel="noopener noreferrer">e</a><u>f</u></p>', "x &lt;"]


def test_selector_induction(spark):
    rows = "".join(f'<li class="row"><a class="t" href="/n/{i}" title="Long full title {i}">Long...</a><span class="d">2026-07-{i + 10}</span></li>' for i in range(8))
    html = f'<html><body><nav><a href="/a">A</a></nav><ul class="news">{rows}</ul></body></html>'
    parsed = O.parse(pages(spark, (1, "https://h/list", html)))
    best = O.selector_candidates(O.links(parsed, with_items=True)).where("rank = 1").first()
    assert (best.item_selector, best.link_selector, best.title_selector, best.published_at_selector) == ("li.row", "a.t@href", "a.t@title", "span.d")
    assert best.matches == 8 and best.confidence == 1.0 and best.evidence == "8 repeated items; 100% contain dates; 100% links stay on site"
    kind = O.page_types(parsed, O.selector_candidates(O.links(parsed, with_items=True))).first()
    assert (kind.page_type, kind.confidence) == ("html_list", 1.0)


def test_dual_forms(spark):
    rows = [(1, "https://h/info/12/345.htm"), (2, "https://h/c.jsp?t=12&id=345"), (3, "https://h/c.jsp?id=345&t=12"), (4, "https://x/c.jsp?t=12&id=345"), (5, "https://h/about")]
    got = {(r.left_id, r.right_id) for r in O.dual_form_pairs(spark.createDataFrame(rows, "id bigint, url string")).collect()}
    assert got == {(1, 2)}
    text = "same words in both forms " * 8
    texts = spark.createDataFrame([(1, "u", "T", text), (2, "u", "T", text + "tail"), (3, "u", "T", "z" * 200)], "page_id bigint, url string, title string, text string")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "left_id bigint, right_id bigint")
    confirmed = O.confirm_dual_forms(pairs, texts).collect()
    assert [(r.left_id, r.right_id) for r in confirmed] == [(1, 2)] and 0.95 < confirmed[0].confidence <= 0.99


def test_dual_forms_compare_whole_texts(spark):
    def page(i, tail):
        return (i, f"https://h/{i}", f"<h1>T</h1><article><p>{'same words in both forms ' * 1000}</p><p>{tail}</p></article>")

    one = page(1, " ".join(f"left{n}" for n in range(2000)))
    texts = O.article_text(O.parse(pages(spark, one, page(2, " ".join(f"right{n}" for n in range(2000, 4000))), page(3, " ".join(f"left{n}" for n in range(1990)))))).cache()
    assert texts.agg(F.min(F.char_length("text"))).first()[0] > 35_000
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "left_id bigint, right_id bigint")
    # Equal for 20,000 characters, then different in 1 and 2.
    assert [(r.left_id, r.right_id) for r in O.confirm_dual_forms(pairs, texts).collect()] == [(1, 3)]


@pytest.mark.parametrize("meetings", [0, alignment.PLAIN_MEETINGS])
def test_alignment_equals_difflib(meetings, monkeypatch):
    monkeypatch.setattr(alignment, "PLAIN_MEETINGS", meetings)
    draw = random.Random(5)
    for n in range(300):
        letters = draw.choice(["ab", "abcdefgh ", "a\xf1\U0001f600z"])
        left = "".join(draw.choice(letters) for _ in range(draw.randint(0, 90)))
        right = list(left)
        for _ in range(draw.randint(0, 12)):
            at = draw.randint(0, len(right))
            right = draw.choice([right[:at] + [draw.choice(letters)] + right[at:], right[:at] + right[at + 1 :], right[at:] + right[:at]])
        right = "".join(right)
        ratio = SequenceMatcher(None, left, right, autojunk=False).ratio()
        assert alignment.similarity(left, right) == ratio
        assert alignment.similarity(left, right, 0.85) == (ratio if ratio >= 0.85 else 0.0)


def test_crawl_skips_known_and_similar_pages(spark):
    body = "<h1>T</h1><article>" + "one two three four five six seven " * 6 + "</article>"
    found = pages(spark, (1, "https://h/1", body), (2, "https://h/2/", body), (3, "https://h/2#x", body), (4, "https://h/4", "<h1>U</h1><article>entirely different words here now</article>"))
    stored = spark.createDataFrame([], "id bigint, url_hash string, fp bigint, status string")
    config = ExtractConfig(selectors={"title": "h1", "content": "article"})
    articles = crawl(found.withColumn("site_id", F.lit(1)), stored, config)
    assert {(r.id, r.status, r.duplicate_of) for r in articles.collect()} == {(1, "EXTRACTED", None), (2, "SKIPPED", 1), (4, "EXTRACTED", None)}
    again = crawl(found.withColumn("site_id", F.lit(1)), articles.select("id", "url_hash", "fp", "status"), config)
    assert again.count() == 0


PLAIN_PAGE = """<html lang="en"><head><title>The title</title></head><body><div class="top"><a href="/">Home</a> | <a href="/news">News of the day</a></div>
<div id="menu"><ul><li><a href="/1">A long headline of another article</a></li><li><a href="/2">And one more long headline of an article</a></li></ul></div>
<div id="c"><h1>The title</h1><p>The first paragraph has <b>enough</b> words to stand out from <a href="/x">what is</a> around it, as texts do.</p><div class="ad"><a href="/ad">Buy now</a></div>
<p>The second paragraph goes on with more words &amp; more sense, again of a good length.</p></div><div>Copyright</div><ul><li><a href="/3">The most read article of the whole week</a></li></ul></body></html>"""
CHINESE_PAGE = "<body><ul>" + '<li><a href="/a">关于举办第三届学术活动的通知公告</a></li>' * 6 + "</ul><div><p>各学院、各有关单位：为进一步加强教学管理，现将有关事项通知如下，请认真组织落实。</p><p>二〇二六年七月，教务处将对各单位的落实情况进行检查。</p></div><div>版权所有</div></body>"


def test_main_text_without_selectors(spark):
    long_list = "<body>" + "<ul>" + '<li><a href="/a">just a list of links</a></li>' * 9 + "</ul></body>"
    named = "<body><p>" + "words outside of it " * 9 + "</p><main>short</main></body>"
    rows = pages(spark, (1, "https://h/", PLAIN_PAGE), (2, "https://h/", CHINESE_PAGE), (3, "https://h/", long_list), (4, "https://h/", ""), (5, "https://h/", None), (6, "https://h/", named))
    got = {r.page_id: r for r in extract_articles(rows, ExtractConfig()).collect()}
    text = got[1].content_text.split("\n")
    assert got[1].title == "The title" and text[-1].startswith("The second paragraph") and "The first paragraph has" in text
    assert not {"Home", "Copyright", "A long headline of another article", "The most read article of the whole week"} & set(text)
    markup = got[1].content_html
    assert "<p>The second paragraph goes on with more words &amp; more sense, again of a good length.</p>" in markup and "headline" not in markup
    assert markup.count("<p>") == markup.count("</p>") == 2
    assert got[2].content_text == "各学院、各有关单位：为进一步加强教学管理，现将有关事项通知如下，请认真组织落实。\n二〇二六年七月，教务处将对各单位的落实情况进行检查。"
    # Where nothing stands out the whole body stays; a main element comes before any score.
    assert got[3].content_text.count("just a list of links") == 9 and got[6].content_text == "short"
    assert got[4].content_text == "" and got[5].content_text == ""


def plain_best_block(scores):
    """All stretches that begin and end with text, by brute force."""
    best = (0.0, None)
    for i, (is_text, _) in enumerate(scores):
        for j in range(i, len(scores)):
            total = sum(s for _, s in scores[i : j + 1])
            if is_text and scores[j][0] and total > best[0] + 1e-9:
                best = (total, (i, j))
    return best


def test_main_block_is_the_largest_sum(spark):
    import random

    draw, sources = random.Random(5), []
    for _ in range(60):
        parts = [draw.choice(["<p>{}</p>", '<a href="#">{}</a>', "<div>{}</div>", "<nav>{}</nav>", "<b>{}</b>", "{}"]).format("x" * draw.choice([1, 5, 12, 30, 80]) if draw.random() < 0.9 else "") for _ in range(12)]
        sources.append("".join(parts))
    frame = pages(spark, *((i, "https://h/", s) for i, s in enumerate(sources))).withColumn("nodes", H.dom("html"))
    rows = frame.select("page_id", "nodes", H.main_block(F.col("nodes"), ("nav",)).alias("b")).collect()
    found = 0
    for r in rows:
        scores, link, aside = [], -1, -1
        for n in r.nodes:
            if n.tag == "#text":
                worth = len(n.text) / H.LETTERS_PER_WORD
                scores.append((True, -worth if n.id <= link or n.id <= aside else worth))
            else:
                link, aside = (max(link, n.last) if n.tag == "a" else link), (max(aside, n.last) if n.tag == "nav" else aside)
                scores.append((False, -H.LINK_COST if n.tag == "a" else 0.0 if n.tag in H.INLINE else -H.BLOCK_COST))
        total, stretch = plain_best_block(scores)
        assert (r.b is None) == (total < H.LEAST_SCORE)
        if r.b is not None:
            found += 1
            got = sum(s for _, s in scores[r.b.id : r.b.last + 1])
            assert abs(got - total) < 1e-6 and scores[r.b.id][0] and scores[r.b.last][0]
    assert found > 20


def test_pages_without_a_marked_body(spark):
    from inkstream.functions import html as H
    from pyspark.sql import functions as F

    pages = [
        (1, "<title>t</title><div>one</div><p>two</p>", "one two", "t one two"),
        (2, "<html><head><title>t</title><script>s</script></head><div>one</div>two</html>", "one two", "t s one two"),
        (3, "<title>t</title><body><div>one</div></body>", "one", "t one"),
        (4, "<title>t</title>", "", "t"),
        (5, "plain <b>text</b>", "plain text", "plain text"),
        (6, "<html><head><title>t</title></head>bare</html>", "bare", "t bare"),
    ]
    rows = spark.createDataFrame([p[:2] for p in pages], "id int, html string").withColumn("nodes", H.dom("html"))
    nodes = F.col("nodes")
    got = rows.select("id", H.text_of(nodes, H.body_of(nodes)).alias("body"), H.text_of(nodes, H.page_of(nodes)).alias("page")).collect()
    assert {(r.id, r.body, r.page) for r in got} == {(i, body, page) for i, _, body, page in pages}


def test_a_parse_holds_few_pages_at_once(spark):
    """Nodes take many times the room of their page, so a task must not keep those of a whole Arrow batch."""
    live = [0]

    class Held(list):
        def __init__(self, nodes):
            super().__init__(nodes)
            live[0] += 1

        def __del__(self):
            live[0] -= 1

    def parse(page):
        held = Held(H.tree(page))
        held[0]["attrs"] = {"live": str(live[0])}
        return held

    pages = spark.range(0, 1000, 1, 1).select(F.format_string("<p>%d</p>", "id").alias("html"))
    nodes = pages.select(H.isolated(parse)("html").alias("n")).select("n.nodes")
    most = nodes.agg(F.max(F.get("nodes", 0)["attrs"]["live"].cast("int"))).first()[0]
    assert most <= 100
    for column in (H.dom, H.xml_dom):
        assert column.evalType == PythonEvalType.SQL_BATCHED_UDF


def test_odd_texts_parse_as_before(spark):
    texts = [None, "", "  ", "<p>a&#0;b&#xD800;\U0001f600<br/>", "<a b c=''>x", "<![x[y]]>z", "<!DOCTYPE html><p>a<p>b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, html string").select("i", H.dom("html").alias("n"), H.xml_dom("html").alias("x"))
    for i, found, strict in ((r["i"], r["n"], r["x"]) for r in rows.collect()):
        expected = None if texts[i] is None else H.tree(texts[i])
        assert (found is None) == (expected is None) and (strict is not None) == bool(H._xml_nodes(texts[i]))
        assert [n.asDict() for n in found or []] == (expected or [])


def test_page_texts_and_links_pass_row_by_row(spark):
    """Arrow batches count rows, not room: what holds whole texts or all links of a page comes in small batches."""
    from pyspark.util import PythonEvalType

    from inkstream.functions import text as X
    from inkstream.functions import urls as U

    for call in (H.sanitize_html, U.absolute_urls, X.simhash64("md5")):
        assert call.evalType == PythonEvalType.SQL_BATCHED_UDF
    rows = [(0, None, None, None), (1, "<p>a b c<script>x", "https://x.example/a/", ["b", None, "//[", "?q"]), (2, "<i>", None, [])]
    frame = spark.createDataFrame(rows, "i int, html string, base string, links array<string>")
    got = frame.select("i", H.sanitize_html("html", "base").alias("h"), U.absolute_urls("base", "links").alias("u"), X.simhash64("md5")("html").alias("f")).orderBy("i").collect()
    assert [r.h for r in got] == [None, "<p>a b c</p>", ""]
    assert [r.u for r in got] == [None, ["https://x.example/a/b", None, None, "https://x.example/a/?q"], []]
    assert got[0].f == 0 and got[1].f == X._fingerprint(rows[1][1], X._md5_low) and got[1].f != 0


@pytest.mark.parametrize("name", ["htm9_onb1_onb3_config_candidates", "htm9_onb1_onb3_built_configs"])
def test_configurations_take_pages_row_by_row(spark, tmp_path, monkeypatch, name):
    """Every Python step of the whole query, those before its stored tables too, passes small batches of pages."""
    from inkstream.plans import load_all, onboarding

    query = load_all()[name]
    pages(spark, *[(i, f"https://x.example/{i}/", LIST) for i in range(3)]).write.parquet(f"{tmp_path}/pages.parquet")
    steps = []

    def stored(frame):
        steps.append(frame)
        return cut_lineage(frame)

    monkeypatch.setattr(onboarding, "cut_lineage", stored)
    steps.append(query.run(spark, str(tmp_path)))
    plans = [frame._jdf.queryExecution().optimizedPlan().toString() for frame in steps]
    assert sum(plan.count("BatchEvalPython") for plan in plans) >= 3
    assert not any("ArrowEvalPython" in plan for plan in plans)
    assert [row.page_id for row in steps[-1].orderBy("page_id").collect()] == [0, 1, 2]


def test_page_types_look_for_the_body_once(spark):
    """The body of a page is bound before its nodes are held against it, so the work is in proportion to the nodes."""
    tree = O.parse(pages(spark, (1, "https://x.example/a", LIST), (2, "https://x.example/b", f"<html><title>t</title><body>{LIST}</body></html>"), (3, "https://x.example/c", None)))
    found = O.page_types(tree, O.selector_candidates(O.links(tree, with_items=True)))
    # The implied body reads its first node's number and place; a search inside the lambda over all nodes would double that.
    assert found._jdf.queryExecution().analyzed().toString().count("noscript") == 2
    text = " ".join(["First...", "2026-07-21", "Second...", "2026-07-20", "Away"])
    assert {row.page_id: row.text_length for row in found.collect()} == {1: len(text), 2: len(text), 3: None}
