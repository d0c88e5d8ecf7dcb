"""Markup as data: a page becomes an array of nodes, and selection is column algebra over it.

Only the parse itself runs in Python. A node carries its pre-order number `id` and the number of its
last descendant `last`, so "inside" is a range test and needs no recursion; `begin`/`stop` are its
character offsets in the source. Text nodes have the tag `#text` and hold stripped, non-blank text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from html import escape
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit
from xml.etree import ElementTree

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dates import let, strip

NODE = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("last", T.IntegerType()),
        T.StructField("up", T.IntegerType()),
        T.StructField("tag", T.StringType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("text", T.StringType()),
        T.StructField("hidden", T.BooleanType()),
        T.StructField("begin", T.IntegerType()),
        T.StructField("stop", T.IntegerType()),
    ]
)
NODES = T.ArrayType(NODE)

# Fixed element lists.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = {"script", "style", "template"}
CLOSES_PARAGRAPH = set(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
CLOSED_BY_SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARRIERS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

SAFE_TAGS = set(
    "a blockquote br code del div em h1 h2 h3 h4 h5 h6 hr img li ol p pre span strong sub sup table tbody td th thead tr u ul".split()
)
SAFE_ATTRS = {
    "a": {"href", "title"},
    "img": {"src", "alt", "title", "width", "height"},
    "td": {"colspan", "rowspan"},
    "th": {"colspan", "rowspan"},
}
DROPPED_WITH_CONTENT = {"script", "style", "iframe", "object", "template"}
SAFE_SCHEMES = {"http", "https", "mailto"}


class _Lenient(HTMLParser):
    """Marked sections of unknown kinds are comments, as browsers read them."""

    def parse_marked_section(self, i, report=1):
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i, report)


class _Tree(_Lenient):
    """Collects nodes in document order while keeping the stack of open elements."""

    def __init__(self, source: str) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.open: list[dict] = []
        self.line_starts = [0, *(m.end() for m in re.finditer("\n", source))]
        self.size = len(source)
        self.feed(source)
        self.close()
        while self.open:
            self._pop(self.size)

    def _here(self) -> int:
        line, column = self.getpos()
        return self.line_starts[line - 1] + column

    def _pop(self, stop: int) -> None:
        node = self.open.pop()
        node["last"], node["stop"] = len(self.nodes) - 1, stop

    def _add(self, tag: str, attrs: dict, text: str | None, begin: int) -> dict:
        up = self.open[-1] if self.open else None
        node = {
            "id": len(self.nodes), "last": len(self.nodes), "up": up["id"] if up else -1, "tag": tag, "attrs": attrs, "text": text,
            "hidden": tag in HIDDEN or bool(up and up["hidden"]), "begin": begin, "stop": begin,
        }
        self.nodes.append(node)
        return node

    def _close_implied(self, tag: str, at: int) -> None:
        names = [n["tag"] for n in self.open]
        if tag in CLOSES_PARAGRAPH and "p" in names:
            self._pop_through(len(names) - 1 - names[::-1].index("p"), at)
            return
        for depth in range(len(names) - 1, -1, -1):
            if names[depth] in BARRIERS.get(tag, ()):
                return
            if names[depth] in CLOSED_BY_SIBLING.get(tag, ()):
                self._pop_through(depth, at)
                return

    def _pop_through(self, depth: int, stop: int) -> None:
        while len(self.open) > depth:
            self._pop(stop)

    def handle_starttag(self, tag, attrs):
        at = self._here()
        self._close_implied(tag, at)
        values: dict[str, str] = {}
        for name, value in attrs:
            values.setdefault(name, value or "")
        node = self._add(tag, values, None, at)
        if tag in VOID:
            node["stop"] = at + len(self.get_starttag_text() or "")
        else:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        at = self._here()
        # The whole page is fed at once, so buffer positions are source positions.
        close = self.rawdata.find(">", at)
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth]["tag"] == tag:
                self._pop_through(depth + 1, at)
                self._pop(close + 1 if close >= 0 else self.size)
                return

    def handle_data(self, data):
        text = data.strip()
        if text:
            at = self._here()
            self._add("#text", {}, text, at)["stop"] = at + len(data)


def tree(page: str) -> list[dict]:
    return _Tree(page).nodes


# Nodes take many times the room of their text, and Arrow batches count rows. Row-wise calls hold a hundred pages at most.
@F.udf(NODES, useArrow=False)
def dom(page: str | None) -> list[dict] | None:
    """HTML text -> nodes."""
    return None if page is None else tree(page)


def strict_tree(page: str) -> list[dict]:
    """Nodes of a page that is well-formed; raises on any other."""
    ElementTree.fromstring(page)
    return tree(page)


def isolated(parse: Callable[[str], list[dict]]):
    """Column function: text -> (nodes, error). What `parse` raises on one text is that row's error, `Type: message`."""

    def one(text: str | None) -> tuple[list[dict] | None, str | None]:
        try:
            return None if text is None else parse(text), None
        except Exception as error:  # whatever a page provokes concerns that page alone
            return None, f"{type(error).__name__}: {error}"

    kind = T.StructType([T.StructField("nodes", NODES), T.StructField("error", T.StringType())])
    return F.udf(one, kind, useArrow=False).asNondeterministic()


def _xml_nodes(text: str | None) -> list[dict] | None:
    if text is None or "<!ENTITY" in text:
        return None
    try:
        root = ElementTree.fromstring(text.lstrip("﻿ \t\r\n"))
    except (ElementTree.ParseError, ValueError):
        return None
    nodes: list[dict] = []
    stack = [(root, -1, None)]
    while stack:
        element, up, done = stack.pop()
        if done is not None:
            done["last"] = len(nodes) - 1
            continue
        node = {
            "id": len(nodes), "last": len(nodes), "up": up, "tag": element.tag.rsplit("}", 1)[-1],
            "attrs": {k.rsplit("}", 1)[-1]: v for k, v in element.attrib.items()},
            "text": (element.text or "").strip() or None, "hidden": False, "begin": 0, "stop": 0,
        }
        nodes.append(node)
        stack.append((element, up, node))
        stack.extend((child, node["id"], None) for child in reversed(list(element)))
    return nodes


@F.udf(NODES, useArrow=False)
def xml_dom(document: str | None) -> list[dict] | None:
    """XML text -> nodes with namespace-free names; NULL when malformed or defining entities."""
    return _xml_nodes(document)


# The optimiser must not move a parse into a lambda that reads its result.
dom = dom.asNondeterministic()
xml_dom = xml_dom.asNondeterministic()

# ---- column algebra ------------------------------------------------------------------------------

_COMPOUND = re.compile(r"""([\w*-]+)|\.([\w-]+)|\#([\w-]+)|\[\s*([\w:-]+)\s*(?:([~^$*|]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]*)))?\s*\]""")


def _compound(selector: str):
    """`tag.class#id[attr^=x]` as a predicate on a node column."""
    tests = []
    for tag, cls, ident, attr, op, quoted, single, bare in _COMPOUND.findall(selector):
        if tag and tag != "*":
            tests.append(lambda n, v=tag.lower(): n["tag"] == v)
        elif cls:
            tests.append(lambda n, v=cls: F.array_contains(F.split(F.coalesce(n["attrs"]["class"], F.lit("")), r"\s+"), v))
        elif ident:
            tests.append(lambda n, v=ident: n["attrs"]["id"] == v)
        elif attr:
            value = quoted or single or bare
            tests.append(lambda n, a=attr, o=op, v=value: _attr_test(n["attrs"][a], o, v))

    def predicate(node: Column) -> Column:
        result = node["tag"] != "#text"
        for test in tests:
            result = result & F.coalesce(test(node), F.lit(False))
        return result

    return predicate


def _attr_test(value: Column, op: str, wanted: str) -> Column:
    if not op:
        return value.isNotNull()
    return {
        "=": lambda: value == wanted,
        "^=": lambda: value.startswith(wanted),
        "$=": lambda: value.endswith(wanted),
        "*=": lambda: value.contains(wanted),
        "~=": lambda: F.array_contains(F.split(value, r"\s+"), wanted),
        "|=": lambda: (value == wanted) | value.startswith(wanted + "-"),
    }[op]()


def matches(nodes: Column, selector: str):
    """Predicate for a selector: compounds, descendant and child combinators, comma lists."""
    options = [_chain(nodes, option.strip()) for option in selector.split(",") if option.strip()]

    def predicate(node: Column) -> Column:
        result = F.lit(False)
        for option in options:
            result = result | option(node)
        return result

    return predicate


def _chain(nodes: Column, selector: str):
    steps = re.split(r"\s*>\s*|\s+", selector)
    links = re.findall(r"\s*>\s*|\s+", selector)
    predicate = _compound(steps[0])
    for step, link in zip(steps[1:], links):
        outer, own, direct = predicate, _compound(step), ">" in link

        def predicate(node, outer=outer, own=own, direct=direct):
            def above(a):
                near = (a["id"] == node["up"]) if direct else ((a["id"] < node["id"]) & (node["id"] <= a["last"]))
                return near & outer(a)

            return own(node) & F.exists(nodes, above)

    return predicate


def select(nodes: Column, selector: str) -> Column:
    """All nodes a selector matches, in document order."""
    return F.filter(nodes, matches(nodes, selector))


def first(nodes: Column, selector: str) -> Column:
    return F.get(select(nodes, selector), 0)


def inside(node: Column, other: Column) -> Column:
    return (other["id"] >= node["id"]) & (other["id"] <= node["last"])


def select_in(nodes: Column, node: Column, selector: str) -> Column:
    test = matches(nodes, selector)
    return F.filter(nodes, lambda n: inside(node, n) & test(n))


def text_of(nodes: Column, node: Column, separator: str = " ", *, visible: bool = False) -> Column:
    """Stripped text pieces below a node; `visible` leaves out script, style and template."""
    def wanted(n: Column) -> Column:
        keep = (n["tag"] == "#text") & inside(node, n)
        return keep & ~n["hidden"] if visible else keep

    return F.array_join(F.transform(F.filter(nodes, wanted), lambda n: n["text"]), separator)


# Fixed value: elements that belong to the head where a page does not mark its body.
HEAD = ("html", "head", "title", "meta", "link", "base", "style", "script", "template", "noscript")


def _region(nodes: Column, start: Column, begin: Column) -> Column:
    """A node that spans everything from node `start` on."""
    stop = F.array_max(F.transform(nodes, lambda n: n["stop"]))
    whole = F.get(nodes, 0).withField("id", start.cast("int")).withField("last", (F.size(nodes) - 1).cast("int"))
    return whole.withField("tag", F.lit("body")).withField("begin", begin).withField("stop", stop)


def page_of(nodes: Column) -> Column:
    """The whole page, which may have several outermost elements."""
    return _region(nodes, F.lit(0), F.get(nodes, 0)["begin"])


def body_of(nodes: Column) -> Column:
    """The body element, or where none is marked all that follows the head elements at the start."""
    top = lambda n: (n["up"] == -1) | (F.get(nodes, n["up"])["tag"] == "html")
    content = F.filter(nodes, lambda n: F.when(n["tag"] == "#text", F.coalesce(top(n), F.lit(True))).otherwise(~n["tag"].isin(*HEAD)))
    start = F.get(content, 0)
    implied = _region(nodes, F.coalesce(start["id"], F.size(nodes)), F.coalesce(start["begin"], F.get(nodes, F.size(nodes) - 1)["stop"]))
    return F.coalesce(first(nodes, "body"), implied)


# Own weights of the main-text score, in words: what an element costs, and what makes a word.
BLOCK_COST, LINK_COST, LETTERS_PER_WORD, LEAST_SCORE = 2.0, 3.0, 6.0, 10.0
INLINE = ("a", "abbr", "b", "br", "cite", "code", "em", "font", "i", "img", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "time", "u", "wbr")
IDEOGRAPHS = r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]"


def main_block(nodes: Column, aside: Sequence[str]) -> Column:
    """The stretch of a page that holds its main text, as a node with the range of all its nodes; NULL if none stands out.

    Every node has a score: text counts its words (an ideograph is a third of one), or loses them inside links, hidden
    elements and those named in `aside`; block elements and links cost a little. The stretch with the largest sum wins, found
    in one pass over the nodes: a sum below zero is never carried on. It begins and ends with text.
    """
    state = "struct<link:int,aside:int,sum:double,from:int,best:double,first:int,last:int>"
    zero = F.struct(*(F.lit(v) for v in (-1, -1, 0.0, -1, 0.0, -1, -1))).cast(state)

    def step(at: Column, n: Column) -> Column:
        words = (F.char_length(n["text"]) + F.regexp_count(n["text"], F.lit(IDEOGRAPHS))) / LETTERS_PER_WORD
        link = F.when(n["tag"] == "a", F.greatest(at["link"], n["last"])).otherwise(at["link"])
        out = F.when(n["tag"].isin(*aside), F.greatest(at["aside"], n["last"])).otherwise(at["aside"])
        loses = (n["id"] <= at["link"]) | (n["id"] <= at["aside"]) | n["hidden"]
        cost = F.when(n["tag"] == "a", F.lit(-LINK_COST)).when(n["tag"].isin(*INLINE), F.lit(0.0)).otherwise(F.lit(-BLOCK_COST))
        is_text = n["tag"] == "#text"
        score = F.when(is_text, F.when(loses, -words).otherwise(words)).otherwise(cost)

        def added(total: Column) -> Column:
            fresh = is_text & ~loses & (at["sum"] <= 0)
            begin = F.when(fresh, n["id"]).otherwise(at["from"])
            better = is_text & (total > at["best"])
            return F.struct(
                link.alias("link"), out.alias("aside"), total.alias("sum"), begin.alias("from"), F.when(better, total).otherwise(at["best"]).alias("best"),
                F.when(better, begin).otherwise(at["first"]).alias("first"), F.when(better, n["id"]).otherwise(at["last"]).alias("last"),
            ).cast(state)

        return let(F.greatest(at["sum"], F.lit(0.0)) + score, added)

    def block(found: Column) -> Column:
        # The source goes on to the next node, and begins with the element that the first text opens.
        stop = F.coalesce(F.get(nodes, found["last"] + 1)["begin"], F.get(nodes, 0)["stop"])

        def stretch(n: Column) -> Column:
            opener = F.get(nodes, n["up"])
            begin = F.when(n["up"] == n["id"] - 1, opener["begin"]).otherwise(n["begin"])
            return n.withField("last", found["last"]).withField("begin", begin).withField("stop", F.greatest(stop, F.get(nodes, found["last"])["stop"]))

        return F.when(found["best"] >= LEAST_SCORE, let(F.get(nodes, found["first"]), stretch))

    return let(F.aggregate(nodes, zero, step), block)


def value_of(nodes: Column, scope: Column | None, expression: str) -> Column:
    """`selector@attr` or `selector`: attribute or text of the first match; blank becomes NULL."""
    parts = re.fullmatch(r"(?s)(?:(?P<css>.*)@(?P<attr>[\w:-]+)|(?P<whole>.*))", expression)
    selector, attr = parts["whole"] if parts["attr"] is None else parts["css"], parts["attr"]
    if not selector:
        node = scope
    elif scope is None:
        node = first(nodes, selector)
    else:
        node = F.get(select_in(nodes, scope, selector), 0)
    raw = let(node, lambda n: n["attrs"][attr] if attr else text_of(nodes, n))
    return let(strip(raw), lambda v: F.when(v != "", v))


# ---- small per-value helpers ------------------------------------------------------------------


class _Cleaner(_Lenient):
    def __init__(self, base: str | None) -> None:
        super().__init__(convert_charrefs=True)
        self.base, self.out, self.open, self.muted = base, [], [], []

    def _attr(self, tag: str, name: str, value: str) -> str | None:
        if name not in SAFE_ATTRS.get(tag, ()):
            return None
        if name in {"href", "src"}:
            scheme = urlsplit(value.strip()).scheme.lower() if ":" in value else ""
            if scheme and scheme not in SAFE_SCHEMES:
                return None
            if not scheme:
                if not self.base:
                    return None
                value = urljoin(self.base, value)
        return f' {name}="{escape(value)}"'

    def handle_starttag(self, tag, attrs):
        if self.muted or tag in DROPPED_WITH_CONTENT:
            self.muted.append(tag)
            return
        if tag not in SAFE_TAGS:
            return
        kept = "".join(filter(None, (self._safe(tag, n, v or "") for n, v in dict(reversed(attrs)).items())))
        rel = ' rel="noopener noreferrer"' if tag == "a" else ""
        self.out.append(f"<{tag}{kept}{rel}>")
        if tag not in VOID:
            self.open.append(tag)

    def _safe(self, tag, name, value):
        try:
            return self._attr(tag, name, value)
        except ValueError:
            return None

    def handle_endtag(self, tag):
        if self.muted:
            if tag in self.muted:
                while self.muted.pop() != tag:
                    pass
            return
        if tag in self.open:
            while True:
                closed = self.open.pop()
                self.out.append(f"</{closed}>")
                if closed == tag:
                    break

    def handle_data(self, data):
        if not self.muted:
            self.out.append(escape(data, quote=False))

    def finish(self) -> str:
        self.close()
        return "".join(self.out) + "".join(f"</{t}>" for t in reversed(self.open))


def _clean(html: str | None, base: str | None) -> str | None:
    if html is None:
        return None
    cleaner = _Cleaner(base)
    cleaner.feed(html)
    return cleaner.finish()


# Row-wise, as the parsers: an Arrow batch would hold ten thousand page texts three times over.
@F.udf(T.StringType(), useArrow=False)
def sanitize_html(fragment: str | None, base: str | None) -> str | None:
    """Allow-listed tags, attributes and schemes; relative addresses become absolute."""
    return _clean(fragment, base)


# Kept apart from later projections, like the parsers above.
sanitize_html = sanitize_html.asNondeterministic()


def escaped(text: Column) -> Column:
    """Text as it stands in markup, inside elements and quoted attributes."""
    for plain, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def cut_source(html: Column, node: Column, dropped: Column) -> Column:
    """Source text of a node without the given inner nodes."""
    inner = F.filter(dropped, lambda d: inside(node, d))
    # Nested drops are covered by their outermost one.
    outer = F.filter(inner, lambda d: ~F.exists(inner, lambda o: (o["id"] < d["id"]) & (d["id"] <= o["last"])))
    starts = F.concat(F.array(node["begin"]), F.transform(outer, lambda d: d["stop"]))
    stops = F.concat(F.transform(outer, lambda d: d["begin"]), F.array(node["stop"]))
    pieces = F.zip_with(starts, stops, lambda a, b: F.substring(html, a + 1, F.greatest(b - a, F.lit(0))))
    return F.array_join(pieces, "")
