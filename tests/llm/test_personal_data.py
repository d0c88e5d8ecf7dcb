"""Personal data: plain forms against the patterns themselves, disguises by what they cover."""

import hashlib
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkstream.llm import personal_data
from inkstream.llm.personal_data import KINDS, Disguises, detect, find_in

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, match):
    digits = [int(c) for c in match if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def plain_detect(text):
    return sorted((m.start(), k, m.end()) for k, kind in enumerate(KINDS) for m in re.finditer(PATTERNS[kind], text) if passes(kind, m.group()))


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="ab.@-_+%0123459 ()\n", max_size=60))
def test_plain_forms_equal_the_patterns(text):
    assert detect(text) == plain_detect(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["x.y@b-c.de", "@", "a@b.c", "_d@e.f.", "1.2.3.4", "255.256.1.1", "007.0.0.255", "4111 1111 1111 1111", "5500-0000-0000-0004", "0" * 14, "+1 (017) 555-7713", "+", "+49 30 123", ".", " ", "é", "00000255", "9" * 30]), max_size=8))
def test_adjoining_forms_equal_the_patterns(parts):
    text = "".join(parts)
    assert detect(text) == plain_detect(text)


CARD = "4111 1111 1111 1111"
SPELLED = "four one one one one one one one one one one one one one one one"
DISGUISED = [
    ("mail jane [at] mail7 [dot] example [dot] com now", "email", "jane [at] mail7 [dot] example [dot] com"),
    ("mail jane(at)example.com now", "email", "jane(at)example.com"),
    ("mail jane {AT} example <DOT> com now", "email", "jane {AT} example <DOT> com"),
    ("mail jane at example dot com now", "email", "jane at example dot com"),
    ("mail jаne＠exаmple．com now", "email", "jаne＠exаmple．com"),
    ("mail jane@​example.com now", "email", "jane@​example.com"),
    ("host 10[.]0[.]0[.]255 now", "ip", "10[.]0[.]0[.]255"),
    ("host 10 dot 0 dot 0 dot 1 now", "ip", "10 dot 0 dot 0 dot 1"),
    ("host １９２．１６８．０．１ now", "ip", "１９２．１６８．０．１"),
    (f"card {SPELLED} now", "card", SPELLED),
    ("card 4lll 1111 llll 1111 now", "card", "4lll 1111 llll 1111"),
    ("card 4111–1111–1111–1111 now", "card", "4111–1111–1111–1111"),
    ("call plus one two one two five five five zero one nine nine now", "phone", "plus one two one two five five five zero one nine nine"),
    ("call +1 (212) five five five 0199 now", "phone", "+1 (212) five five five 0199"),
    ("call ＋٤٩ ٣٠ ١٢٣٤٥٦٧٨ now", "phone", "＋٤٩ ٣٠ ١٢٣٤٥٦٧٨"),
]


@pytest.mark.parametrize("text, kind, covered", DISGUISED)
def test_disguised_forms_are_mapped_back(text, kind, covered):
    for before, after in [("", ""), ("ça й ", " ]["), ("x@y.zz 1.1.1.1 ", " see [at] once")]:
        whole = before + text + after
        added = [(KINDS[k], whole[a:b]) for a, k, b, base in find_in(whole, Disguises()) if not base]
        assert (kind, covered) in added
        assert [s[:3] for s in find_in(whole, Disguises()) if s[3]] == detect(whole)


@pytest.mark.parametrize("text", ["look at example.org for one or two", "at one dot he stopped", "one two buckle my shoe", "call +1 (017) 555-7713 one day", f"{CARD} one two", "a (at) b", "meet at dot", "nine one", "1l 2l 3l", "é" * 40, "прийти на дом 5 раз"])
def test_ordinary_prose_gets_no_added_spans(text):
    assert all(base for *_, base in find_in(text, Disguises()))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["one", "TWO", "five ", " at ", " dot ", "[at]", "( dot )", "a", "b@c", ".d", "é", "​", "＠", "ſix", "fıve", "SİX", "1", "23", "-", " ", "plus ", "O", "l", "<", "]", "4111 1111"]), max_size=25))
def test_spans_of_mixed_texts_lie_within_them(parts):
    text = "".join(parts)
    found = find_in(text, Disguises())
    assert found == sorted(found) and all(0 <= a < b <= len(text) for a, _, b, _ in found)
    assert [s[:3] for s in found if s[3]] == plain_detect(text)


@pytest.mark.parametrize("unit", ["a", "a.", "1", "1.", "1 ", "+1", "+1 ", "@", "a@", "one ", "1one ", " at a", " dot ", " ", "[", "( ", "four one at a dot ", "l1", "​", "а"])
def test_long_texts_take_linear_time(unit):
    disguises, began = Disguises(), time.process_time()
    find_in(unit * (400_000 // len(unit)), disguises)
    assert time.process_time() - began < 6


def test_find_and_digests(spark, plain, odd, clashing, nothing):
    rows = [(1, "x a@b.co 1.2.3.4"), (2, None), (3, ""), (4, DISGUISED[0][0]), (4, DISGUISED[0][0]), (None, "+1 (017) 555-7713")]
    got = personal_data.digests(personal_data.find(plain(rows))).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert by_id[1][1:] == (1, 1, 0, 0, sha("email:2:8,ip:9:16"), "email:2:8,ip:9:16", 0)
    assert by_id[2][1:] == by_id[3][1:] == (0, 0, 0, 0, sha(""), "", 0)
    assert by_id[4][1:] == (0, 0, 0, 0, sha(""), "email:5:44", 1)
    assert by_id[None]["spans"] == "phone:0:17"
    want = sorted((str(r["doc_id"]), ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in find_in(r["text"] or "", Disguises()))) for r in odd.collect())
    for docs in (odd, clashing):
        assert sorted((str(r["doc_id"]), r["spans"]) for r in personal_data.digests(personal_data.find(docs)).collect()) == want
    assert personal_data.find(nothing).collect() == []


def test_redact_keeps_everything_else(plain, clashing):
    rows = [(1, f"a@b.co and jane [at] example [dot] com, {CARD}."), (2, None), (3, "nothing here")]
    got = {r["doc_id"]: r["text"] for r in personal_data.redact(plain(rows)).collect()}
    assert got == {1: "[email] and [email], [card].", 2: None, 3: "nothing here"}
    done = personal_data.redact(clashing)
    assert done.columns == clashing.columns and done.dtypes == clashing.dtypes
    drop = lambda r: tuple(map(str, (v for c, v in zip(clashing.columns, r) if c != "text")))
    assert sorted(map(drop, done.collect())) == sorted(map(drop, clashing.collect()))


def test_masking_joins_overlaps():
    spans = [(0, 0, 4, True), (2, 2, 8, False), (9, 3, 12, True)]
    assert personal_data.masked("abcdefgh ijk.", spans) == "[email] [phone]."
    draw = random.Random(3)
    text = "".join(draw.choice("ab1 ") for _ in range(50))
    assert personal_data.masked(text, []) == text
