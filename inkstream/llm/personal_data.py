"""Personal data in whole texts, also where it is disguised, with spans in the source's code points.

Four detectors (KINDS) run over the text as it is: these are the base spans. Texts that hold a disguise then pass a chain
of transducers, each of which rewrites some places and carries along, for every character it writes, the span of source
characters it stands for:

    look-alikes    letters of other scripts, full-width and styled forms become ASCII; invisible characters go
    spelled digits runs of three or more digits, three or most of them in words ("five five 5"), "plus", letters among digits
    at and dot     "[at]", "(dot)" and, inside addresses, " at " and " dot "

The same detectors run over what comes out, and their spans are mapped back. A span found there is added if it holds
a rewritten place and no base span of its kind covers it. Everything about a text is decided in one pass over it, so
documents never meet and nothing is shuffled.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import per_text

KINDS = ("email", "ip", "card", "phone")
#: Digits of a run that is read as spelled out.
LEAST_SPELLED = 3

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits begins; possessive runs keep failures linear.
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = re.compile("[^0-9]")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+ leftmost and not overlapping, in linear time."""
    floor, at = 0, text.find("@")
    while at >= 0:
        local = at - len(text[floor:at].rstrip(_LOCAL)) - floor
        domain = _DOMAIN.match(text, at + 1) if local else None
        if domain:
            yield at - local, domain.end()
        floor = domain.end() if domain else at + 1
        at = text.find("@", floor)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(_DOUBLED[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def _digits(match: str) -> str:
    return _NO_DIGIT.sub("", match)


def detect(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the plain forms, in order."""
    found = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := _digits(m.group())) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return sorted(found)


# Letters that look like ASCII ones and have no compatibility form, by script.
_LOOK_ALIKES = {
    "АВЕЅІЈКМНОРСТУХаеоѕіјрсухԁһԛԝ": "ABESIJKMHOPCTYXaeosijpcyxdhqw",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονιυρκ": "ABEZHIKMNOPTYXovlupk",
    "ıİ": "iI",
    "‐‑‒–—−": "------",
    "․﹒。": "...",
}
#: Characters without width, which go: soft hyphen, joiners, marks of direction, byte order mark.
_INVISIBLE = "­​‌‍‎‏⁠﻿"


@functools.cache
def look_alikes() -> np.ndarray:
    """What each code point becomes: the list above, and all whose compatibility form is one ASCII character or digit.

    Others become themselves, invisible ones 0.
    """
    made = np.arange(0x110000, dtype=np.uint32)
    for code in range(0x80, 0x20000):
        c = chr(code)
        form = unicodedata.normalize("NFKC", c)
        if len(form) == 1 and form.isascii() and form.isprintable():
            made[code] = ord(form)
        elif (digit := unicodedata.decimal(c, None)) is not None:
            made[code] = ord("0") + digit
    for alike, ascii_ in _LOOK_ALIKES.items():
        made[list(map(ord, alike))] = list(map(ord, ascii_))
    made[list(map(ord, _INVISIBLE))] = 0
    return made


class Rewritten:
    """A text with, for each of its characters, the source span it stands for and whether it was rewritten.

    While nothing is rewritten (`same`), no spans are kept.
    """

    def __init__(self, text: str) -> None:
        self.text, self.same = text, True

    def _begin(self) -> None:
        if self.same:
            self.same = False
            self.starts = np.arange(len(self.text), dtype=np.int32)
            self.ends = self.starts + np.int32(1)
            self.changed = np.zeros(len(self.text), bool)

    def exchange(self, become: np.ndarray) -> None:
        """Write every character as become has it; those that become 0 go."""
        old = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        new = become[old]
        changed = new != old
        if not changed.any():
            return
        self._begin()
        stay = (new != 0) | (old == 0)
        self.text = new[stay].tobytes().decode("utf-32-le", "surrogatepass")
        self.starts, self.ends, self.changed = self.starts[stay], self.ends[stay], (self.changed | changed)[stay]

    def replace(self, places: list[tuple[int, int, str]]) -> None:
        """Write each place (start, end, new) anew; places are in order and apart, their characters share the place's span."""
        if not places:
            return
        self._begin()
        # Stretches that stay and new ones take turns; a new one's characters all point to its place.
        firsts, lasts = (np.array([p[i] for p in places]) for i in (0, 1))
        kept_from, kept_to = np.append(0, lasts), np.append(firsts, len(self.text))
        lengths = np.zeros(2 * len(places) + 1, np.int64)
        lengths[::2], lengths[1::2] = kept_to - kept_from, [len(p[2]) for p in places]
        is_new = np.repeat(np.arange(len(lengths)) % 2 == 1, lengths)
        offset = np.where(is_new, 0, np.arange(len(is_new)) - np.repeat(np.cumsum(lengths) - lengths, lengths))
        base_first, base_last = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        base_first[::2] = base_last[::2] = kept_from
        base_first[1::2], base_last[1::2] = firsts, lasts - 1
        first, last = np.repeat(base_first, lengths) + offset, np.repeat(base_last, lengths) + offset
        self.starts, self.ends, self.changed = self.starts[first], self.ends[last], self.changed[first] | is_new
        pieces, done = [], 0
        for start, end, new in places:
            pieces += [self.text[done:start], new]
            done = end
        self.text = "".join([*pieces, self.text[done:]])


_SPELLED = 3

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits begins; possessive runs keep failures linear.
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = re.compile("[^0-9]")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+ leftmost and not overlapping, in linear time."""
    floor, at = 0, text.find("@")
    while at >= 0:
        local = at - len(text[floor:at].rstrip(_LOCAL)) - floor
        domain = _DOMAIN.match(text, at + 1) if local else None
        if domain:
            yield at - local, domain.end()
        floor = domain.end() if domain else at + 1
        at = text.find("@", floor)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(_DOUBLED[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def _digits(match: str) -> str:
    return _NO_DIGIT.sub("", match)


def detect(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the plain forms, in order."""
    found = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := _digits(m.group())) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return sorted(found)


# Letters that look like ASCII ones and have no compatibility form, by script.
_LOOK_ALIKES = {
    "АВЕЅІЈКМНОРСТУХаеоѕіјрсухԁһԛԝ": "ABESIJKMHOPCTYXaeosijpcyxdhqw",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονιυρκ": "ABEZHIKMNOPTYXovlupk",
    "ıİ": "iI",
    "‐‑‒–—−": "------",
    "․﹒。": "...",
}
#: Characters without width, which go: soft hyphen, joiners, marks of direction, byte order mark.
_INVISIBLE = "­​‌‍‎‏⁠﻿"


@functools.cache
def look_alikes() -> np.ndarray:
    """What each code point becomes: the list above, and all whose compatibility form is one ASCII character or digit.

    Others become themselves, invisible ones 0.
    """
    made = np.arange(0x110000, dtype=np.uint32)
    for code in range(0x80, 0x20000):
        c = chr(code)
        form = unicodedata.normalize("NFKC", c)
        if len(form) == 1 and form.isascii() and form.isprintable():
            made[code] = ord(form)
        elif (digit := unicodedata.decimal(c, None)) is not None:
            made[code] = ord("0") + digit
    for alike, ascii_ in _LOOK_ALIKES.items():
        made[list(map(ord, alike))] = list(map(ord, ascii_))
    made[list(map(ord, _INVISIBLE))] = 0
    return made


class Rewritten:
    """A text with, for each of its characters, the source span it stands for and whether it was rewritten.

    While nothing is rewritten (`same`), no spans are kept.
    """

    def __init__(self, text: str) -> None:
        self.text, self.same = text, True

    def _begin(self) -> None:
        if self.same:
            self.same = False
            self.starts = np.arange(len(self.text), dtype=np.int32)
            self.ends = self.starts + np.int32(1)
            self.changed = np.zeros(len(self.text), bool)

    def exchange(self, become: np.ndarray) -> None:
        """Write every character as become has it; those that become 0 go."""
        old = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        new = become[old]
        changed = new != old
        if not changed.any():
            return
        self._begin()
        stay = (new != 0) | (old == 0)
        self.text = new[stay].tobytes().decode("utf-32-le", "surrogatepass")
        self.starts, self.ends, self.changed = self.starts[stay], self.ends[stay], (self.changed | changed)[stay]

    def replace(self, places: list[tuple[int, int, str]]) -> None:
        """Write each place (start, end, new) anew; places are in order and apart, their characters share the place's span."""
        if not places:
            return
        if self.same:
            self.same = False
            self.starts = np.arange(len(self.text), dtype=np.int32)
            self.ends = self.starts + np.int32(1)
            self.changed = np.zeros(len(self.text), bool)
        text, starts, ends, changed, done = [], [], [], [], 0
        for a, b, new in places:
            text += [self.text[done:a], new]
            starts += [self.starts[done:a], np.full(len(new), self.starts[a], np.int32)]
            ends += [self.ends[done:a], np.full(len(new), self.ends[b - 1], np.int32)]
            changed += [self.changed[done:a], np.ones(len(new), bool)]
            done = b
        self.text = "".join([*text, self.text[done:]])
        self.starts = np.concatenate([*starts, self.starts[done:]])
        self.ends = np.concatenate([*ends, self.ends[done:]])
        self.changed = np.concatenate([*changed, self.changed[done:]])


_SPELLED = {w: str(n) for n, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0"}
_DIGIT_WORD = "zero|one|two|three|four|five|six|seven|eight|nine|oh"
_ANY_DIGIT = rf"(?:{_DIGIT_WORD}|[0-9])"
#: Digits in words or figures, one to four blanks or hyphens apart.
_RUN = re.compile(rf"\b{_ANY_DIGIT}(?:[ -]{{0,4}}+(?:(?<![A-Za-z])|(?=[0-9])){_ANY_DIGIT})+(?![A-Za-z])", re.I)
_RUN_PART = re.compile(rf"({_DIGIT_WORD})|([0-9])|([ -]+)", re.I)
_HAS_WORD = re.compile(rf"\b(?:{_DIGIT_WORD})\b", re.I)
_PLUS = re.compile(rf"\bplus +(?=[0-9]|(?:{_DIGIT_WORD})\b)", re.I)
#: Letters between digits that stand for digits.
_LETTER_DIGIT = re.compile(r"(?:(?<=[0-9])|(?<=[0-9][ -]))[OolI]{1,4}(?=[ -]?[0-9])")
_AS_DIGIT = str.maketrans("OolI", "0011")
_BRACKETED = re.compile(r" {0,3}(?:\[ {0,3}(at|dot|@|\.) {0,3}\]|\( {0,3}(at|dot|@|\.) {0,3}\)|\{ {0,3}(at|dot|@|\.) {0,3}\}|< {0,3}(at|dot|@|\.) {0,3}>) {0,3}", re.I)
#: " at " counts only before a name and a " dot ": "look at example.org" is ordinary prose.
_BARE_AT = re.compile(r"(?<=[A-Za-z0-9]) ++at ++(?=[A-Za-z0-9-]++ ++dot ++[A-Za-z0-9-])", re.I)
_BARE_DOT = re.compile(r"(?<=[A-Za-z0-9]) ++dot ++(?=[A-Za-z0-9-])", re.I)


class Disguises:
    """The chain of transducers. Built once per task; the tables don't depend on the data."""

    def __init__(self) -> None:
        self.alike = look_alikes()

    def characters(self, at: Rewritten) -> None:
        if not at.text.isascii():
            at.exchange(self.alike)

    def digits(self, at: Rewritten) -> None:
        if _HAS_WORD.search(at.text):
            places = []
            for run in _RUN.finditer(at.text):
                parts = [m for m in _RUN_PART.finditer(at.text, *run.span())]
                words = sum(m.lastindex == 1 for m in parts)
                count = sum(m.lastindex != 3 for m in parts)
                if count >= LEAST_SPELLED and (words >= LEAST_SPELLED or 2 * words > count):
                    for m in parts:
                        if m.lastindex == 1:
                            places.append((m.start(), m.end(), _SPELLED[m.group().lower()]))
                        elif m.lastindex == 3 and len(m.group()) > 1:
                            places.append((m.start(), m.end(), "-" if "-" in m.group() else " "))
            at.replace(places)
            at.replace([(m.start(), m.end(), "+") for m in _PLUS.finditer(at.text)])
        at.replace([(m.start(), m.end(), m.group().translate(_AS_DIGIT)) for m in _LETTER_DIGIT.finditer(at.text)])

    def signs(self, at: Rewritten) -> None:
        lower = at.text.lower()
        if any(bracket in lower for bracket in "[({<"):
            at.replace([(m.start(), m.end(), "@" if m.group(m.lastindex).lower() in ("at", "@") else ".") for m in _BRACKETED.finditer(at.text)])
        if " at " in lower:
            at.replace([(m.start(), m.end(), "@") for m in _BARE_AT.finditer(at.text)])
        if " dot " in lower:
            at.replace([(m.start(), m.end(), ".") for m in _BARE_DOT.finditer(at.text)])

    def __call__(self, text: str) -> Rewritten:
        at = Rewritten(text)
        self.characters(at)
        self.digits(at)
        self.signs(at)
        return at


def find_in(text: str, disguises: Disguises) -> list[tuple[int, int, int, bool]]:
    """(start, kind number, end, base) of a whole text, in order."""
    base = detect(text)
    found = [(*span, True) for span in base]
    at = disguises(text)
    if not at.same:
        covered = {kind: np.array([(a, b) for a, k, b in base if k == kind]).reshape(-1, 2) for kind in range(len(KINDS))}
        for a, kind, b in detect(at.text):
            first, last, spans = int(at.starts[a]), int(at.ends[b - 1]), covered[kind]
            rewritten = at.changed[a:b].any() or last - first != b - a
            place = np.searchsorted(spans[:, 0], first, side="right") - 1
            if rewritten and not (place >= 0 and spans[place, 1] >= last):
                found.append((first, kind, last, False))
    return sorted(found)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) of every row of docs: array of (kind, start, end, base), ordered by start, then kind as in KINDS.

    Offsets count code points of the whole text, the end is exclusive. A null, empty or blank text has no spans.
    Repeated rows and null ids stay as rows of their own; an empty table gives no rows; extra columns aren't read.
    Base spans of one kind never overlap; an added span may overlap base spans of less than its own reach.
    """
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def make() -> Callable[[list], list[pa.Array]]:
        disguises = Disguises()

        def run(texts: list) -> list[pa.Array]:
            found = [[{"kind": KINDS[k], "start": a, "end": b, "base": base} for a, k, b, base in find_in(text or "", disguises)] for text in texts]
            return [pa.array(found, pa.list_(kind))]

        return run

    return per_text(docs, [id_col], "spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>", make, text_col)


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of find()'s rows; the counts are of base spans."""
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    added = F.size(F.filter("spans", lambda s: ~s["base"])).cast("long")
    return found.select(id_col, *map(count, KINDS), F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"), added.alias("n_added"))


def masked(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    """The text with each stretch of overlapping spans replaced by the name of its first kind in brackets."""
    pieces, done, reach = [], 0, 0
    stretches: list[list[int]] = []
    for a, kind, b, _ in spans:
        if stretches and a < reach:
            stretches[-1][2] = reach = max(reach, b)
        else:
            stretches.append([a, kind, b])
            reach = b
    for a, kind, b in stretches:
        pieces += [text[done:a], f"[{KINDS[kind]}]"]
        done = b
    return "".join([*pieces, text[done:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs, all columns as they were, with personal data in the text replaced by [email], [ip], [card] or [phone].

    Null texts stay null.
    """

    def make() -> Callable[[list], list[pa.Array]]:
        disguises = Disguises()
        return lambda texts: [pa.array([None if t is None else masked(t, find_in(t, disguises)) for t in texts], pa.string())]

    names = [f"c{i}" for i in range(len(docs.columns))]
    place = names[docs.columns.index(text_col)]
    done = per_text(docs.toDF(*names), [n for n in names if n != place], "redacted string", make, place)
    return done.select(*("redacted" if n == place else n for n in names)).toDF(*docs.columns)
