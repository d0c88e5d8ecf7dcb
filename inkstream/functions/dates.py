"""Date parsing, quiet hours and local rendering as column expressions (session zone UTC)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns: labels in front of a date, the ISO-like core, slash dates, quiet-hour grammar.
LABEL = r"^(发布(时间|日期)|时间|日期)[：:](?U)\s*"
ISO_CORE = r"\d{4}-\d{1,2}-\d{1,2}(?:[T ]\d{1,2}:\d{2}(?::\d{2})?(?:Z|[+-]\d{2}:?\d{2})?)?"
ISO_PARTS = r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:([T ])(\d{1,2}):(\d{2})(?::(\d{2}))?(Z|[+-]\d{2}:?\d{2})?)?$"
SLASH_PARTS = r"^(\d{4})/(\d{1,2})/(\d{1,2})$"
COMPACT_PARTS = r"^(\d{4})(\d{2})(\d{2})$"
QUIET = r"^([01]?\d|2[0-3]):([0-5]\d)-([01]?\d|2[0-3]):([0-5]\d)$"
PAGE_DATE = r"(?:19|20)\d{2}[年./-]\d{1,2}(?:[月./-]\d{1,2}日?)?"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _int(text: Column) -> Column:
    return text.try_cast("int")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind an expression once; inside lambdas repeated expressions would be evaluated again."""
    return F.get(F.transform(F.array(value), body), 0)


def parse_flexible(value: Column, tz: str = "UTC") -> Column:
    """Instant for the date spellings listing pages use; NULL when nothing parses.

    Values without an offset are read in the site's zone.
    """
    text = F.regexp_replace(strip(value), LABEL, "")
    text = F.regexp_replace(F.regexp_replace(text, "[年月]", "-"), "日", "")
    core = let(text, lambda t: let(F.regexp_extract(t, ISO_CORE, 0), lambda c: F.when(c != "", c).otherwise(t)))
    return let(core, lambda t: _instant(t, tz))


def _instant(text: Column, tz: str) -> Column:
    def part(i: int) -> Column:
        return F.regexp_extract(text, ISO_PARTS, i)

    offset = F.regexp_replace(part(8), r"^([+-]\d{2}):?(\d{2})$", "$1:$2")
    zone = F.when(part(8) == "Z", F.lit("+00:00")).when(part(8) != "", offset).otherwise(F.lit(tz))
    has_time, seconds = part(4) != "", part(7)
    padded = (F.length(part(2)) == 2) & (F.length(part(3)) == 2) & (F.length(part(5)) == 2)
    # Without seconds, or with an offset after a blank, only the zero-padded spelling is a date.
    strict = has_time & ((seconds == "") | ((part(4) == " ") & (part(8) != "")))
    accepted = (~strict | padded) & (F.coalesce(_int(seconds), F.lit(0)) < 60)
    iso = F.when(
        accepted,
        F.try_make_timestamp(
            _int(part(1)),
            _int(part(2)),
            _int(part(3)),
            F.coalesce(_int(part(5)), F.lit(0)),
            F.coalesce(_int(part(6)), F.lit(0)),
            F.coalesce(_int(seconds), F.lit(0)),
            zone,
        ),
    )

    def whole_day(pattern: str) -> Column:
        y, m, d = (F.regexp_extract(text, pattern, i) for i in (1, 2, 3))
        zero = F.lit(0)
        return F.try_make_timestamp(_int(y), _int(m), _int(d), zero, zero, zero, F.lit(tz))

    return (
        F.when(text.rlike(ISO_PARTS), iso)
        .when(text.rlike(SLASH_PARTS), whole_day(SLASH_PARTS))
        .when(text.rlike(COMPACT_PARTS), whole_day(COMPACT_PARTS))
    )


def parse_http_date(value: Column) -> Column:
    """`Sun, 06 Nov 1994 08:49:37 GMT` -> instant."""
    body = F.regexp_replace(strip(value), r"^[A-Za-z]{3},\s*", "")
    named = F.try_to_timestamp(F.regexp_replace(body, r"(?i)\s*(GMT|UTC|[+-]0000)$", " UTC"), F.lit("d MMM yyyy HH:mm:ss z"))
    shifted = F.try_to_timestamp(body, F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.coalesce(named, shifted)


def to_iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def format_local(ts: Column, tz: str) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, tz), "yyyy-MM-dd HH:mm")


def quiet_bounds(spec: Column) -> tuple[Column, Column]:
    """Start and end in minutes of the day; NULL for a malformed specification."""
    text = strip(spec)

    def minute(i: int) -> Column:
        return _int(F.regexp_extract(text, QUIET, i)) * 60 + _int(F.regexp_extract(text, QUIET, i + 1))

    valid = text.rlike(QUIET)
    return F.when(valid, minute(1)), F.when(valid, minute(3))


def in_quiet_hours(ts: Column, spec: Column, tz: str) -> Column:
    """Half-open containment; wraps midnight when start > end; equal bounds are never quiet."""
    start, end = quiet_bounds(spec)
    local = F.from_utc_timestamp(ts, tz)
    second = F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)
    return F.when(start <= end, (second >= start * 60) & (second < end * 60)).otherwise(
        (second >= start * 60) | (second < end * 60)
    )


def next_active_time(ts: Column, spec: Column, tz: str) -> Column:
    """End of the quiet period holding `ts`, or `ts` itself outside of it (and without a spec)."""
    _, end = quiet_bounds(spec)
    local = F.from_utc_timestamp(ts, tz)
    day = F.to_date(local)

    def at_end(offset_days: int) -> Column:
        base = F.date_add(day, offset_days)
        return F.make_timestamp(
            F.year(base), F.month(base), F.dayofmonth(base), (end / 60).cast("int"), end % 60, F.lit(0)
        )

    wake = F.when(at_end(0) <= local, at_end(1)).otherwise(at_end(0))
    return F.when(in_quiet_hours(ts, spec, tz), F.to_utc_timestamp(wake, tz)).otherwise(ts)


def page_date_days(text: Column) -> Column:
    """Day numbers (since 1970) of all dates found in page text, in text order; invalid dates drop out."""
    found = F.regexp_extract_all(text, F.lit(PAGE_DATE), F.lit(0))

    def day(raw: Column) -> Column:
        parts = F.regexp_extract_all(raw, F.lit(r"\d+"), F.lit(0))
        third = F.when(F.size(parts) > 2, F.get(parts, 2)).otherwise(F.lit("1"))
        zero = F.lit(0)
        made = F.try_make_timestamp(_int(F.get(parts, 0)), _int(F.get(parts, 1)), _int(third), zero, zero, zero, F.lit("UTC"))
        return F.unix_date(F.to_date(made))

    return F.filter(F.transform(found, day), lambda x: x.isNotNull())
