"""URL identity. Exact parsing and quoting rules come from urllib, in Arrow batches."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_URL_CHARS = 4096
DEFAULT_PORTS = {"http": 80, "https": 443}


@dataclass(frozen=True)
class RewriteRule:
    """URLs matching `match` that carry all `params` get the path `rewrite` filled with them."""

    match: str
    params: tuple[str, ...]
    rewrite: str


@dataclass(frozen=True)
class CanonicalConfig:
    rules: tuple[RewriteRule, ...] = ()
    strip_params: frozenset[str] = field(default_factory=frozenset)


def _rewritten(absolute: str, config: CanonicalConfig):
    parts = urlsplit(absolute)
    given = dict(parse_qsl(parts.query, keep_blank_values=True))
    for rule in config.rules:
        if re.search(rule.match, absolute) and given.keys() >= set(rule.params):
            try:
                target = rule.rewrite.format_map(given)
            except KeyError:
                continue
            return urlsplit(urljoin(f"{parts.scheme}://{parts.netloc}/", target))
    return parts


def _canonical(url: str | None, base: str | None, config: CanonicalConfig) -> str | None:
    if not url or len(url) > MAX_URL_CHARS or re.search(r"[\x00-\x20\x7f]", url):
        return None
    try:
        parts = _rewritten(urljoin(base or "", url), config)
        host = (parts.hostname or "").encode("idna").decode("ascii").lower().rstrip(".")
        port = parts.port
    except ValueError:  # includes IDNA failures
        return None
    host = f"[{host}]" if ":" in host else host
    shown_port = f":{port}" if port and port != DEFAULT_PORTS.get(parts.scheme) else ""
    path = re.sub("/+", "/", parts.path or "/")
    path = path.rstrip("/") or "/"
    pairs = sorted(p for p in parse_qsl(parts.query, keep_blank_values=True) if p[0] not in config.strip_params)
    return urlunsplit((parts.scheme.lower(), host + shown_port, path, urlencode(pairs), ""))


def canonical_url(config: CanonicalConfig = CanonicalConfig()):
    """UDF (url, base) -> canonical form; NULL for empty, overlong, unsafe or invalid URLs."""

    @F.pandas_udf(T.StringType())
    def canonical(urls: pd.Series, bases: pd.Series) -> pd.Series:
        return pd.Series([_canonical(u, b, config) for u, b in zip(urls, bases)], dtype=object)

    return canonical


def url_hash(url: Column) -> Column:
    return F.sha2(url, 256)


def _join(base: str | None, link: str | None) -> str | None:
    try:
        return None if link is None else urljoin(base or "", link)
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def absolute_url(bases: pd.Series, links: pd.Series) -> pd.Series:
    return pd.Series([_join(b, link) for b, link in zip(bases, links)], dtype=object)


# Row-wise: an Arrow batch would hold the links of ten thousand pages.
@F.udf(T.ArrayType(T.StringType()), useArrow=False)
def absolute_urls(base: str | None, links: list[str | None] | None) -> list[str | None] | None:
    """Resolve all links of a page in one call, so a page stays one row."""
    return None if links is None else [_join(base, link) for link in links]


# Its result is read inside lambdas, into which the optimiser must not move the call.
absolute_urls = absolute_urls.asNondeterministic()


def _with_param(url: str, name: str, value: str) -> str:
    parts = urlsplit(url)
    pairs = {**dict(parse_qsl(parts.query, keep_blank_values=True)), name: value}
    return urlunsplit(parts._replace(query=urlencode(pairs)))


@F.pandas_udf(T.StringType())
def set_query_param(urls: pd.Series, names: pd.Series, values: pd.Series) -> pd.Series:
    """Set one query parameter; a repeated key keeps its last value."""
    rows = zip(urls, names, values)
    return pd.Series([None if u is None else _with_param(u, n, str(v)) for u, n, v in rows], dtype=object)


def host_of(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def site_slug(url: Column) -> Column:
    """Host without `www.`, other characters as dashes, at most 63 characters."""
    host = F.regexp_replace(F.coalesce(host_of(url), F.lit("site")), r"^www\.", "")
    slug = F.regexp_replace(F.regexp_replace(host, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.substring(F.when(slug == "", F.lit("site")).otherwise(slug), 1, 63), "-+$", "")


def path_numbers(url: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit(r"\d+"), F.lit(0))


def origin_root(url: Column) -> Column:
    return F.concat(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.lit("/"))


def query_pairs(url: Column) -> Column:
    """array<struct<key,value>> of the non-empty query pairs, `+` and escapes decoded."""
    raw = F.split(F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit("")), "&")

    def decoded(text: Column) -> Column:
        return F.coalesce(F.try_url_decode(text), text)

    pairs = F.transform(
        F.filter(raw, lambda p: p.contains("=")),
        lambda p: F.struct(
            decoded(F.substring_index(p, "=", 1)).alias("key"), decoded(F.regexp_replace(p, "^[^=]*=", "")).alias("value")
        ),
    )
    return F.filter(pairs, lambda p: p["value"] != "")
