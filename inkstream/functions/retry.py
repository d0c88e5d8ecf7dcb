"""Retry, back-off and lock-out arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import parse_http_date

# Fixed values of the retry rules.
BACKOFF_CAP_SEC = 3600
CRAWL_CAP_SEC = 86400
RETRY_AFTER_CAP_SEC = 300
LOCKOUT_FROM = 5
LOCKOUT_MINUTES = (1, 5, 15, 60)


def _doubling(base_sec: float, attempt: Column) -> Column:
    return F.lit(float(base_sec)) * F.pow(F.lit(2.0), F.greatest(F.lit(0), attempt - 1))


def backoff_delay(attempt: Column, base_sec: float, cap_sec: float = BACKOFF_CAP_SEC, jitter_seed: int | None = None) -> Column:
    """Seconds until the next try; a seed switches on the +-50 % jitter."""
    delay = F.least(_doubling(base_sec, attempt), F.lit(float(cap_sec)))
    if jitter_seed is not None:
        delay = delay * (F.rand(jitter_seed) + 0.5)
    return F.bround(F.least(delay, F.lit(float(cap_sec))), 2)


def crawl_retry_delay(attempts: Column, retryable: Column, retry_after: Column, base_sec: float, max_attempts: int) -> Column:
    """NULL ends the retries; otherwise the advertised or doubled delay, at most one day."""
    wanted = F.coalesce(retry_after.cast("double"), F.lit(float(base_sec)) * F.pow(F.lit(2.0), attempts - 1))
    return F.when(retryable & (attempts < max_attempts), F.least(wanted, F.lit(float(CRAWL_CAP_SEC))))


def delivery_retry_delay(attempts: Column, terminal: Column, retry_after: Column, base_sec: float) -> Column:
    delay = F.coalesce(retry_after.cast("double"), backoff_delay(attempts, base_sec))
    return F.when(~terminal, F.greatest(F.lit(0.0), delay))


def model_retry_delay(transient_attempt: Column, retry_after: Column, base_sec: float) -> Column:
    return F.coalesce(retry_after.cast("double"), F.lit(float(base_sec)) * F.pow(F.lit(2.0), transient_attempt - 1))


def retry_after_seconds(header: Column, now: Column) -> Column:
    """Seconds or HTTP date, clamped to 0..300; NULL when unreadable."""
    header = F.when(header != "", header)
    at = parse_http_date(header)
    seconds = F.coalesce(header.try_cast("double"), (F.unix_micros(at) - F.unix_micros(now)) / F.lit(1e6))
    clamped = F.least(F.lit(float(RETRY_AFTER_CAP_SEC)), F.greatest(F.lit(0.0), seconds))
    # least and greatest pass over NULLs, an unreadable header must stay NULL.
    return F.when(seconds.isNotNull(), clamped)


def lockout_minutes(failures: Column) -> Column:
    table = F.array(*[F.lit(m) for m in LOCKOUT_MINUTES])
    index = F.least(failures - LOCKOUT_FROM, F.lit(len(LOCKOUT_MINUTES) - 1)) + 1
    return F.when(failures >= LOCKOUT_FROM, F.try_element_at(table, index.cast("int")))
