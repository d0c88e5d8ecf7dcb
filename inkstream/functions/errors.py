"""Error taxonomy and HTTP status classes that drive every retry decision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed classification by error class name.
RETRYABLE = (
    "AllBackendsFailed FetchFailed FetchTimeout InvalidTaggerOutput NotifyTransient ProviderUnavailable RateLimited"
).split()
FATAL = (
    "ConfigError ConfigValidationError ContentRejected ContentTooShort DecryptionFailed HttpStatusError MigrationError "
    "NotFound QuotaExhausted ResponseTooLarge RobotsDenied SelectorMiss SsrfBlocked TagsetNotReady TargetRejected"
).split()
QUOTA_WORDS = ("quota", "balance", "billing", "credit", "insufficient", "余额", "额度")


def error_class(message: Column) -> Column:
    """Class name in front of the first colon of a stored error text."""
    return F.regexp_extract(message, r"^(\w+)", 1)


def is_retryable(name: Column) -> Column:
    return name.isin(RETRYABLE)


def is_fatal(name: Column) -> Column:
    return name.isin(FATAL)


def attachment_failure_status(name: Column) -> Column:
    """Fatal errors end an attachment; every other error leaves it for another try."""
    return F.when(is_fatal(name), F.lit("skipped")).otherwise(F.lit("failed"))


def http_error_class(status: Column, detail: Column, retry_after: Column, quota_words=QUOTA_WORDS) -> Column:
    """quota / transient / fatal for a failed model call."""
    said_quota = F.lower(F.substring(detail, 1, 500)).rlike("|".join(quota_words))
    quota = (status == 429) & (F.coalesce(retry_after >= 60, F.lit(False)) | F.coalesce(said_quota, F.lit(False)))
    return (
        F.when(quota, F.lit("quota"))
        .when((status == 429) | (status == 408) | (status >= 500), F.lit("transient"))
        .otherwise(F.lit("fatal"))
    )
