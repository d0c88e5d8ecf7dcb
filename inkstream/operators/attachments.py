"""Attachment storage: reuse by content, quota, inline and link decisions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage

# Fixed channel limits: body characters, attachment bytes. Other channels take no attachments.
CHANNELS = {
    "tgram": (4096, 50 * 1024 * 1024),
    "telegram": (4096, 50 * 1024 * 1024),
    "discord": (2000, 25 * 1024 * 1024),
    "slack": (40000, 1024 * 1024 * 1024),
}
BODY_FORMATS = ("text", "markdown", "html")
BLOCKS, BLOCK_ROWS = 4096, 100_000


def channel_scheme(fingerprint: Column) -> Column:
    return F.lower(F.substring_index(fingerprint, ":", 1))


def _limit(fingerprint: Column, index: int) -> Column:
    known = F.create_map(*[F.lit(v) for name, limits in CHANNELS.items() for v in (name, limits[index])])
    return F.try_element_at(known, channel_scheme(fingerprint))


def body_limit(fingerprint: Column, configured: int) -> Column:
    return F.least(F.lit(configured), F.coalesce(_limit(fingerprint, 0), F.lit(configured)))


def body_format(requested: Column) -> Column:
    return F.when(requested.isin(*BODY_FORMATS), requested).otherwise(F.lit("text"))


def sends_inline(wanted: Column, mode: str, fingerprint: Column, local_path: Column, size: Column, inline_max: int) -> Column:
    """May the file itself go out with the message?"""
    channel_max = _limit(fingerprint, 1)
    fits = size.isNull() | (size <= F.least(F.lit(inline_max), channel_max))
    return F.coalesce(wanted & F.lit(mode != "link") & channel_max.isNotNull() & local_path.isNotNull() & fits, F.lit(False))


def attachment_link(status: Column, source_url: Column, attachment_id: Column, mode: str, base_url: str, token: Column | None) -> Column:
    """Source address until downloaded; afterwards a shared link where links are on and signable."""
    shared = F.lit(None).cast("string")
    if token is not None and base_url and mode in ("link", "both"):
        shared = F.concat(F.lit(base_url.rstrip("/") + "/shared/attachments/"), attachment_id.cast("string"), F.lit("?token="), token)
    return F.when(status == "downloaded", shared).otherwise(source_url)


def blob_path(digest: Column) -> Column:
    return F.concat_ws("/", F.substring(digest, 1, 2), F.substring(digest, 3, 2), digest)


def store_within_quota(downloads: DataFrame, stored: DataFrame, *, quota: int) -> DataFrame:
    """(id, outcome): downloaded, reused or skipped, as if files arrived one by one in id order.

    Downloads: id, sha256, size_bytes. Stored: id, sha256, size_bytes of files already kept. A known hash
    is reused without cost; a new one is kept while used + size stays within the quota, otherwise it
    is skipped and uses nothing. As the used space never shrinks, a refused hash stays refused, so
    one decision per hash suffices.

    Rounds halve the space that is left, however many files are refused: until less than half of it
    remains, every file of at most half fits, and the first larger one that fits ends the round. So a
    round is one running sum over the files of at most half.
    """
    kept = stored.where("sha256 IS NOT NULL").groupBy("sha256").agg(F.max("size_bytes").alias("size_bytes"))
    used = stored.groupBy(F.coalesce("sha256", F.concat(F.lit("id:"), F.col("id").cast("string"))).alias("k")).agg(F.max("size_bytes").alias("s"))
    left = quota - int(used.agg(F.coalesce(F.sum("s"), F.lit(0))).first()[0])
    known = kept.select("sha256").distinct()
    first = downloads.groupBy("sha256").agg(F.min_by(F.struct("id", "size_bytes"), "id").alias("f")).select("sha256", "f.*")
    waiting = cut_lineage(first.join(known, "sha256", "left_anti"))
    accepted = None
    while True:
        waiting = waiting.where(F.col("size_bytes") <= left)
        if waiting.isEmpty():
            break
        small = F.col("size_bytes") * 2 <= left
        summed = running_sum(waiting.withColumn("_small", F.when(small, F.col("size_bytes")).otherwise(0)), "id", "_small")
        summed = cut_lineage(summed)
        ends = F.when(small, (left - F.col("total")) * 2 < left).otherwise(F.col("size_bytes") <= left - F.col("total"))
        end = summed.where(ends).agg(F.min("id")).first()[0]
        fits = summed.where(small if end is None else (F.col("id") < end) & small | (F.col("id") == end))
        accepted = fits.select("sha256", "id") if accepted is None else accepted.unionByName(fits.select("sha256", "id"))
        if end is None:
            break
        left -= int(fits.agg(F.sum("size_bytes")).first()[0])
        waiting = summed.where(F.col("id") > end).drop("total", "_small")
    if accepted is None:
        accepted = first.where(F.lit(False)).select("sha256", "id")
    result = downloads.join(accepted.withColumnRenamed("id", "_first"), "sha256", "left").join(known.withColumn("_known", F.lit(True)), "sha256", "left")
    outcome = (
        F.when(F.col("_known"), "reused").when(F.col("_first").isNull(), "skipped").when(F.col("_first") == F.col("id"), "downloaded").otherwise("reused")
    )
    return result.select("id", outcome.alias("outcome"))


def store_decisions(downloads: DataFrame, stored: DataFrame, *, quota: int) -> DataFrame:
    """(id, outcome, path, skip_reason): where each download's content lies; the first of a hash writes it, skipped ones have none."""
    decided = store_within_quota(downloads, stored, quota=quota).join(downloads.select("id", "sha256"), "id")
    kept = F.col("outcome") != "skipped"
    return decided.select("id", "outcome", F.when(kept, blob_path(F.col("sha256"))).alias("path"), F.when(~kept, F.lit("quota exceeded")).alias("skip_reason"))


def running_sum(rows: DataFrame, order: str, value: str, *, blocks: int = BLOCKS) -> DataFrame:
    """Adds `total`: running sum in `order`, an integer; ties in any order. Blocks are summed apart and shifted by their offsets.

    Blocks end at quantiles of `order`, so they hold about equally many rows however the values lie.
    """
    blocks = min(blocks, math.ceil(rows.count() / BLOCK_ROWS))
    ends = np.array([], dtype=np.int64)
    if blocks > 1:
        found = rows.agg(F.percentile_approx(order, [i / blocks for i in range(1, blocks)], 10 * blocks)).first()[0]
        ends = np.unique(np.array(found, dtype=np.int64))

    @F.pandas_udf("int")
    def block(values: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(ends, values.to_numpy(np.int64)))

    blocked = rows.withColumn("_block", block(order) if len(ends) else F.lit(0))
    sums = blocked.groupBy("_block").agg(F.sum(value).alias("_s"))
    # At most `blocks` summary rows exist, so one task may order them.
    before = Window.partitionBy(F.lit(0)).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_block", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        blocked.withColumn("_in", F.sum(value).over(inside))
        .join(F.broadcast(offsets), "_block")
        .withColumn("total", F.col("_in") + F.col("_offset"))
        .drop("_block", "_in", "_offset")
    )
