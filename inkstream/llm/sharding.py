"""Shards of near equal bytes by Karmarkar-Karp differencing; rows of one text stay together.

A partial partition is a vector of shard sizes. The two with the largest spread are repeatedly combined, the largest
shard of one with the smallest of the other, until one is left; walking back gives every group its shard. The groups
are hashed into buckets of bounded size that are differenced side by side, so neither a task nor the driver ever holds
all of them.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import hot_salted_join
from .common import blocks_for, utf8_bytes, written

#: Groups that one task partitions, and rows of a shard that one task numbers.
BUCKET_GROUPS, BLOCK_ROWS = 4096, 20_000
#: A group above this part of a shard's bytes is placed before all others.
LARGE_PARTS = 100
#: Bytes that count for a document besides its text.
ROW_BYTES = 16
#: Copies of one text are spread over several join keys from a thousandth of all rows on: at most 1,000 texts.
HOT_SHARE = 1000


def difference(sizes: np.ndarray) -> np.ndarray:
    """Shard of each entry of `sizes` (m rows of k shard sizes): an m x k table of labels 0 to k - 1.

    Ties are broken by position, so the same sizes give the same labels.
    """
    m, k = sizes.shape
    entry = np.argsort(-sizes, axis=1, kind="stable")
    ordered = np.take_along_axis(sizes, entry, axis=1)
    vectors = list(ordered - ordered[:, -1:])
    heap = [(-int(v[0]), at) for at, v in enumerate(vectors)]
    heapq.heapify(heap)
    made = []
    while len(heap) > 1:
        first, second = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        total = vectors[first] + vectors[second][::-1]
        order = np.argsort(-total, kind="stable")
        total = total[order]
        total -= total[-1]
        vectors[first] = vectors[second] = None
        made.append((first, second, order))
        heapq.heappush(heap, (-int(total[0]), len(vectors)))
        vectors.append(total)
    labels = np.empty((len(vectors), k), np.int64)
    labels[-1] = np.arange(k)
    for at in range(len(made) - 1, -1, -1):
        first, second, order = made[at]
        mine = np.empty(k, np.int64)
        mine[order] = labels[m + at]
        labels[first], labels[second] = mine, mine[::-1]
    result = np.empty((m, k), np.int64)
    np.put_along_axis(result, entry, labels[:m], axis=1)
    return result


def beside(loads: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Shard of each of `sizes`, differenced together with the shards' present loads."""
    table = np.zeros((len(sizes) + 1, len(loads)), np.int64)
    table[0], table[1:, 0] = loads, sizes
    labels = difference(table)
    own = np.empty(len(loads), np.int64)
    own[labels[0]] = np.arange(len(loads))
    return own[labels[1:, 0]].astype(np.int32)


def dithered(loads: np.ndarray, step: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the shards, their loads in it, in multiples of step): right on average over the seeds.

    Differences below the size of a group would send every bucket's remainder to the same shard.
    """
    draw = np.random.default_rng(seed)
    order = draw.permutation(len(loads))
    return order, (loads[order] + draw.integers(0, step, len(loads))) // step * step


def assign_groups(groups: DataFrame, shards: int, bucket_groups: int = BUCKET_GROUPS) -> DataFrame:
    """(key, shard) for groups (key, bytes).

    Groups above a LARGE_PARTS-th of a shard (at most shards * LARGE_PARTS of them) are differenced first. Each bucket
    of the others is differenced beside its part of these loads, so that it fills what they leave open; the last
    bucket is differenced beside the sum of all that, and evens out what the buckets leave.
    """
    count, total = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    limit, buckets = total / (shards * LARGE_PARTS), blocks_for(count, bucket_groups)
    node = F.when(F.col("bytes") > limit, F.lit(-1)).otherwise(F.pmod(F.xxhash64("key"), F.lit(buckets)))
    groups = groups.withColumn("node", node)

    def placed(part: DataFrame, loads: list[int], shared: bool = False) -> DataFrame:
        def within(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(["bytes", "key"], ascending=False, kind="stable")
            order, now = np.arange(shards), np.array(loads, np.int64)
            if shared:
                order, now = dithered(now, int(frame["bytes"].iloc[0]) + 1, int(frame["node"].iloc[0]))
            return frame[["key", "bytes"]].assign(shard=order[beside(now, frame["bytes"].to_numpy(np.int64))].astype(np.int32))

        return written(part.groupBy("node").applyInPandas(within, "key binary, bytes bigint, shard int"), "shard-groups")

    def loads_of(*parts: DataFrame) -> list[int]:
        """One number per shard."""
        sums = reduce(DataFrame.unionAll, parts).groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect()
        found = {r["shard"]: r["bytes"] for r in sums}
        return [found.get(k, 0) for k in range(shards)]

    large = placed(groups.filter("node = -1"), [0] * shards)
    middle = placed(groups.filter("node > 0"), [load // buckets for load in loads_of(large)], shared=True)
    last = placed(groups.filter("node = 0"), loads_of(large, middle))
    return large.unionAll(middle).unionAll(last).select("key", "shard")


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", bucket_groups: int = BUCKET_GROUPS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for every row of docs.

    Rows with the same text share a shard, so a text that alone outweighs a shard's part makes that shard larger.
    A null text counts ROW_BYTES, has no crc32, and null texts are groups of their own by id. slot numbers the rows
    of a shard from 0 without gaps; rows that are alike in everything are numbered in any order. The law is `bytes`,
    so grown_shard is null. An empty table gives no rows; extra columns aren't read.
    """
    digest = F.coalesce(F.sha2(F.col(text_col), 256), F.sha2(F.concat(F.lit("no text "), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256))
    rows = docs.select(F.col(id_col).alias("id"), (utf8_bytes(text_col) + ROW_BYTES).alias("size"), F.crc32(F.col(text_col).cast("binary")).alias("text_crc32"), F.unhex(digest).alias("key"))
    rows = written(rows, "shard-rows")
    count = rows.count()
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "shard-sizes")
    hot = groups.filter(F.col("n") >= max(2, -(-count // HOT_SHARE))).select("key")
    placed = hot_salted_join(rows, assign_groups(groups.select("key", "bytes"), shards, bucket_groups), ["key"], F.col("id"), hot)
    blocks = blocks_for(-(-count // shards), block_rows)
    placed = written(placed.withColumn("block", F.pmod(F.xxhash64("id", "key"), F.lit(blocks))), "shard-placed")
    counts = placed.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "block").orderBy("id", "key")) - 1
    numbered = placed.withColumn("inside", inside).join(starts, ["shard", "block"])
    return numbered.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("inside")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
