"""Joins that stay balanced when a single key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

# A key is hot from this many rows on. At most (rows / HOT_ROWS) keys can be hot, which bounds the
# size of every hot-key table by construction.
HOT_ROWS = 1_000_000
SALTS = 64


def hot_keys(df: DataFrame, keys: Sequence[str], *, min_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with at least `min_rows` rows; counted with map-side partial aggregation."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows).drop("_n")


def hot_salted_join(
    many: DataFrame,
    few: DataFrame,
    keys: Sequence[str],
    spread: Column,
    hot: DataFrame,
    *,
    salts: int = SALTS,
    how: str = "inner",
) -> DataFrame:
    """Equi-join where only the keys listed in `hot` are spread and repeated.

    `hot` comes from `hot_keys`, so its size is bounded by rows / HOT_ROWS and it may be broadcast. Where it is empty
    the join is a plain one.
    """
    hot = cut_lineage(hot)
    if hot.isEmpty():
        return many.join(few, list(keys), how)
    flag = F.broadcast(hot.select(*keys).withColumn("_hot", F.lit(True)))
    salt = F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")
    left = (
        many.join(flag, list(keys), "left")
        .withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(F.lit(0)))
        .drop("_hot")
    )
    right = (
        few.join(flag, list(keys), "left")
        .withColumn(
            "_salt",
            F.explode(
                F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
            ),
        )
        .drop("_hot")
    )
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
