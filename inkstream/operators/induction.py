"""Merging tag candidates level by level with an injected merging function, and the review before a freeze."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .attachments import running_sum
from .bootstrap import merge_candidates, merge_roots, require

#: Chunks of a level hold this many times the tags that may be left of one.
CHUNK_FACTOR = 4
MERGED = "slug string, name string, description string, keywords array<string>, titles array<string>, sources array<string>"
Call = Callable[[pd.DataFrame], pd.DataFrame]


def fold_duplicates(candidates: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates that share a slug or a name become one tag; its members are those of all of them.

    candidates: position, slug, name, description, keywords, titles. members: slug, article_id, as rows, so no list of
    a tag's articles is ever gathered.
    """
    bare = candidates.select("*", F.array().cast("array<bigint>").alias("article_ids"), F.lit(0).cast("bigint").alias("coverage"))
    tags = cut_lineage(merge_candidates(bare).select("position", "slug", "name", "description", "keywords", "titles"))
    roots = merge_roots(candidates)
    return tags, cut_lineage(members.join(roots, "slug").select(F.col("root").alias("slug"), "article_id").distinct())


def _level(tags: DataFrame, members: DataFrame, call: Call, size: int, *, most: int, least: int) -> tuple[DataFrame, DataFrame]:
    numbered = running_sum(tags.withColumn("_one", F.lit(1)), "position", "_one")
    chunked = cut_lineage(numbered.withColumn("chunk", F.floor((F.col("total") - 1) / size)).select("chunk", *tags.columns))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return call(rows.sort_values("position", ignore_index=True)).assign(chunk=key[0])

    merged = cut_lineage(chunked.groupBy("chunk").applyInPandas(run, f"{MERGED}, chunk bigint"))
    counts = chunked.groupBy("chunk").agg(F.count(F.lit(1)).alias("given")).join(merged.groupBy("chunk").agg(F.count(F.lit(1)).alias("left")), "chunk", "left").fillna(0, ["left"])
    require(counts.where((F.col("left") > most) | (F.col("left") < F.least(F.lit(least), F.col("given")))), "a merge left too many or too few tags", ["chunk", "left"])
    used = cut_lineage(merged.select("chunk", F.col("slug").alias("into"), F.explode("sources").alias("slug")))
    known = chunked.select("chunk", "slug", "position")
    require(used.join(known, ["chunk", "slug"], "left_anti"), "a merge names tags outside of its chunk", ["chunk", "slug"])
    require(used.groupBy("chunk", "slug").count().where("count > 1"), "a merge uses a tag twice", ["chunk", "slug"])
    moved = used.join(known, ["chunk", "slug"])
    placed = moved.groupBy("chunk", F.col("into").alias("slug")).agg(F.min("position").alias("position"))
    tags = merged.join(placed, ["chunk", "slug"]).select("position", "slug", "name", "description", "keywords", "titles")
    return tags, members.join(moved.select("slug", "into"), "slug").select(F.col("into").alias("slug"), "article_id").distinct()


def merge_rounds(candidates: DataFrame, members: DataFrame, call: Call, *, max_tags: int, min_tags: int = 1) -> tuple[DataFrame, DataFrame, int]:
    """(tags, members, levels): candidates reduced to at most max_tags tags.

    `call` gets the candidates of a chunk in order (position, slug, name, description, keywords, titles) and returns at most
    max_tags rows of MERGED, each naming its `sources` among the chunk's slugs; a source it leaves out is dropped with its
    members. Chunks of a level hold CHUNK_FACTOR * max_tags candidates, so a level leaves a quarter at most, and when one
    chunk is left its merge is the last. After every level duplicates are folded. Tags of the result have their `coverage`.
    A merge that breaks the rules raises ValueError.
    """
    size, levels = CHUNK_FACTOR * max_tags, 0
    tags, members = fold_duplicates(candidates, members)
    while True:
        count = tags.count()
        if not count:
            break
        last = count <= size
        tags, members = _level(tags, members, call, size, most=max_tags, least=min_tags if last else 1)
        tags, members = fold_duplicates(tags, members)
        levels += 1
        if last:
            break
    coverage = members.groupBy("slug").agg(F.count(F.lit(1)).alias("coverage"))
    return tags.join(coverage, "slug", "left").fillna(0, ["coverage"]), members, levels
