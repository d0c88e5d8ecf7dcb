"""Choosing tags: model responses, cosine similarity to tag centroids, and persistence rules."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import clip01, dot


def top_articles_per_tag(article_tags: DataFrame, score: str, *, k: int = 20) -> DataFrame:
    order = Window.partitionBy("tag_id").orderBy(F.col(score).desc(), "article_id")
    return article_tags.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).drop("_rank")


# Rows of one matrix product: centroids of a block, vectors of a part.
CENTROID_BLOCK, VECTOR_PART = 1024, 8192


def _unit_rows(rows: list) -> np.ndarray:
    """Unit rows of equally long vectors; a zero vector stays zero."""
    matrix = np.array(rows, dtype=np.float64)
    return matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)


def _matrices(block: pd.DataFrame) -> dict[int, tuple]:
    """Unit centroids, thresholds and slugs of a block by dimension."""
    by_size = block.groupby(block["centroid"].map(len))
    return {n: (_unit_rows(rows["centroid"].tolist()), rows["threshold"].to_numpy(np.float64), rows["slug"].to_numpy(object)) for n, rows in by_size}


def _best_of_block(vectors: pd.DataFrame, matrices: dict[int, tuple], k: int | None) -> pd.DataFrame:
    """(article_id, slug, threshold, score) against the centroids of one block: the k best that reach their threshold, or all."""
    parts = [pd.DataFrame({"article_id": vectors["article_id"].iloc[:0], "slug": pd.Series(dtype=object), "threshold": pd.Series(dtype=float), "score": pd.Series(dtype=float)})]
    for size, group in vectors.groupby(vectors["vector"].map(len)):
        if size not in matrices:
            continue
        tags, floors, slugs = matrices[size]
        scores = _unit_rows(group["vector"].tolist()) @ tags.T
        kept = np.ones_like(scores, dtype=bool) if k is None else scores >= floors
        if k is not None and k < len(slugs):
            # Ties at the last place stay; the exact order is made over all blocks.
            last = np.partition(np.where(kept, scores, -np.inf), -k, axis=1)[:, -k][:, None]
            kept &= scores >= last
        rows, tag = np.nonzero(kept)
        parts.append(pd.DataFrame({"article_id": group["article_id"].to_numpy()[rows], "slug": slugs[tag], "threshold": floors[tag], "score": scores[rows, tag]}))
    return pd.concat(parts[1:]) if len(parts) > 1 else parts[0]


def cosine_scores(vectors: DataFrame, centroids: DataFrame, *, k: int | None = None, block_rows: int = CENTROID_BLOCK) -> DataFrame:
    """(article_id, slug, threshold, score) of article vectors and centroids of equal dimension.

    Input: article_id, vector / slug, threshold, centroid. A tag set of at most block_rows goes along with the task and
    the articles stay where they are. A larger one is cut into blocks and the articles into parts, and each part meets each
    block by key on the executors. With k, only scores that reach the tag's threshold and are among the k best of
    the block (with ties) leave a product.
    """
    schema = f"article_id {vectors.schema['article_id'].dataType.simpleString()}, slug string, threshold double, score double"
    rows = vectors.select("article_id", "vector").where("vector IS NOT NULL")
    usable = centroids.where("centroid IS NOT NULL").select("slug", "threshold", "centroid")
    total = usable.count()
    if total <= block_rows:
        # At most block_rows rows, as just counted.
        found = usable.collect()
        only = _matrices(pd.DataFrame({c: pd.Series([r[c] for r in found], dtype=object) for c in usable.columns}))

        def along(batches):
            for batch in batches:
                yield _best_of_block(batch, only, k)

        return rows.mapInPandas(along, schema)
    blocks, parts = math.ceil(total / block_rows), max(1, math.ceil(rows.count() / VECTOR_PART))
    place = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("_part", place("article_id", parts)).withColumn("_block", every(blocks))
    right = usable.withColumn("_block", place("slug", blocks)).withColumn("_part", every(parts))

    def met(some: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        return _best_of_block(some, _matrices(block), k)

    keys = ["_part", "_block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(met, schema)


def local_tags(vectors: DataFrame, centroids: DataFrame, *, k: int = 5) -> DataFrame:
    """Tags whose unclipped cosine reaches the threshold; (score, slug) descending, k per article.

    An incomplete tag set (any centroid missing, or none at all) yields no tags.
    """
    incomplete = centroids.where("centroid IS NULL").limit(1).count() > 0
    kept = cosine_scores(vectors, centroids.limit(0) if incomplete else centroids, k=k)
    clipped = kept.withColumn("confidence", clip01(F.col("score")))
    order = Window.partitionBy("article_id").orderBy(F.col("confidence").desc(), F.col("slug").desc())
    return clipped.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("article_id", "rank", "slug", "confidence")


# ---- model responses ----------------------------------------------------------------------------

FENCE = r"(?is)^\s*```(?:json)?\s*(.*?)\s*```\s*$"
JSON_OBJECT = r"(?s)\{.*\}"


def lenient_json(text: Column) -> Column:
    """Variant of the JSON object in a model answer: fenced, plain, or between the outer braces."""
    fenced = F.regexp_extract(text, FENCE, 1)
    body = F.when(text.rlike(FENCE), fenced).otherwise(text)
    value = F.coalesce(F.try_parse_json(body), F.try_parse_json(F.nullif(F.regexp_extract(body, JSON_OBJECT, 0), F.lit(""))))
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), value)


def parse_tag_responses(responses: DataFrame, tagsets: DataFrame, *, k: int, min_confidence: float = 0.0) -> DataFrame:
    """(article_id, group_id, valid, tags) of model answers (article_id, group_id, response), one per article.

    One malformed entry invalidates the answer. Unknown slugs and confidences below the tag's or the
    global floor drop out; a repeated slug keeps its maximum at its first accepted place. The k best
    follow by confidence, ties in order of acceptance. Tagsets: group_id, slug, threshold.
    """

    def kind(v: Column, path: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("VOID"))

    def entry(v: Column) -> Column:
        number = kind(v, "$.confidence").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
        return F.struct(
            F.when(kind(v, "$.slug") == "STRING", F.try_variant_get(v, "$.slug", "string")).alias("slug"),
            F.when(number, F.try_variant_get(v, "$.confidence", "double")).alias("confidence"),
        )

    answer = responses.withColumn("_json", lenient_json(F.col("response")))
    answer = answer.withColumn("_entries", F.transform(F.try_variant_get("_json", "$.tags", "array<variant>"), entry))
    sound = F.forall("_entries", lambda e: e["slug"].isNotNull() & F.coalesce(e["confidence"].between(0, 1), F.lit(False)))
    # Entries become rows that meet their tag by key, so no tag set travels with an article. The first row of an
    # article carries its verdict, also where it names nothing.
    entries = answer.select("article_id", "group_id", F.coalesce(sound, F.lit(False)).alias("valid"), F.posexplode_outer("_entries").alias("at", "e"))
    entries = entries.select("article_id", "group_id", "valid", "at", "e.slug", "e.confidence")
    floors = tagsets.select("group_id", "slug", F.greatest("threshold", F.lit(float(min_confidence))).alias("_floor"))
    met = entries.join(floors, ["group_id", "slug"], "left")
    accepted = F.coalesce(F.col("valid") & (F.col("confidence") >= F.col("_floor")), F.lit(False))
    per_slug = met.groupBy("article_id", "group_id", "slug").agg(
        F.any_value("valid").alias("valid"), F.max(F.when(accepted, F.col("confidence"))).alias("confidence"), F.min(F.when(accepted, F.col("at"))).alias("at")
    )
    order = Window.partitionBy("article_id", "group_id").orderBy(F.col("confidence").desc_nulls_last(), "at")
    best = per_slug.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= max(k, 1))
    chosen = F.when(F.col("confidence").isNotNull() & (F.col("_rank") <= k), F.struct("_rank", "slug", "confidence"))
    # At most k entries per article.
    tags = F.transform(F.array_sort(F.collect_list(chosen)), lambda t: F.struct(t["slug"].alias("slug"), t["confidence"].alias("confidence")))
    return best.groupBy("article_id", "group_id").agg(F.any_value("valid").alias("valid"), tags.alias("tags"))


def replace_tags(
    stored: DataFrame, results: DataFrame, articles: DataFrame, tags: DataFrame, *, backend: str, at: Column
) -> tuple[DataFrame, DataFrame]:
    """Persist tag results: (new article_tags, outcome per article).

    A result is refused when its article is not EXTRACTED, belongs to another tag-set group, or uses
    a slug that is not in the frozen set. Results: article_id, group_id, tags. Articles: id, status,
    group_id. Tags: id, group_id, slug (current version).
    """
    state = articles.select(F.col("id").alias("article_id"), "status", F.col("group_id").alias("_own"))
    judged = results.join(state, "article_id", "left")
    flat = judged.select("article_id", "group_id", F.explode_outer("tags").alias("t")).select(
        "article_id", "group_id", F.col("t.slug").alias("slug"), F.col("t.confidence").alias("confidence")
    )
    known = tags.select("group_id", "slug", F.col("id").alias("tag_id"))
    resolved = flat.join(known, ["group_id", "slug"], "left")
    unknown = resolved.groupBy("article_id").agg(F.bool_or(F.col("slug").isNotNull() & F.col("tag_id").isNull()).alias("_unknown"))
    outcome = judged.join(unknown, "article_id").select(
        "article_id",
        F.when(~F.coalesce(F.col("status") == "EXTRACTED", F.lit(False)), "wrong_status")
        .when(F.col("_own") != F.col("group_id"), "wrong_group")
        .when(F.col("_unknown"), "unknown_tag")
        .otherwise("tagged")
        .alias("outcome"),
    )
    accepted = outcome.where("outcome = 'tagged'").select("article_id")
    fresh = resolved.where("slug IS NOT NULL").join(accepted, "article_id", "left_semi").select(
        "article_id", "tag_id", "confidence", F.lit(backend).alias("backend"), at.alias("created_at")
    )
    kept = stored.join(accepted, "article_id", "left_anti").select("article_id", "tag_id", "confidence", "backend", "created_at")
    return kept.unionByName(fresh), outcome


def summary_candidates(articles: DataFrame, *, enabled: bool, on_demand: bool = False) -> DataFrame:
    """Articles that still need a summary; scheduled runs take EXTRACTED ones while enabled."""
    open_rows = articles.where(F.coalesce("summary_backend", F.lit("")) == "")
    if on_demand:
        return open_rows
    return open_rows.where((F.col("status") == "EXTRACTED") & F.lit(enabled))


# ---- prompts ---------------------------------------------------------------------------------

@dataclass(frozen=True)
class PromptTemplate:
    """Wording of the classification request; `{title}` and `{body}` are filled per article."""

    system: str = 'You sort articles. Use only the labels that you are given. Reply with JSON: {"tags": [{"slug": "...", "confidence": 0.0}]}, or {"tags": []} if none fits.'
    correction: str = "\nYour last reply could not be read. Reply with the JSON object alone."
    label: str = "* {slug} ({name}): {description}"
    article: str = "Title: {title}\n\n{body}"


def _filled(template: str, **values: Column) -> Column:
    """The template with columns for its names."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(F.coalesce(values[part], F.lit("")) if n % 2 else F.lit(part) for n, part in enumerate(parts)))


def label_lines(tagsets: DataFrame, template: PromptTemplate = PromptTemplate()) -> DataFrame:
    """(group_id, id, line): the label list of a group in tag order, one row per label.

    The caller of a model reads a group's lines once, in front of all its articles.
    """
    line = _filled(template.label, slug=F.col("slug"), name=F.col("name"), description=F.col("description"))
    return tagsets.select("group_id", "id", line.alias("line"))


def tag_prompts(articles: DataFrame, *, max_chars: int, correction: bool = False, template: PromptTemplate = PromptTemplate()) -> DataFrame:
    """(article_id, group_id, system, user): the part of the request that belongs to the article."""
    from ..functions.text import head_tail

    system = F.lit(template.system + (template.correction if correction else ""))
    user = _filled(template.article, title=F.col("title"), body=head_tail(F.col("content_text"), max_chars))
    return articles.select(F.col("id").alias("article_id"), "group_id", system.alias("system"), user.alias("user"))


# ---- centroids ---------------------------------------------------------------------------------


def tag_centroids(members: DataFrame, tag: str = "label") -> DataFrame:
    """Unit-length mean of the member vectors (tag, vector) of every tag; NULL vectors are left out.

    Averages run per dimension with partial aggregation, so a tag with very many members is no
    hot spot.
    """
    from ..functions.vectors import l2_normalize

    means = members.select(tag, F.posexplode("vector").alias("dim", "x")).groupBy(tag, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = means.groupBy(tag).agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("_v"))
    return ordered.select(tag, l2_normalize(F.transform("_v", lambda e: e["x"])).alias("centroid"))


def representatives(members: DataFrame, centroids: DataFrame, tag: str = "label", *, k: int = 3) -> DataFrame:
    """The members nearest to the centroid of their tag. Members: tag, id, vector."""
    # One row per tag: the rank limit is applied per partition before the shuffle.
    scored = members.join(centroids, tag).withColumn("score", dot(F.col("vector"), F.col("centroid")))
    order = Window.partitionBy(tag).orderBy(F.col("score").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(tag, "id", "rank", "score")


def tag_with_model(articles: DataFrame, tag_batch, schema: str) -> DataFrame:
    """Run an injected model function (iterator of pandas batches to the same) over articles.

    The caller supplies the network call or model; nothing here holds credentials.
    """
    return articles.mapInPandas(tag_batch, schema)
