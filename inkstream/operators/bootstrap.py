"""Building a tag set: corpus, induction batches, candidate merging, curation, stable ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import name_key, normalize_slug
from ..session import cut_lineage
from ..sources.files import stage
from .attachments import running_sum

READY = ("EXTRACTED", "TAGGED", "NOTIFIED")
SUMMARY_CHARS = 1200
MAX_DOCUMENTS = 2000
BATCH = 40
MAX_TITLES = 3
NAME_BLOCK = 100_000


def historical_articles(articles: DataFrame, sites: DataFrame, group_id: int, *, limit: int = MAX_DOCUMENTS) -> DataFrame:
    """The newest usable articles of a group: id, title, summary (or the start of the text)."""
    members = sites.where(F.col("tagset_group_id") == group_id).select(F.col("id").alias("site_id"))
    usable = articles.where(F.col("status").isin(*READY) & (F.trim("content_text") != "")).join(members, "site_id", "left_semi")
    newest = usable.orderBy(F.col("id").desc()).limit(limit)
    summary = F.coalesce(F.nullif("summary", F.lit("")), F.substring("content_text", 1, SUMMARY_CHARS))
    return newest.select("id", F.coalesce("title", F.lit("")).alias("title"), summary.alias("summary"))


def induction_batches(corpus: DataFrame, *, size: int = BATCH) -> DataFrame:
    """(batch, article_ids, articles) in id order. The corpus is limited, so one task may order it."""
    order = Window.partitionBy(F.lit(0)).orderBy("id")
    numbered = corpus.withColumn("batch", F.floor((F.row_number().over(order) - 1) / size).cast("int"))
    entries = F.array_sort(F.collect_list(F.struct("id", "title", "summary")))
    return numbered.groupBy("batch").agg(entries.alias("articles")).withColumn("article_ids", F.transform("articles", lambda a: a["id"]))


def induce(batches: DataFrame, call, schema: str) -> DataFrame:
    """Run an injected naming function (iterator of pandas batches) over the induction batches."""
    return batches.mapInPandas(call, schema)


def foreign_ids(candidates: DataFrame, batches: DataFrame) -> DataFrame:
    """Candidates that name articles outside of their batch; must be empty."""
    joined = candidates.join(batches.select("batch", F.col("article_ids").alias("_allowed")), "batch")
    return joined.where(F.size(F.array_except("article_ids", "_allowed")) > 0).drop("_allowed")


def parse_candidates(responses: DataFrame) -> DataFrame:
    """Strict check of naming answers: (batch, response) -> (batch, valid, candidates).

    The root holds `tags` and nothing else. Every tag needs a slug, name, description, positive
    distinct-countable article ids and a coverage equal to their number.
    """
    parsed = responses.withColumn("_v", F.try_parse_json("response"))
    root_keys = F.json_object_keys("response")
    parsed = parsed.withColumn("_raw", F.try_variant_get("_v", "$.tags", "array<variant>"))

    def kind(v: Column, path: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("VOID"))

    def texts(v: Column, path: str) -> Column:
        return F.transform(F.try_variant_get(v, path, "array<variant>"), lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))

    def ids(v: Column) -> Column:
        return F.transform(F.try_variant_get(v, "$.article_ids", "array<variant>"), lambda x: F.when(F.schema_of_variant(x) == "BIGINT", F.try_variant_get(x, "$", "bigint")))

    def string(v: Column, path: str) -> Column:
        return F.when(kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))

    def optional_texts(v: Column, path: str) -> Column:
        missing = F.try_variant_get(v, path, "variant").isNull()
        return F.when(missing, F.array().cast("array<string>")).otherwise(texts(v, path))

    def cleaned(values: Column) -> Column:
        return F.array_distinct(F.filter(F.transform(values, lambda t: F.trim(t)), lambda t: t != ""))

    def entry(v: Column) -> Column:
        members = ids(v)
        coverage = F.when(kind(v, "$.coverage") == "BIGINT", F.try_variant_get(v, "$.coverage", "bigint"))
        keywords, titles = optional_texts(v, "$.keywords"), optional_texts(v, "$.representative_titles")
        slug = normalize_slug(string(v, "$.slug"))
        sound = (
            (slug != "") & (F.trim(string(v, "$.name")) != "") & (F.trim(string(v, "$.description")) != "")
            & (F.size(members) > 0) & F.forall(members, lambda i: F.coalesce(i > 0, F.lit(False)))
            & (coverage == F.size(F.array_distinct(members))) & F.forall(keywords, lambda t: t.isNotNull()) & F.forall(titles, lambda t: t.isNotNull())
        )
        return F.struct(
            F.coalesce(sound, F.lit(False)).alias("sound"), slug.alias("slug"), F.trim(string(v, "$.name")).alias("name"), F.trim(string(v, "$.description")).alias("description"),
            cleaned(keywords).alias("keywords"), F.array_distinct(members).alias("article_ids"), coverage.alias("coverage"), F.slice(cleaned(titles), 1, MAX_TITLES).alias("titles"),
        )

    shaped = parsed.withColumn("_entries", F.transform("_raw", entry))
    valid = F.coalesce((F.array_join(root_keys, ",") == "tags") & F.forall("_entries", lambda e: e["sound"]), F.lit(False))
    return shaped.select("batch", valid.alias("valid"), F.when(valid, F.transform("_entries", lambda e: e.dropFields("sound"))).alias("candidates"))


def merge_roots(candidates: DataFrame) -> DataFrame:
    """(slug, root): into which first slug every slug merges.

    Candidates meet in `position` order. A known slug joins its tag; an unknown one joins the tag that
    last used its normalised name, and starts a tag otherwise. So a slug is decided once, by its
    first row, and points to the slug of the latest earlier row with the same name. Following the
    pointers (doubling the reach each round) gives the roots.
    """
    keyed = candidates.select("position", "slug", name_key("name").alias("_name"))
    blocked = keyed.withColumn("_block", F.floor(F.col("position") / NAME_BLOCK))
    inside = Window.partitionBy("_name", "_block").orderBy("position")
    near = blocked.withColumn("_near", F.lag("slug").over(inside))
    # The last slug of every earlier block covers the first row of a block.
    tails = blocked.groupBy("_name", "_block").agg(F.max_by("slug", "position").alias("_tail"))
    over_blocks = Window.partitionBy("_name").orderBy("_block")
    carried = tails.select("_name", "_block", F.lag("_tail").over(over_blocks).alias("_far"))
    linked = near.join(carried, ["_name", "_block"]).select("position", "slug", F.coalesce("_near", "_far").alias("_to"))
    first = linked.groupBy("slug").agg(F.min_by(F.struct("_to"), "position").alias("_f"))
    pointers = cut_lineage(first.select("slug", F.coalesce("_f._to", "slug").alias("root")))
    while True:
        above = pointers.select(F.col("slug").alias("root"), F.col("root").alias("_next"))
        jumped = cut_lineage(pointers.join(above, "root").select("slug", "root", "_next"))
        moved = not jumped.where("root <> _next").isEmpty()
        pointers = jumped.select("slug", F.col("_next").alias("root"))
        if not moved:
            return pointers


def merge_candidates(candidates: DataFrame) -> DataFrame:
    """Merged tags: slug, name, description, keywords, titles, coverage, n_merged, position.

    Input: position, slug, name, description, keywords, article_ids, coverage, titles.
    """
    roots = merge_roots(candidates)
    rows = candidates.join(roots, "slug")
    scalars = rows.groupBy("root").agg(
        F.min_by("name", "position").alias("name"),
        F.max_by("description", F.struct(F.char_length("description"), -F.col("position"))).alias("description"),
        F.max("coverage").alias("_coverage"), F.count(F.lit(1)).alias("_n"), F.min("position").alias("position"),
    )
    # Distinct members are counted as rows; a tag's article list is never gathered.
    members = rows.select("root", F.explode("article_ids").alias("article_id")).distinct().groupBy("root").agg(F.count(F.lit(1)).alias("_ids"))

    def first_seen(column: str, keep: int | None = None) -> DataFrame:
        seen = rows.select("root", "position", F.posexplode(column).alias("_i", "_x")).groupBy("root", "_x").agg(F.min(F.struct("position", "_i")).alias("_at"))
        if keep:
            # Only what is kept is gathered.
            seen = seen.withColumn("_r", F.row_number().over(Window.partitionBy("root").orderBy("_at"))).where(F.col("_r") <= keep)
        ordered = seen.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("_at", "_x"))).alias("_l"))
        return ordered.select("root", F.transform("_l", lambda e: e["_x"]).alias(column))

    merged = scalars.join(members, "root", "left").join(first_seen("keywords"), "root", "left").join(first_seen("titles", MAX_TITLES), "root", "left")
    none = F.array().cast("array<string>")
    coverage = F.when(F.col("_n") > 1, F.greatest("_coverage", F.coalesce("_ids", F.lit(0)))).otherwise(F.col("_coverage"))
    return merged.select(
        F.col("root").alias("slug"), "name", "description", F.coalesce("keywords", none).alias("keywords"), F.coalesce("titles", none).alias("titles"),
        coverage.alias("coverage"), (F.col("_n") - 1).alias("n_merged"), "position",
    )


def curate(tags: DataFrame, *, document_count: int, min_docs: int, max_tags: int, max_ratio: float = 0.4) -> DataFrame:
    """Tags worth keeping: enough coverage, not too broad, the best covered first, at most max_tags."""
    enough = tags.where(F.col("coverage") >= min_docs)
    if document_count >= 10:
        enough = enough.where(F.col("coverage") / document_count <= max_ratio)
    return enough.orderBy(F.col("coverage").desc(), "slug").limit(max_tags)


def drop_reasons(tags: DataFrame, *, document_count: int, min_docs: int, max_ratio: float = 0.4) -> DataFrame:
    broad = (F.lit(document_count) >= 10) & (F.col("coverage") / document_count > max_ratio)
    reason = F.when(F.col("coverage") < min_docs, F.format_string("coverage %d < %d", "coverage", F.lit(min_docs))).when(
        broad, F.format_string("coverage %d/%d too broad", "coverage", F.lit(document_count))
    )
    return tags.select("slug", reason.alias("reason")).where("reason IS NOT NULL")


def curation_notes(tags: DataFrame, *, document_count: int, min_docs: int, max_tags: int, max_ratio: float = 0.4) -> DataFrame:
    """(slug, note): why each tag that `curate` leaves out is left out."""
    rule = {"document_count": document_count, "min_docs": min_docs, "max_ratio": max_ratio}
    refused = drop_reasons(tags, **rule)
    kept = curate(tags, max_tags=max_tags, **rule)
    beyond = tags.select("slug").join(refused, "slug", "left_anti").join(kept.select("slug"), "slug", "left_anti")
    both = refused.unionByName(beyond.withColumn("reason", F.lit(f"beyond max_tags={max_tags}")))
    return both.select("slug", F.concat(F.lit("dropped '"), "slug", F.lit("': "), "reason").alias("note"))


def report_lines(tags: DataFrame) -> DataFrame:
    """One report section per tag, in curation order."""
    dash = F.lit("—")
    keywords = F.coalesce(F.nullif(F.array_join("keywords", ", "), F.lit("")), dash)
    titles = F.coalesce(F.nullif(F.array_join(F.slice("titles", 1, MAX_TITLES), ", "), F.lit("")), dash)
    section = F.concat(
        F.lit("### `"), "slug", F.lit("` — "), "name", F.lit("\n\n- Coverage: "), F.col("coverage").cast("string"), F.lit("\n- Description: "), "description",
        F.lit("\n- Keywords: "), keywords, F.lit("\n- Representatives: "), titles, F.lit("\n"),
    )
    return tags.select("slug", "coverage", section.alias("section"))


def report_document(kept: DataFrame, notes: DataFrame, *, group: str, mode: str, document_count: int, status: str) -> DataFrame:
    """(part, position, text): the pieces of a whole report; joined in that order by line breaks they are the document.

    Part 0 is the heading, 1 the sections of the kept tags in curation order, 2 the heading of what was merged or dropped, 3
    its notes (position, note), or one line that there are none.
    """
    lines = [f"# Tagset bootstrap report: {group}", "", f"- Status: **{status}**", f"- Build mode: `{mode}`", f"- Historical articles: {document_count}", "- Curated tags: "]
    head = kept.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("position"), F.concat(F.lit("\n".join(lines)), F.col("n").cast("string"), F.lit("\n\n## Tags\n")).alias("text")
    )
    # Curation leaves at most max_tags tags, so one task may number them.
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("coverage").desc(), "slug")
    sections = report_lines(kept).select(F.lit(1).alias("part"), F.row_number().over(order).cast("bigint").alias("position"), F.col("section").alias("text"))
    first = notes.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(2).alias("part"), F.lit(0).cast("bigint").alias("position"), F.when(F.col("n") > 0, "## Merged / dropped\n").otherwise("## Merged / dropped\n\n- None").alias("text")
    )
    rest = notes.select(F.lit(3).alias("part"), F.col("position").cast("bigint").alias("position"), F.concat(F.lit("- "), "note").alias("text"))
    return head.unionByName(sections).unionByName(first).unionByName(rest)


def assign_ids(document_tags: DataFrame, stored: DataFrame) -> DataFrame:
    """Stable ids: known (group_id, slug) keep theirs, new ones continue after the largest id.

    Document tags: group_id, slug, position. Stored: id, group_id, slug.
    """
    known = document_tags.join(stored.select("group_id", "slug", "id"), ["group_id", "slug"], "left")
    fresh = cut_lineage(known.where("id IS NULL").drop("id").withColumn("_one", F.lit(1)))
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    numbered = running_sum(fresh, "position", "_one")
    return known.where("id IS NOT NULL").unionByName(numbered.withColumn("id", F.col("total") + top).drop("total", "_one"))


def removed_subscribed_tags(stored: DataFrame, subscription_tags: DataFrame, incoming: DataFrame) -> DataFrame:
    """Subscribed slugs that a new version would drop; must be empty before a freeze."""
    used = stored.join(subscription_tags.select(F.col("tag_id").alias("id")), "id", "left_semi")
    return used.join(incoming.select("group_id", "slug"), ["group_id", "slug"], "left_anti").select("group_id", "slug")


def version_of(date: Column, document_digest: Column) -> Column:
    return F.concat(F.date_format(date, "yyyy-MM-dd"), F.lit("-"), F.substring(document_digest, 1, 6))


def cluster_vectors(vectors: DataFrame, *, k: int, seed: int = 7) -> DataFrame:
    """Cluster label per vector for tag naming (id, vector -> id, label).

    The density clustering of the original tool has no Spark counterpart; bisecting k-means takes its
    place, so labels differ from it. No point is treated as noise.
    """
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.functions import array_to_vector

    features = vectors.withColumn("features", array_to_vector(F.transform("vector", lambda x: x.cast("double"))))
    model = BisectingKMeans(k=k, seed=seed, distanceMeasure="cosine").fit(features)
    return model.transform(features).select("id", F.col("prediction").alias("label"))


# Fixed value: pages of one entry that a history run may read.
MAX_HISTORY_PAGES = 500


def history_entries(entries: DataFrame, asked: Column) -> tuple[DataFrame, DataFrame]:
    """(entries to read back, refused ones with `reason`) of a history run.

    Entries as in `sources.discovery.page_urls`, without max_pages. `asked` pages are read, or up to the last known one
    (max_page) where none are asked for; an entry without pagination, or outside of 1 to MAX_HISTORY_PAGES, is refused alone.
    """
    pages = F.coalesce(asked, F.col("max_page"))
    reason = F.when(F.coalesce("mode", F.lit("none")) == "none", "no pagination").when(
        ~F.coalesce(pages.between(1, MAX_HISTORY_PAGES), F.lit(False)), f"pages must be in 1..{MAX_HISTORY_PAGES}"
    )
    judged = entries.withColumn("max_pages", pages.cast("int")).withColumn("reason", reason)
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL")


def require(problems: DataFrame, message: str, columns: Sequence[str]) -> None:
    """Refuse to continue when a validation query finds rows; only a few examples are fetched."""
    examples = problems.select(*columns).take(5)
    if examples:
        raise ValueError(f"{message}: {[tuple(e) for e in examples]}")


def freeze(document_tags: DataFrame, stored: DataFrame, subscription_tags: DataFrame, path: str, *, version: str) -> DataFrame:
    """Stage the tags of a new frozen version at `path`; `promote` or `recover` completes it.

    Ids stay stable per (group, slug). A version that drops a subscribed tag is refused. Document
    tags: group_id, slug, position and the tag's own columns. Stored: id, group_id, slug.
    """
    groups = document_tags.select("group_id").distinct()
    current = stored.join(groups, "group_id", "left_semi")
    require(removed_subscribed_tags(current, subscription_tags, document_tags), "subscribed tags would be removed", ["group_id", "slug"])
    numbered = assign_ids(document_tags.select("group_id", "slug", "position"), stored).select("group_id", "slug", "id")
    frozen = document_tags.join(numbered, ["group_id", "slug"]).withColumn("tagset_version", F.lit(version))
    untouched = stored.join(groups, "group_id", "left_anti")
    stage(frozen.unionByName(untouched, allowMissingColumns=True), path)
    return frozen
