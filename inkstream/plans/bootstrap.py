"""Tag-set building queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..operators import bootstrap as B
from ..operators import density as D
from ..operators import induction as I
from ..operators.sinks import insert_if_absent
from ..session import cut_lineage, new_shared_path
from ..sources import versions as V
from ..sources.files import document_checksum, verify_tagsets
from ..sources.site_files import import_sites as import_site_rows
from ..sources.site_files import parse_site_files
from .bridge import cte, read, table
from .catalogue import query


@query("src15_historical_articles", cte("articles", "sites") + """
SELECT a.id, a.title, coalesce(nullif(a.summary, ''), substr(a.content_text, 1, 1200)) AS summary FROM articles a JOIN sites s ON s.id = a.site_id
WHERE s.tagset_group_id = 2 AND trim(a.content_text, ' ') <> '' AND a.status IN ('EXTRACTED', 'TAGGED', 'NOTIFIED') ORDER BY a.id DESC LIMIT 2000""")
def corpus(spark, d):
    return B.historical_articles(table(spark, d, "articles"), table(spark, d, "sites"), 2)


@query("bst1_induction_batches", cte("articles", "sites") + """
, corpus AS (SELECT a.id FROM articles a JOIN sites s ON s.id = a.site_id WHERE s.tagset_group_id = 2 AND trim(a.content_text, ' ') <> '' AND a.status IN ('EXTRACTED', 'TAGGED', 'NOTIFIED') ORDER BY a.id DESC LIMIT 2000)
SELECT CAST((row_number() OVER (ORDER BY id) - 1) // 40 AS INT) AS batch, id AS article_id FROM corpus""")
def batches(spark, d):
    articles = B.historical_articles(table(spark, d, "articles"), table(spark, d, "sites"), 2)
    return B.induction_batches(articles).select("batch", F.explode("article_ids").alias("article_id"))


@query("ded10_foreign_ids", """
WITH lines AS (SELECT l_orderkey AS batch, list(DISTINCT l_partkey) AS ids FROM lineitem GROUP BY 1), tag AS (SELECT p_partkey AS batch, [p_partkey, p_partkey + 1] AS ids FROM part)
SELECT t.batch FROM tag t JOIN lines l ON l.batch = t.batch WHERE NOT list_has_all(l.ids, t.ids)""")
def foreign_ids(spark, d):
    allowed = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("batch"), "l_partkey").distinct().groupBy("batch").agg(F.collect_list("l_partkey").alias("article_ids"))
    named = read(spark, d, "part").select(F.col("p_partkey").alias("batch"), F.array("p_partkey", F.col("p_partkey") + 1).alias("article_ids"))
    return B.foreign_ids(named, allowed).select("batch")


@query("jsn4_candidate_schema", """
SELECT p_partkey AS batch, p_partkey % 7 = 0 OR p_partkey % 7 = 6 AS valid, CASE WHEN p_partkey % 7 = 0 THEN 'x-' || CAST(p_partkey AS STRING) WHEN p_partkey % 7 = 6 THEN 'y' END AS slug FROM part""")
def candidate_schema(spark, d):
    good = "concat('{\"tags\":[{\"slug\":\" X_', p_partkey, ' \",\"name\":\"N\",\"description\":\"d\",\"keywords\":[\"a\",\" a \",\"\"],\"article_ids\":[1,2,1],\"coverage\":2}]}')"
    text = F.expr(f"""CASE p_partkey % 7 WHEN 0 THEN {good} WHEN 1 THEN '{{"tags":[],"more":1}}' WHEN 2 THEN replace({good}, '"coverage":2', '"coverage":3') WHEN 3 THEN replace({good}, '[1,2,1]', '[1,2,true]')
      WHEN 4 THEN replace({good}, '"description":"d"', '"description":" "') WHEN 5 THEN 'oops' ELSE replace({good}, concat(' X_', p_partkey, ' '), 'Y') END""")
    parsed = B.parse_candidates(read(spark, d, "part").select(F.col("p_partkey").alias("batch"), text.alias("response")))
    return parsed.select("batch", "valid", F.get("candidates", 0)["slug"].alias("slug"))


def candidates(spark, d):
    """One candidate per part: slugs and names collide in different ways."""
    key = F.col("p_partkey")
    return read(spark, d, "part").select(
        key.alias("position"), F.concat(F.lit("s"), (key * 7 % 613).cast("string")).alias("slug"),
        F.concat(F.when(key % 2 == 0, "Topic ").otherwise("TOPIC-"), (key * 11 % 431).cast("string")).alias("name"),
        F.concat("p_brand", F.lit(" "), "p_type").alias("description"), F.array("p_brand", "p_type").alias("keywords"),
        F.array(key % 97, key % 89).alias("article_ids"), (F.col("p_size") % 7).cast("bigint").alias("coverage"), F.array("p_name").alias("titles"),
    )


# Sequential reference: the key table as two maps, one candidate per step.
MERGED = """
WITH RECURSIVE cand AS (SELECT p_partkey AS position, 's' || CAST(p_partkey * 7 % 613 AS STRING) AS slug, 'topic' || CAST(p_partkey * 11 % 431 AS STRING) AS name_key,
  CASE WHEN p_partkey % 2 = 0 THEN 'Topic ' ELSE 'TOPIC-' END || CAST(p_partkey * 11 % 431 AS STRING) AS name, p_brand || ' ' || p_type AS description, p_size % 7 AS coverage, [p_partkey % 97, p_partkey % 89] AS ids, row_number() OVER (ORDER BY p_partkey) AS rn FROM part),
prev AS (SELECT c.*, (SELECT max(b.rn) FROM cand b WHERE b.name_key = c.name_key AND b.rn < c.rn) AS name_prev, (SELECT min(b.rn) FROM cand b WHERE b.slug = c.slug) AS slug_first FROM cand c),
step AS (SELECT rn, CASE WHEN slug_first < rn THEN slug_first ELSE name_prev END AS up FROM prev),
walk AS (SELECT rn, rn AS at FROM step UNION ALL SELECT w.rn, s.up FROM walk w JOIN step s ON s.rn = w.at WHERE s.up IS NOT NULL),
roots AS (SELECT w.rn, min(w.at) AS root FROM walk w JOIN step s ON s.rn = w.at WHERE s.up IS NULL GROUP BY w.rn),
rows AS (SELECT c.*, r.root, (SELECT slug FROM cand x WHERE x.rn = r.root) AS root_slug FROM cand c JOIN roots r ON r.rn = c.rn),
ids AS (SELECT root_slug, count(DISTINCT i) AS n_ids FROM (SELECT root_slug, unnest(ids) AS i FROM rows) q GROUP BY 1),
merged AS (SELECT r.root_slug AS slug, arg_min(name, position) AS name, arg_max(description, (length(description), -position)) AS description, count(*) - 1 AS n_merged,
  CASE WHEN count(*) > 1 THEN greatest(max(coverage), any_value(n_ids)) ELSE max(coverage) END AS coverage FROM rows r JOIN ids i ON i.root_slug = r.root_slug GROUP BY 1)"""


@query("agg16_merge_candidates", MERGED + " SELECT slug, name, description, n_merged, CAST(coverage AS BIGINT) AS coverage FROM merged")
def merge(spark, d):
    return B.merge_candidates(candidates(spark, d)).select("slug", "name", "description", "n_merged", "coverage")


@query("mth5_top9_bst3_curation", MERGED + """
 SELECT slug, CAST(coverage AS BIGINT) AS coverage FROM merged WHERE coverage >= 5 AND coverage / 100.0 <= 0.4 ORDER BY merged.coverage DESC, slug LIMIT 80""")
def curation(spark, d):
    return B.curate(B.merge_candidates(candidates(spark, d)), document_count=100, min_docs=5, max_tags=80).select("slug", "coverage")


@query("bst4_report", MERGED + """
, words AS (SELECT root_slug AS slug, w, min((position, k)) AS seen FROM (SELECT r.root_slug, r.position, unnest([p.p_brand, p.p_type]) AS w, unnest([1, 2]) AS k FROM rows r JOIN part p ON p.p_partkey = r.position) q GROUP BY 1, 2),
heads AS (SELECT root_slug AS slug, t, min(position) AS seen FROM (SELECT r.root_slug, r.position, p.p_name AS t FROM rows r JOIN part p ON p.p_partkey = r.position) q GROUP BY 1, 2),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY seen) AS rk FROM heads) x WHERE rk <= 3)
 SELECT m.slug, '### `' || m.slug || '` — ' || name || chr(10) || chr(10) || '- Coverage: ' || CAST(coverage AS STRING) || chr(10) || '- Description: ' || description
  || chr(10) || '- Keywords: ' || (SELECT string_agg(w, ', ' ORDER BY seen) FROM words g WHERE g.slug = m.slug)
  || chr(10) || '- Representatives: ' || (SELECT string_agg(t, ', ' ORDER BY seen) FROM top h WHERE h.slug = m.slug) || chr(10) AS section FROM merged m""")
def report(spark, d):
    return B.report_lines(B.merge_candidates(candidates(spark, d))).select("slug", "section")


@query("bst4_report_document", MERGED + """
, kept AS (SELECT slug, coverage FROM merged WHERE coverage >= 6 AND coverage / 100.0 <= 0.4 ORDER BY merged.coverage DESC, slug LIMIT 80)
SELECT 0 AS part, 0::BIGINT AS position, '# Tagset bootstrap report: campus' || chr(10) || chr(10) || '- Status: **draft**' || chr(10) || '- Build mode: `llm`' || chr(10) || '- Historical articles: 100' || chr(10) || '- Curated tags: ' || (SELECT CAST(count(*) AS STRING) FROM kept) || chr(10) || chr(10) || '## Tags' || chr(10) AS text
UNION ALL SELECT 1, row_number() OVER (ORDER BY kept.coverage DESC, slug), '### `' || slug || '`' FROM kept
UNION ALL SELECT 2, 0, '## Merged / dropped' || chr(10)
UNION ALL SELECT 3, CAST(substr(slug, 2) AS BIGINT), '- dropped ''' || slug || ''': ' || CASE WHEN coverage < 6 THEN 'coverage ' || CAST(coverage AS STRING) || ' < 6' WHEN coverage / 100.0 > 0.4 THEN 'coverage ' || CAST(coverage AS STRING) || '/100 too broad' ELSE 'beyond max_tags=80' END FROM merged WHERE slug NOT IN (SELECT slug FROM kept)""")
def report_document(spark, d):
    """Sections are compared by their first words here; `bst4_report` compares them whole."""
    merged = cut_lineage(B.merge_candidates(candidates(spark, d)))
    rule = {"document_count": 100, "min_docs": 6, "max_tags": 80}
    kept = B.curate(merged, **rule)
    notes = B.curation_notes(merged, **rule).select(F.substring("slug", 2, 20).cast("bigint").alias("position"), "note")
    pieces = B.report_document(kept, notes, group="campus", mode="llm", document_count=100, status="draft")
    return pieces.withColumn("text", F.when(F.col("part") == 1, F.substring_index("text", " — ", 1)).otherwise(F.col("text")))


@query("agg19_stm13_stable_ids", cte("tags") + """
, doc AS (SELECT group_id, CASE WHEN id % 3 = 0 THEN slug ELSE 'new-' || CAST(id AS STRING) END AS slug, id AS position FROM tags),
j AS (SELECT d.*, t.id FROM doc d LEFT JOIN tags t ON t.group_id = d.group_id AND t.slug = d.slug)
SELECT group_id, slug, position, id FROM j WHERE id IS NOT NULL UNION ALL SELECT group_id, slug, position, (SELECT max(id) FROM tags) + row_number() OVER (ORDER BY position) FROM j WHERE id IS NULL""")
def stable_ids(spark, d):
    tags = table(spark, d, "tags").select("id", "group_id", "slug")
    document = tags.select("group_id", F.when(F.col("id") % 3 == 0, F.col("slug")).otherwise(F.concat(F.lit("new-"), F.col("id").cast("string"))).alias("slug"), F.col("id").alias("position"))
    return B.assign_ids(document, tags).select("group_id", "slug", "position", "id")


@query("agg20_removed_subscribed_tags", cte("tags", "subscription_tags") + """
SELECT DISTINCT t.group_id, t.slug FROM tags t JOIN subscription_tags s ON s.tag_id = t.id WHERE t.tagset_version <> 'v0' AND t.slug NOT IN (SELECT slug FROM tags WHERE threshold < 0.4)""")
def removed_tags(spark, d):
    tags = table(spark, d, "tags")
    incoming = tags.where("threshold < 0.4").select("group_id", "slug")
    return B.removed_subscribed_tags(tags.where("tagset_version <> 'v0'"), table(spark, d, "subscription_tags"), incoming)


@query("src13_import_sites", """
SELECT p_name AS slug, min(p_partkey) AS first_seen FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size > 49) GROUP BY p_name""")
def import_sites(spark, d):
    part = read(spark, d, "part").select(F.col("p_name").alias("slug"), F.col("p_partkey").alias("first_seen"), "p_size")
    stored = part.where("p_size > 49").select("slug").distinct()
    return insert_if_absent(part.select("slug", "first_seen"), stored, ["slug"], order=["first_seen"])


def tagset_documents(spark, d):
    """One frozen document per part, with every kind of defect."""
    body = F.expr("""concat('{"build_mode":"llm","frozen_at":"2024-01-01T00:00:00+00:00","group":"g', p_partkey % 5, '","tags":[{"description":"', p_type, '","keywords":["k"],"name":"', p_name, '","slug":"a","threshold":0.5},{"name":"b","slug":"', CASE WHEN p_partkey % 6 = 4 THEN 'a' ELSE 'b' END, '","threshold":', CASE WHEN p_partkey % 6 = 5 THEN '1.5' ELSE '0.25' END, '}],"tagset_version":"', CASE WHEN p_partkey % 6 = 3 THEN '' ELSE 'v1' END, '"}')""")
    rows = read(spark, d, "part").select("p_partkey", body.alias("canonical"))
    digest = F.concat(F.lit("sha256:"), F.sha2("canonical", 256))
    shown = F.when(F.col("p_partkey") % 6 == 1, F.lit("sha256:0")).otherwise(digest)
    # Key order and blanks differ from the canonical form on purpose.
    spaced = F.concat(F.lit('{ "checksum" : "'), shown, F.lit('", '), F.expr("substring(canonical, 2)"))
    return rows.withColumn("document", F.when(F.col("p_partkey") % 6 == 2, F.lit("[broken")).otherwise(spaced)).withColumn("expected", digest)


CANONICAL = """'{"build_mode":"llm","frozen_at":"2024-01-01T00:00:00+00:00","group":"g' || CAST(p_partkey % 5 AS STRING) || '","tags":[{"description":"' || p_type || '","keywords":["k"],"name":"' || p_name || '","slug":"a","threshold":0.5},{"name":"b","slug":"' || CASE WHEN p_partkey % 6 = 4 THEN 'a' ELSE 'b' END || '","threshold":' || CASE WHEN p_partkey % 6 = 5 THEN '1.5' ELSE '0.25' END || '}],"tagset_version":"' || CASE WHEN p_partkey % 6 = 3 THEN '' ELSE 'v1' END || '"}'"""


@query("jsn3_bst5_checksum", f"SELECT p_partkey, CASE WHEN p_partkey % 6 <> 2 THEN 'sha256:' || sha256({CANONICAL}) END AS checksum FROM part")
def checksum(spark, d):
    return tagset_documents(spark, d).select("p_partkey", document_checksum("document").alias("checksum"))


@query("src14_ded13_verify_tagset", """
SELECT p_partkey, CASE p_partkey % 6 WHEN 1 THEN 'checksum' WHEN 2 THEN 'unreadable' WHEN 3 THEN 'metadata' WHEN 4 THEN 'slugs' WHEN 5 THEN 'threshold' END AS error, CASE WHEN p_partkey % 6 <> 2 THEN 2 END AS n_tags FROM part""")
def verify(spark, d):
    return verify_tagsets(tagset_documents(spark, d)).select("p_partkey", "error", F.when(F.col("tags").isNotNull(), F.size("tags")).alias("n_tags"))


@query("bst2_cluster_vectors")
def cluster(spark, d):
    """Clusters for naming; the number of clusters follows the labels of the table."""
    rows = read(spark, d, "embeddings")
    vectors = rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return B.cluster_vectors(vectors, k=rows.agg(F.countDistinct("label")).first()[0])


def vectors(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


@query("bst2_core_distances", """
WITH n AS (SELECT vec_id AS id, list_transform(embedding, lambda c: c::DOUBLE) AS x FROM embeddings),
u AS (SELECT id, list_transform(x, lambda c: round(c / sqrt(list_reduce(list_transform(x, lambda e: e * e), lambda a, b: a + b)) * 65536)) AS v FROM n),
near AS (SELECT a.id, list_dot_product(a.v, a.v) + list_dot_product(b.v, b.v) - 2 * list_dot_product(a.v, b.v) AS w FROM u a JOIN u b ON a.id <> b.id)
SELECT id, w::BIGINT AS core FROM near QUALIFY row_number() OVER (PARTITION BY id ORDER BY w) = 5""")
def core_distances(spark, d):
    """How dense the place of each vector is: squared distance to its fifth nearest neighbour, in whole units."""
    return D.core_distances(D.unit_points(vectors(spark, d)), 5)


@query("bst2_density_clusters")
def density_clusters(spark, d):
    """Clusters of the vectors for naming; what lies in no dense place is noise."""
    return D.density_clusters(vectors(spark, d), least=5)


def merge_by_remainder(rows: pd.DataFrame) -> pd.DataFrame:
    """Stand-in for a naming model: numbers with the same remainder by five become one tag, named after the first."""
    kept = []
    for _, same in rows.assign(_k=rows["slug"].str[1:].astype(int) % 5).groupby("_k", sort=False):
        first = same.iloc[0]
        kept.append((first["slug"], first["name"], first["description"], list(first["keywords"]), list(first["titles"]), same["slug"].tolist()))
    return pd.DataFrame(kept, columns=["slug", "name", "description", "keywords", "titles", "sources"])


@query("bst1_merge_rounds", """
WITH RECURSIVE c AS (SELECT 0 AS level, p_partkey AS orig, p_partkey AS cur, false AS done FROM part
 UNION ALL SELECT level + 1, orig, min(cur) OVER (PARTITION BY (dr - 1) // 100, cur % 5), n <= 100 FROM (SELECT *, max(dr) OVER () AS n FROM (SELECT *, dense_rank() OVER (ORDER BY cur) AS dr FROM c WHERE NOT done) x) y),
last AS (SELECT orig, cur, level FROM c WHERE done)
SELECT 's' || CAST(cur AS STRING) AS slug, 'Name ' || CAST(cur AS STRING) AS name, count(DISTINCT article) AS coverage, max(level) AS levels FROM (SELECT cur, level, unnest([orig % 500, orig % 7 + 500]) AS article FROM last) z GROUP BY 1, 2""")
def merge_rounds(spark, d):
    """One candidate per part, merged by hundreds over several levels until five are left; members are counted as rows."""
    key = F.col("p_partkey")
    number = key.cast("string")
    part = read(spark, d, "part")
    rows = part.select(key.alias("position"), F.concat(F.lit("s"), number).alias("slug"), F.concat(F.lit("Name "), number).alias("name"), F.col("p_type").alias("description"), F.array("p_brand").alias("keywords"), F.array("p_name").alias("titles"))
    members = part.select(F.concat(F.lit("s"), number).alias("slug"), F.explode(F.array(key % 500, key % 7 + 500)).alias("article_id"))
    tags, _, levels = I.merge_rounds(rows, members, merge_by_remainder, max_tags=25)
    return tags.select("slug", "name", "coverage", F.lit(levels).alias("levels"))


class Crash(RuntimeError):
    """Stands for the end of a process."""


@query("bst6_stm13_review_and_recovery", """
WITH t AS (SELECT p_size % 5 AS g, count(*) AS n, max(p_partkey) AS top FROM part GROUP BY 1)
SELECT CASE g WHEN 0 THEN 'rejected' WHEN 1 THEN 'draft' WHEN 2 THEN 'published' WHEN 3 THEN 'lost' ELSE 'finished' END AS name, CASE WHEN g IN (2, 4) THEN 'v2' WHEN g = 3 THEN 'v1' END AS current,
 CASE WHEN g >= 2 THEN n END AS tags, CASE WHEN g IN (2, 4) THEN top + 1 WHEN g = 3 THEN top END AS top,
 CASE g WHEN 1 THEN 'v2:draft' WHEN 2 THEN 'v2:current' WHEN 3 THEN 'v1:current,v2:discarded' WHEN 4 THEN 'v1:current,v2:current' ELSE '' END AS states FROM t""")
def review_and_recovery(spark, d):
    """Five groups: too few tags, a draft, a published draft, and crashes before and after the group's own record changed."""
    part = read(spark, d, "part").select((F.col("p_size") % 5).alias("g"), F.col("p_partkey").alias("id"), F.col("p_name").alias("slug"))
    root, groups = new_shared_path(spark, "tagset-versions"), {}

    def crash_after(at):
        def after(step):
            if step == at:
                raise Crash(at)
        return after

    names = ["rejected", "draft", "published", "lost", "finished"]
    for g, name in enumerate(names):
        old = part.where(F.col("g") == g).drop("g")
        new = old.withColumn("id", F.col("id") + 1)
        put = lambda version, name=name: groups.__setitem__(name, version)
        plain = V.Versions(spark, root)
        if name == "rejected":
            V.bootstrap(plain, new.where("id < 0"), name, "v2", min_tags=1, review=False, update_group=put)
        elif name in ("draft", "published"):
            V.bootstrap(plain, new, name, "v2", min_tags=1, review=True, update_group=put)
            if name == "published":
                V.publish(plain, name, "v2", update_group=put)
        else:
            V.bootstrap(plain, old, name, "v1", min_tags=1, review=False, update_group=put)
            try:
                V.bootstrap(V.Versions(spark, root, crash_after("staged" if name == "lost" else "group")), new, name, "v2", min_tags=1, review=False, update_group=put)
            except Crash:
                plain.recover(name, groups[name])
    store = V.Versions(spark, root)
    states = store.states().orderBy("version").collect()
    rows = [(n, store.current_version(n), ",".join(f"{r['version']}:{r['state']}" for r in states if r["group"] == n)) for n in names]
    found = spark.createDataFrame(rows, "name string, current string, states string")
    held = None
    for n, version, _ in rows:
        if version:
            one = store.read(n).agg(F.count(F.lit(1)).alias("tags"), F.max("id").alias("top")).select(F.lit(n).alias("name"), "tags", "top")
            held = one if held is None else held.unionByName(one)
    return found.join(held, "name", "left").select("name", "current", "tags", "top", "states")


def site_files(spark, d):
    """One file per part, written as text and read back: most are sound, others break one rule each."""
    body = F.expr("""concat('{"tagset_groups": [{"slug": "g', p_size % 9, '", "name": "Group ', p_size % 9, '"}], "sites": [{"slug": "site-', p_partkey % 900, '", "name": "Site ', p_partkey, '", "base_url": "', CASE WHEN p_partkey % 8 = 1 THEN 'ftp' ELSE 'https' END,
      '://s', p_partkey, '.example/", "discovery_mode": "', CASE WHEN p_partkey % 8 = 2 THEN 'guess' ELSE 'rss' END, '", "tagset_group": "g', CASE WHEN p_partkey % 8 = 3 THEN 99 ELSE p_size % 9 END, '", "enabled": ', CASE WHEN p_partkey % 8 = 4 THEN '"yes"' ELSE 'false' END,
      ', "crawl_interval_sec": ', CASE WHEN p_partkey % 8 = 5 THEN 5 ELSE 60 + p_size END, ', "config": {"n": ', p_partkey, '}}]}')""")
    text = F.when(F.col("p_partkey") % 8 == 6, F.lit("{ broken")).when(F.col("p_partkey") % 8 == 7, F.lit('{"sites": {"slug": "x"}}')).otherwise(body)
    rows = read(spark, d, "part").select(F.format_string("%012d", "p_partkey").alias("path"), text.alias("document"))
    folder = new_shared_path(spark, "site-files")
    rows.select(F.to_json(F.struct("path", "document")).alias("value")).write.text(folder)
    held = spark.read.text(folder).select(F.from_json("value", "path string, document string").alias("f")).select("f.*")
    groups, sites = parse_site_files(held)
    stored = read(spark, d, "part").where("p_partkey % 50 = 0").select(F.concat(F.lit("site-"), (F.col("p_partkey") % 900).cast("string")).alias("slug"))
    return import_site_rows(groups, sites, spark.createDataFrame([("g0",)], "slug string"), stored)


SITE_FILES = """
WITH f AS (SELECT p_partkey AS k, p_partkey % 8 AS e, p_size % 9 AS g, p_size, 'site-' || CAST(p_partkey % 900 AS STRING) AS slug FROM part),
stored AS (SELECT DISTINCT 'site-' || CAST(p_partkey % 900 AS STRING) AS slug FROM part WHERE p_partkey % 50 = 0)"""


@query("src13_site_files", SITE_FILES + """
SELECT slug, 'Site ' || CAST(min(k) AS STRING) AS name, 'https://s' || CAST(min(k) AS STRING) || '.example/' AS base_url, 'g' || CAST(arg_min(g, k) AS STRING) AS tagset_group, false AS enabled, false AS render_js,
 CAST(60 + arg_min(p_size, k) AS INT) AS crawl_interval_sec, '{"n":' || CAST(min(k) AS STRING) || '}' AS config FROM f WHERE e = 0 AND slug NOT IN (SELECT slug FROM stored) GROUP BY slug""")
def import_site_files(spark, d):
    return site_files(spark, d)[1].drop("discovery_mode")


@query("src13_refused_site_files", SITE_FILES + """
SELECT lpad(CAST(k AS STRING), 12, '0') AS path, 0 AS position, CASE WHEN e < 6 THEN slug END AS slug, CASE e WHEN 1 THEN 'base_url' WHEN 2 THEN 'discovery_mode' WHEN 3 THEN 'tagset_group' WHEN 4 THEN 'flag' WHEN 5 THEN 'crawl_interval_sec' WHEN 6 THEN 'unreadable' ELSE 'not_a_list' END AS error
FROM f, range(2) r(n) WHERE e BETWEEN 1 AND 7 AND (n = 0 OR e >= 6)""")
def refused_site_files(spark, d):
    return site_files(spark, d)[2]
