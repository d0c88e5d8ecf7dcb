"""Date, text, file-name and message functions over the supplied tables."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates as D
from ..functions import message as G
from ..functions import mime as N
from ..functions import retry as R
from ..functions import text as X
from .bridge import EPOCH, cte, read, table
from .catalogue import query
from .reports import iso

EVENT_SECOND = "CAST(floor(epoch(ts)) AS BIGINT)"


def events(spark, d):
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return read(spark, d, "events").withColumn("at", F.timestamp_micros(micros))


@query("dt1_parse_flexible", """
SELECT event_id, CASE event_id % 8 WHEN 5 THEN NULL WHEN 4 THEN strftime(ts - INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:00+00:00') WHEN 6 THEN strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S+00:00')
 WHEN 7 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') WHEN 3 THEN strftime(ts - INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S+00:00') ELSE strftime(date_trunc('day', ts) - INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S+00:00') END AS published_at FROM events""")
def parse_flexible(spark, d):
    at, k = F.col("at"), F.col("event_id") % 8
    spelled = (
        F.when(k == 0, F.concat(F.lit("发布时间："), F.date_format(at, "yyyy年M月d日"))).when(k == 1, F.date_format(at, "yyyy/M/d"))
        .when(k == 2, F.concat(F.lit(" 日期: "), F.date_format(at, "yyyy-MM-dd"), F.lit(" 来源")))
        .when(k == 3, F.date_format(at, "yyyy-MM-dd HH:mm:ss")).when(k == 4, F.date_format(at, "yyyy-MM-dd HH:mm"))
        .when(k == 5, F.concat(F.date_format(at, "yyyy"), F.lit("-13-45"))).when(k == 6, F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
        .otherwise(F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    )
    return events(spark, d).select("event_id", D.to_iso(D.parse_flexible(spelled, "Asia/Shanghai")).alias("published_at"))


@query("dt2_dt11_retry_after", f"""
SELECT event_id, CASE event_id % 5 WHEN 0 THEN least(300, greatest(0, CAST(event_id % 700 AS DOUBLE))) WHEN 1 THEN NULL WHEN 2 THEN NULL
  WHEN 3 THEN least(300, greatest(0, CAST({EVENT_SECOND} - {EPOCH + 15 * 86400} AS DOUBLE))) ELSE 0 END AS wait FROM events""")
def retry_after(spark, d):
    k = F.col("event_id") % 5
    header = (
        F.when(k == 0, (F.col("event_id") % 700).cast("string")).when(k == 1, F.lit("soon")).when(k == 2, F.lit(None))
        .when(k == 3, F.date_format("at", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).otherwise(F.lit("-5"))
    )
    wait = R.retry_after_seconds(header, F.timestamp_seconds(F.lit(EPOCH + 15 * 86400)))
    return events(spark, d).select("event_id", wait.alias("wait"))


@query("dt3_local_time", "SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') AS shown FROM events")
def local_time(spark, d):
    return events(spark, d).select("event_id", D.format_local(F.col("at"), "Asia/Shanghai").alias("shown"))


@query("dt4_dt5_quiet_hours", cte("subscriptions") + """
, pairs AS (SELECT e.event_id, s.quiet_hours, ts + INTERVAL 8 HOUR AS lt FROM events e JOIN subscriptions s ON s.id = e.user_id WHERE s.quiet_hours IS NOT NULL),
bounds AS (SELECT *, CAST(substr(quiet_hours, 1, 2) AS INT) * 3600 + CAST(substr(quiet_hours, 4, 2) AS INT) * 60 AS lo, CAST(substr(quiet_hours, 7, 2) AS INT) * 3600 + CAST(substr(quiet_hours, 10, 2) AS INT) * 60 AS hi,
  CAST(floor(epoch(lt)) AS BIGINT) % 86400 AS sec FROM pairs),
q AS (SELECT *, CASE WHEN lo <= hi THEN sec >= lo AND sec < hi ELSE sec >= lo OR sec < hi END AS quiet FROM bounds)
SELECT event_id, quiet, CASE WHEN quiet THEN CAST(floor(epoch(lt)) AS BIGINT) - sec + hi + CASE WHEN hi <= sec THEN 86400 ELSE 0 END ELSE CAST(floor(epoch(lt)) AS BIGINT) END - 28800 AS wake_second FROM q""")
def quiet_hours(spark, d):
    subs = table(spark, d, "subscriptions").where("quiet_hours IS NOT NULL").select(F.col("id").alias("user_id"), "quiet_hours")
    joined = events(spark, d).join(subs, "user_id")
    at, spec = F.col("at"), F.col("quiet_hours")
    return joined.select(
        "event_id", D.in_quiet_hours(at, spec, "Asia/Shanghai").alias("quiet"), F.unix_timestamp(D.next_active_time(at, spec, "Asia/Shanghai")).alias("wake_second")
    )


@query("dt6_dt7_dt8_dt9_retry_delays", """
SELECT event_id, least(5 * pow(2, greatest(0, n - 1)), 3600)::DOUBLE AS backoff, CASE WHEN event_type = 'error' AND n < 9 THEN least(coalesce(w, 60 * pow(2, n - 1)), 86400)::DOUBLE END AS crawl_delay,
 CASE WHEN event_type <> 'view' THEN coalesce(w, least(30 * pow(2, greatest(0, n - 1)), 3600))::DOUBLE END AS delivery_delay, coalesce(w, 2 * pow(2, n - 1))::DOUBLE AS model_delay
FROM (SELECT *, CAST(event_id % 12 AS INT) AS n, CASE WHEN event_id % 7 = 0 THEN 90000.0 END AS w FROM events) x""")
def retry_delays(spark, d):
    n, w, kind = (F.col("event_id") % 12).cast("int"), F.when(F.col("event_id") % 7 == 0, 90000.0), F.col("event_type")
    return read(spark, d, "events").select(
        "event_id", R.backoff_delay(n, 5).alias("backoff"), R.crawl_retry_delay(n, kind == "error", w, 60, 9).alias("crawl_delay"),
        R.delivery_retry_delay(n, kind == "view", w, 30).alias("delivery_delay"), R.model_retry_delay(n, w, 2).alias("model_delay"),
    )


@query("dt10_page_dates", """
SELECT event_id, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS STRING) || ',' || CAST(date_diff('day', DATE '1970-01-01', CAST(date_trunc('month', ts) AS DATE)) AS STRING) AS days FROM events""")
def page_dates(spark, d):
    text = F.concat(F.lit("x "), F.date_format("at", "yyyy.M.d"), F.lit(" y 2024-02-31 z "), F.date_format("at", "yyyy年MM"), F.lit("月"))
    return events(spark, d).select("event_id", F.array_join(D.page_date_days(text).cast("array<string>"), ",").alias("days"))


@query("dt12_login_lockout", cte("users") + """
SELECT id, CASE WHEN failed_logins >= 5 THEN CASE least(failed_logins - 5, 3) WHEN 0 THEN 1 WHEN 1 THEN 5 WHEN 2 THEN 15 ELSE 60 END END AS minutes FROM users""")
def lockout(spark, d):
    return table(spark, d, "users").select("id", R.lockout_minutes(F.col("failed_logins")).alias("minutes"))


@query("str4_head_tail", "SELECT doc_id, CASE WHEN length(text) <= 301 THEN text ELSE substr(text, 1, 180) || right(text, 121) END AS cut FROM documents")
def head_tail(spark, d):
    return read(spark, d, "documents").select("doc_id", X.head_tail(F.col("text"), 301).alias("cut"))


@query("str5_truncate_unicode", """
SELECT doc_id, CASE WHEN length(text) <= 280 THEN text ELSE rtrim(substr(text, 1, 270), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)) || '…（全文见原文链接）' END AS cut FROM documents""")
def truncate(spark, d):
    return read(spark, d, "documents").select("doc_id", X.truncate_unicode("text", F.lit(280)).alias("cut"))


@query("str6_human_size", """
SELECT l_orderkey, l_linenumber, l_partkey, ' (' || regexp_replace(regexp_replace(printf('%.1f', CASE WHEN s < 1024 THEN s WHEN s < 1048576 THEN s / 1024 WHEN s < 1073741824 THEN s / 1048576 ELSE s / 1073741824 END), '0+$', ''), '[.]$', '') ||
 CASE WHEN s < 1024 THEN ' B' WHEN s < 1048576 THEN ' KB' WHEN s < 1073741824 THEN ' MB' ELSE ' GB' END || ')' AS shown FROM (SELECT *, CAST(pow(l_quantity, 1 + l_linenumber) AS BIGINT)::DOUBLE AS s FROM lineitem) x""")
def human_size(spark, d):
    size = F.pow("l_quantity", F.col("l_linenumber") + 1).cast("bigint")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", X.human_size(size).alias("shown"))


@query("str10_redact", r"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\bsk-[A-Za-z0-9_-]{8,}', '***', 'g'), '\bBearer\s+[A-Za-z0-9._-]{8,}', '***', 'gi'),
 '(://)[^:@/\s]+:[^@/\s]+(@)', '\1***\2', 'g'), '([?&](?:token|api_key|key|secret|password|signature|sig)=)[^&\s"'']+', '\1***', 'gi'), '\b(authorization|cookie|set-cookie):\s*[^\r\n]+', '\1: ***', 'gi') AS clean
FROM (SELECT doc_id, 'https://u' || CAST(doc_id AS STRING) || ':p4ss@h/p?token=' || CAST(doc_id AS STRING) || '&x=1 sk-abcdefgh' || CAST(doc_id AS STRING) || ' ' || text || chr(10) || 'Cookie: a=b' AS text FROM documents) d""")
def redact(spark, d):
    text = F.concat(F.lit("https://u"), F.col("doc_id").cast("string"), F.lit(":p4ss@h/p?token="), F.col("doc_id").cast("string"), F.lit("&x=1 sk-abcdefgh"), F.col("doc_id").cast("string"), F.lit(" "), "text", F.lit("\nCookie: a=b"))
    return read(spark, d, "documents").select("doc_id", X.redact(text).alias("clean"))


@query("str11_slugs_and_names", """
SELECT p_partkey, substr(trim(regexp_replace(lower(p_brand || ' / ' || p_name), '[^a-z0-9]+', '-', 'g'), '-'), 1, 63) AS slug, regexp_replace(lower(p_brand || ' / ' || p_name), '[^a-z0-9_]+', '', 'g') AS name_key FROM part""")
def slugs(spark, d):
    label = F.concat("p_brand", F.lit(" / "), "p_name")
    return read(spark, d, "part").select("p_partkey", X.normalize_slug(label).alias("slug"), X.name_key(label).alias("name_key"))


@query("str17_fingerprints", cte("notify_targets") + """
SELECT id, split_part(url_fingerprint, '://', 1) || '://…' || substr(sha256(url_fingerprint), 1, 6) AS shown, sha256(CAST(id AS STRING)) AS token_hash FROM notify_targets""")
def target_prints(spark, d):
    return table(spark, d, "notify_targets").select("id", X.target_fingerprint(F.col("url_fingerprint")).alias("shown"), X.token_hash(F.col("id").cast("string")).alias("token_hash"))


@query("str18_charset_pattern", """
SELECT page_id, lower(regexp_extract(substr(html, 1, 4096), 'charset\\s*=\\s*["'']?\\s*([a-z0-9._-]+)', 1, 'i')) AS charset FROM pages""")
def charset(spark, d):
    pages = read(spark, d, "pages")
    return pages.select("page_id", F.lower(F.regexp_extract(F.substring("html", 1, 4096), r"(?i)charset\s*=\s*[\"']?\s*([a-z0-9._-]+)", 1)).alias("charset"))


@query("src9_detect_encoding", """
SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'gb18030' WHEN 2 THEN 'utf-8-sig' WHEN 3 THEN 'latin-1' ELSE 'utf-8' END AS encoding, CASE page_id % 5 WHEN 2 THEN html ELSE regexp_replace(html, '[^\x00-\x7f]', '?', 'g') END AS decoded FROM pages""")
def encoding(spark, d):
    k = F.col("page_id") % 5
    header = F.when(k == 1, "text/html; charset=GB2312").when(k == 3, 'text/html; charset="latin-1"').when(k == 4, "text/html; charset=unknown-8").otherwise(F.lit(None))
    marked = F.concat(F.unhex(F.lit("EFBBBF")), F.encode("html", "UTF-8"))
    body = F.when(k == 2, marked).otherwise(F.encode(F.regexp_replace("html", "[^\\x00-\\x7f]", "?"), "UTF-8"))
    rows = read(spark, d, "pages").select("page_id", header.alias("h"), body.alias("b"))
    return rows.select("page_id", N.detect_encoding("h", "b").alias("encoding"), N.decode_body("h", "b").alias("decoded"))


@query("str7_sanitize_filename", """
SELECT page_id, trim(regexp_replace('..' || regexp_extract(url, '/([^/]*)$', 1) || '/\\x' || chr(9) || 'y. ', '[\\x00-\\x1f\\x7f/\\\\]+', '_', 'g'), ' .') AS name FROM pages""")
def safe_names(spark, d):
    raw = F.concat(F.lit(".."), F.regexp_extract("url", "/([^/]*)$", 1), F.lit("/\\x\ty. "))
    return read(spark, d, "pages").select("page_id", N.sanitize_filename(raw).alias("name"))


@query("str8_content_disposition", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '附件 ' || p_name || '.docx' WHEN 1 THEN p_name || '.pdf' WHEN 2 THEN 'fallback' ELSE '附件.pdf' END AS name FROM part""")
def content_disposition(spark, d):
    k = F.col("p_partkey") % 4
    encoded = F.replace("p_name", F.lit(" "), F.lit("%20"))
    header = (
        F.when(k == 0, F.concat(F.lit("attachment; filename=\"old.doc\"; filename*=UTF-8''%E9%99%84%E4%BB%B6%20"), encoded, F.lit(".docx")))
        .when(k == 1, F.concat(F.lit('attachment; filename="'), "p_name", F.lit('.pdf"'))).when(k == 3, F.lit('inline; filename="%E9%99%84%E4%BB%B6.pdf"'))
    )
    return read(spark, d, "part").select("p_partkey", N.filename_from_header(header, F.lit("fallback")).alias("name"))


@query("str9_sniff_mime", """
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/jpeg' WHEN 3 THEN 'application/gzip' ELSE 'application/octet-stream' END AS mime FROM part""")
def sniff(spark, d):
    magic = F.expr("CASE p_partkey % 6 WHEN 0 THEN '255044462D312E' WHEN 1 THEN '89504E470D0A1A0A' WHEN 2 THEN 'FFD8FFE0' WHEN 3 THEN '1F8B08' WHEN 4 THEN '504B0304' ELSE '00' END")
    return read(spark, d, "part").select("p_partkey", N.sniff_mime(F.concat(F.unhex(magic), F.encode("p_name", "UTF-8"))).alias("mime"))


@F.pandas_udf(T.BinaryType())
def container(folders: pd.Series, notes: pd.Series) -> pd.Series:
    """A ZIP file with one entry in each of the named folders (comma-separated) and a note beside them."""

    def pack(names: str, note: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("note.txt", note)
            for name in names.split(","):
                archive.writestr(f"{name}/part.xml", note)
        return out.getvalue()

    return pd.Series([pack(names, note) for names, note in zip(folders, notes)], dtype=object)


OFFICE = "application/vnd.openxmlformats-officedocument."


@query("str9_office_containers", f"""
SELECT p_partkey, CASE WHEN p_partkey % 7 = 6 THEN 'application/octet-stream' ELSE CASE p_partkey % 7 WHEN 0 THEN '{OFFICE}wordprocessingml.document' WHEN 1 THEN '{OFFICE}spreadsheetml.sheet'
 WHEN 2 THEN '{OFFICE}presentationml.presentation' WHEN 3 THEN '{OFFICE}wordprocessingml.document' ELSE 'application/zip' END END AS mime FROM part""")
def office_containers(spark, d):
    """Real containers: documents, sheets, slides, one with several such folders, other folders, and torn files."""
    k = F.col("p_partkey") % 7
    folders = F.when(k == 0, "word").when(k == 1, "xl").when(k == 2, "docProps,ppt").when(k == 3, "xl,word").otherwise("data,wordy")
    rows = read(spark, d, "part").select("p_partkey", container(folders, F.col("p_name")).alias("content"))
    content = F.when(F.col("p_partkey") % 7 == 6, F.substring("content", 1, 40)).otherwise(F.col("content"))
    return rows.select("p_partkey", content.alias("content")).select("p_partkey", N.sniff_mime(F.col("content")).alias("mime"))


DATE = "coalesce(strftime(a.published_at + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M'), '未知时间')"
GIVEN_SUMMARY = "trim(a.summary, ' ' || chr(9) || chr(10) || chr(13) || chr(160))"


def plain_body(bold: str, rule: str) -> str:
    """The message in SQL, with marks around headings and a rule between sections."""
    return f"""'{bold}标签{bold}：' || coalesce(g.tags, '无') || chr(10) || '{bold}来源{bold}：' || s.name || ' · ' || {DATE} || chr(10) || '{bold}原文{bold}：' || a.url ||
 CASE WHEN trim(coalesce(a.summary, '')) <> '' THEN {rule} || '{bold}AI 总结{bold}：' || chr(10) || {GIVEN_SUMMARY} ELSE '' END || {rule} || '附件（1）：' || chr(10) || '- f.pdf (2 KB)' || {rule} || a.content_text"""


def quoted(value: str) -> str:
    for plain, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        value = f"replace({value}, '{plain}', '{written}')"
    return value


HTML_BODY = f"""'<b>标签</b>：' || {quoted("coalesce(g.tags, '无')")} || '<br><b>来源</b>：' || {quoted("s.name")} || ' · ' || {DATE} || '<br><b>原文</b>：<a href="' || {quoted("a.url")} || '">' || {quoted("a.url")} || '</a>' ||
 CASE WHEN trim(coalesce(a.summary, '')) <> '' THEN '<hr><b>AI 总结</b>：<br>' || replace({quoted(GIVEN_SUMMARY)}, chr(10), '<br>') ELSE '' END || '<hr>附件（1）：<br>- f.pdf (2 KB)<hr><pre>' || {quoted("a.content_text")} || '</pre>'"""


def message_sql(body: str) -> str:
    return cte("articles", "sites", "article_tags") + f"""
, g AS (SELECT article_id, string_agg('tag-' || CAST(tag_id AS STRING) || ' (0.' || lpad(CAST(conf_pct AS STRING), 2, '0') || ')', ' · ' ORDER BY conf_pct DESC, tag_id) AS tags FROM article_tags GROUP BY article_id),
m AS (SELECT a.id, '[' || s.name || '] ' || CASE WHEN a.title = '' THEN '无标题' ELSE a.title END AS title, {body} AS body FROM articles a JOIN sites s ON s.id = a.site_id LEFT JOIN g ON g.article_id = a.id)
SELECT id, title, md5(CASE WHEN length(body) <= 2000 THEN body ELSE rtrim(substr(body, 1, 1990), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)) || '…（全文见原文链接）' END) AS body_md5 FROM m"""


def messages(spark, d, body_format):
    tags = table(spark, d, "article_tags").groupBy("article_id").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("conf_pct")).alias("o"), "tag_id", F.concat(F.lit("tag-"), F.col("tag_id").cast("string")).alias("name"), (F.col("conf_pct") / 100).alias("confidence")))).alias("tags")
    )
    sites = table(spark, d, "sites").select(F.col("id").alias("site_id"), F.col("name").alias("site_name"))
    rows = table(spark, d, "articles").join(sites, "site_id").join(tags.withColumnRenamed("article_id", "id"), "id", "left")
    none = F.array().cast("array<struct<name:string,confidence:double>>")
    files = F.array(F.struct(F.lit("f.pdf").alias("filename"), F.lit(2048).cast("bigint").alias("size_bytes"), F.lit(None).cast("string").alias("url")))
    body = G.message_body(
        site_name=F.col("site_name"), url=F.col("url"), published_at=F.col("published_at"),
        tags=F.coalesce(F.transform("tags", lambda t: F.struct(t["name"].alias("name"), t["confidence"].alias("confidence"))), none),
        content=F.col("content_text"), summary=F.col("summary"), attachments=files, body_format=body_format, tz="Asia/Shanghai",
    )
    found = rows.select("id", G.message_title(F.col("site_name"), F.col("title")).alias("title"), body.alias("body"))
    return G.cut_to_limit(found, F.lit(2000)).select("id", "title", F.md5("body").alias("body_md5"))


@query("str16_message_markdown", message_sql(plain_body("**", "chr(10) || chr(10) || '---' || chr(10)")))
def message_markdown(spark, d):
    return messages(spark, d, "markdown")


@query("str16_message_text", message_sql(plain_body("", "chr(10) || chr(10)")))
def message_text(spark, d):
    return messages(spark, d, "text")


@query("str16_message_html", message_sql(HTML_BODY))
def message_html(spark, d):
    return messages(spark, d, "html")


@query("ded5_ded10_array_rules", """
WITH w AS (SELECT doc_id, string_split(text, ' ') AS words FROM documents),
first AS (SELECT doc_id, words, list_filter(words, lambda x, i: list_position(words, x) = i) AS distinct_words FROM w)
SELECT doc_id, md5(array_to_string(distinct_words, ' ')) AS distinct_md5, list_has_all(words, ['the', 'of']) AS has_both, list_has_any(words, ['the', 'of']) AS has_any FROM first""")
def array_rules(spark, d):
    from ..operators.matching import set_matches

    words = read(spark, d, "documents").select("doc_id", F.split("text", " ").alias("w"))
    wanted = F.array(F.lit("the"), F.lit("of"))
    return words.select(
        "doc_id", F.md5(F.array_join(F.array_distinct("w"), " ")).alias("distinct_md5"),
        set_matches(F.lit("all"), wanted, F.col("w")).alias("has_both"), set_matches(F.lit("any"), wanted, F.col("w")).alias("has_any"),
    )
