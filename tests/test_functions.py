from datetime import datetime

from pyspark.sql import functions as F

from inkstream.functions import dates as D
from inkstream.functions import mime as N
from inkstream.functions import retry as R
from inkstream.functions import text as X
from inkstream.functions import urls as U
from inkstream.operators import filters as S
from inkstream.operators import matching as M


def test_canonical_urls(spark, values):
    rule = U.RewriteRule(r"content\.jsp", ("wbtreeid", "wbnewsid"), "/info/{wbtreeid}/{wbnewsid}.htm")
    canonical = U.canonical_url(U.CanonicalConfig(rules=(rule,), strip_params=frozenset({"urltype"})))
    got = values(
        [
            "https://News.Campus.EXAMPLE/content.jsp?urltype=x&wbnewsid=30031&wbtreeid=1331#top", "/a/?z=2&a=1#x", "https://[2606:4700:4700::1111]:443/a",
            "https://例子.测试/a", "bad\nurl", "x" * 4097, "", "https://user:pw@h.example:8443//b//c/?k=&k=2", "http://h:80/?q=a+b*~",
        ],
        canonical("v", F.lit("https://EXAMPLE.com")),
    )
    assert got == [
        "https://news.campus.example/info/1331/30031.htm", "https://example.com/a?a=1&z=2", "https://[2606:4700:4700::1111]/a",
        "https://xn--fsqu00a.xn--0zwm56d/a", None, None, None, "https://h.example:8443/b/c?k=&k=2", "http://h/?q=a+b%2A~",
    ]


def test_query_param_and_slug(values):
    assert values(["https://h/l?page=1&x=2&x=3#f"], U.set_query_param("v", F.lit("page"), F.lit("4"))) == ["https://h/l?page=4&x=3#f"]
    assert values(["https://www.News.campus.example/x", "nohost"], U.site_slug(F.col("v"))) == ["news-campus-example", "site"]


def test_dates(values):
    got = values(
        ["2026-07-21", "2026年7月21日", "2026/7/21", "发布时间：2026-07-21 10:00:00", "2026-07-21T10:00:00+08:00", "2026-07-21T10:00:00Z", "2026-7-1 9:05", "soon", ""],
        D.parse_flexible(F.col("v"), "Asia/Shanghai"),
    )
    midnight = datetime(2026, 7, 20, 16)
    assert got == [midnight, midnight, midnight, datetime(2026, 7, 21, 2), datetime(2026, 7, 21, 2), datetime(2026, 7, 21, 10), None, None, None]
    assert values(["Sun, 06 Nov 1994 08:49:37 GMT", "x"], D.parse_http_date(F.col("v"))) == [datetime(1994, 11, 6, 8, 49, 37), None]


def test_quiet_hours(spark):
    hours = [22, 23, 0, 6, 7, 12]
    rows = spark.createDataFrame([(h, datetime(2026, 1, 5, h)) for h in hours], "h int, t timestamp")
    wrap = {r.h: r.q for r in rows.select("h", D.in_quiet_hours(F.col("t"), F.lit("23:00-07:00"), "UTC").alias("q")).collect()}
    assert [wrap[h] for h in hours] == [False, True, True, True, False, False]
    never = rows.select(D.in_quiet_hours(F.col("t"), F.lit("00:00-00:00"), "UTC").alias("q")).collect()
    assert not any(r.q for r in never)
    wake = {r.h: r.w for r in rows.select("h", D.next_active_time(F.col("t"), F.lit("23:00-07:00"), "UTC").alias("w")).collect()}
    assert wake[23] == datetime(2026, 1, 6, 7) and wake[0] == datetime(2026, 1, 5, 7) and wake[12] == datetime(2026, 1, 5, 12)


def test_quiet_hours_over_clock_change(spark):
    # 2026-03-08 02:00 does not exist in New York; the quiet period ends at 07:00 local summer time.
    row = spark.createDataFrame([(datetime(2026, 3, 8, 4, 30),)], "t timestamp")
    wake = row.select(D.next_active_time(F.col("t"), F.lit("23:00-07:00"), "America/New_York").alias("w")).first().w
    assert wake == datetime(2026, 3, 8, 11)


def test_backoff(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 8, 30)], "n int")
    assert [r.d for r in rows.select(R.backoff_delay(F.col("n"), 5).alias("d")).collect()] == [5, 5, 10, 20, 640, 3600]
    jittered = rows.select(R.backoff_delay(F.col("n"), 5, jitter_seed=3).alias("d")).collect()
    assert all(2.5 <= r.d <= 3600 for r in jittered)


def test_fingerprints(spark, values):
    body = "这是一段用于测试的正文内容，包含足够多的文字来生成稳定的指纹。" * 5
    fps = values([body, body + "。", "", None], X.simhash64()("v"))
    assert (fps[0] ^ fps[1]).bit_count() <= 3 and fps[2] == 0 and fps[3] == 0
    assert values(["0" * 16, "f" * 16, "10", "zz"], X.fingerprint_from_hex(F.col("v"))) == [0, -1, 16, None]
    assert values(["1", "2"], X.fingerprint_hex(F.lit(-1).cast("bigint"))) == ["f" * 16] * 2
    two = spark.createDataFrame([(0x10, 0x20), (0, -1)], "a bigint, b bigint").select(X.hamming(F.col("a"), F.col("b")).alias("d")).collect()
    assert [r.d for r in two] == [2, 64]


def test_even_split_leaves_bit_unset():
    # Two tokens with complementary bits: no strict majority anywhere they differ.
    a, b = X._blake(b"a"), X._blake(b"b")
    both = int.from_bytes(a, "big") & int.from_bytes(b, "big")
    assert X._fingerprint("a b", X._blake) & ((1 << 64) - 1) == both


def test_truncation(values):
    assert values(["0123456789"], X.head_tail(F.col("v"), 5)) == ["01289"]
    suffix = X.TRUNCATION_SUFFIX
    # The tenth character of the second text starts a combining pair that may not be split.
    inputs = ["a" * 30, "b" * 7 + "e\u0301" * 10, "short", "c" * 7 + "\r\n" + "d" * 20]
    expected = ["a" * 8 + suffix, "b" * 7 + "e" + suffix, "short", "c" * 7 + suffix]
    assert values(inputs, X.truncate_unicode("v", F.lit(18))) == expected
    assert values(["e\u0301\u0301\u0301" * 9], X.truncate_unicode("v", F.lit(14))) == ["e" + suffix]
    assert values(["x" * 30], X.truncate_unicode("v", F.lit(4))) == [suffix[:4]]


def test_redaction(values):
    got = values(
        ["key sk-abcdefgh12 end", "Authorization: Basic xyz", "https://u:p@h/p", "https://h/?token=abc&x=1", "bearer abcdefghij"], X.redact(F.col("v"))
    )
    assert got == ["key *** end", "Authorization: ***", "https://***@h/p", "https://h/?token=***&x=1", "***"]


def test_files(spark, values):
    header = "attachment; filename=\"x.doc\"; filename*=UTF-8''%E9%99%84%E4%BB%B61%20%E7%94%B3%E6%8A%A5%E8%A1%A8.docx"
    assert values([header, None], N.filename_from_header("v", F.lit("f/b"))) == ["附件1 申报表.docx", "f_b"]
    import io
    import zipfile

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        archive.writestr("word/document.xml", "x")
    rows = spark.createDataFrame([(0, bytearray(buffer.getvalue())), (1, bytearray(b"PK\x03\x04bad")), (2, bytearray(b"%PDF-1.4"))], "i int, b binary")
    got = [r.m for r in rows.orderBy("i").select(N.sniff_mime(F.col("b")).alias("m")).collect()]
    assert got == ["application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/octet-stream", "application/pdf"]
    text = spark.createDataFrame([("text/html; charset=gbk", bytearray("你好".encode("gbk")))], "h string, b binary")
    assert text.select(N.decode_body("h", "b").alias("t")).first().t == "你好"


def test_site_rules(values):
    filters = [None, "", "[]", "[1]", '{"a":1}', "bad", "[2, 1]"]
    assert values(filters, M.site_allowed(F.col("v"), F.lit(1))) == [True, True, False, True, False, False, True]


def test_globs(values):
    assert values(["image/png", "text/html", "application/pdf"], S.mime_allowed(F.col("v"), ["image/*", "APPLICATION/p?f"])) == [True, False, True]
