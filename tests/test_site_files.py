"""Site configuration files: whole texts, errors by file and row, first rows kept."""

import json

from inkstream.sources import site_files as S

SITE = {"slug": "a", "name": "A", "base_url": "https://a.example/", "discovery_mode": "rss", "tagset_group": "g"}


def test_files_are_read_whole_and_errors_stay_apart(spark, tmp_path):
    group = {"slug": "g", "name": "G"}
    files = {
        "1.json": {"tagset_groups": [group], "sites": [SITE, {**SITE, "slug": "b", "enabled": False, "config": {"feed_url": "https://a.example/f", "deep": {"x": [1, None]}}}]},
        "2.json": {"tagset_groups": [{"slug": "g", "name": "other"}, {"slug": "G!", "name": "x"}, {"slug": "h", "name": "H", "build_mode": "magic"}], "sites": [{**SITE, "name": "second"}, {**SITE, "slug": "c", "tagset_group": "h"}, "text", {**SITE, "slug": "d", "config": []}]},
        "3.json": "[1, 2]", "4.json": " \n", "5.json": {"sites": [{**SITE, "slug": "old"}, {**SITE, "slug": "e", "crawl_interval_sec": "60"}, {**SITE, "slug": None}]}, "6.json": {},
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text if isinstance(text, str) else json.dumps(text, indent=1))
    groups, sites = S.parse_site_files(S.read_site_files(spark, str(tmp_path)))
    stored = spark.createDataFrame([("old",)], "slug string")
    new_groups, new_sites, refused = S.import_sites(groups, sites, stored.limit(0), stored)
    assert {(r.slug, r.name, r.build_mode) for r in new_groups.collect()} == {("g", "G", "llm")}
    got = {r.slug: r for r in new_sites.collect()}
    assert set(got) == {"a", "b"} and got["a"].name == "A" and got["a"].enabled and got["a"].crawl_interval_sec == 1800 and got["a"].config == "{}"
    assert not got["b"].enabled and json.loads(got["b"].config) == {"feed_url": "https://a.example/f", "deep": {"x": [1, None]}}
    errors = sorted((r.path.rsplit("/", 1)[1], r.slug or "", r.error) for r in refused.collect())
    assert errors == sorted([
        ("2.json", "G!", "slug"), ("2.json", "h", "build_mode"), ("2.json", "c", "tagset_group"), ("2.json", "", "not_an_object"), ("2.json", "d", "config"), ("3.json", "", "unreadable"), ("3.json", "", "unreadable"),
        ("4.json", "", "unreadable"), ("4.json", "", "unreadable"), ("5.json", "e", "crawl_interval_sec"), ("5.json", "", "slug"),
    ])


def test_nothing_to_import(spark):
    groups, sites = S.parse_site_files(spark.createDataFrame([], "path string, document string"))
    stored = spark.createDataFrame([], "slug string")
    assert [df.collect() for df in S.import_sites(groups, sites, stored, stored)] == [[], [], []]
