"""Merge rounds and versioned tag sets: rules of every level, every crash point."""

import pandas as pd
import pytest

from inkstream.operators import induction as I
from inkstream.plans.bootstrap import Crash, merge_by_remainder
from inkstream.sources import versions as V

SCHEMA = "position bigint, slug string, name string, description string, keywords array<string>, titles array<string>"


def tables(spark, count, names=None):
    rows = [(i, f"s{i}", names(i) if names else f"Name {i}", "d", [f"k{i}"], [f"t{i}"]) for i in range(count)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(f"s{i}", a) for i in range(count) for a in (i, i + 1)], "slug string, article_id bigint")


def plain_rounds(count, most):
    tags, levels = {i: {i, i + 1} for i in range(count)}, 0
    while True:
        order, merged = sorted(tags), {}
        for at in range(0, len(order), 4 * most):
            same = {}
            for i in order[at : at + 4 * most]:
                same.setdefault(i % 5, []).append(i)
            merged.update((min(group), set().union(*(tags[i] for i in group))) for group in same.values())
        levels, last = levels + 1, len(order) <= 4 * most
        tags = merged
        if last:
            return {f"s{i}": len(a) for i, a in tags.items()}, levels


@pytest.mark.parametrize("count", [3, 20, 21, 130])
def test_rounds_equal_plain_merging(spark, count):
    tags, members, levels = I.merge_rounds(*tables(spark, count), merge_by_remainder, max_tags=5)
    assert ({r.slug: r.coverage for r in tags.collect()}, levels) == plain_rounds(count, 5)
    assert members.count() == members.distinct().count() == sum(r.coverage for r in tags.collect())


def test_duplicates_fold_before_and_between_levels(spark):
    tags, _, levels = I.merge_rounds(*tables(spark, 40, lambda i: f"Topic {i % 3}"), merge_by_remainder, max_tags=5)
    assert levels == 1 and {r.slug: r.coverage for r in tags.collect()} == {"s0": 28, "s1": 26, "s2": 26}


@pytest.mark.parametrize("change, message", [
    (lambda f: f.assign(sources=[["s99999"]] * len(f)), "outside of its chunk"), (lambda f: f.assign(sources=[["s0"]] * len(f)), "twice"),
    (lambda f: pd.concat([f, f.assign(slug=f["slug"] + "x", sources=[[]] * len(f))]), "too many"), (lambda f: f.iloc[:0], "too few"),
])
def test_rules_of_a_merge(spark, change, message):
    with pytest.raises(ValueError, match=message):
        I.merge_rounds(*tables(spark, 10), lambda rows: change(merge_by_remainder(rows)), max_tags=5)


def test_no_candidates(spark):
    tags, members, levels = I.merge_rounds(*(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "slug string, article_id bigint")), merge_by_remainder, max_tags=5)
    assert tags.collect() == [] and members.collect() == [] and levels == 0


@pytest.mark.parametrize("step, version, states", [
    ("data", "v1", {"v1": "current"}), ("staged", "v1", {"v1": "current", "v2": "discarded"}), ("group", "v2", {"v1": "current", "v2": "current"}), ("current", "v2", {"v1": "current", "v2": "current"}),
])
def test_recovery_from_every_crash_point(spark, tmp_path, step, version, states):
    group, record = "g", {}

    def crash(at):
        if at == step:
            raise Crash(at)

    one, two = (spark.createDataFrame([(i,)], "id bigint") for i in (1, 2))
    store = V.Versions(spark, str(tmp_path))
    put = lambda v: record.__setitem__(group, v)
    assert V.bootstrap(store, one, group, "v1", min_tags=1, review=False, update_group=put) == "frozen"
    with pytest.raises(Crash):
        V.bootstrap(V.Versions(spark, str(tmp_path), crash), two, group, "v2", min_tags=1, review=False, update_group=put)
    assert {r.id for r in store.read(group).collect()} == ({2} if step == "current" else {1})
    for _ in range(2):
        store.recover(group, record[group])
        assert store.current_version(group) == version == record[group]
        assert {r.version: r.state for r in store.states().collect()} == states
    assert {r.id for r in store.read(group).collect()} == {int(version[1])}
    assert (tmp_path / "data" / group / "v2").exists() == (step != "data")
    if step == "data":
        assert V.bootstrap(store, two, group, "v2", min_tags=1, review=False, update_group=put) == "frozen"


def test_review_gate(spark, tmp_path):
    store, tags, groups = V.Versions(spark, str(tmp_path)), spark.createDataFrame([(1,)], "id bigint"), []
    assert store.current_version("g") is None and store.read("g") is None and store.recover("g", None) == {}
    assert V.bootstrap(store, tags, "g", "v1", min_tags=2, review=True, update_group=groups.append) == "rejected"
    assert V.bootstrap(store, tags, "g", "v1", min_tags=1, review=True, update_group=groups.append) == "draft"
    assert groups == [] and store.current_version("g") is None and store.recover("g", None) == {}
    assert V.publish(store, "g", "v1", update_group=groups.append) == "frozen" and groups == ["v1"] and store.current_version("g") == "v1"
    with pytest.raises(ValueError, match="exists"):
        V.bootstrap(store, tags, "g", "v1", min_tags=1, review=True, update_group=groups.append)
    V.bootstrap(store, tags, "g", "v2", min_tags=1, review=True, update_group=groups.append)
    store.reject("g", "v2")
    with pytest.raises(ValueError, match="discarded"):
        V.publish(store, "g", "v2", update_group=groups.append)
    assert store.current_version("g") == "v1"
