"""Reports of either version: detection, expansion by position, back-fill of times."""

from __future__ import annotations

import datetime as dt
import json

from pressloom.operators import legacy as L

FULL = {"version": 2, "generatedAt": "2024-01-31T00:00:00Z", "stories": [], "topStories": [], "importantStories": [], "watchlist": [], "sections": [], "coverage": {}, "quality": {}}


def forms(spark, *values):
    texts = [v if isinstance(v, str) or v is None else json.dumps(v) for v in values]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    return L.versioned(df)


def test_versions_are_told_apart(spark):
    item = [{"id": "a"}]
    cases = [
        ({**FULL, "items": item}, "v2"), ({**FULL, "items": []}, "v2"), ({**FULL, "items": item, "version": 3}, "v1"), ({**FULL, "items": item, "version": "2"}, "v1"), ({**FULL, "items": item, "generatedAt": "soon"}, "v1"),
        ({k: v for k, v in {**FULL, "items": item}.items() if k != "quality"}, "v1"), ({**FULL, "items": item, "coverage": None}, "v1"), ({"items": item}, "v1"), ({"items": []}, "none"), ({"items": {"0": 1}}, "none"), ("[1]", "none"), ("{bad", "none"), (None, "none"), ("", "none"),
    ]
    got = [r.form for r in forms(spark, *[c for c, _ in cases]).orderBy("k").collect()]
    assert got == [f for _, f in cases]


def test_items_expand_by_position(spark):
    item = {"id": "b", "title": "B", "url": "u", "sourceId": "s0", "sourceName": "n0"}
    v = forms(spark, {"items": [{**item, "sourceIds": ["s1", "s2", "s1"], "relatedUrls": ["u1"], "sourceNames": []}, item, {**item, "sourceIds": []}]}, {"items": [{**item, "sourceIds": ["only"], "extra": {"x": [1]}}]}, "{bad")
    got = [(r.k, r.place, r["at"], r.id, r.url, r.source_id, r.source_name) for r in L.expanded_items(v, "k").orderBy("k", "place", "at").collect()]
    assert got == [
        (0, 0, 0, "b-evidence-1", "u1", "s1", "n0"), (0, 0, 1, "b-evidence-2", "u", "s2", "n0"), (0, 0, 2, "b-evidence-3", "u", "s1", "n0"),
        (0, 1, 0, "b", "u", "s0", "n0"), (0, 2, 0, "b", "u", "s0", "n0"), (1, 0, 0, "b", "u", "only", "n0"),
    ]


def test_both_versions_of_a_report_give_the_same_sources(spark):
    old = {"items": [{"id": "i1", "url": "u", "sourceId": "a", "sourceName": "A", "publishedAt": "2024-01-01T00:00:00Z"}]}
    new = {**FULL, "items": [{**old["items"][0]}], "stories": [{"id": "s", "itemId": "i1", "updatedAt": "2024-01-01T00:00:00Z", "evidence": []}]}
    v = forms(spark, old, new)
    first = [(r.id, r.url, r.source_id) for r in L.expanded_items(v, "k").collect()]
    second = [(r.id, r.url, r.source_id) for r in L.normalised_items(v, "k").collect()]
    assert first == second == [("i1", "u", "a")]


def test_times_are_filled_in(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    day = lambda d: f"2024-01-{d:02}T00:00:00Z"
    stories = [{"id": "s1", "itemId": "a", "updatedAt": day(9), "evidence": [{"publishedAt": day(5)}, {"publishedAt": "soon"}, {}]}, {"id": "s2", "itemId": "b", "updatedAt": day(9), "startedAt": day(2)}]
    items = [{"id": "a"}, {"id": "b", "updatedAt": day(8), "startedAt": day(1)}, {"id": "c", "publishedAt": day(3)}, {"id": "d", "extractedAt": day(4)}, {"id": "e"}]
    got = {r.id: (r.updated_at, r.started_at) for r in L.normalised_items(forms(spark, {**FULL, "stories": stories, "items": items}), "k").collect()}
    assert got == {"a": (t(9), t(5)), "b": (t(8), t(1)), "c": (t(3), t(3)), "d": (t(4), t(4)), "e": (None, None)}
