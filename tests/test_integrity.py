"""Report integrity: nothing on sound reports, every rule on a report damaged by hand, and the compact form and back."""

from __future__ import annotations

import datetime as dt

import pytest
from pressloom.operators import integrity as I
from pressloom.plans.integrity import sources_of, tables_of

NOON = dt.datetime(2024, 1, 2, 12)
SHAPES = {
    "reports": "report int, version int, generated_at timestamp, accepted int, source_count int, unmapped int", "items": "report int, item string",
    "stories": "report int, story string, item string, started_at timestamp, updated_at timestamp, digest string",
    "evidence": "report int, story string, candidate string, source string, url string, published_at timestamp",
    "lists": "report int, list string, pos int, story string, digest string", "sections": "report int, section string, story string",
}
SOUND = {
    "reports": [(1, 2, NOON, 3, 2, 0)], "items": [(1, "i1"), (1, "i2")],
    "stories": [(1, "s1", "i1", NOON, NOON, "A"), (1, "s2", "i2", NOON - dt.timedelta(hours=3), NOON - dt.timedelta(hours=2), "B")],
    "evidence": [(1, "s1", "c1", "a", "https://a.example/1", NOON), (1, "s1", "c2", "b", "https://www.b.example/2", None), (1, "s2", "c3", "a", "https://a.example/3", None)],
    "lists": [(1, "latest", 0, "s1", "A"), (1, "latest", 1, "s2", "B"), (1, "top", 0, "s2", "B")], "sections": [(1, "ai", "s1"), (1, "ai", "s2")],
}


def broken(spark, **damage):
    t = I.Tables(**{k: spark.createDataFrame(damage.get(k, v), SHAPES[k]) for k, v in SOUND.items()})
    sources = spark.createDataFrame([("a", "a.example"), ("b", "b.example")], "source string, host string")
    return sorted((r.rule, r.key) for r in I.violations(t, sources).collect())


def test_sound_reports_break_no_rule(spark, sf):
    assert broken(spark) == []
    assert I.violations(tables_of(spark, spark.read.parquet(f"{sf}/events.parquet"), False), sources_of(spark, False)).count() == 0


@pytest.mark.parametrize("damage,expected", [
    ({"reports": [(1, 1, None, 3, 2, None)]}, ["incomplete_latest_stories", "invalid_generated_at", "unmapped_candidates", "unsupported_schema_version"]),
    ({"reports": [(1, 2, NOON, 4, 0, 0)]}, ["candidate_mapping_count_mismatch", "empty_sources", "source_count_mismatch"]),
    ({"items": []}, ["empty_items", "invalid_story_item_reference", "invalid_story_item_reference", "unmapped_report_item"]),
    ({"items": [(1, "i1"), (1, "i2"), (1, "i2"), (1, None)]}, ["duplicate_or_missing_item_id", "duplicate_or_missing_item_id", "unmapped_report_item"]),
    ({"sections": [(1, "ai", "nobody")]}, ["dangling_section_reference"]),
    ({"lists": [(1, "latest", 0, "s1", "A"), (1, "latest", 1, "s2", "older"), (1, "top", 0, "gone", "G")]}, ["compact_round_trip_mismatch", "compact_round_trip_mismatch", "dangling_story_reference", "inconsistent_story_reference", "inconsistent_story_reference"]),
    ({"lists": [(1, "latest", 0, "s2", "B"), (1, "latest", 1, "s1", "A")]}, ["incomplete_latest_stories"]),
    ({"evidence": [(1, "s1", "c1", "x", "http://a.example/1", NOON + dt.timedelta(hours=1)), (1, "s2", "c1", "b", "https://a.example/3", None)]},
     ["candidate_mapping_count_mismatch", "duplicate_or_missing_candidate_mapping", "evidence_url_out_of_scope", "invalid_evidence_time_relation", "invalid_story_url", "unapproved_evidence_source"]),
    ({"evidence": [(1, "s1", c, s, u, None) for c, s, u in (("c1", "a", "https://a.example/1"), ("c2", "b", "https://b.example/2"), ("c3", "a", "https://a.example/3"))]}, ["missing_story_evidence"]),
])
def test_each_rule_is_told(spark, damage, expected):
    assert sorted(r for r, _ in broken(spark, **damage)) == expected


def test_lists_come_back_in_order_without_dangling_ids(spark):
    t = {k: spark.createDataFrame(v, SHAPES[k]) for k, v in replace_lists(SOUND, [(1, "top", 5, "s2", "B"), (1, "top", 2, "gone", "G"), (1, "top", 3, "s1", "A")]).items()}
    back = I.hydrated(I.compact(t["lists"]), t["stories"])
    assert [(r.story, r.digest) for r in back.orderBy("pos").collect()] == [("s1", "A"), ("s2", "B")]


def replace_lists(tables, lists):
    return {**tables, "lists": lists}
