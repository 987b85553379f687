"""Content hashes of multisets, publication of missing hashes, and the status fold of events."""

from __future__ import annotations

import itertools
from types import SimpleNamespace

from pressloom.operators import store as S
from pressloom.operators.events import _Event


def hashed(spark, rows, shape="a int, s struct<y:int,x:string>"):
    return S.content_hash(spark.createDataFrame(rows, shape), "a", "s").first().content_hash


def test_equal_rows_count_in_a_content_hash(spark):
    one, two, seven = ((i, (i, "x")) for i in (1, 2, 7))
    sets = [[one, one, seven], [two, two, seven], [seven], [one, seven], [one, one, one, seven], []]
    assert len({hashed(spark, rows) for rows in sets}) == len(sets)
    assert hashed(spark, [one, two, seven]) == hashed(spark, [seven, one, two])
    # nested keys come in order of name, whatever their order in the schema
    assert hashed(spark, [(1, (5, "q"))]) == hashed(spark, [(1, ("q", 5))], "a int, s struct<x:string,y:int>")


def test_missing_hashes_are_the_same_content(spark):
    offers = spark.createDataFrame([("a", 1, None), ("a", 2, None), ("a", 3, "x"), ("a", 4, "x"), ("a", 5, None), ("b", 1, "x")], "stream string, slot int, hash string")
    got = sorted((r.stream, r.slot, r.version, r.supersedes) for r in S.publish(offers).collect())
    assert got == [("a", 1, 1, None), ("a", 3, 2, 1), ("a", 5, 3, 3), ("b", 1, 1, None)]


def shown_by_rule(members):
    """Summary and status after each member in turn, as the rule states it."""
    (status, size, voice), *rest = members
    for s, n, v in rest:
        if (status, s) == ("complete", "pending"):
            pass
        elif (status, s) == ("pending", "complete") or n > size:
            size, voice = n, v
        status = "complete" if "complete" in (status, s) else "pending" if "pending" in (status, s) else None
    return voice, status


def test_the_status_fold_is_apart_from_the_summary(spark):
    for states in itertools.product([None, "pending", "complete"], repeat=3):
        for sizes in itertools.permutations([1, 2, 3]):
            members = [(s, n, i) for i, (s, n) in enumerate(zip(states, sizes, strict=True))]
            rows = [SimpleNamespace(ord=i, event_url="u", title_tokens=["t"], title_text="t", primary_category="ai", at=0, categories=["ai"], summary_size=n, summary_status=s, summary_text="", summary_tokens=[]) for s, n, i in members]
            event = _Event(rows[0])
            for r in rows[1:]:
                event.add(r)
            assert (event.voice, event.state) == shown_by_rule(members), members
