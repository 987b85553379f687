"""Slot budgets against the greedy rule over all sources, ranks, even samples and probes by hand."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pressloom import config as C
from pressloom.operators import coverage as V
from pressloom.operators import probing as P
from pyspark.sql import functions as F

SHAPE = "registry int, source_id string, region string, media_type string, weight double, beats array<string>, approved boolean, due_at timestamp, accepted_rate double, consecutive_failures int, last_error string"
NOON = dt.datetime(2024, 1, 1, 12)


def by_rule(rows, most):
    """All sources of one registry, chosen one after the other."""
    role = C.MEDIA_ROLE_SCORE
    half_up = lambda x: int(x + 0.5)
    able = [r for r in rows if r[6] and (r[7] is None or r[7] <= NOON)]

    def fair(pool, limit):
        out, beats, regions = [], dict.fromkeys(C.CATEGORIES, 0), set()
        while len(out) < min(limit, len(pool)):
            left = [r for r in pool if r not in out]
            due = min((r[7] or dt.datetime.min for r in left))
            def score(r):
                opened = sum({0: 60, 1: 30}[beats[b]] + 10 - C.CATEGORIES.index(b) for b in r[5] if beats[b] < 2)
                return opened + (0 if r[2] in regions else 18) + role[r[3]] + half_up(r[4] * 10) + half_up((0.5 if r[8] is None else r[8]) * 20) - min(60, (r[9] or 0) * 15)
            best = sorted((r for r in left if (r[7] or dt.datetime.min) == due), key=lambda r: (-score(r), r[1]))[0]
            out.append(best)
            regions.add(best[2])
            for b in best[5]:
                beats[b] += 1
        return out

    retry = [r for r in able if (r[9] or 0) > 0 or r[10]]
    plain = [r for r in able if r not in retry]
    normal = fair(plain, min(9, max(0, most - min(2, len(retry), most))))
    again = fair(retry, min(2, max(0, most - len(normal))))
    fill = fair([r for r in able if r not in normal and r not in again], most - len(normal) - len(again))
    return [("normal", r[1]) for r in normal] + [("backfill", r[1]) for r in fill] + [("retry", r[1]) for r in again]


@pytest.mark.parametrize("most", [11, 4, 1])
def test_budgets_are_those_of_the_rule(spark, most):
    rnd = random.Random(most)
    rows = []
    for registry, n in enumerate([150, 40, 8, 3, 1]):
        for i in range(n):
            due = rnd.choice([None, *[NOON + dt.timedelta(hours=h) for h in (-3, -2, -1, 1)]])
            rows.append((registry, f"s{i}", rnd.choice(["us", "eu", "cn"]), rnd.choice(list(C.MEDIA_ROLE_SCORE)), rnd.choice([1.0, 1.5, 2.0]), rnd.sample(C.CATEGORIES, rnd.choice([1, 2])), rnd.random() < 0.9, due, rnd.choice([None, 0.0, 0.25, 1.0]), rnd.choice([None, 0, 0, 0, 2]) if registry else 0, rnd.choice([None, "", None, "timeout"]) if registry == 1 else None))
    got = V.slot_budget(spark.createDataFrame(rows, SHAPE), F.lit(NOON), most).collect()
    for registry in range(5):
        assert [(r.pool, r.source_id) for r in sorted((r for r in got if r.registry == registry), key=lambda r: r.position)] == by_rule([r for r in rows if r[0] == registry], most)
    assert V.slot_budget(spark.createDataFrame([], SHAPE), F.lit(NOON)).count() == 0


def test_beats_follow_open_ones(spark):
    base = ("us", "public", 1.0)
    rows = [(1, s, *base, b, ok, None, None, 0, None) for s, b, ok in (("a", ["ai"], True), ("b", ["china"], True), ("c", ["china"], True), ("d", ["china", "ai"], True), ("e", ["policy"], False))]
    got = V.slot_budget(spark.createDataFrame(rows, SHAPE), F.lit(NOON)).orderBy("position").collect()
    assert [r.source_id for r in got] == ["d", "b", "a", "c"]


def test_ranks_cross_the_borders_of_ranges(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice(["hot", "hot", "hot", "b", None]), i, rnd.random()) for i in range(500)]
    got = P.ranked(spark.createDataFrame(rows, "k string, i int, x double"), "k", [F.desc("x"), F.col("i")]).collect()
    for key in ("hot", "b", None):
        order = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[2], r[1]))
        mine = sorted((r for r in got if r.k == key), key=lambda r: r["rank"])
        assert [(r.i, r["rank"], r.total) for r in mine] == [(r[1], n, len(order)) for n, r in enumerate(order)]


def spread(values, limit):
    if len(values) <= limit:
        return values
    return values[:1] if limit <= 1 else [values[int(j * (len(values) - 1) / (limit - 1) + 0.5)] for j in range(limit)]


def test_even_samples(spark):
    for n, limit in [(5, 5), (6, 5), (100, 7), (50, 49), (3, 1), (1, 10), (11, 2), (1000, 20)]:
        df = spark.range(n).selectExpr("'a' AS k", "id")
        assert sorted(r.id for r in P.even_sample(df, "k", [F.col("id")], limit).collect()) == spread(list(range(n)), limit)


def test_probes_by_quota(spark):
    rnd = random.Random(9)
    rows, want = [], set()
    for s in range(24):
        feed, n = s % 2 == 0, rnd.choice([0, 1, 5, 12, 30, 60])
        days = sorted((rnd.choice([None, 1, 2, 3]) if s % 3 else 1 for _ in range(n)), key=lambda d: (d is None, -(d or 0)))
        section = [(f"s{s}", i, d, feed, d is not None if s % 4 else d is not None and i % 2 == 0) for i, d in enumerate(days)]
        rows += section
        if feed:
            dated, undated = [c for c in section if c[4]], [c for c in section if not c[4]]
            chosen = dated[:4]
            chosen = chosen + spread(undated, min(len(undated), 10 - len(chosen)))
            chosen += [c for c in section if c not in chosen][: max(0, 10 - len(chosen))]
        elif n <= 10:
            chosen = section
        else:
            chosen = spread([c for c in section if c[2] == section[0][2]], min(10, sum(c[2] == section[0][2] for c in section)))
            chosen = chosen + [c for c in section if c not in chosen][: 10 - len(chosen)]
        want |= {(c[0], c[1]) for c in chosen}
    got = P.probes(spark.createDataFrame(rows, "section string, ord int, recency int, feed boolean, dated boolean"), 4, 10).collect()
    assert {(r.section, r.ord) for r in got} == want and len(got) == len(want)
