"""What keeps the joins and folds from growing faster than their input."""

from __future__ import annotations

import random

from pressloom.operators import events as E
from pressloom.operators import graph as G
from pressloom.operators import network
from tests.test_rules import SCHEMA, article, fold_by_hand


def test_pairs_of_a_word_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(G, "HEAVY", 40)
    rng = random.Random(3)
    sets = {i: frozenset(f"w{rng.randrange(9)}" for _ in range(rng.randrange(1, 6))) for i in range(80)}
    sets = {i: t for t, i in {t: i for i, t in sets.items()}.items()}
    found = G.similar_sets(spark.createDataFrame([(i, list(t)) for i, t in sets.items()], "id long, t array<string>"), [("t", 80)])
    got = [tuple(sorted((r.a, r.b))) for r in found.collect()]
    assert sorted(got) == sorted({(i, j) for i, a in sets.items() for j, b in sets.items() if i < j and len(a & b) * 100 >= 80 * min(len(a), len(b))})


def test_equal_titles_over_other_texts_are_folded_apart(spark, monkeypatch):
    groups = []
    named = E._named
    monkeypatch.setattr(E, "_named", lambda rows, edges: groups.append(named(rows, edges)) or groups[-1])
    rows = [article(i, "market budget council river", " ".join(f"t{i}w{k}" for k in range(30))) for i in range(6)]
    got = {r.ord: r.cluster for r in E.clusters(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: i for i in range(6)}
    assert groups[-1].select("component").distinct().count() == 6  # one title made them one task before


def test_a_shown_summary_of_another_title_takes_a_row_from_outside(spark):
    own, late = " ".join(f"a{k}" for k in range(20)), " ".join(f"b{k}xx" for k in range(30))
    rows = [
        article(1, "market budget council river", own, "https://x.example/p"),
        article(2, "other words entirely", late, "https://x.example/p"),  # by URL; its longer summary is shown
        article(3, "market budget council river", late),  # like what is shown, not like any row
    ]
    got = {r.ord: (r.cluster, r.voice) for r in E.clusters(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == fold_by_hand(rows) == {1: (1, 2), 2: (1, 2), 3: (1, 2)}


def test_addresses_stay_in_their_rows(spark):
    rows = spark.range(2000).selectExpr("concat(id % 256, '.', id % 199, '.1.2') AS address")
    plan = network.matched(rows, network.networks(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "monotonically_increasing_id" not in plan
