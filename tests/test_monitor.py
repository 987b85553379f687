"""The acceptance monitor against its rule written out slot by slot."""

from __future__ import annotations

import random

import pytest
from pressloom.operators import monitor as M


def by_hand(symbols: list[int], plan: M.Plan) -> list[tuple]:
    phase, wait, attempt, baseline, burn, soak, audited, passed = "seeking_baseline", 0, 1, None, 0, 0, 0, 0
    out = []
    for slot, s in enumerate(symbols, 100):
        due = phase not in ("passed", "needs_review") and wait == 0
        ok = s in (M.PASS, M.STOP_PASS)
        if due:
            audited, passed = audited + 1, passed + ok
            if s in (M.STOP_PASS, M.STOP_FAIL):
                phase = "needs_review"
            elif ok and phase == "seeking_baseline":
                phase, baseline, burn = "burn_in", slot, 0
            elif ok and phase == "burn_in":
                burn += 1
                if burn >= plan.burn_in:
                    phase, soak, wait = "soak", 0, plan.day - 1
            elif ok:
                soak += 1
                phase, wait = ("passed", 0) if soak >= plan.soak else ("soak", plan.day - 1)
            elif phase == "soak":
                attempt, soak, wait = attempt + 1, 0, plan.day - 1
            else:
                phase, attempt, baseline, burn = "seeking_baseline", attempt + 1, None, 0
        elif wait:
            wait -= 1
        over = phase == "needs_review"
        out.append((slot, due, phase, attempt, baseline, None if over else burn, None if over else soak, audited, passed))
    return out


@pytest.mark.parametrize("range_slots,fan", [(7, 2), (16, 3), (1000, 64)])
def test_states_are_those_of_the_rule(spark, range_slots, fan):
    plan, rnd = M.Plan(day=5, burn_in=3, soak=4), random.Random(range_slots)
    logs = {f"log{p}": [rnd.choices([M.PASS, M.FAIL, M.STOP_PASS, M.STOP_FAIL], [100 - p, p, p > 20, p > 30])[0] for _ in range(150)] for p in (1, 8, 25, 45)}
    for symbols in logs.values():
        symbols[0] = symbols[-1] = M.PASS
    # a slot without a row counts as failed
    rows = [(log, 100 + i, s) for log, symbols in logs.items() for i, s in enumerate(symbols) if s != M.FAIL]
    got = M.monitored(spark.createDataFrame(rows, "log string, slot long, symbol int"), plan, range_slots=range_slots, fan=fan).collect()
    for log, symbols in logs.items():
        assert [tuple(r)[1:] for r in sorted(r for r in got if r["log"] == log)] == by_hand(symbols, plan)
    assert M.monitored(spark.createDataFrame([], "log string, slot long, symbol int"), plan).count() == 0


def test_a_full_plan_passes_after_its_burn_in_and_soak(spark):
    plan = M.Plan()
    slots = 1 + plan.burn_in + plan.soak * plan.day
    rows = spark.range(slots).selectExpr("'a' AS log", "id AS slot", "0 AS symbol")
    states = {r.slot: r for r in M.monitored(rows, plan).where("slot IN (288, 289, 2304)").collect()}
    assert states[288].phase == "soak" and not states[289].audited
    assert (states[2304].phase, states[2304].soak_days_passed, states[2304].total_audited) == ("passed", 7, 289 + 7)
