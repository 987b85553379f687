"""The acceptance monitor as an automaton over time slots, run as a parallel scan.

A log of slots is cut into ranges.  Each range becomes a transition function: for every state it
may be entered in, the state it is left in and what the counters gain.  Functions compose
associatively, so a tree of compositions with FAN children a node gives the state in which every
range starts; the slots inside a range follow from there.  No step sees a whole log, however long.

States: seeking a baseline; burn-in with its passed slots; soak with its passed days and the slots
still to wait, since in soak one slot a day is looked at; passed; needs review.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.operators.graph import durable

PASS, FAIL, STOP_PASS, STOP_FAIL = range(4)  # a stop is a passed deadline, or the wrong deployment
PHASES = ["seeking_baseline", "burn_in", "soak", "passed", "needs_review"]
KEPT, NONE = -1, -2  # of the baseline slot
COUNTERS = ("attempts", "audited", "passed")
RANGE_SLOTS, FAN = 1024, 64


@dataclass(frozen=True)
class Plan:
    """Slots a day, passed slots that end the burn-in, passed days that end the soak."""

    day: int = 288
    burn_in: int = 288
    soak: int = 7


@functools.lru_cache(maxsize=8)
def tables(plan: Plan) -> dict[str, np.ndarray]:
    """next, audited and attempts by (symbol, state); phase, burn_in and soak of every state."""
    soak_at = 1 + plan.burn_in
    n = soak_at + plan.soak * plan.day + 2
    done, review = n - 2, n - 1
    in_soak = lambda days, wait: soak_at + days * plan.day + wait
    nxt, audited, attempts = np.tile(np.arange(n), (4, 1)), np.zeros((4, n), bool), np.zeros((4, n), np.int64)
    phase, burn, soak = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    phase[1:soak_at], burn[1:soak_at] = 1, np.arange(plan.burn_in)
    phase[soak_at:done], soak[soak_at:done] = 2, np.repeat(np.arange(plan.soak), plan.day)
    burn[soak_at:done], phase[done], phase[review] = plan.burn_in, 3, 4
    burn[done], soak[done] = plan.burn_in, plan.soak
    for s in range(done):
        waits = s >= soak_at and (s - soak_at) % plan.day > 0
        if waits:
            nxt[:, s] = s - 1
            continue
        audited[:, s] = True
        nxt[STOP_PASS, s] = nxt[STOP_FAIL, s] = review
        attempts[FAIL, s] = 1
        if s == 0:
            nxt[PASS, s], nxt[FAIL, s] = 1, 0
        elif s < soak_at:
            nxt[PASS, s], nxt[FAIL, s] = (s + 1 if s < plan.burn_in else in_soak(0, plan.day - 1)), 0
        else:
            days = (s - soak_at) // plan.day
            nxt[PASS, s], nxt[FAIL, s] = (done if days + 1 >= plan.soak else in_soak(days + 1, plan.day - 1)), in_soak(0, plan.day - 1)
    return {"next": nxt, "audited": audited, "attempts": attempts, "phase": phase, "burn_in": burn, "soak": soak}


def _function(symbols: np.ndarray, first: int, t: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The transition function of a run of slots."""
    n = t["next"].shape[1]
    at, out = np.arange(n), {c: np.zeros(n, np.int64) for c in COUNTERS} | {"baseline": np.full(n, KEPT, np.int64)}
    for i, s in enumerate(symbols.tolist()):
        met = t["audited"][s][at]
        out["audited"] += met
        out["passed"] += met & (s in (PASS, STOP_PASS))
        out["attempts"] += t["attempts"][s][at]
        new = t["next"][s][at]
        out["baseline"] = np.where((at == 0) & (new == 1), first + i, np.where((s == FAIL) & met & (t["phase"][at] < 2), NONE, out["baseline"]))
        at = new
    return {"to": at, **out}


def _then(f: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """f, then g."""
    out = {c: f[c] + g[c][f["to"]] for c in COUNTERS}
    later = g["baseline"][f["to"]]
    return {"to": g["to"][f["to"]], **out, "baseline": np.where(later == KEPT, f["baseline"], later)}


FUNCTION = ["to", *COUNTERS, "baseline"]
FUNCTION_SCHEMA = ", ".join(f"{c} array<long>" for c in FUNCTION)
STATE_SCHEMA = ", ".join(f"s_{c} long" for c in FUNCTION)
START = {"to": 0, "attempts": 1, "audited": 0, "passed": 0, "baseline": NONE}


def _read(table: pa.Table, i: int) -> dict[str, np.ndarray]:
    return {c: np.asarray(table[c][i].values) for c in FUNCTION}


def _ranges(plan: Plan, deadline: int):
    """One row a range: its symbols and its function; a slot without a verdict failed, from the deadline on it stops."""

    def run(key: tuple, spans: pa.Table, verdicts: pa.Table) -> pa.Table:
        if not len(spans):
            return pa.table({"log": pa.array([], pa.string())})
        start, stop = spans["first"][0].as_py(), spans["stop"][0].as_py()
        symbols = np.where(np.arange(start, stop) < deadline, FAIL, STOP_FAIL).astype(np.uint8)
        if len(verdicts):
            symbols[verdicts["slot"].to_numpy() - start] = verdicts["symbol"].to_numpy()
        f = _function(symbols, start, tables(plan))
        row = {"log": [key[0].as_py()], "part": [key[1].as_py()], "first": [start], "symbols": [symbols.tobytes()]} | {c: [f[c].tolist()] for c in FUNCTION}
        return pa.table({k: pa.array(v, pa.binary() if k == "symbols" else None) for k, v in row.items()})

    return run


def _composed(key: tuple, table: pa.Table) -> pa.Table:
    table = table.sort_by("part")
    f = functools.reduce(_then, (_read(table, i) for i in range(len(table))))
    return pa.table({"log": [key[0].as_py()], "part": [key[1].as_py()]} | {c: [f[c].tolist()] for c in FUNCTION})


def _started(key: tuple, table: pa.Table, starts: pa.Table) -> pa.Table:
    """The state at the start of every member of a node, from the node's own."""
    table = table.sort_by("part")
    state, out = {c: starts[f"s_{c}"][0].as_py() for c in FUNCTION}, []
    for i in range(len(table)):
        out.append({"log": key[0].as_py(), "part": table["part"][i].as_py()} | {f"s_{c}": state[c] for c in FUNCTION})
        f = {c: table[c][i].values for c in FUNCTION}
        s = state["to"]
        later = f["baseline"][s].as_py()
        state = {"to": f["to"][s].as_py()} | {c: state[c] + f[c][s].as_py() for c in COUNTERS} | {"baseline": state["baseline"] if later == KEPT else later}
    return pa.Table.from_pylist(out)


def _replayed(plan: Plan):
    schema = ["log", "slot", "audited", "phase", "attempt", "baseline_slot", "burn_in_passed", "soak_days_passed", "total_audited", "total_passed"]

    def run(batches):
        t = tables(plan)
        for batch in batches:
            for r in batch.to_pylist():
                state = {c: r[f"s_{c}"] for c in FUNCTION}
                out = []
                for i, s in enumerate(r["symbols"]):
                    at = state["to"]
                    met, new = bool(t["audited"][s, at]), int(t["next"][s, at])
                    if at == 0 and new == 1:
                        state["baseline"] = r["first"] + i
                    elif s == FAIL and met and t["phase"][at] < 2:
                        state["baseline"] = NONE
                    state["to"] = new
                    state["attempts"] += int(t["attempts"][s, at])
                    state["audited"] += met
                    state["passed"] += met and s in (PASS, STOP_PASS)
                    burn, soak = (None, None) if t["phase"][new] == 4 else (int(t["burn_in"][new]), int(t["soak"][new]))
                    out.append((r["log"], r["first"] + i, met, PHASES[t["phase"][new]], state["attempts"], None if state["baseline"] == NONE else state["baseline"], burn, soak, state["audited"], state["passed"]))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.string(), pa.int64(), pa.bool_(), pa.string(), *[pa.int64()] * 6], strict=True)], names=schema)

    return run


def monitored(verdicts: DataFrame, plan: Plan = Plan(), deadline: int = 1 << 62, range_slots: int = RANGE_SLOTS, fan: int = FAN) -> DataFrame:
    """The monitor's state after every slot of every log.

    verdicts: (log string, slot long, symbol int), at most one row a slot; slots count on from a
    log's first to its last, and those without a row were missed: failed, or past the deadline slot a stop.  Counts within a phase are null
    once a review is needed.
    """
    spans = verdicts.groupBy("log").agg(F.min("slot").alias("low"), (F.max("slot") + 1).alias("high"))
    spans = spans.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("high") - F.col("low") - 1) / range_slots))))
    spans = spans.withColumn("first", F.col("low") + F.col("part") * range_slots).withColumn("stop", F.least("high", F.col("first") + range_slots))
    placed = verdicts.join(spans.select("log", "low").distinct(), "log").withColumn("part", F.floor((F.col("slot") - F.col("low")) / range_slots))
    schema = f"log string, part long, first long, symbols binary, {FUNCTION_SCHEMA}"
    fresh = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])  # columns of its own, so that cogroup can tell the sides apart
    leaves = durable(spans.groupBy("log", "part").cogroup(fresh(placed.select("log", "part", "slot", "symbol")).groupBy("log", "part")).applyInArrow(_ranges(plan, deadline), schema))

    most = leaves.agg(F.max("part")).first()[0]
    levels, node = [leaves], F.floor(F.col("part") / fan)
    while most is not None and most > 0:
        up = levels[-1].select("log", node.alias("node"), "part", *FUNCTION).groupBy("log", "node")
        levels.append(durable(up.applyInArrow(_composed, f"log string, part long, {FUNCTION_SCHEMA}")))
        most //= fan
    states = levels[-1].select("log", "part", *[F.lit(START[c]).cast("long").alias(f"s_{c}") for c in FUNCTION])
    for level in reversed(levels[:-1]):
        members = level.select("log", node.alias("node"), "part", *FUNCTION).groupBy("log", "node")
        states = members.cogroup(fresh(states.withColumnRenamed("part", "node")).groupBy("log", "node")).applyInArrow(_started, f"log string, part long, {STATE_SCHEMA}")
    rows = leaves.select("log", "part", "first", "symbols").join(states, ["log", "part"])
    return rows.mapInArrow(_replayed(plan), "log string, slot long, audited boolean, phase string, attempt long, baseline_slot long, burn_in_passed long, soak_days_passed long, total_audited long, total_passed long")
