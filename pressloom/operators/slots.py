"""The audit of expected time slots: what ran in each, every rule it breaks, and the verdict.

Slots and runs meet by bucketed time: a run belongs to the slot it is nearest behind, or up to
``early`` seconds before, so the join is an equality on a computed slot and no range of time is
compared with another.  Each log is aggregated to one row a slot before it is joined.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONGEST_SECONDS = 60
TERMINAL = ("published", "completed")


@dataclass(frozen=True)
class Grid:
    """Seconds a slot lasts, seconds a run may come before it, and seconds after which it is late."""

    width: int = 300
    early: int = 0
    late: int = 240


def slot_of(at: Column, grid: Grid) -> Column:
    """The slot, in seconds since 1970, that a time is matched with."""
    seconds = F.unix_micros(at.cast("timestamp")) / 1_000_000
    return (F.floor((seconds + grid.early) / grid.width) * grid.width).cast("long")


def expected_slots(logs: DataFrame, grid: Grid) -> DataFrame:
    """log, slot: all slots from a log's first to its last; logs: (log, first, last) in seconds."""
    return logs.select("log", F.explode(F.sequence(F.col("first"), F.col("last"), F.lit(grid.width).cast("long"))).alias("slot"))


def _first(df: DataFrame, name: str, order: str, grid: Grid, at: str) -> DataFrame:
    """log, slot, n_<name>, <name>: how many rows a slot has, and the first of them."""
    s = slot_of(F.col(at), grid)
    return df.groupBy("log", s.alias("slot")).agg(F.count("*").alias(f"n_{name}"), F.min_by(F.struct(*df.columns), F.struct(at, order)).alias(name))


def audits(slots: DataFrame, cron: DataFrame, runs: DataFrame, responses: DataFrame, snapshots: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """One row a slot with what the rules read.

    cron: (log, cron_id, at, status); runs: (log, run_id, at, status, started_at, finished_at, planned,
    attempted, skipped, missing, discovered, accepted, report_id, outcome), its id lists as arrays;
    responses: (run_id, status_code, keys, failed, report_id, body_status, selected, discovered, accepted),
    any number a run; snapshots: (run_id, report_id).
    """
    answers = responses.groupBy("run_id").agg(F.count("*").alias("n_responses"), F.max_by(F.struct(*[c for c in responses.columns if c != "run_id"]), F.struct("status_code", "keys")).alias("response"))
    kept = snapshots.groupBy("run_id").agg(F.max("report_id").alias("snapshot_report"))
    facts = runs.withColumns({
        "duration": F.floor((F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6 * 1000 + 0.5) / 1000,
        "set_mismatch": F.size(F.array_except(F.array_union("attempted", "skipped"), "planned")) + F.size(F.array_except("planned", F.array_union("attempted", "skipped"))),
        "overlap": F.size(F.array_intersect("attempted", "skipped")), "n_attempted": F.size("attempted"), "n_missing": F.size("missing"),
    }).drop("planned", "attempted", "skipped", "missing").join(answers, "run_id", "left").join(kept, "run_id", "left")
    out = slots.join(_first(cron, "cron", "cron_id", grid, "at"), ["log", "slot"], "left").join(_first(facts, "run", "run_id", grid, "at"), ["log", "slot"], "left")
    offset = lambda c: F.unix_micros(F.col(f"{c}.at").cast("timestamp")) / 1e6 - F.col("slot")
    return out.withColumns({"n_cron": F.coalesce("n_cron", F.lit(0)), "n_run": F.coalesce("n_run", F.lit(0)), "cron_late": F.coalesce(offset("cron") > grid.late, F.lit(False)), "run_late": F.coalesce(offset("run") > grid.late, F.lit(False))})


def rules() -> dict[str, Column]:
    """Every rule by its code, in order; a rule holds where its column is true, a null breaks it."""
    c = F.col
    run, answer = (lambda f: c(f"run.{f}")), (lambda f: c(f"run.response.{f}"))
    published, completed = run("status") == "published", run("status") == "completed"
    unless = lambda condition, holds: ~F.coalesce(condition, F.lit(False)) | F.coalesce(holds, F.lit(False))
    return {
        "schedule_cron_count": c("n_cron") == 1, "schedule_durable_count": c("n_run") == 1, "schedule_missing_cron": c("n_cron") > 0, "schedule_missing_durable": c("n_run") > 0,
        "schedule_duplicate_cron": c("n_cron") <= 1, "schedule_duplicate_durable": c("n_run") <= 1, "schedule_late_cron": ~c("cron_late"), "schedule_late_durable": ~c("run_late"),
        "cron_not_succeeded": c("cron.status") == "succeeded", "pgnet_response_count": run("n_responses") == 1, "pgnet_not_http_200": answer("status_code") == 200, "pgnet_body_not_exact_9": answer("keys") == 9,
        "pgnet_network_error": ~answer("failed"), "durable_terminal_status": run("status").isin(*TERMINAL), "durable_over_60_seconds": run("duration") <= LONGEST_SECONDS, "durable_missing": run("n_missing") == 0,
        "durable_set_mismatch": run("set_mismatch") == 0, "durable_attempt_skip_overlap": run("overlap") == 0, "durable_response_mismatch": (answer("status_code") == 200) & (answer("keys") == 9) & ~answer("failed"),
        "durable_body_counts_mismatch": (answer("selected") == run("n_attempted")) & (answer("discovered") == run("discovered")) & (answer("accepted") == run("accepted")),
        "published_report_missing": unless(published, run("report_id").isNotNull()), "published_snapshot_not_linked": unless(published, run("snapshot_report") == run("report_id")),
        "completed_response_report_mismatch": unless(completed, answer("report_id") == run("report_id")),
        "partial_outcome_metadata_mismatch": unless(F.coalesce(run("outcome"), answer("body_status")) == "partial", answer("body_status") == "partial"),
    }


def verdicts(audited: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """log, slot, passed, failures in the order of the rules, run_id, report_id and duration; extra adds rules of one's own."""
    table = rules() | (extra or {})
    failures = F.array_compact(F.array(*[F.when(~F.coalesce(holds, F.lit(False)), F.lit(code)) for code, holds in table.items()]))
    return audited.select("log", "slot", failures.alias("failures"), F.col("run.run_id").alias("run_id"), F.col("run.report_id").alias("report_id"), F.col("run.duration").alias("duration")).withColumn("passed", F.size("failures") == 0)
