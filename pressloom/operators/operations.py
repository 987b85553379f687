"""Operational analytics over the source run log: streaks, circuits, latency, slots, due lists, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressloom import config as C


def attempts(runs: DataFrame) -> DataFrame:
    """Runs that touch source state: skipped ones do not."""
    return runs.where("status <> 'skipped'").withColumn("ok", F.col("status").isin("success", "empty"))


def failure_streaks(runs: DataFrame, interval_minutes: int = 90, limits: C.Limits = C.DEFAULTS) -> DataFrame:
    """Consecutive failures after the last success, and until when the circuit is open.

    Two grouped aggregates and a join instead of a window: a source of any size is pre-aggregated.
    """
    a = attempts(runs)
    at = F.struct("attempted_at", "event_id")
    last_ok = a.where("ok").groupBy("source_id").agg(F.max(at).alias("last_ok"))
    tail = a.join(last_ok, "source_id", "left").where(F.col("last_ok").isNull() | (at > F.col("last_ok")))
    fails = tail.groupBy("source_id").agg(F.count("*").alias("consecutive_failures"), F.max("attempted_at").alias("last_failure"))
    out = a.groupBy("source_id").agg(F.max("attempted_at").alias("last_attempt_at"), F.count("*").alias("n_attempts")).join(fails, "source_id", "left")
    failures = F.coalesce("consecutive_failures", F.lit(0))
    return out.select(
        "source_id", "n_attempts", "last_attempt_at", failures.alias("consecutive_failures"),
        F.when(failures >= limits.failures_to_open, F.col("last_failure") + F.make_interval(mins=F.lit(2 * interval_minutes))).alias("circuit_open_until"),
    )


def latency_trend(runs: DataFrame) -> DataFrame:
    """Smoothed median and decayed maximum of latency, folded in time order."""
    a = attempts(runs).where("latency_ms > 0")
    xs = F.array_sort(F.collect_list(F.struct("attempted_at", "event_id", F.col("latency_ms").cast("double").alias("v"))))
    half_up = lambda x: F.floor(x + 0.5)
    p50 = F.aggregate("xs", F.lit(None).cast("double"), lambda s, x: F.when(s.isNull(), x["v"]).otherwise(half_up(s * 0.8 + x["v"] * 0.2).cast("double")))
    p95 = F.aggregate("xs", F.lit(None).cast("double"), lambda s, x: F.when(s.isNull(), x["v"]).otherwise(F.greatest(x["v"], half_up(s * 0.95).cast("double"))))
    return a.groupBy("source_id").agg(xs.alias("xs")).select("source_id", p50.cast("long").alias("latency_ms_p50"), p95.cast("long").alias("latency_ms_p95"))


def accepted_rate(runs: DataFrame) -> DataFrame:
    """The latest accepted / discovered share; attempts that discovered nothing keep the old one."""
    a = attempts(runs).withColumn("discovered", F.col("k") % 10).withColumn("accepted", F.least(F.col("discovered"), F.col("k") % 7)).where("discovered > 0")
    last = a.groupBy("source_id").agg(F.max_by(F.struct("accepted", "discovered"), F.struct("attempted_at", "event_id")).alias("x"))
    return last.select("source_id", (F.col("x.accepted") / F.col("x.discovered")).alias("accepted_rate"))


def slot_rollup(runs: DataFrame, minutes: int = 5) -> DataFrame:
    """Counts by status and latency limits per time slot."""
    return runs.groupBy(F.window("attempted_at", f"{minutes} minutes").alias("w")).agg(
        F.count("*").alias("runs"), F.count_if(F.col("status") == "success").alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("latency_ms") > 30_000).alias("over_30s"), F.max("latency_ms").alias("max_latency_ms"),
    ).select(F.col("w.start").alias("slot"), "runs", "succeeded", "failed", "over_30s", "max_latency_ms")


def missing_slots(runs: DataFrame, hours: int = 2) -> DataFrame:
    """Expected slots without any successful run."""
    slots = runs.agg(F.min("attempted_at").alias("a"), F.max("attempted_at").alias("b"))
    step = F.expr(f"interval {hours} hours")
    floor = lambda c: F.timestamp_seconds(F.floor(F.unix_timestamp(c) / (hours * 3600)) * (hours * 3600))
    expected = slots.select(F.explode(F.sequence(floor(F.col("a")), floor(F.col("b")), step)).alias("slot"))
    seen = runs.where("status = 'success'").select(floor(F.col("attempted_at")).alias("slot")).distinct()
    return expected.join(seen, "slot", "left_anti")


def success_gaps(runs: DataFrame) -> DataFrame:
    """Longest time between successes of each source, in minutes with three decimals."""
    w = Window.partitionBy("source_id").orderBy("attempted_at", "event_id")
    at = F.col("attempted_at").cast("timestamp")
    gap = (F.unix_micros(at) - F.unix_micros(F.lag(at).over(w))) / 60e6
    gaps = runs.where("status = 'success'").withColumn("gap", gap)
    return gaps.groupBy("source_id").agg((F.floor(F.max("gap") * 1000 + 0.5) / 1000).alias("max_gap_minutes"), F.count("*").alias("successes"))


def source_states(runs: DataFrame) -> DataFrame:
    """Last attempt, success and due time of every source, from the run log."""
    a = attempts(runs)
    interval = (F.col("source_id") % 4 + 1) * 30
    s = a.groupBy("source_id").agg(F.max("attempted_at").alias("last_attempt_at"), F.max(F.when(F.col("ok"), F.col("attempted_at"))).alias("last_success_at"))
    return s.withColumns({"interval_minutes": interval.cast("int"), "enabled": F.col("source_id") % 11 != 0}).withColumn(
        "next_due_at", F.col("last_attempt_at") + F.make_interval(mins=F.col("interval_minutes") * 2)
    )


def due_list(states: DataFrame, as_of: Column, limit: int = 100) -> DataFrame:
    """Enabled sources due by as_of: earliest first, never attempted first among equals."""
    due = F.least("next_due_at", F.col("last_attempt_at") + F.make_interval(mins=F.col("interval_minutes")))
    return states.where("enabled").withColumn("due_at", due).where(F.col("due_at").isNull() | (F.col("due_at") <= as_of)).orderBy(
        F.col("due_at").asc_nulls_first(), F.col("last_attempt_at").asc_nulls_first(), "source_id"
    ).limit(limit).select("source_id", "due_at", "last_attempt_at")


def health(states: DataFrame, as_of: Column, hours: int = 12) -> DataFrame:
    """One row of coverage: enabled, recently attempted, and when the last full sweep ended."""
    recent = F.col("last_attempt_at") >= as_of - F.make_interval(hours=F.lit(hours))
    e = states.where("enabled")
    return e.agg(
        F.count("*").alias("enabled_count"), F.count_if(recent).alias("recent_count"), F.count_if(F.col("next_due_at") < as_of).alias("overdue_count"),
        F.when(F.count_if(F.col("last_attempt_at").isNull()) == 0, F.min("last_attempt_at")).alias("full_sweep_at"),
    )


def freshness(states: DataFrame, now: Column, stale_minutes: int) -> DataFrame:
    """Status, pipeline and content axes of each source's data."""
    age = lambda c: F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(F.col(c).cast("timestamp"))) / 60e6)
    failed = F.coalesce(F.col("last_attempt_at") > F.col("last_success_at"), F.lit(False))
    checked = age("last_attempt_at") <= stale_minutes
    return states.select(
        "source_id",
        F.when(F.col("last_success_at").isNull(), "unavailable").when(age("last_success_at") > stale_minutes, "stale").when(failed, "degraded").otherwise("fresh").alias("status"),
        F.when(F.col("last_success_at").isNull(), "failed").when(failed, "degraded").otherwise("healthy").alias("pipeline_status"),
        F.when(F.col("last_success_at").isNull(), "unknown").when(age("last_success_at") <= stale_minutes, "current").when(checked, "quiet").otherwise("stale").alias("content_status"),
        (F.floor(age("last_success_at") * 1000 + 0.5) / 1000).alias("age_minutes"),
    )


def rate_limited(events: DataFrame, per_minute: int = 6) -> DataFrame:
    """Whether each client request fits its fixed one-minute window."""
    w = Window.partitionBy("user_id", F.date_trunc("minute", "ts")).orderBy("ts", "event_id")
    return events.withColumn("allowed", F.row_number().over(w) <= per_minute).select("event_id", "allowed")


def snapshot_chain(links: DataFrame, start: int, depth: int) -> DataFrame:
    """The chain of superseded snapshots from start, at most depth long (J18): a recursive query."""
    return links.sparkSession.sql(
        """WITH RECURSIVE chain(id, previous, depth) AS (
          SELECT id, previous, 1 FROM {links} WHERE id = {start}
          UNION ALL SELECT l.id, l.previous, c.depth + 1 FROM chain c JOIN {links} l ON l.id = c.previous WHERE c.depth < {depth})
        SELECT id, depth FROM chain""",
        links=links, start=int(start), depth=int(depth),
    )


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Merge on keys: new values win where set, the first discovery stays."""
    s, n = stored.alias("s"), new.alias("n")
    on = [F.col(f"s.{k}") == F.col(f"n.{k}") for k in keys]
    pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"s.{c}")).alias(c)
    return s.join(n, on, "full_outer").select(
        *[pick(c) for c in keys], *[pick(c) for c in ("title", "summary")], F.least("s.discovered_at", "n.discovered_at").alias("discovered_at"),
        F.greatest("s.last_seen_at", "n.last_seen_at").alias("last_seen_at"),
    )


def sync_registry(states: DataFrame, registry: DataFrame, as_of: Column) -> DataFrame:
    """State after a registry payload: updated intervals, due times moved up, absent sources disabled."""
    r = registry.select("source_id", F.col("interval_minutes").alias("new_interval"))
    j = states.join(r, "source_id", "full_outer")
    interval = F.coalesce("new_interval", "interval_minutes")
    due = F.when(F.col("next_due_at").isNull(), as_of).otherwise(F.least("next_due_at", F.coalesce(F.col("last_attempt_at") + F.make_interval(mins=interval), as_of)))
    return j.select("source_id", interval.alias("interval_minutes"), F.col("new_interval").isNotNull().alias("enabled"), F.when(F.col("new_interval").isNotNull(), due).otherwise(F.col("next_due_at")).alias("next_due_at"))


def combine_outcomes(search: DataFrame, direct: DataFrame) -> DataFrame:
    """One outcome a source from two scans: success over partial over empty over failed."""
    rank = lambda c: F.coalesce(F.array_position(F.array(*[F.lit(x) for x in ("success", "partial", "empty", "failed", "skipped")]), c), F.lit(99))
    best = lambda df: df.groupBy("source_id").agg(F.min_by("status", rank(F.col("status"))).alias("status"), F.count("*").alias("n"))
    a, b = best(search).withColumnsRenamed({"status": "sa", "n": "na"}), best(direct).withColumnsRenamed({"status": "sb", "n": "nb"})
    j = a.join(b, "source_id", "full_outer")
    return j.select("source_id", F.when(rank(F.col("sa")) <= rank(F.col("sb")), F.col("sa")).otherwise(F.coalesce("sb", "sa")).alias("status"), (F.coalesce("na", F.lit(0)) + F.coalesce("nb", F.lit(0))).alias("attempts"))
