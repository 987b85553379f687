"""Audits of the collection: recall, duplicates, source partitions, correlation of logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def recall(stories: DataFrame, active: Column, visible: Column) -> DataFrame:
    """Share of active stories that are visible, 1 when none is active."""
    n = stories.agg(F.count_if(active).alias("eligible"), F.count_if(active & visible).alias("visible"))
    return n.select("eligible", "visible", (F.col("eligible") - F.col("visible")).alias("missing"), F.when(F.col("eligible") > 0, F.col("visible") / F.col("eligible")).otherwise(1.0).alias("recall"))


def duplicate_slots(slots: DataFrame, slot: str) -> DataFrame:
    """Slots taken more than once: rows less different slots."""
    return slots.agg((F.count(slot) - F.countDistinct(slot)).alias("duplicate_slots"), F.countDistinct(slot).alias("slots"))


def partitions(states: DataFrame, now: Column, window_minutes: int = 30) -> DataFrame:
    """Counts of enabled sources by condition.

    Healthy is every source without an open circuit.  Attempts and successes count while they
    are at most window_minutes old; a source without such an attempt is overdue, one that is
    healthy and due is backlog.
    """
    opened = F.coalesce(F.col("circuit_open_until") > now, F.lit(False))
    since = now - F.make_interval(mins=F.lit(window_minutes))
    tried, won = (F.coalesce(F.col(c) >= since, F.lit(False)) for c in ("last_attempt_at", "last_success_at"))
    due = F.col("next_due_at") <= now
    return states.where("enabled").agg(
        F.count("*").alias("enabled"), F.count_if(~opened).alias("healthy"), F.count_if(opened).alias("open_circuit"), F.count_if((F.col("circuit_open_until") <= now) & due).alias("half_open_due"),
        F.count_if(tried).alias("rolling_attempted"), F.count_if(~opened & won).alias("rolling_succeeded"), F.count_if(~tried).alias("overdue"), F.count_if(~opened & due).alias("backlog"),
    )


def correlate(runs: DataFrame, responses: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Runs with their response and snapshot, and which of them are missing."""
    j = runs.join(responses, "run_id", "left").join(snapshots, "run_id", "left")
    codes = F.array_compact(F.array(F.when(F.col("response_at").isNull(), "missing_response"), F.when(F.col("published") & F.col("snapshot_id").isNull(), "missing_snapshot"), F.when(~F.col("published") & F.col("snapshot_id").isNotNull(), "unexpected_snapshot")))
    return j.withColumn("problems", codes)


def set_mismatch(plans: DataFrame, planned: str, attempted: str, skipped: str) -> DataFrame:
    """Differences of planned and attempted or skipped sources a run, and what was both attempted and skipped."""
    done = F.array_union(attempted, skipped)
    return plans.withColumns({
        "missing": F.array_sort(F.array_except(planned, done)), "unplanned": F.array_sort(F.array_except(done, planned)), "overlap": F.array_sort(F.array_intersect(attempted, skipped)),
    })
