"""Which sources of a registry are collected next: normal, retry and backfill slots by fair coverage.

Any number of registries, each with any number of sources, are decided at once.  A choice goes to
the earliest due time first and among equals to the score, which depends on what was chosen before.
So of a pool only few sources can ever be chosen: those with fewer than ``most`` strictly earlier
ones, and of equals in due time, beats and region the first ``most`` by fixed score.  Both cuts are
group limits that run before the shuffle; what is left of a registry is folded in one task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressloom import config as C

NORMAL, RETRY = 9, 2
NEVER = -(1 << 62)


def beats_of(sections: Column) -> Column:
    """The beats of a source's sections, each an own one with further ones, in order and once."""
    return F.array_distinct(F.flatten(F.transform(sections, lambda s: F.concat(F.array(s["primary"]), s["further"]))))


def fixed_score(media_type: Column, weight: Column, accepted_rate: Column, failures: Column) -> Column:
    """The part of a source's score that no choice changes."""
    role = F.lit(0)
    for k, v in C.MEDIA_ROLE_SCORE.items():
        role = F.when(media_type == k, v).otherwise(role)
    half_up = lambda x: F.floor(x + 0.5)
    return role + half_up(weight * 10) + half_up(F.coalesce(accepted_rate, F.lit(0.5)) * 20) - F.least(F.lit(60), F.coalesce(failures, F.lit(0)) * 15)


def fair_order(rows: list[dict], limit: int) -> list[dict]:
    """The first limit rows: earliest due, then score, then id; rows: source_id, due, fixed, region, beats."""
    left, out, regions, beats = list(rows), [], set(), dict.fromkeys(C.CATEGORIES, 0)

    def score(r: dict) -> int:
        opened = sum((60 if beats[b] == 0 else 30) + len(C.CATEGORIES) - C.CATEGORIES.index(b) for b in r["beats"] if beats[b] < 2)
        return r["fixed"] + opened + (0 if r["region"] in regions else 18)

    while left and len(out) < limit:
        due = min(r["due"] for r in left)
        best = min((r for r in left if r["due"] == due), key=lambda r: (-score(r), r["source_id"]))
        left.remove(best)
        out.append(best)
        regions.add(best["region"])
        for b in best["beats"]:
            beats[b] += 1
    return out


def _budget(most: int):
    def choose(registry: pd.DataFrame) -> pd.DataFrame:
        rows = registry.to_dict("records")
        retry = [r for r in rows if r["retry"]]
        kept = min(RETRY, len(retry), most)
        normal = fair_order([r for r in rows if not r["retry"]], min(NORMAL, max(0, most - kept)))
        again = fair_order(retry, min(RETRY, max(0, most - len(normal))))
        taken = {r["source_id"] for r in normal + again}
        fill = fair_order([r for r in rows if r["source_id"] not in taken], most - len(normal) - len(again))
        named = [("normal", r) for r in normal] + [("backfill", r) for r in fill] + [("retry", r) for r in again]
        return pd.DataFrame([(r["registry"], i, pool, r["source_id"]) for i, (pool, r) in enumerate(named, 1)], columns=["registry", "position", "pool", "source_id"])

    return choose


def slot_budget(sources: DataFrame, cutoff: Column, max_sources: int = NORMAL + RETRY) -> DataFrame:
    """registry, position, pool, source_id of what is collected next.

    sources: (registry, source_id, region, media_type, weight, beats, approved, due_at, accepted_rate,
    consecutive_failures, last_error), one row a source; those due by cutoff take part, a null due time
    comes first.  Failing sources have RETRY slots, the others NORMAL; what both leave is filled from all.
    """
    most = min(max_sources, NORMAL + RETRY)
    failing = (F.coalesce("consecutive_failures", F.lit(0)) > 0) | (F.coalesce("last_error", F.lit("")) != "")
    due = sources.where(F.col("approved") & (F.col("due_at").isNull() | (F.col("due_at") <= cutoff))).select(
        "registry", "source_id", "region", "beats", failing.alias("retry"), F.coalesce(F.unix_micros(F.col("due_at").cast("timestamp")), F.lit(NEVER)).alias("due"),
        fixed_score(F.col("media_type"), F.col("weight"), F.col("accepted_rate"), F.col("consecutive_failures")).cast("long").alias("fixed"),
    )
    alike = Window.partitionBy("registry", "retry", "due", "beats", "region").orderBy(F.desc("fixed"), "source_id")
    pool = Window.partitionBy("registry", "retry").orderBy("due")
    few = due.withColumn("r", F.row_number().over(alike)).where(F.col("r") <= most).withColumn("r", F.rank().over(pool)).where(F.col("r") <= most).drop("r")
    out = f"registry {sources.schema['registry'].dataType.simpleString()}, position int, pool string, source_id string"
    return few.groupBy("registry").applyInPandas(_budget(most), out)
