"""Candidates of the last good report, for windows whose read failed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ["report", "candidate", "title", "url", "source", "language", "primary_category", "categories", "summary", "published_at", "updated_at", "discovered_at", "summary_status"]


def rebuilt(stories: DataFrame, evidence: DataFrame, items: DataFrame, sources: DataFrame) -> DataFrame:
    """One candidate a piece of evidence, told by its story, item and source; what one lacks another gives.

    stories: (report, story, item, title, beat, what_happened, published_at, started_at, updated_at,
    summary_status); evidence: (report, story, candidate, source, title, url, published_at); items:
    (report, item, categories, primary_category, language, summary_status); sources: (source, language).
    """
    s, e = stories.alias("s"), evidence.alias("e")
    rows = e.join(s, ["report", "story"]).join(items.alias("i"), ["report", "item"], "left").join(sources.alias("o"), "source", "left")
    c = F.col
    categories = F.when(F.size(c("i.categories")) > 0, c("i.categories")).otherwise(F.array(c("s.beat")))
    return rows.select(
        "report", c("e.candidate"), F.coalesce(F.nullif(c("e.title"), F.lit("")), c("s.title")).alias("title"), c("e.url"), "source", F.coalesce(c("o.language"), c("i.language"), F.lit("zh-CN")).alias("language"),
        F.coalesce(c("i.primary_category"), c("s.beat")).alias("primary_category"), categories.alias("categories"), c("s.what_happened").alias("summary"), F.coalesce(c("e.published_at"), c("s.published_at")).alias("published_at"),
        c("s.updated_at"), F.coalesce(c("s.started_at"), c("e.published_at"), c("s.updated_at")).alias("discovered_at"), F.coalesce(c("s.summary_status"), c("i.summary_status")).alias("summary_status"),
    )


def with_last_known_good(window: DataFrame, reads: DataFrame, good: DataFrame) -> DataFrame:
    """The candidates of every report: its window where that was read, else the last good ones; degraded tells which.

    window: candidates read; reads: (report, ok), a report without a row counts as failed.  One
    semi-join and one anti-join decide it a report, whatever their number.
    """
    read = reads.where("ok").select("report").distinct()
    fresh = window.select(*COLUMNS).join(read, "report", "left_semi").withColumn("degraded", F.lit(False))
    return fresh.unionByName(good.select(*COLUMNS).join(read, "report", "left_anti").withColumn("degraded", F.lit(True)))
