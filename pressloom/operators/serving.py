"""What a reader of reports is shown: coverage of sources, which report stands, how fresh it is, what of it is visible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The states that a report may claim for itself.
STATES = ("fresh", "stale", "degraded", "unavailable")


def coverage_status(states: DataFrame, key: str, now: Column, minutes: int) -> DataFrame:
    """Coverage of each key's enabled sources: unavailable, incomplete, current or stale.

    Sources come as (key, enabled, last_attempt_at); a null enabled counts as enabled.  A key
    without an enabled source is unavailable, one with a source never attempted is incomplete.
    """
    on = F.coalesce("enabled", F.lit(True))
    got = states.groupBy(key).agg(
        F.count_if(on).alias("enabled_count"), F.count_if(on & F.col("last_attempt_at").isNull()).alias("never"), F.min(F.when(on, F.col("last_attempt_at"))).alias("full_sweep_at"),
    )
    status = F.when(F.col("enabled_count") == 0, "unavailable").when(F.col("never") > 0, "incomplete").when(F.col("full_sweep_at") >= now - F.make_interval(mins=F.lit(minutes)), "current").otherwise("stale")
    return got.select(key, "enabled_count", F.when(F.col("never") == 0, F.col("full_sweep_at")).alias("full_sweep_at"), status.alias("coverage_status"))


def replaces(current: str, candidate: str) -> Column:
    """Whether a candidate report takes the place of the current one.

    Both are structs of serving_mode, publication_state_at, data_as_of and generated_at.  A durable
    report never yields to another kind; among durable ones the publication state decides, then the age of the data.
    """
    of = lambda r, c: F.col(f"{r}.{c}")
    durable = lambda r: F.coalesce(of(r, "serving_mode") == "durable", F.lit(False))
    data = lambda r: F.coalesce(of(r, "data_as_of"), of(r, "generated_at"))
    was, offered = of(current, "publication_state_at"), of(candidate, "publication_state_at")
    by_data = F.coalesce(data(candidate) >= data(current), F.lit(False))
    return (
        F.when(F.col(current).isNull(), True)
        .when(durable(current) & ~durable(candidate), False)
        .when(~durable(candidate) | offered.isNull(), by_data)
        .when(~durable(current) | was.isNull(), True)
        .when(was != offered, offered > was)
        .otherwise(by_data)
    )


def freshness_view(reports: DataFrame, now: Column, default_minutes: int = 30) -> DataFrame:
    """The states shown for a report: claimed ones before inferred ones.

    A claim of fresh does not stand against data older than stale_after_minutes (default where
    null or not positive); a failed or degraded pipeline comes before the state of the content.
    """
    minutes = F.when(F.col("stale_after_minutes") > 0, F.col("stale_after_minutes")).otherwise(float(default_minutes))
    as_of = F.coalesce("data_as_of", "generated_at")
    age = (F.unix_micros(now) - F.unix_micros(as_of)) / 60e6
    r = reports.withColumn("_inferred", F.when(as_of.isNull(), "unavailable").when(age > minutes, "stale").otherwise("fresh"))
    claimed, inferred = F.when(F.col("status").isin(*STATES), F.col("status")), F.col("_inferred")
    overdue = F.coalesce((claimed == "fresh") & (inferred == "stale"), F.lit(False))
    pipeline = F.coalesce(F.col("pipeline_status"), F.when(claimed == "unavailable", "failed").when(claimed == "degraded", "degraded").otherwise("healthy"))
    content = F.coalesce(F.col("content_status"), F.when(inferred == "stale", "stale").otherwise("current"))
    shown = F.when(claimed == "unavailable", "unavailable").when(pipeline.isin("degraded", "failed"), "degraded").when((content == "stale") | overdue, "stale").otherwise(F.coalesce(claimed, inferred))
    return r.withColumns({"shown_status": shown, "shown_pipeline": pipeline, "shown_content": content, "was_inferred": claimed.isNull() | overdue}).drop("_inferred")


def public_summary(stories: DataFrame, evidence: DataFrame, reports: DataFrame, now: Column) -> DataFrame:
    """Recall, missing, repeated and unmapped stories of each report's latest list.

    stories: (report, story_id, updated_at, listed); evidence: (report, candidate_id); reports:
    (report, lists_latest, accepted, unmapped).  Without a list of its own a report shows the
    stories of 24 hours, else those of 72.  Rows meet by (report, story) first, so a report of
    any size is counted before it is gathered.
    """
    within = lambda hours: F.coalesce((F.col("updated_at") <= now) & (F.col("updated_at") >= now - F.make_interval(hours=F.lit(hours))), F.lit(False))
    named = F.nullif(F.col("story_id"), F.lit(""))
    by_story = stories.groupBy("report", named.alias("story_id")).agg(F.count_if(within(24)).alias("day"), F.count_if(within(72)).alias("three"), F.count_if(F.coalesce("listed", F.lit(False))).alias("own"))
    days = by_story.groupBy("report").agg(F.sum("day").alias("all_day"))
    shown = F.when(F.col("lists_latest"), F.col("own")).when(F.col("all_day") > 0, F.col("day")).otherwise(F.col("three"))
    s = by_story.join(days, "report").join(reports.select("report", F.coalesce("lists_latest", F.lit(False)).alias("lists_latest")), "report").withColumn("shown", shown)
    name = F.col("story_id").isNotNull()
    total = lambda c, cond=name: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    seen = name & (F.col("shown") > 0)
    got = s.groupBy("report").agg(
        total("day").alias("eligible"), total("day", seen).alias("visible"), total("three").alias("all_fallback"), total("three", seen).alias("seen_fallback"),
        (total("shown") - F.count_if(seen)).alias("duplicates"), F.sum("three").alias("any_three"),
    )
    mapped = evidence.where("candidate_id <> ''").select("report", "candidate_id").distinct().groupBy("report").agg(F.count("*").alias("mapped"))
    j = reports.join(got, "report", "left").join(mapped, "report", "left")
    number = lambda c: F.coalesce(c, F.lit(0))
    eligible, visible = number("eligible"), number("visible")
    fallback = lambda c: F.when(eligible == 0, number(c)).otherwise(0)
    derived = F.when(F.col("accepted").isNotNull(), F.greatest(F.lit(0), F.col("accepted") - number("mapped")))
    return j.select(
        "report", eligible.alias("eligible_24h"), visible.alias("visible_24h"), (eligible - visible).alias("missing_24h"), F.when(eligible == 0, 1.0).otherwise(visible / eligible).alias("recall"),
        number("duplicates").alias("duplicate_ids"), F.when(eligible > 0, 24).when(number("any_three") > 0, 72).alias("fallback_hours"),
        fallback("all_fallback").alias("eligible_fallback"), fallback("seen_fallback").alias("visible_fallback"), F.greatest("unmapped", derived).alias("unmapped"),
    )
