"""The daily report: gate, cluster, rank, cards, selection, sections and quality as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressloom import config as C
from pressloom.functions import numbers as N
from pressloom.functions import scoring as S
from pressloom.functions import text as X
from pressloom.functions import urls as U
from pressloom.operators import events as E
from pressloom.operators import gate


@dataclass
class Report:
    """Parts of one report; every part is a DataFrame over the same accepted candidates."""

    candidates: DataFrame
    gated: DataFrame
    evidence: DataFrame
    stories: DataFrame
    selected: DataFrame


def story_cards(accepted: DataFrame, labels: DataFrame, sources: DataFrame, now: Column, prefs: C.Preferences) -> tuple[DataFrame, DataFrame]:
    """Evidence rows and one scored card per event."""
    labels = labels.select("ord", "cluster", "voice")
    evidence = accepted.join(labels, "ord").select(
        "cluster", "ord", F.col("id").alias("candidate_id"), "source_id", "url", "title", "published_at", "credibility", "media_type", "paywall",
        S.evidence_role(F.col("media_type")).alias("role"), U.host(F.col("url")).alias("independence_group"),
    )
    facts = evidence.groupBy("cluster").agg(
        F.count("*").alias("n_evidence"), F.countDistinct("independence_group").alias("n_independent"), F.min(F.struct("ord", "source_id", "role")).alias("first"),
        F.max("credibility").alias("max_credibility"), F.max(F.col("role") == "original").alias("official"), F.max(F.col("role") == "confirmation").alias("wire"),
        F.max(F.col("role") == "lead").alias("social"), F.max("paywall").alias("paywall"),
    )
    per_source = evidence.select("cluster", "source_id", "credibility").distinct().groupBy("cluster").agg(F.avg(F.coalesce("credibility", F.lit(45))).alias("avg_credibility"))
    e = E.events_of(accepted, labels).join(facts, "cluster").join(per_source, "cluster")
    e = e.select("*", "lead.title", "lead.url").drop("lead")
    text = X.normalize_text(F.concat_ws(" ", "title", "summary"))
    e = e.withColumns({"text": text, "n_sources": F.size("source_ids")})
    e = e.withColumns({
        "primary_beat": E.vote_category(F.col("categories"), F.col("votes"), F.col("text")),
        "public_importance": S.public_importance(F.col("categories"), F.col("text"), F.col("n_sources")),
        "user_preference": S.user_preference(F.col("categories"), F.col("text"), F.col("source_ids"), prefs),
        "timeliness": S.timeliness(F.col("published_at"), now), "source_confidence": S.source_confidence(F.col("n_sources")),
        "content_quality": S.content_quality(F.col("summary"), F.col("published_at"), F.col("url"), F.col("paywall")),
        "trust": S.trust_score(F.col("avg_credibility"), F.col("official"), F.col("wire"), F.col("social"), F.col("n_sources"), F.col("published_at"), F.col("summary"), F.col("paywall"), F.lit(False)),
    })
    e = e.withColumns({
        "final_score": S.final_score(*[F.col(c) for c in ("public_importance", "user_preference", "timeliness", "source_confidence", "content_quality")]),
        "event_type": S.event_type(F.col("text"), F.col("primary_beat")), "trust_level": S.trust_level(F.col("trust")),
    })
    e = e.withColumn("impact", S.public_impact(F.col("text"), F.col("primary_beat"), F.col("event_type")))
    e = e.withColumn("total", S.total_importance(F.col("impact"), F.col("timeliness")))
    cards = e.withColumns({
        "tier": S.tier(F.col("impact"), F.col("total"), F.col("primary_beat")),
        "status": S.story_status(F.col("first.role"), F.col("n_evidence"), F.col("n_independent"), F.col("trust_level"), F.col("max_credibility")),
        "story_id": E.anchor_event_id(F.col("primary_beat"), F.col("anchor.url")),
        "publisher": F.col("first.source_id"), "activity": F.col("updated_at"),
    })
    return evidence, cards


def select_diverse(stories: DataFrame, eligible: Column, limit: int, now: Column, stages: list[tuple[int, int]], start: DataFrame | None = None, limits: C.Limits = C.DEFAULTS) -> DataFrame:
    """Positions of a diverse top list (T03): staged freshness, at most so many a beat and a publisher, then a soft fill.

    Whoever is picked in any pass is among the first rows of its (beat, publisher) group or, in the soft
    fill, among the first rows overall; so the greedy fold only sees a bounded number of rows:
    limit rows a stage and pass of every group, and limit rows overall.
    """
    key = [F.desc("total"), F.col("activity").desc_nulls_last(), F.col("cluster")]
    rows = stories.where(eligible).select("cluster", "story_id", "primary_beat", "publisher", "total", "activity")
    pool = rows.withColumn("r", F.row_number().over(Window.partitionBy("primary_beat", "publisher").orderBy(*key))).where(F.col("r") <= limit).drop("r")
    fresh = [rows.where((F.col("activity") <= now) & (F.col("activity") >= now - F.make_interval(mins=F.lit(m)))).withColumn("r", F.row_number().over(Window.partitionBy("primary_beat", "publisher").orderBy(*key))).where(F.col("r") <= limit).drop("r") for m, _ in stages]
    top = rows.orderBy(*key).limit(2 * limit)
    for part in [*fresh, top]:
        pool = pool.union(part)
    pool = pool.distinct()
    packed = pool.withColumn("x", F.struct((-F.col("total")).alias("a"), (-F.coalesce(F.unix_timestamp("activity"), F.lit(-(10**12)))).alias("b"), "cluster", "primary_beat", "publisher", F.unix_timestamp("activity").alias("at")))
    ordered = packed.groupBy().agg(F.array_sort(F.collect_list("x")).alias("xs"))
    seed = start.groupBy().agg(F.collect_list("publisher").alias("used")) if start is not None else None
    ordered = ordered.join(seed) if seed is not None else ordered.withColumn("used", F.array().cast("array<string>"))

    def step(strict: bool, cap: int, minutes: int | None):
        def add(acc: Column, x: Column) -> Column:
            ok = (F.size(acc) < cap) & ~F.exists(acc, lambda s: s["cluster"] == x["cluster"])
            if minutes is not None:
                age = F.unix_timestamp(now) - x["at"]
                ok = ok & F.coalesce((age >= 0) & (age <= minutes * 60), F.lit(False))
            if strict:
                same_beat = F.size(F.filter(acc, lambda s: s["primary_beat"] == x["primary_beat"]))
                same_pub = F.size(F.filter(acc, lambda s: s["publisher"] == x["publisher"])) + F.size(F.filter(F.col("used"), lambda s: s == x["publisher"]))
                ok = ok & (same_beat < limits.beat) & (same_pub < limits.publisher)
            return F.when(ok, F.concat(acc, F.array(x))).otherwise(acc)

        return add

    acc = F.slice("xs", 1, 0)
    for strict, cap, minutes in [*[(True, min(limit, slots), m) for m, slots in stages], (True, limit, None), (False, limit, None)]:
        ordered = ordered.withColumn("acc", F.aggregate("xs", acc, step(strict, cap, minutes)))
        acc = F.col("acc")
    return ordered.select(F.posexplode("acc").alias("pos", "x")).select((F.col("pos") + 1).alias("position"), F.col("x.cluster").alias("cluster"), F.col("x.publisher").alias("publisher"), F.col("x.primary_beat").alias("primary_beat"))


def curated_tiers(stories: DataFrame, now: Column) -> DataFrame:
    """The three lists of a report: must_know 10, important 30, watchlist 8."""
    tier = F.col("tier")
    top = select_diverse(stories, tier == "must_know", 10, now, [(120, 3), (24 * 60, 5)])
    rest = stories.join(top.select("cluster"), "cluster", "left_anti")
    important = select_diverse(rest, tier.isin("must_know", "important"), 30, now, [(120, 3), (24 * 60, 15)], start=top)
    left = rest.join(important.select("cluster"), "cluster", "left_anti")
    watch = select_diverse(left, (F.col("status") != "confirmed") & ((F.col("status") == "unverified") | (F.col("total") >= 35)), 8, now, [(120, 8), (24 * 60, 8)])
    named = [df.withColumn("list", F.lit(n)) for n, df in (("must_know", top), ("important", important), ("watchlist", watch))]
    return named[0].unionByName(named[1]).unionByName(named[2])


def build_report(candidates: DataFrame, sources: DataFrame, now: Column, prefs: C.Preferences | None = None) -> Report:
    """Everything a report holds."""
    # both hold texts, which as compressed columns take a fraction of a checkpoint
    gated, _ = E.stored(gate.with_reason(candidates, sources))  # read by clusters, cards, evidence and quality
    accepted = gate.accepted(gated)
    labels = E.clusters(accepted)
    evidence, stories = story_cards(accepted, labels, sources, now, prefs or C.Preferences())
    stories, _ = E.stored(stories)
    E.release(candidates.sparkSession)
    return Report(accepted, gated, evidence, stories, curated_tiers(stories, now))


def beat_sections(stories: DataFrame) -> DataFrame:
    """A row a story: its beat, the beat's place, and its position in rank order there; beats without stories give one row of nulls."""
    spark = stories.sparkSession
    beats = spark.createDataFrame([(b, i) for i, b in enumerate(C.CATEGORIES)], "primary_beat string, place int")
    ranked = stories.select("primary_beat", "cluster", "final_score", F.row_number().over(Window.partitionBy("primary_beat").orderBy(F.desc("final_score"), "cluster")).alias("position"))
    return beats.join(ranked.select("primary_beat", "position", "cluster"), "primary_beat", "left")


def coverage(candidates: DataFrame, stories: DataFrame, selected: DataFrame) -> DataFrame:
    """Candidates, stories and selected stories of every beat, zero beats included."""
    spark = stories.sparkSession
    beats = spark.createDataFrame([(b,) for b in C.CATEGORIES], "beat string")
    a = candidates.groupBy(F.col("primary_category").alias("beat")).agg(F.count("*").alias("candidate_count"))
    b = stories.groupBy(F.col("primary_beat").alias("beat")).agg(F.count("*").alias("story_count"))
    c = selected.groupBy(F.col("primary_beat").alias("beat")).agg(F.count("*").alias("selected_count"))
    return beats.join(a, "beat", "left").join(b, "beat", "left").join(c, "beat", "left").fillna(0)


def quality_summary(gated: DataFrame, stories: DataFrame, selected: DataFrame, now: Column) -> DataFrame:
    """One row of quality metrics (A08-A11); core stories are those of the must_know and important lists."""
    counts = gated.agg(F.count("*").alias("candidate_count"), F.count_if(F.col("reject_reason").isNull()).alias("accepted_candidate_count"))
    weak = (F.col("n_independent") <= 1) & ~(F.col("official") & (F.col("max_credibility") >= 80))
    single = F.count_if(F.col("n_independent") <= 1)
    all_stories = stories.agg(
        F.count("*").alias("event_count"), single.alias("single"), F.sum("members").alias("mapped"),
        F.count_if((F.col("activity") <= now) & (F.col("activity") >= now - F.expr("interval 24 hours"))).alias("day"), F.count_if((F.col("activity") <= now) & (F.col("activity") >= now - F.expr("interval 72 hours"))).alias("three"),
    )
    core = selected.where(F.col("list").isin("must_know", "important")).select("cluster", "publisher").join(stories.select("cluster", weak.alias("weak")), "cluster")
    biggest = core.groupBy("publisher").agg(F.count("*").alias("n"), F.count_if("weak").alias("weak")).agg(F.max("n").alias("most"), F.sum("n").alias("core"), F.sum("weak").alias("weak"))
    one = counts.join(F.broadcast(all_stories)).join(F.broadcast(biggest))  # one row each
    accepted = F.col("accepted_candidate_count")
    return one.select(
        "candidate_count", accepted, (F.col("candidate_count") - accepted).alias("rejected_candidate_count"), "event_count", F.col("event_count").alias("selected_event_count"),
        N.ratio(accepted - F.col("event_count"), accepted).alias("duplicate_event_rate"), N.ratio(F.col("single"), F.col("event_count")).alias("single_source_share"),
        N.ratio(F.coalesce("most", F.lit(0)), F.coalesce("core", F.lit(0))).alias("max_primary_publisher_share"), N.ratio(F.coalesce("weak", F.lit(0)), F.coalesce("core", F.lit(0))).alias("weakly_sourced_core_share"),
        F.when(F.col("day") > 0, F.col("day")).otherwise(F.col("three")).alias("latest_event_count"), (accepted - F.coalesce("mapped", F.lit(0))).alias("unmapped_candidate_count"),
    )
