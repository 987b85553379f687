"""Integrity of reports held as flat tables, and their compact form and back.

All rules on single rows are read in one scan a table.  All rules on references are read in one
shuffle: every definition and every use of an id becomes a row (report, kind, key, how), and one
aggregation by key tells what is defined twice, used without a definition or never used.

Tables: reports (report, version, generated_at, item_count, accepted, source_count, unmapped),
items (report, item), stories (report, story, item, title, started_at, updated_at, digest),
evidence (report, story, candidate, source, url, published_at), lists (report, list, pos, story,
digest) and sections (report, section, story).  A digest stands for all that a card shows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.functions import urls as U
from pressloom.operators.graph import durable

LATEST = "latest"


@dataclass(frozen=True)
class Tables:
    reports: DataFrame
    items: DataFrame
    stories: DataFrame
    evidence: DataFrame
    lists: DataFrame
    sections: DataFrame


def _codes(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """report, rule, key of every rule that a row breaks; key is the row's own."""
    failed = F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(rule)) for rule, broken in rules.items()]))
    return rows.select("report", F.explode(failed).alias("rule"), "key")


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (F.col(c) == "")


def latest(stories: DataFrame, reports: DataFrame) -> DataFrame:
    """report, story, updated_at of the newest stories: those of 24 hours, or of 72 where there are none."""
    at = stories.join(reports.select("report", "generated_at"), "report").where(F.col("updated_at") <= F.col("generated_at"))
    age = F.col("generated_at").cast("timestamp") - F.col("updated_at").cast("timestamp")
    at = at.withColumn("day", age <= F.expr("interval 24 hours")).where(age <= F.expr("interval 72 hours"))
    has_day = at.groupBy("report").agg(F.bool_or("day").alias("has_day"))
    return at.join(has_day, "report").where(F.col("day") | ~F.col("has_day")).select("report", "story", "updated_at")


def _id_lists(rows: DataFrame) -> DataFrame:
    """report, ids: the ids of latest stories in order of time and id."""
    return rows.groupBy("report").agg(F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("updated_at").cast("timestamp"))).alias("t"), "story"))).alias("x")).select("report", F.transform("x", lambda s: s["story"]).alias("ids"))


def violations(t: Tables, sources: DataFrame) -> DataFrame:
    """report, rule, key: every broken rule with the key that breaks it; sources: (source, host) of the approved ones."""
    report_key = F.lit("").alias("key")
    row_rules = _codes(t.reports.select("*", report_key), {
        "unsupported_schema_version": F.coalesce(F.col("version") != 2, F.lit(True)), "invalid_generated_at": F.col("generated_at").isNull(),
        "empty_sources": F.coalesce(F.col("source_count") < 1, F.lit(True)), "unmapped_candidates": F.coalesce(F.col("unmapped") != 0, F.lit(True)),
    })
    items = _codes(t.items.select("*", F.col("item").alias("key")), {"duplicate_or_missing_item_id": _blank("item")})
    stories = _codes(t.stories.select("*", F.col("story").alias("key")), {
        "duplicate_or_missing_story_id": _blank("story"), "invalid_story_item_reference": _blank("item"),
        "invalid_story_time_relation": F.coalesce(F.col("started_at") > F.col("updated_at"), F.lit(True)),
    })
    known = t.evidence.join(t.stories.select("report", "story", "updated_at"), ["report", "story"], "left").join(sources.select("source", "host"), "source", "left")
    place = U.authority(F.col("url"))
    scoped = U.is_secure_source_url(F.col("url")) & ((place == F.col("host")) | F.endswith(place, F.concat(F.lit("."), "host")))
    evidence = _codes(known.select("*", F.col("candidate").alias("key")), {
        "duplicate_or_missing_candidate_mapping": _blank("candidate"), "unapproved_evidence_source": F.col("host").isNull(),
        "evidence_url_out_of_scope": F.col("host").isNotNull() & ~F.coalesce(scoped, F.lit(False)), "invalid_story_url": ~(U.is_url(F.col("url")) & (U.scheme(F.col("url")) == "https")),
        "invalid_evidence_time_relation": F.col("published_at") > F.col("updated_at"),
    })

    uses = lambda df, kind, key, how, digest=None: df.select(
        "report", F.lit(kind).alias("kind"), F.coalesce(F.col(key), F.lit("")).alias("key"), F.lit(how).alias("how"), (F.col(digest) if digest else F.lit(None).cast("string")).alias("digest"))
    rows = uses(t.items, "item", "item", "made").unionByName(uses(t.stories, "item", "item", "used")).unionByName(uses(t.stories, "story", "story", "made", "digest"))
    rows = rows.unionByName(uses(t.lists, "story", "story", "listed", "digest")).unionByName(uses(t.sections, "story", "story", "sectioned")).unionByName(uses(t.evidence, "story", "story", "proven"))
    rows = rows.unionByName(uses(t.evidence, "candidate", "candidate", "made")).unionByName(uses(t.evidence, "source", "source", "made"))
    n = lambda how: F.count_if(F.col("how") == how).alias(how)
    keyed = rows.groupBy("report", "kind", "key").agg(
        *[n(h) for h in ("made", "used", "listed", "sectioned", "proven")],
        F.count_if((F.col("how") == "listed")).alias("copies"), F.min(F.when(F.col("how") == "listed", F.coalesce("digest", F.lit("")))).alias("low"),
        F.max(F.when(F.col("how") == "listed", F.coalesce("digest", F.lit("")))).alias("high"), F.max(F.when(F.col("how") == "made", F.coalesce("digest", F.lit("")))).alias("own"),
    )
    keyed = durable(keyed)  # read for its own rules and for the reports' counts
    kind, real = F.col("kind"), F.col("key") != ""
    by_key = _codes(keyed, {
        "duplicate_or_missing_item_id": (kind == "item") & real & (F.col("made") > 1), "duplicate_or_missing_story_id": (kind == "story") & real & (F.col("made") > 1),
        "duplicate_or_missing_candidate_mapping": (kind == "candidate") & real & (F.col("made") > 1),
        "invalid_story_item_reference": (kind == "item") & real & ((F.col("used") > 1) | ((F.col("used") > 0) & (F.col("made") == 0))),
        "missing_story_evidence": (kind == "story") & (F.col("made") > 0) & (F.col("proven") == 0),
        "dangling_story_reference": (kind == "story") & (F.col("listed") > 0) & (F.col("made") == 0), "dangling_section_reference": (kind == "story") & (F.col("sectioned") > 0) & (F.col("made") == 0),
        "inconsistent_story_reference": (kind == "story") & (F.col("listed") > 0) & ((F.col("made") == 0) | (F.col("low") != F.col("own")) | (F.col("high") != F.col("own"))),
    })
    per = lambda k, c: F.count_if((kind == k) & (F.col(c) > 0)).alias(f"{k}_{c}")
    totals = keyed.groupBy("report").agg(per("item", "made"), per("item", "used"), per("story", "made"), per("candidate", "made"), per("source", "made"))
    counted = t.reports.join(totals, "report", "left").fillna(0, ["item_made", "item_used", "story_made", "candidate_made", "source_made"])
    by_report = _codes(counted.select("*", report_key), {
        "empty_items": F.col("item_made") == 0, "empty_stories": F.col("story_made") == 0, "unmapped_report_item": F.col("item_made") != F.col("item_used"),
        "candidate_mapping_count_mismatch": F.coalesce(F.col("accepted") != F.col("candidate_made"), F.lit(True)), "source_count_mismatch": F.coalesce(F.col("source_count") != F.col("source_made"), F.lit(True)),
    })

    none = F.array().cast("array<string>")
    want = _id_lists(latest(t.stories, t.reports)).withColumnRenamed("ids", "want")
    told = in_order(t.lists.where(F.col("list") == LATEST)).select("report", F.transform("cards", lambda c: c["story"]).alias("told"))
    shown = t.reports.select("report").join(want, "report", "left").join(told, "report", "left")
    newest = _codes(shown.select("report", F.lit("").alias("key"), "want", "told"), {"incomplete_latest_stories": F.coalesce("want", none) != F.coalesce("told", none)})

    back = hydrated(compact(t.lists), t.stories)
    same = in_order(t.lists).withColumnRenamed("cards", "before").join(in_order(back).withColumnRenamed("cards", "after"), ["report", "list"], "left")
    trip = _codes(same.select("report", F.col("list").alias("key"), "before", "after"), {"compact_round_trip_mismatch": F.col("after").isNull() | (F.col("before") != F.col("after"))})
    out = row_rules
    for part in (items, stories, evidence, by_key, by_report, newest, trip):
        out = out.unionByName(part)
    return out.select("report", "rule", F.coalesce("key", F.lit("")).alias("key")).distinct()


def in_order(lists: DataFrame) -> DataFrame:
    """report, list, cards: the cards of every list by position."""
    cards = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("story", F.lit("")).alias("story"), F.coalesce("digest", F.lit("")).alias("digest"))))
    grouped = lists.groupBy("report", "list").agg(cards.alias("cards"))
    return grouped.select("report", "list", F.transform("cards", lambda c: F.struct(c["story"], c["digest"])).alias("cards"))


def compact(lists: DataFrame) -> DataFrame:
    """report, list, ids: lists as ids alone, in order; the cards are told once, with the stories."""
    return in_order(lists).select("report", "list", F.transform("cards", lambda c: c["story"]).alias("ids"))


def hydrated(compacted: DataFrame, stories: DataFrame) -> DataFrame:
    """report, list, pos, story, digest: lists of ids with their cards again, ids without a story dropped.

    Of stories that share an id the last by digest counts.
    """
    cards = stories.where(~_blank("story")).groupBy("report", "story").agg(F.max("digest").alias("digest"))
    ids = compacted.select("report", "list", F.posexplode("ids").alias("at", "story"))
    return ids.join(cards, ["report", "story"]).select("report", "list", F.col("at").alias("pos"), "story", "digest")
