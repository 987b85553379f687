"""Explainable scores of a candidate or event as plain expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressloom import config as C
from pressloom.functions.numbers import clamp
from pressloom.functions.text import information_length, is_informative


def _lookup(table: dict, key: Column, default=None) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def _any(text: Column, words) -> Column:
    return reduce(lambda a, w: a | F.contains(text, F.lit(w)), words, F.lit(False))


def _found(text: Column, pattern: str) -> Column:
    """text.rlike of a pattern that lists plain words, "(a|b|c)": searched as bytes, without trying every word at every character."""
    words = pattern.removeprefix("(").removesuffix(")").split("|")
    if not (pattern.startswith("(") and pattern.endswith(")")) or any(not w or re.search(r"[^\w ]", w) for w in words):
        return text.rlike(pattern)
    return _any(text, words)


def public_importance(categories: Column, text: Column, n_sources: Column) -> Column:
    base = F.aggregate(categories, F.lit(50), lambda a, c: F.greatest(a, _lookup(C.CATEGORY_IMPORTANCE, c, 50)))
    return clamp(base + F.when(_any(text, C.HIGH_IMPACT), 12).otherwise(0) + F.least(F.lit(12), 6 * (n_sources - 1)))


def user_preference(categories: Column, text: Column, source_ids: Column, p: C.Preferences) -> Column:
    preferred = F.size(F.filter(categories, lambda c: c.isin(*p.categories)))
    boosted = reduce(lambda a, w: a + F.contains(text, F.lit(w)).cast("int"), p.boosted, F.lit(0))
    bonus = F.aggregate(source_ids, F.lit(0), lambda a, s: a + _lookup(p.source_bonus, s, 0))
    return F.when(_any(text, p.blocked), 0).otherwise(clamp(45 + 30 * preferred + 10 * boosted + bonus))


def timeliness(published_at: Column, now: Column) -> Column:
    hours = (F.unix_timestamp(now) - F.unix_timestamp(published_at)) / 3600.0
    out = F.lit(20)
    for limit, score in ((48, 42), (24, 65), (12, 78), (6, 90), (1, 100)):
        out = F.when(hours <= limit, score).otherwise(out)
    return F.when(published_at.isNull(), 45).otherwise(out)


def source_confidence(n_sources: Column) -> Column:
    return clamp(60 + F.least(F.lit(12), 6 * (n_sources - 1)))


def content_quality(summary: Column, published_at: Column, url: Column, paywall: Column) -> Column:
    return clamp(
        F.when(F.trim(summary) != "", 50).otherwise(30) + F.least(F.lit(30), F.floor(information_length(summary) / 12))
        + F.when(published_at.isNotNull(), 10).otherwise(0) + F.when(F.trim(url) != "", 10).otherwise(0) - F.when(paywall, 8).otherwise(0)
    )


def final_score(importance: Column, preference: Column, time: Column, confidence: Column, quality: Column) -> Column:
    w = C.WEIGHTS
    return clamp(importance * F.lit(w["public_importance"]) + preference * F.lit(w["user_preference"]) + time * F.lit(w["timeliness"]) + confidence * F.lit(w["source_confidence"]) + quality * F.lit(w["content_quality"]))


def trust_score(avg_credibility: Column, official: Column, wire: Column, social: Column, n_sources: Column, published_at: Column, summary: Column, paywall: Column, blank: Column) -> Column:
    score = (
        F.lit(35.0) + (avg_credibility - 50) * 0.55 + F.when(official, 18).otherwise(0) + F.when(wire, 16).otherwise(0) - F.when(social, 16).otherwise(0)
        + F.when(n_sources > 1, F.least(F.lit(18), 8 * (n_sources - 1))).otherwise(0) + F.when(published_at.isNotNull(), 6).otherwise(-8)
        + F.when(is_informative(summary), 6).otherwise(-8) - F.when(paywall, 4).otherwise(0)
    )
    return F.when(blank, 0).otherwise(clamp(score))


def trust_level(score: Column) -> Column:
    return F.when(score >= 75, "high").when(score >= 50, "medium").otherwise("low")


def event_type(text: Column, beat: Column) -> Column:
    out = _lookup(C.BEAT_EVENT_TYPES, beat, "general")
    for name, pattern in reversed(C.EVENT_TYPES):
        out = F.when(_found(text, pattern), name).otherwise(out)
    return out


def public_impact(text: Column, beat: Column, kind: Column) -> Column:
    score = _lookup(C.BEAT_IMPACT, beat, 0)
    for boost, pattern in C.IMPACT_BOOSTS:
        score = score + F.when(_found(text, pattern), boost).otherwise(0)
    score = score + _lookup(C.EVENT_BOOSTS, kind, 0) - F.when(_found(text, C.OPINION), 15).otherwise(0)
    score = score - F.when(_found(text, C.LOCAL) & (kind != "disaster"), 8).otherwise(0)
    return clamp(score - F.when((beat == "sports") & ~_found(text, C.SPORT_PEAK), 8).otherwise(0))


def total_importance(impact: Column, time: Column) -> Column:
    return clamp(impact * F.lit(0.8) + time * F.lit(0.2))


def tier(impact: Column, total: Column, beat: Column) -> Column:
    return (
        F.when((impact >= 82) & (total >= 76), "must_know").when((impact >= 58) & (total >= 58), "important")
        .when(((impact >= 36) & (total >= 40)) | (beat.isin("sports", "entertainment") & (total >= 25)), "special_interest").otherwise("noise")
    )


def evidence_role(media_type: Column) -> Column:
    return _lookup({"official": "original", "wire": "confirmation", "social": "lead", "technology": "analysis", "business": "analysis"}, media_type, "context")


def story_status(role: Column, n_evidence: Column, n_independent: Column, level: Column, credibility: Column) -> Column:
    """Unverified for a single lead, confirmed with two groups, high trust or a strong source, else developing."""
    return F.when((role == "lead") & (n_evidence == 1), "unverified").when((n_independent >= 2) | (level == "high") | (credibility >= 80), "confirmed").otherwise("developing")
