"""The quality gate: ordered reasons for rejection, degradation and default states."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom import config as C
from pressloom.functions import text as X
from pressloom.functions import urls as U


def is_promotion(text: Column) -> Column:
    """Advertising in a text (F07); a pattern is only tried where one of the words that it needs occurs."""
    low = F.lower(text)
    tried = [reduce(lambda a, w: a | F.contains(low, F.lit(w)), words, F.lit(False)) & text.rlike(p) for p, words in zip(C.PROMOTION, C.PROMOTION_WORDS, strict=True)]
    return reduce(lambda a, b: a | b, tried)


def with_reason(candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """Candidates joined with their source (F01-F07); reject_reason is null for accepted rows.

    The registry is one small row a source; whether it is broadcast is left to its size.
    """
    url, title, authority = F.col("url"), F.col("title"), U.authority(F.col("url"))
    in_scope = U.is_secure_source_url(url) & ((authority == F.col("allowed_host")) | F.endswith(authority, F.concat(F.lit("."), "allowed_host")))
    reason = (
        F.when((F.trim(title) == "") | (F.trim(url) == ""), "missing_identity")
        .when(~U.is_url(url) | ~U.scheme(url).isin("http", "https"), "invalid_url")
        .when(U.is_navigation(url), "navigation_page")
        .when(~F.coalesce(F.col("approved"), F.lit(False)), "unapproved_source")
        .when(~in_scope, "source_url_out_of_scope")
        .when(is_promotion(F.concat_ws(" ", "title", "summary")), "promotional")
    )
    return candidates.join(sources, "source_id", "left").withColumn("reject_reason", reason)


def accepted(gated: DataFrame) -> DataFrame:
    """Accepted rows with degradation reasons and default states."""
    same = X.normalize_text(F.col("summary")) == X.normalize_text(F.col("title"))
    reasons = F.array_compact(F.array(
        F.when(F.col("published_at").isNull(), "missing_published_at"),
        F.when((F.trim("summary") == "") | same, "insufficient_summary"),
        F.when(F.col("summary").rlike("相关报道聚焦.+具体背景.+以原文披露为准"), "template_summary"),
    ))
    return gated.where("reject_reason IS NULL").drop("reject_reason").withColumn("degradation", reasons).withColumns({
        "quality_status": F.when(F.size("degradation") > 0, "degraded").otherwise("accepted"),
        "time_status": F.when(F.col("published_at").isNull(), "unknown").otherwise("published"),
        "summary_status": F.when(F.array_contains("degradation", "insufficient_summary"), "pending").otherwise("original"),
    })


def recent(df: DataFrame, now: Column, hours: int) -> DataFrame:
    """Rows whose activity is at most hours old and not in the future."""
    return df.where((F.col("published_at") <= now) & (F.col("published_at") >= now - F.make_interval(hours=F.lit(hours))))


def keep_first(df: DataFrame, *keys: str, order: str = "ord") -> DataFrame:
    """The first row of each key in input order."""
    best = df.groupBy(*keys).agg(F.min(order).alias(order))  # aggregated before the shuffle, unlike a window
    return df.join(best, [*keys, order], "left_semi")
