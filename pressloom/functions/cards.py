"""Texts of story cards: key facts and what to watch next."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressloom import config as C
from pressloom.functions.text import let, normalize_text

#: What to watch, by status first, then by the type of the event.
WATCH_BY_STATUS = {"unverified": "等待独立可靠来源或官方信息确认。", "developing": "关注后续权威更新与关键事实是否发生变化。"}
WATCH_BY_TYPE = {
    "policy": "关注正式文本、执行时间与落地范围。", "conflict": "关注权威机构更新的影响范围与处置进展。", "disaster": "关注权威机构更新的影响范围与处置进展。", "economy": "关注后续数据、市场反馈与实际影响。",
    "company": "关注后续数据、市场反馈与实际影响。", "product": "关注可用范围、复现结果与后续验证。", "research": "关注可用范围、复现结果与后续验证。",
}
WATCH_ELSE = "关注事件是否出现实质性后续进展。"


def key_facts(summaries: Column, most: int = 3, size: int = 180) -> Column:
    """The first summaries that say something new: none of which the normalised text begins one kept before, or the reverse.

    White space is collapsed; a fact longer than size is cut two short of it and marked.
    """
    fact = lambda s: F.regexp_replace(F.regexp_replace(s, f"^{C.SPACES}+|{C.SPACES}+$", ""), f"{C.SPACES}+", " ")
    facts = F.filter(F.transform(summaries, fact), lambda f: f.isNotNull() & (f != ""))
    pairs = F.transform(facts, lambda f: F.struct(F.when(F.length(f) > size, F.concat(F.substring(f, 1, size - 2), F.lit("…"))).otherwise(f).alias("shown"), normalize_text(f).alias("plain")))

    def add(kept: Column, f: Column) -> Column:
        told = F.exists(kept, lambda k: F.startswith(k["plain"], f["plain"]) | F.startswith(f["plain"], k["plain"]))
        own = F.struct(f["shown"].alias("shown"), normalize_text(f["shown"]).alias("plain"))  # what is kept is compared as shown
        return F.when((F.size(kept) < most) & ~told, F.concat(kept, F.array(own))).otherwise(kept)

    none = F.array().cast("array<struct<shown:string,plain:string>>")
    return let(pairs, lambda p: F.transform(F.aggregate(p, none, add), lambda k: k["shown"]))


def next_watch(event_type: Column, status: Column) -> Column:
    """What a reader should look for next."""
    out = F.lit(WATCH_ELSE)
    for kind, text in WATCH_BY_TYPE.items():
        out = F.when(event_type == kind, text).otherwise(out)
    for state, text in WATCH_BY_STATUS.items():
        out = F.when(status == state, text).otherwise(out)
    return out
