"""Dates and texts of pages: linked data of any depth, meta, time tags and inline dates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom import config as C
from pressloom.functions import dates as D
from pressloom.functions import html as H
from pressloom.operators.graph import durable


def linked_values(scripts: DataFrame, keys: list[str]) -> DataFrame:
    """page, script, path, value: the string values of keys anywhere in JSON texts (page, script, text).

    An object's own keys come first, in the order of keys, then its members in the order
    written, each with all below it; path sorts that way.  One pass a level of nesting, over
    the nodes of that level alone.  Variants tell the types; the order of members, which
    variants do not keep, comes from the text of each node read as a map of raw texts.
    Texts that are no JSON give no row.
    """
    nodes = scripts.select("page", "script", F.array().cast("array<int>").alias("path"), "text", F.try_parse_json("text").alias("v")).where("v IS NOT NULL")
    found = None
    while True:
        kind = F.schema_of_variant("v")
        nodes = durable(nodes.withColumn("kind", F.when(F.startswith(kind, F.lit("OBJECT")), "object").when(F.startswith(kind, F.lit("ARRAY")), "array")).where("kind IS NOT NULL"))
        if nodes.isEmpty():
            break
        members = nodes.sparkSession.sql("SELECT n.page, n.script, n.path, n.kind, n.text, e.pos, e.key, e.value AS v FROM {nodes} n, LATERAL variant_explode(n.v) e", nodes=nodes)
        own = F.array_position(F.array(*[F.lit(k) for k in keys]), F.col("key"))
        text = F.expr("try_variant_get(v, '$', 'string')")
        hit = members.where((F.col("kind") == "object") & (own > 0) & (F.schema_of_variant("v") == "STRING"))
        hit = hit.select("page", "script", F.concat("path", F.array((own - 1 - len(keys)).cast("int"))).alias("path"), text.alias("value"))
        found = hit if found is None else found.unionByName(hit)
        as_map, as_list = F.from_json("text", "map<string,string>"), F.from_json("text", "array<string>")
        of_object = F.col("kind") == "object"
        place = F.when(of_object, F.array_position(F.map_keys(as_map), F.col("key")) - 1).otherwise(F.col("pos")).cast("int")
        inner = F.when(of_object, F.get(F.map_values(as_map), place)).otherwise(F.get(as_list, F.col("pos")))
        nodes = members.select("page", "script", F.concat("path", F.array(place)).alias("path"), inner.alias("text"), "v")
    empty = scripts.sparkSession.createDataFrame([], "page long, script int, path array<int>, value string")
    return found if found is not None else empty


def _linked(pages: DataFrame, keys: list[str], text, fallback: str, least: int) -> DataFrame:
    """page, values: what linked data scripts say under keys, in order; a script that is no JSON is searched by pattern."""
    scripts = pages.select(F.col("page_id").alias("page"), F.posexplode(H.linked_data(F.col("html"))).alias("script", "raw"))
    scripts = durable(scripts.select("page", "script", text(F.col("raw")).alias("text")))
    good = linked_values(scripts, keys)
    broken = scripts.where(F.try_parse_json("text").isNull()).select("page", "script", F.posexplode(F.regexp_extract_all("text", F.lit(fallback), 1)).alias("i", "value"))
    rows = good.unionByName(broken.select("page", "script", F.array("i").alias("path"), "value")).where(F.length("value") >= least)
    rows = rows.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("script", "path", "value"))).alias("v"))
    return rows.select("page", F.transform("v", lambda s: s["value"]).alias("values"))


def linked_dates(pages: DataFrame) -> DataFrame:
    return _linked(pages, C.LINKED_DATES, H.clean, r'(?i)"date(?:Published|Created|Modified)"\s*:\s*"([^"]+)"', 1)


def linked_texts(pages: DataFrame) -> DataFrame:
    found = _linked(pages, C.LINKED_TEXTS, H.squeezed, r'(?i)"(?:description|articleBody)"\s*:\s*"([^"]{40,})"', 1)
    return found.select("page", F.filter(F.transform("values", H.clean), lambda t: F.length(t) >= 40).alias("values"))


def page_dates(pages: DataFrame) -> DataFrame:
    """page_id and its publication time (S12): inline dates, time tags, linked data, then meta.

    Those with a clock time go first; the first that can be read counts, and where none can,
    the date in the URL.
    """
    rows = pages.join(linked_dates(pages).withColumnRenamed("page", "page_id"), "page_id", "left")
    linked = F.coalesce("values", F.array().cast("array<string>"))
    html = F.col("html")
    candidates = F.concat(H.inline_dates(html), H.time_tag_dates(html), linked, H.meta_dates(html))
    rows = rows.select("page_id", "url", candidates.alias("candidates"))
    return rows.select("page_id", D.first_parsed(F.col("candidates")).alias("named"), "url", F.size("candidates").alias("n_candidates"))


def resolved_date(own, named, from_url):
    """A candidate's own date, else its page's, else its URL's."""
    return F.coalesce(own, named, from_url)


def contexts(pages: DataFrame, cap: int = 3200) -> DataFrame:
    """page_id and what a summary can be made from."""
    rows = pages.join(linked_texts(pages).withColumnRenamed("page", "page_id"), "page_id", "left")
    linked = F.coalesce("values", F.array().cast("array<string>"))
    return rows.select("page_id", H.article_context(F.col("html"), linked, cap).alias("context"))


def summary_from_context(title, context):
    """The first line of at least 30 characters that says more than the title, at most 120 long, where the context is Chinese."""
    from pressloom.functions.text import needs_repair

    lines = F.filter(F.transform(F.split(context, "\n+"), H.clean), lambda t: (F.length(t) >= 30) & ~needs_repair(title, t))
    first = F.get(lines, F.lit(0))
    return F.when(context.rlike("[一-鿿]"), F.when(F.length(first) > 120, F.concat(F.substring(first, 1, 118), F.lit("..."))).otherwise(first))


def minimal_summary(title):
    """What stands in for a missing summary."""
    return F.concat(F.lit("相关报道聚焦“"), title, F.lit("”，具体背景、影响和后续进展以原文披露为准。"))
