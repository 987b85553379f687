"""Stored reports of either version as rows: version detection, expansion of the older form, back-fill.

Reports are JSON texts.  A text is read once as a variant, which tells its version; what is missing
or of another kind falls through to the next form, and a text in no form to the fixed report that is
handed in.  Lists become rows by position, never by name alone, so repeated entries stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ITEM = "id string, title string, url string, sourceId string, sourceName string, primaryCategory string, summary string, publishedAt string, updatedAt string, startedAt string, extractedAt string, sourceIds array<string>, sourceNames array<string>, relatedUrls array<string>"
STORY = "id string, itemId string, publishedAt string, updatedAt string, startedAt string, evidence array<struct<publishedAt string>>"


V2_LISTS = ("items", "stories", "topStories", "importantStories", "watchlist", "sections")


def _kind(path: str) -> Column:
    """The kind of what a path of the report leads to: OBJECT, ARRAY, STRING, ... or null."""
    return F.regexp_extract(F.schema_of_variant(F.expr(f"try_variant_get(v, '$.{path}', 'variant')")), "^[A-Z]+", 0)


def versioned(reports: DataFrame, text: str = "text") -> DataFrame:
    """reports with form: v2, v1 or none, and the variant v.

    v2 says so, names a readable time and has all lists, coverage and quality of that version; v1 is
    any other object with a list of items that is not empty.
    """
    rows = reports.withColumn("v", F.try_parse_json(text))
    many = F.coalesce(F.size(F.expr("try_variant_get(v, '$.items', 'array<variant>')")) > 0, F.lit(False))
    lists = reduce(lambda a, p: a & (_kind(p) == "ARRAY"), V2_LISTS, F.lit(True))
    parts = reduce(lambda a, p: a & ~_kind(p).isin("", "VOID"), ("coverage", "quality"), F.lit(True))
    dated = (_kind("generatedAt") == "STRING") & _moment(F.expr("try_variant_get(v, '$.generatedAt', 'string')")).isNotNull()
    second = (_kind("version") != "STRING") & (F.expr("try_variant_get(v, '$.version', 'double')") == 2) & dated & lists & parts
    return rows.withColumn("form", F.when(F.coalesce(second, F.lit(False)), "v2").when(F.coalesce(_kind("items") == "ARRAY", F.lit(False)) & many, "v1").otherwise("none"))


def _list(path: str, shape: str) -> Column:
    return F.from_json(F.to_json(F.expr(f"try_variant_get(v, '$.{path}', 'variant')")), f"array<struct<{', '.join(f'{f.split(chr(32), 1)[0]}: {f.split(chr(32), 1)[1]}' for f in shape.split(', '))}>>")


def expanded_items(reports: DataFrame, key: str) -> DataFrame:
    """One row a source of every item of a v1 report (S15), in the order of the lists.

    Lists of an item that are missing or empty stand for its single fields; a name or URL that a
    list is too short for is the item's.
    """
    items = reports.where("form = 'v1'").select(key, F.posexplode(_list("items", ITEM)).alias("place", "i"))
    i = lambda f: F.col(f"i.{f}")
    or_single = lambda many, one: F.when(F.size(many) > 0, many).otherwise(F.array(one))
    rows = items.select("*", F.posexplode(or_single(i("sourceIds"), i("sourceId"))).alias("at", "source_id"))
    names, urls = or_single(i("sourceNames"), i("sourceName")), or_single(i("relatedUrls"), i("url"))
    several = F.size(or_single(i("sourceIds"), i("sourceId"))) > 1
    return rows.select(
        key, "place", "at", F.when(several, F.concat(i("id"), F.lit("-evidence-"), F.col("at") + 1)).otherwise(i("id")).alias("id"), i("title").alias("title"), F.coalesce(F.get(urls, F.col("at")), i("url")).alias("url"),
        "source_id", F.coalesce(F.get(names, F.col("at")), i("sourceName")).alias("source_name"), i("primaryCategory").alias("primary_category"), i("summary").alias("summary"), i("publishedAt").alias("published_at"), i("extractedAt").alias("extracted_at"),
    )


def _moment(text: Column) -> Column:
    return F.try_to_timestamp(text)


def normalised_items(reports: DataFrame, key: str) -> DataFrame:
    """The items of v2 reports with started_at and updated_at filled in from their story, else from their own times.

    A story that tells no start began with the earliest of its own and its evidence's publication and its update.
    """
    v2 = reports.where("form = 'v2'")
    stories = v2.select(key, F.posexplode(_list("stories", STORY.replace("evidence array<struct<publishedAt string>>", "evidence array<struct<publishedAt: string>>"))).alias("p", "s"))
    s = lambda f: F.col(f"s.{f}")
    times = F.filter(F.transform(F.concat(F.array(s("publishedAt"), s("updatedAt")), F.coalesce(F.transform(s("evidence"), lambda e: e["publishedAt"]), F.array().cast("array<string>"))), _moment), lambda t: t.isNotNull())
    told = stories.select(key, "p", s("itemId").alias("item"), _moment(s("updatedAt")).alias("story_updated"), F.coalesce(_moment(s("startedAt")), F.array_min(times)).alias("story_started"))
    last = told.groupBy(key, "item").agg(F.max_by(F.struct("story_updated", "story_started"), "p").alias("s"))
    items = v2.select(key, F.posexplode(_list("items", ITEM)).alias("place", "i"))
    j = items.join(last.withColumnsRenamed({key: "_k", "item": "_i"}), (F.col("_k") == F.col(key)) & (F.col("_i") == F.col("i.id")), "left")
    own = lambda f: _moment(F.col(f"i.{f}"))
    updated = F.coalesce(own("updatedAt"), F.col("s.story_updated"), own("publishedAt"), own("extractedAt"))
    started = F.coalesce(own("startedAt"), F.col("s.story_started"), own("publishedAt"), updated)
    return j.select(key, "place", F.col("i.id").alias("id"), F.col("i.title").alias("title"), F.col("i.url").alias("url"), F.col("i.sourceId").alias("source_id"), updated.alias("updated_at"), started.alias("started_at"))
