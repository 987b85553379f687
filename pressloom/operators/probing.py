"""Ranks without a window over a whole group, and what is chosen by them: even samples and probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressloom.operators.graph import durable


def ranked(df: DataFrame, key: str, order: list[Column], rank: str = "rank", total: str = "total") -> DataFrame:
    """df with the place of every row in its group, from 0, and the group's size.

    Rows are dealt by ranges of (key, order), so that a group of any size is spread over tasks;
    each range is numbered on its own, and the rows of a group in earlier ranges are added.  Orders
    have to be total, or equal rows take either place.
    """
    dealt = durable(df.repartitionByRange(F.col(key), *order).withColumn("_part", F.spark_partition_id()))
    within = Window.partitionBy("_part", key).orderBy(*order)
    numbered = dealt.withColumn("_n", F.row_number().over(within) - 1)
    parts = dealt.groupBy(key, "_part").agg(F.count("*").alias("_size"))  # one row a group and range
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select(F.col(key).alias("_key"), F.col("_part").alias("_at"), before.alias("_before"), F.sum("_size").over(Window.partitionBy(key)).alias(total))
    joined = numbered.join(offsets, F.col("_key").eqNullSafe(F.col(key)) & (F.col("_at") == F.col("_part")))
    return joined.withColumn(rank, F.col("_n") + F.col("_before")).select(*df.columns, rank, total)


def sampled_evenly(rank: Column, total: Column, limit: Column) -> Column:
    """Whether a place is one of limit evenly spread ones of total; all, where they fit, and one at least."""
    step = (total - 1) / F.greatest(limit - 1, F.lit(1))
    nearest = F.floor(rank / F.greatest(step, F.lit(1e-9)) + 0.5)
    near = [F.floor((nearest + d) * (total - 1) / F.greatest(limit - 1, F.lit(1)) + 0.5) for d in (-1, 0, 1)]
    spread = F.exists(F.array(*near), lambda p: p == rank)
    return F.when(total <= limit, True).when(limit <= 1, rank == 0).otherwise(spread)


def even_sample(df: DataFrame, key: str, order: list[Column], limit: int) -> DataFrame:
    """At most limit rows of every group, evenly spread over its order."""
    return ranked(df, key, order).where(sampled_evenly(F.col("rank"), F.col("total"), F.lit(limit))).drop("rank", "total")


def probes(candidates: DataFrame, per_section: int, limit: int) -> DataFrame:
    """The candidates of every section whose pages are looked at.

    candidates: (section, ord, recency, feed, dated), ord the place in the section's listing, newest
    first, and recency null where unknown.  Of a feed: the first per_section dated ones, an even sample
    of the undated, and, where room is left, further dated ones.  Of a page: all if they fit, else an
    even sample of the newest moment's, and, where room is left, the next.
    """
    flat = candidates.withColumns({"_group": F.concat_ws("|", "section", F.when(F.col("feed"), F.col("dated").cast("string")))})
    places = ranked(flat, "_group", [F.col("ord")])
    sizes = places.groupBy("section").agg(
        F.count_if("dated").alias("n_dated"), F.count_if(~F.col("dated")).alias("n_undated"), F.count("*").alias("n"), F.min_by("recency", "ord").alias("newest"),
    )
    newest = candidates.join(sizes.select("section", "newest"), "section").where(F.col("recency").eqNullSafe(F.col("newest"))).groupBy("section").agg(F.count("*").alias("n_newest"))
    c = places.join(sizes.join(newest, "section"), "section")
    first = F.least(F.lit(per_section), F.col("n_dated"))
    room = F.lit(limit) - first
    undated = F.when(F.col("n_undated") <= room, F.col("n_undated")).otherwise(F.greatest(F.lit(1), room))
    of_feed = F.when(F.col("dated"), F.col("rank") < first + F.greatest(F.lit(0), F.lit(limit) - first - undated)).otherwise(sampled_evenly(F.col("rank"), F.col("n_undated"), undated))
    # a page's newest candidates come first in its order, so their places are the first ones
    crowded = sampled_evenly(F.col("rank"), F.col("n_newest"), F.lit(limit)) & (F.col("rank") < F.col("n_newest"))
    of_page = F.when(F.col("n") <= limit, True).when(F.col("n_newest") >= limit, crowded).otherwise(F.col("rank") < limit)
    return c.where(F.when(F.col("feed"), of_feed).otherwise(of_page)).select(*candidates.columns)
