"""Mixing sources to target weights by Sainte-Lague apportionment.

Every source gets a word target (its weight's share of all words, at most
``max_repeat`` times its own size, the excess shared again by weight).  Targets
become whole blocks of ``block_words`` words by the Sainte-Lague rule (highest
quotients target / (2 s + 1)), first over the sources, then over the shards of
each source.  A shard lays its documents out in a seeded order and takes whole
passes plus a seeded, evenly spread choice of its blocks.

Defined cases: a null text has size 0 and takes 0 words; a null source is a
source of its own, ordered last; a null id is mixed like any other document;
repeated rows are separate documents; an empty table gives an empty result;
other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pressloom.llm.durable import durable

WORD = r"[^\x20\x09-\x0D]+"


def sainte_lague(votes: np.ndarray, seats: int) -> np.ndarray:
    """Seats for each vote by highest quotients votes / (2 s + 1); ties go to the earlier entry."""
    votes = np.asarray(votes, dtype=np.float64)
    out = np.zeros(len(votes), dtype=np.int64)
    total = votes.sum()
    if seats <= 0 or total <= 0:
        return out
    # Bisection for the largest factor that gives no seat too many; the rest are ties of the next quotient.
    low, high = 0.0, 2.0 * (seats + len(votes)) / total
    for _ in range(200):
        middle = (low + high) / 2
        if np.floor(votes * middle + 0.5).sum() <= seats:
            low = middle
        else:
            high = middle
    out = np.floor(votes * low + 0.5).astype(np.int64)
    while (rest := seats - int(out.sum())) > 0:
        best = np.lexsort((np.arange(len(votes)), -votes / (2 * out + 1)))
        best = best[votes[best] > 0]
        out[best[:rest]] += 1
    while True:  # exchange until no source's next quotient beats another's last one
        nxt = np.where(votes > 0, votes / (2 * out + 1), -1.0)
        last = np.where(out > 0, votes / np.maximum(2 * out - 1, 1), np.inf)
        to, frm = int(np.argmax(nxt)), len(last) - 1 - int(np.argmin(last[::-1]))
        if nxt[to] > last[frm] or (nxt[to] == last[frm] and to < frm):
            out[to] += 1
            out[frm] -= 1
        else:
            return out


def capped_targets(weights: np.ndarray, sizes: np.ndarray, max_repeat: int) -> np.ndarray:
    """Shares of all words by weight, each at most max_repeat times its size, the excess shared again."""
    total = int(sizes.sum())
    caps = sizes * max_repeat
    order = np.argsort(caps / weights, kind="stable")
    left, w_left = total, int(weights.sum())
    level = 0.0
    for i in order:
        level = left / w_left
        if caps[i] / weights[i] >= level:
            break
        left -= int(caps[i])
        w_left -= int(weights[i])
    return np.where(caps / weights < level, caps.astype(np.float64), weights * level)


def mix_to_weights(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    max_repeat: int = 3,
    block_words: int = 64,
    shard_words: int = 1 << 20,
    seed: str = "mix-1",
    salts: int = 64,
    chosen: bool = False,
) -> DataFrame:
    """One row per document: its id, source, size, source_size, target and the words taken.

    With chosen also how these words come about: passes (whole copies) and chosen, the word ranges
    [first, stop) of the document that lie in chosen blocks of its shard, in order.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))
    sized = durable(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            key.alias("key"),
            F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("draw"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        )
    )
    sources = sized.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))

    def plan(batches):
        # one row per source (not per document): ordered by code point, null last
        got = [b for b in batches if len(b)]
        if not got:
            return
        t = pd.concat(got)
        t = t.iloc[sorted(range(len(t)), key=lambda i: (t["key"].iloc[i] == "n", t["key"].iloc[i]))].reset_index(drop=True)
        w = np.array([weights[i % len(weights)] for i in range(len(t))], dtype=np.int64)
        sizes = t["source_size"].to_numpy(np.int64)
        target = capped_targets(w, sizes, max_repeat)
        seats = sainte_lague(target, int(sizes.sum()) // block_words)
        yield pd.DataFrame({
            "key": t["key"], "source_size": sizes, "target": target, "seats": seats,
            "n_shards": 1 + sizes // shard_words,
        })

    planned = durable(
        sources.select("key", "source_size").repartition(1)
        .mapInPandas(plan, "key string, source_size long, target double, seats long, n_shards long")
    )
    # A source may hold a third of all rows: its one row of the plan is repeated so that its documents meet it in many tasks.
    spread = planned.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = sized.withColumn("salt", F.pmod(F.xxhash64("draw", "size"), F.lit(salts)).cast("int"))
    drawn = salted.join(spread, ["key", "salt"]).drop("salt").withColumn(
        "shard", F.conv(F.substring("draw", 1, 8), 16, 10).cast("long") % F.col("n_shards")
    )
    shards = drawn.groupBy("key", "shard").agg(F.sum("size").alias("shard_size"), F.first("seats").alias("seats"))

    def quotas(group: pd.DataFrame) -> pd.DataFrame:
        # the shards of one source: at most source_size / shard_words + 1 rows
        group = group.sort_values("shard").reset_index(drop=True)
        group["quota"] = sainte_lague(group["shard_size"].to_numpy(np.float64), int(group["seats"].iloc[0]))
        return group[["key", "shard", "shard_size", "quota"]]

    q = shards.groupBy("key").applyInPandas(quotas, "key string, shard long, shard_size long, quota long")
    q = durable(q.withColumns({
        "want": F.least(F.col("quota") * block_words, F.col("shard_size") * max_repeat),
        "blocks": F.ceil(F.col("shard_size") / block_words),
        "start": F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "key", "shard")), 1, 8), 16, 10).cast("long"),
    }).select(
        "key", "shard", "blocks",
        F.when(F.col("shard_size") > 0, F.floor(F.col("want") / F.col("shard_size"))).otherwise(0).alias("passes"),
        F.when(F.col("shard_size") > 0, F.floor(F.expr(f"want % shard_size / {block_words}D + 0.5"))).otherwise(0).alias("picks"),
        F.when(F.col("blocks") > 0, F.col("start") % F.col("blocks")).otherwise(0).alias("offset"),
    ))
    w = Window.partitionBy("key", "shard").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = drawn.join(q, ["key", "shard"]).withColumn("hi", F.sum("size").over(w)).withColumn("lo", F.col("hi") - F.col("size"))

    n = lambda i: f"((({i}) + offset) * picks div blocks)"

    def before(x: str) -> str:
        """Words of the chosen blocks in front of word x of the shard."""
        j = f"({x} div {block_words})"
        return f"((({n(j)} - {n('0')}) * {block_words}) + if({n(j + ' + 1')} > {n(j)}, {x} % {block_words}, 0))"

    picked = F.when(F.col("blocks") > 0, F.expr(f"{before('hi')} - {before('lo')}")).otherwise(0)
    ranges = F.expr(f"""if(size > 0 and picks > 0,
        transform(filter(sequence(lo div {block_words}, (hi - 1) div {block_words}), j -> {n('j + 1')} > {n('j')}),
            j -> named_struct('first', greatest(j * {block_words}, lo) - lo, 'stop', least((j + 1) * {block_words}, hi) - lo)),
        cast(array() as array<struct<first: bigint, stop: bigint>>))""")
    return laid.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("passes") * F.col("size") + picked).cast("long").alias("taken"),
        *([F.col("passes").cast("long").alias("passes"), ranges.alias("chosen")] if chosen else []),
    )
