"""The candidate store and the snapshots published from it, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from pressloom.functions.numbers import fingerprint


def upsert_candidates(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row a (source_id, canonical_url) after all incoming rows, in order of ord, met the stored ones.

    The last row gives title, summary and fingerprint; a null date or language keeps the
    last known one; the earliest discovery stays.  One aggregation with partial results
    before its shuffle; no join.
    """
    columns = ["source_id", "canonical_url", "title", "summary", "published_at", "updated_at", "discovered_at", "language"]
    rows = stored.select(F.lit(0).alias("side"), "ord", *columns).unionByName(incoming.select(F.lit(1).alias("side"), "ord", *columns))
    turn = F.struct("side", "ord")
    last = lambda c: F.max_by(c, turn).alias(c)
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), turn)).alias(c)
    merged = rows.groupBy("source_id", "canonical_url").agg(
        last("title"), last("summary"), known("published_at"), known("updated_at"), F.min("discovered_at").alias("discovered_at"), known("language"), F.count("*").alias("seen"),
    )
    return merged.withColumn("content_fingerprint", fingerprint(F.col("canonical_url"), F.col("title"), F.col("summary")))


def _ordered(c: Column, kind: DataType) -> Column:
    """c with the fields of every nested struct in order of name."""
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*[_ordered(c[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]))
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: _ordered(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(c)))
    return c


def content_hash(df: DataFrame, *columns: str) -> DataFrame:
    """One row: the hash of a multiset of rows whatever their order.

    Each row is digested as JSON with its keys in order, nested ones too, nulls left out.  Four
    lanes of 60 bits of the digests are added up modulo 2^60, with the number of rows: equal rows
    count as often as they are there, and a task hands on five numbers.
    """
    digest = F.sha2(F.to_json(_ordered(F.struct(*[F.col(c) for c in sorted(columns)]), df.select(*sorted(columns)).schema)), 256)
    lane = lambda i: F.conv(F.substring(digest, 15 * i + 1, 15), 16, 10).cast("decimal(38,0)")
    added = df.agg(F.count("*").alias("n"), *[(F.coalesce(F.sum(lane(i)), F.lit(0)) % (1 << 60)).cast("long").alias(f"l{i}") for i in range(4)])
    return added.select("n", F.sha2(F.concat_ws("|", "n", "l0", "l1", "l2", "l3"), 256).alias("content_hash"))


def publish(offers: DataFrame) -> DataFrame:
    """Offers (stream, slot, hash) that become snapshots: unchanged ones do not (K06); each names the one it supersedes.

    Two missing hashes are the same content; offers of one slot come in order of their hash.
    """
    w = Window.partitionBy("stream").orderBy("slot", F.col("hash").asc_nulls_first())
    changed = offers.withColumns({"latest": F.lag("hash").over(w), "first": F.row_number().over(w) == 1})
    changed = changed.where(F.col("first") | ~F.col("latest").eqNullSafe(F.col("hash")))
    return changed.drop("latest", "first").withColumns({"version": F.row_number().over(w), "supersedes": F.lag("slot").over(w)})


def rolled_back(snapshots: DataFrame, leases: DataFrame) -> DataFrame:
    """The pointer of every stream after one rollback (K10): the snapshot before the latest, unless a lease is held or none is older."""
    latest = snapshots.groupBy("stream").agg(F.max_by(F.struct("slot", "supersedes"), "slot").alias("s"))
    held = leases.where("active").select("stream").distinct().withColumn("held", F.lit(True))
    free = ~F.coalesce(F.col("held"), F.lit(False)) & F.col("s.supersedes").isNotNull()
    return latest.join(held, "stream", "left").select("stream", F.when(free, F.col("s.supersedes")).otherwise(F.col("s.slot")).alias("pointer"), free.alias("moved"))


def first_of_key(log: DataFrame, key: Column) -> DataFrame:
    """Attempts with their idempotency key: the first of a key runs, the others are duplicates."""
    keyed = log.withColumn("key", key)
    best = keyed.groupBy("key").agg(F.min(F.struct("at", "event_id")).alias("best"), F.count("*").alias("attempts"))
    return best.select("key", F.col("best.event_id").alias("winner"), (F.col("attempts") - 1).alias("duplicates"))
