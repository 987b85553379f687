"""Near-duplicate groups by one-permutation MinHash with exact confirmation.

Each text's distinct shingle hashes fall into ``bins`` bins by their high bits; a
bin keeps its minimum, and an empty bin borrows from the first filled bin of its own
fixed random order (optimal densification).  Bands of ``rows`` bins are bucket keys.
Texts with equal shingle sets are one member.  A bucket offers star-shaped candidate
edges, every member to the smallest, so pairs stay linear in its size.  Each edge is
confirmed on the full sets and leaves the codes in which the member differs from the
centre; from these few codes the members of a star that are not linked to the centre
are compared exactly with the others, in blocks of bounded size, and at most one link
a member leaves.  No bucket-mate is missed, whatever it shares with the centre.

With 32 bands of 4 rows a pair of similarity 0.8 shares no bucket with a chance of
about 5e-8.

Defined cases: texts are lower-cased (A-Z); a text of fewer words than a shingle is
one shingle; null and empty texts have no shingles and stay alone; rows with a null
id stay alone, are kept and have a null component; repeated rows share a component;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.llm.columns import ORDER_CODES, mix, shingle_sets, slices
from pressloom.llm.durable import durable, lean
from pressloom.llm.graph import components

BINS, ROWS = 128, 4
#: For every bin the order in which it looks for a filled one.
BORROW = np.argsort(np.random.Generator(np.random.PCG64(7)).random((BINS, BINS)), axis=1)
EDGES = (np.arange(BINS, dtype=np.uint64) << np.uint64(57)).astype(np.uint64)
BAND_CODES = mix(np.arange(1, BINS // ROWS + 1, dtype=np.uint64))


def signature(codes: np.ndarray) -> np.ndarray:
    """The densified one-permutation signature of a sorted set of hashes (not empty)."""
    at = np.minimum(np.searchsorted(codes, EDGES), len(codes) - 1)
    sig = codes[at]
    filled = (sig >> np.uint64(57)) == np.arange(BINS, dtype=np.uint64)
    if not filled.all():
        empty = np.flatnonzero(~filled)
        lender = BORROW[empty]
        sig[empty] = sig[lender[np.arange(len(empty)), filled[lender].argmax(axis=1)]]
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    return mix((sig.reshape(-1, ROWS) * ORDER_CODES[:ROWS]).sum(axis=1, dtype=np.uint64) ^ BAND_CODES)


def _signed(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int32)
    values = np.concatenate(rows).view(np.int64) if rows else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _profiles(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text")
            for a, b in slices(texts):
                n, fp1, fp2, bands = [], [], [], []
                for codes in shingle_sets(texts.slice(a, b - a), width):
                    n.append(len(codes))
                    fp1.append(codes.sum(dtype=np.uint64))
                    fp2.append(mix(codes ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                    bands.append(band_keys(signature(codes)) if len(codes) else codes)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(n, pa.int64()), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fp1, fp2)), _signed(bands)],
                    names=["id", "n", "fp1", "fp2", "bands"],
                )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text")
            for a, b in slices(texts):
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), _signed(list(shingle_sets(texts.slice(a, b - a), width)))], names=["id", "codes"])

    return run


def _compared(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Pairs (u, v) with both set sizes, how many of u's shingles v lacks, and the codes in which they differ."""
    needed = pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct()
    sets = durable(texts.join(needed, "id", "left_semi").dropDuplicates(["id"]).mapInArrow(lean(_sets(width)), "id long, codes array<long>"))
    a = sets.select(F.col("id").alias("u"), F.col("codes").alias("cu"))
    b = sets.select(F.col("id").alias("v"), F.col("codes").alias("cv"))
    both = pairs.join(a, "u").join(b, "v").select("u", "v", F.size("cu").alias("nu"), F.size("cv").alias("nv"), F.array_except("cu", "cv").alias("lacks"), F.array_except("cv", "cu").alias("adds"))
    return both.select("u", "v", "nu", "nv", F.size("lacks").alias("lacking"), F.concat("lacks", "adds").alias("codes"))


def _star_links(percent: int):
    """Links within two blocks of a star's members, from their differences to the centre.

    Members u and v share n - lacking(u) - lacking(v) + |codes(u) and codes(v)| shingles, n the
    centre's number.  Pairs that are connected already are skipped; at most one link a member leaves.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        centre, first, second = (k.as_py() for k in key)
        table = table.sort_by("v")
        v, n, lacking = (table[c].to_numpy().astype(np.int64) for c in ("v", "nv", "lacking"))
        block, size = table["block"].to_numpy(), int(table["nu"][0].as_py())
        codes = table["codes"].combine_chunks()
        bounds, values = codes.offsets.to_numpy().astype(np.int64), codes.values.to_numpy()
        bounds = bounds - bounds[0]
        _, feature = np.unique(values, return_inverse=True)
        holder = np.repeat(np.arange(len(v)), np.diff(bounds))
        order = np.argsort(feature, kind="stable")
        holder = holder[order]
        start = np.r_[0, np.cumsum(np.bincount(feature))]
        common = size - lacking
        linked = 100 * common >= percent * (size + n - common)
        group = np.where(linked, -1, np.arange(len(v)))
        out_u, out_v = [], []
        for i in np.flatnonzero(~linked).tolist():
            other = (group != group[i]) & ((block != block[i]) if first != second else True)
            f = feature[bounds[i] : bounds[i + 1]]
            take = start[f + 1] - start[f]
            at = np.repeat(start[f] - (np.cumsum(take) - take), take) + np.arange(take.sum())
            both = size - lacking[i] - lacking + np.bincount(holder[at], minlength=len(v))
            for j in np.flatnonzero(other & (100 * both >= percent * (n[i] + n - both))).tolist():
                if group[i] != group[j]:
                    out_u.append(min(v[i], v[j]))
                    out_v.append(max(v[i], v[j]))
                    group[group == group[i]] = group[j]
        return pa.table([pa.array(out_u, pa.int64()), pa.array(out_v, pa.int64())], names=["u", "v"])

    return run


def _star_member_links(stars: DataFrame, percent: int, block_rows: int = 4096) -> DataFrame:
    """Links between the members of each star; a star of many members is dealt in pairs of blocks."""
    sizes = stars.groupBy("u").agg(F.count("*").alias("members")).where("members > 1")
    sizes = sizes.select("u", (1 + F.floor(F.col("members") / block_rows)).cast("int").alias("blocks"))
    dealt = stars.join(sizes, "u").withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"first": F.least("block", "other"), "second": F.greatest("block", "other")})
    columns = ["u", "first", "second", "block", "v", "nu", "nv", "lacking", "codes"]
    return dealt.select(*columns).groupBy("u", "first", "second").applyInArrow(_star_links(percent), "u long, v long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id and whether it is its component's first."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    profiles = durable(texts.mapInArrow(lean(_profiles(width)), "id long, n long, fp1 long, fp2 long, bands array<long>"))
    with_id = profiles.where("id IS NOT NULL AND n > 0")
    # Equal sets are one member, named by its smallest id.
    reps = durable(with_id.groupBy("fp1", "fp2", "n").agg(F.min("id").alias("rep"), F.first("bands").alias("bands")))
    spread = reps.select("rep", "n", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count("*").alias("size"), F.min("rep").alias("centre")).where("size > 1")
    texts = texts.where("id IS NOT NULL")
    centred = spread.join(shared, "bucket").select(F.col("centre").alias("u"), F.col("rep").alias("v")).where("u <> v").distinct()
    stars = durable(_compared(durable(centred), texts, width))
    common = F.col("nu") - F.col("lacking")
    links = stars.where(100 * common >= percent * (F.col("nu") + F.col("nv") - common)).select("u", "v")
    roots = components(links.union(_star_member_links(stars, percent)))

    labels = reps.select("fp1", "fp2", "n", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    labels = labels.select("fp1", "fp2", "n", F.coalesce("root", "rep").alias("component"))
    alone = profiles.where("id IS NULL OR n = 0").select("id", "n", F.col("id").alias("component"))
    found = with_id.select("id", "n", "fp1", "fp2").join(labels, ["fp1", "fp2", "n"]).select("id", "n", "component").union(alone)
    return found.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"),
    )
