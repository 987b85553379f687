"""Embedding near-duplicates by randomised-rotation binary codes.

A vector of length one is turned by a fixed random rotation; the signs of what comes out,
over sqrt(D), are its code o', and f = <o', o> is its stored correction factor.  For any
other turned vector q, <o', q> / f estimates <o, q> without bias.  Its error is at most
sin(o, q) * sqrt(1 - f^2) / f * EPSILON / sqrt(D - 1) but for a chance of about 2e-9, and
always below that with EPSILON / sqrt(D - 1) replaced by one.  The q of a pair travels as
8-bit integers with random rounding, whose error enters the bound too.  A pair whose estimate
plus bound stays under the threshold either way round is done; the others are computed
exactly, in double precision, from the vectors themselves.

Which pairs are looked at: signs of further rotations make ``bands`` keys of ``bits`` signs.
Two vectors at the threshold differ in a sign with chance angle / pi, so bands are as
many as bring the chance to share none under ``miss``, whatever the number of rows; bits
grow with the logarithm of the largest label, so buckets of unrelated vectors keep their
size.  A pair counts in the first band that it shares.

Rows of one label with the same vector are one member with a weight.  Small buckets are
gathered by hash into bins of some thousand rows; a bucket of more than ``block_rows`` is
dealt in pairs of blocks.  The first pass carries codes only and keeps the bands in which
a member has candidates; the second brings vectors to these alone.  A task hands on a
count of links a member and a spanning forest of its links, never the pairs.

Defined cases: null labels, null or empty vectors, zero vectors and vectors with null or
non-finite components link with nothing, as do rows with a null id (whose component is
null); vectors are compared at equal label and length; repeated rows and equal vectors
link with each other and each counts; an empty table gives an empty result; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.llm.durable import durable, release
from pressloom.llm.graph import components

EPSILON = 6.0
#: Rows that a bucket of unrelated vectors may hold on average, as a power of two, and the least bits of a key.
BUCKET_BITS, LEAST_BITS = 9, 8
BIN_ROWS = 8192
TILE = 1024
PAIRS = 1 << 17  # compared at a time


def bands_for(largest: int, threshold: float, miss: float) -> tuple[int, int]:
    """(bits, bands) for the largest number of vectors that a label has."""
    bits = int(np.clip(max(1, largest).bit_length() - BUCKET_BITS, LEAST_BITS, 60))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-same)) if same < 1 else 1


@functools.lru_cache(maxsize=64)
def rotation(dim: int, number: int) -> np.ndarray:
    """A random rotation of dim dimensions, the same everywhere."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64([20240607, dim, number])).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; large and small components are scaled first, so that squares stay finite."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def codes_of(x: np.ndarray, bits: int, bands: int) -> dict[str, np.ndarray]:
    """For rows of length one: the sign code, its correction factor, the turned vector in 8 bits with its step, and band keys."""
    dim = x.shape[1]
    turned = x @ rotation(dim, 0)
    signs = turned >= 0
    factor = np.abs(turned).sum(axis=1) / math.sqrt(dim)
    step = np.maximum(np.abs(turned).max(axis=1) / 127, 1e-30)
    noise = np.random.Generator(np.random.PCG64(5)).random(turned.shape)
    small = np.clip(np.floor(turned / step[:, None] + noise), -127, 127).astype(np.int8)
    more = [x @ rotation(dim, 1 + r) >= 0 for r in range(-(-bits * bands // dim))]
    keys = np.concatenate(more, axis=1)[:, : bits * bands].reshape(len(x), bands, bits)
    return {"code": np.packbits(signs, axis=1), "factor": factor, "small": small, "step": step, "keys": np.packbits(keys, axis=2)}


def _blobs(rows: np.ndarray) -> pa.Array:
    """Each row's bytes as one binary value."""
    flat = np.ascontiguousarray(rows).reshape(len(rows), -1).view(np.uint8)
    return pa.array([r.tobytes() for r in flat], pa.binary())


def _coded(bits: int, bands: int):
    """Codes of members; a band's key goes out as a number too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = pc.list_value_length(batch.column("vector")).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                x = part.column("vector").flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
                got = codes_of(unit(x), bits, bands)
                number = np.zeros(got["keys"].shape[:2], np.int64)
                for b in range(got["keys"].shape[2]):
                    number = (number << 8) | got["keys"][:, :, b]
                offsets = np.arange(0, number.size + 1, bands, dtype=np.int32)
                columns = {c: part.column(c) for c in ("first", "mark", "label", "dim", "times")} | {
                    "code": _blobs(got["code"]), "factor": pa.array(got["factor"]), "small": _blobs(got["small"]), "step": pa.array(got["step"]), "keys": _blobs(got["keys"]),
                    "numbers": pa.ListArray.from_arrays(pa.array(offsets), pa.array(number.ravel())),
                }
                yield pa.RecordBatch.from_pydict(columns)

    return run


def _runs(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Row numbers of every bucket in a group with more than one member; of a pair of different blocks, both sides."""
    label = pc.dictionary_encode(table["label"].combine_chunks()).indices.to_numpy().astype(np.int64)
    order = np.lexsort((table["number"].to_numpy(), table["band"].to_numpy(), table["dim"].to_numpy(), label))
    same = np.ones(max(0, len(order) - 1), bool)
    for c in (table["number"].to_numpy(), table["band"].to_numpy(), table["dim"].to_numpy(), label):
        same &= c[order][1:] == c[order][:-1]
    bounds = np.r_[0, np.flatnonzero(~same) + 1, len(order)]
    first, second, block = (table[c].to_numpy() for c in ("one", "two", "block"))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        own = order[a:b]
        if len(own) < 2:
            continue
        if first[own[0]] == second[own[0]]:
            yield own, None
        else:
            yield own[block[own] == first[own[0]]], own[block[own] == second[own[0]]]


class Codes:
    """The columns of a group as arrays."""

    def __init__(self, table: pa.Table, width: int):
        self.width = width  # bytes of a band's key
        self.band, self.dim = table["band"].to_numpy(), table["dim"].to_numpy()
        self.factor, self.step = table["factor"].to_numpy(), table["step"].to_numpy()
        self.code, self.small, self.keys = (table[c].to_pylist() for c in ("code", "small", "keys"))

    def bounds(self, rows: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Signs over f, turned vectors, and the least estimate that still may belong to a link."""
        dim, f = int(self.dim[rows[0]]), self.factor[rows]
        signs = np.unpackbits(np.frombuffer(b"".join(self.code[r] for r in rows), np.uint8).reshape(len(rows), -1), axis=1)[:, :dim]
        signs = (signs * np.float32(2) - 1) / (np.float32(math.sqrt(dim)) * f[:, None].astype(np.float32))
        small = np.frombuffer(b"".join(self.small[r] for r in rows), np.int8).reshape(len(rows), dim)
        apart = min(1.0, EPSILON / math.sqrt(max(1, dim - 1))) * math.sqrt(1 - threshold * threshold) * np.sqrt(np.maximum(0, 1 - f * f)) / f
        return signs, small * self.step[rows].astype(np.float32)[:, None], threshold - apart - 1e-5

    def candidates(self, one: np.ndarray, two: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows of a bucket that may be links and share no earlier band."""
        within = two is None
        two = one if within else two
        if not len(one) or not len(two):
            return
        band, width, dim = int(self.band[one[0]]), self.width, int(self.dim[one[0]])
        sa, qa, ta = self.bounds(one, threshold)
        sb, qb, tb = (sa, qa, ta) if within else self.bounds(two, threshold)
        ka, kb = (np.frombuffer(b"".join(self.keys[r] for r in rows), np.uint8).reshape(len(rows), -1) for rows in (one, two))
        # rounding moves a sum of D terms of 1/sqrt(D) by step/2 in the mean square, by sqrt(D)*step at most
        loose = lambda rows: min(math.sqrt(dim), EPSILON / 2) * self.step[rows]
        la, lb = loose(one), loose(two)
        for a in range(0, len(one), TILE):
            for b in range(a if within else 0, len(two), TILE):
                i, j = slice(a, a + TILE), slice(b, b + TILE)
                ok = sa[i] @ qb[j].T >= ta[i][:, None] - lb[j][None, :] / self.factor[one[i]][:, None]
                ok &= (sb[j] @ qa[i].T >= tb[j][:, None] - la[i][None, :] / self.factor[two[j]][:, None]).T
                if within and a == b:
                    ok &= np.triu(np.ones(ok.shape, bool), 1)
                x, y = np.nonzero(ok)
                x, y = x + a, y + b
                for c in range(0, len(x), PAIRS):
                    u, v = x[c : c + PAIRS], y[c : c + PAIRS]
                    new = np.ones(len(u), bool)
                    for earlier in range(band):
                        k = slice(earlier * width, (earlier + 1) * width)
                        new &= (ka[u, k] != kb[v, k]).any(axis=1)
                    if new.any():
                        yield one[u[new]], two[v[new]]


def _active(threshold: float, width: int):
    """Members with a candidate in a band: (first, mark, band)."""

    def run(table: pa.Table) -> pa.Table:
        codes, met = Codes(table, width), np.zeros(len(table), bool)
        for one, two in _runs(table):
            for u, v in codes.candidates(one, two, threshold):
                met[u] = met[v] = True
        return table.select(["first", "mark", "band"]).filter(pa.array(met))

    return run


def _links(threshold: float, width: int):
    """first, mark, links: a member's links counted here; to_first, to_mark: the root of its tree in a forest of the links."""

    def run(table: pa.Table) -> pa.Table:
        codes = Codes(table, width)
        times, vectors = table["times"].to_numpy(), table["vector"].combine_chunks()
        vectors = vectors.cast(pa.list_(pa.float64()))
        at, values = vectors.offsets.to_numpy(), vectors.values.to_numpy()
        links, root = np.zeros(len(table), np.int64), np.arange(len(table))
        for one, two in _runs(table):
            rows = one if two is None else np.r_[one, two]
            dim = int(codes.dim[rows[0]])
            place = np.empty(len(table), np.int64)
            place[rows] = np.arange(len(rows))
            x = unit(values[at[rows][:, None] + np.arange(dim)])
            for u, v in codes.candidates(one, two, threshold):
                linked = np.einsum("ij,ij->i", x[place[u]], x[place[v]]) >= threshold
                u, v = u[linked], v[linked]
                np.add.at(links, u, times[v])
                np.add.at(links, v, times[u])
                while True:
                    a, b = root[u], root[v]
                    apart = a != b
                    if not apart.any():
                        break
                    np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
                    while (root[root] != root).any():
                        root = root[root]
        met = links > 0
        first, mark = table["first"].to_numpy(), table["mark"].to_numpy()
        return pa.table({"first": first[met], "mark": mark[met], "links": links[met], "to_first": first[root[met]], "to_mark": mark[root[met]]})

    return run


def _dealt(members: DataFrame, sizes: DataFrame, bins: int, block_rows: int) -> DataFrame:
    """members with the group of each: a bin of small buckets, or a pair of blocks of a large one."""
    bucket = ["label", "dim", "band", "number"]
    large = sizes.where(F.col("size") > block_rows).withColumn("blocks", (1 + F.col("size") / block_rows).cast("int")).drop("size")
    out = members.join(large, bucket, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    out = out.withColumn("block", F.pmod(F.xxhash64("first", "mark"), F.col("blocks")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = F.xxhash64(*bucket)
    return out.withColumns({
        "bin": F.when(F.col("blocks") > 1, key).otherwise(F.pmod(key, F.lit(bins))),
        "one": F.least("block", "other"), "two": F.greatest("block", "other"),
    }).drop("blocks", "other")


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: finite components, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_vectors(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, miss: float = 1e-4, block_rows: int = 4096
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    linkable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector")), F.lit(False))
    members = rows.where(linkable).groupBy("label", "vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("times"))
    # two members may start at the same id, when one id has several vectors: the mark tells them apart
    members = durable(members.select("first", F.xxhash64("label", "vector").alias("mark"), "label", F.size("vector").alias("dim"), "times", "vector"))
    facts = members.groupBy("label", "dim").count().agg(F.max("count"), F.sum("count")).first()
    bits, bands = bands_for(facts[0] or 0, threshold, miss)
    width, bins = -(-bits // 8), 1 + (facts[1] or 0) * bands // BIN_ROWS

    label = members.schema["label"].dataType.simpleString()
    schema = f"first long, mark long, label {label}, dim int, times long, code binary, factor double, small binary, step double, keys binary, numbers array<long>"
    codes = durable(members.mapInArrow(_coded(bits, bands), schema))
    spread = codes.select("*", F.posexplode("numbers").alias("band", "number")).drop("numbers")
    sizes = durable(codes.select("label", "dim", F.posexplode("numbers").alias("band", "number")).groupBy("label", "dim", "band", "number").agg(F.count("*").alias("size")).where("size > 1"))
    # a member alone in its bucket has nothing to meet there
    met = spread.join(sizes.select("label", "dim", "band", "number"), ["label", "dim", "band", "number"], "left_semi")
    group = ["bin", "one", "two"]
    carried = ["first", "mark", "label", "dim", "times", "code", "factor", "small", "step", "keys", "band", "number", "block"]
    active = _dealt(met, sizes, bins, block_rows).select(*group, *carried).groupBy(*group).applyInArrow(_active(threshold, width), "first long, mark long, band int")
    active = durable(active.distinct())
    again = spread.join(active, ["first", "mark", "band"]).join(members.select("first", "mark", "vector"), ["first", "mark"])
    linked = _dealt(again, sizes, bins, block_rows).select(*group, *carried, "vector").groupBy(*group)
    linked = durable(linked.applyInArrow(_links(threshold, width), "first long, mark long, links long, to_first long, to_mark long"))
    release(spark)

    u, v = F.struct("first", "mark"), F.struct(F.col("to_first").alias("first"), F.col("to_mark").alias("mark"))
    roots = components(linked.select(u.alias("u"), v.alias("v"))).select("node.first", "node.mark", F.col("root.first").alias("root"))
    counts = linked.groupBy("first", "mark").agg(F.sum("links").alias("links"))
    named = members.join(counts, ["first", "mark"], "left").join(roots, ["first", "mark"], "left").select(
        "label", "vector", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("root", "first").alias("component_id")
    )
    # only usable rows look for their member; the others would be one hot key
    found = rows.where(linkable).join(named, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~linkable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
