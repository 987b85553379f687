"""Centroid clustering by weighted deduplication: Lloyd's rounds over distinct quantised vectors.

Rows become integer codes, floor(scale * x) per component; identical codes are one
weighted vector, counted before anything is shuffled.  Each round deals only distinct
vectors: a task finds the nearest centroid of each, adds weight * component in exact
integers and hands on one row a cluster and component, so what the driver reads has
k * (dims + 1) rows whatever the corpus.  Assignments go back to the rows by one join
on the codes; a code that very many rows share is split there by adaptive execution.

Distances are exact: float64 products where they stay below 2^53, 64-bit integers
beyond; sums take Python integers where 64 bits do not hold them.

Defined cases: vectors that are null, of another length, or hold null or non-finite
components are left out; rows with a null id are clustered but start no centroid;
repeated rows count each and may start several (equal) centroids; ties of the start go
by hash, then code; fewer than k rows give fewer centroids; an empty table gives an
empty result; other columns are ignored, whatever their names.  A quantised component beyond 2^27 raises
ArithmeticError, since distances would leave 64 bits.
"""

from __future__ import annotations

import decimal
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.llm.durable import durable

LARGEST = 1 << 27


def _quantised(dims: int, scale: int):
    """(vec_id, code) of the usable vectors; a code is the components as 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            fits = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(vectors), dims), False).to_numpy(zero_copy_only=False))
            flat = vectors.take(pa.array(fits)).flatten().cast(pa.float64())
            x = flat.to_numpy(zero_copy_only=False).reshape(-1, dims)  # a null component is NaN
            ok = np.isfinite(x).all(axis=1)
            with np.errstate(over="ignore"):
                codes = np.floor(x[ok] * scale)
            if len(codes) and np.abs(codes).max() > LARGEST:
                raise ArithmeticError(f"a quantised component is beyond {LARGEST}")
            body = codes.astype("<i4").tobytes()
            rows = [body[i : i + 4 * dims] for i in range(0, len(body), 4 * dims)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(fits[ok])), pa.array(rows, pa.binary())], names=["vec_id", "code"])

    return run


def _matrix(codes: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(codes.to_pylist()), "<i4").reshape(-1, dims).astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of the nearest centroid (the smaller on ties) and the squared distance."""
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    kind = np.float64 if 4 * x.shape[1] * largest * largest < 1 << 53 else np.int64
    a, b = x.astype(kind), centroids.astype(kind)
    distance = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)
    owner = distance.argmin(axis=1)
    return owner, distance[np.arange(len(x)), owner].astype(np.int64)


def _sums(centroids: np.ndarray):
    """Exact weighted component sums a cluster, and weights as component -1, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centroids), centroids.shape[1] + 1), object)
        for batch in batches:
            x = _matrix(batch.column("code"), centroids.shape[1])
            owner, _ = nearest(x, centroids)
            weight = batch.column("weight").to_numpy()
            if int(np.abs(x).max(initial=1)) * sum(weight.tolist()) >= 1 << 62:
                x, weight = x.astype(object), weight.astype(object)
            for c in np.unique(owner).tolist():
                own = owner == c
                total[c] += np.r_[[weight[own].sum()], weight[own] @ x[own]].astype(object)
        cluster, dim = np.nonzero(total != 0)
        values = [decimal.Decimal(int(v)) for v in total[cluster, dim]]
        yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(dim - 1, pa.int32()), pa.array(values, pa.decimal128(38, 0))], names=["cluster", "dim", "total"])

    return run


def moved(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round; a cluster without vectors stays where it is."""
    parts = distinct.mapInArrow(_sums(centroids), "cluster int, dim int, total decimal(38,0)")
    found = {(r["cluster"], r["dim"]): int(r["total"]) for r in parts.groupBy("cluster", "dim").agg(F.sum("total").alias("total")).collect()}
    out = centroids.copy()
    for c in range(len(centroids)):
        if n := found.get((c, -1)):
            out[c] = [found.get((c, d), 0) // n for d in range(centroids.shape[1])]
    return out


def _assign(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, distance = nearest(_matrix(batch.column("code"), centroids.shape[1]), centroids)
            yield pa.RecordBatch.from_arrays([batch.column("code"), batch.column("weight"), pa.array(owner, pa.int32()), pa.array(distance)], names=["code", "weight", "cluster", "distance"])

    return run


def cluster_vectors(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, scale: int = 256, k: int = 40, rounds: int = 5, seed: str = "2"
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every usable vector."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")).mapInArrow(_quantised(dims, scale), "vec_id long, code binary")
    distinct = durable(rows.groupBy("code").agg(F.count("*").alias("weight")))

    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = rows.where("vec_id IS NOT NULL").withColumn("h", drawn).orderBy("h", "code").limit(k).collect()  # k rows
    centroids = np.array([np.frombuffer(r["code"], "<i4") for r in start], np.int64).reshape(-1, dims)
    if len(centroids) == 0:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(distinct, centroids)

    placed = durable(distinct.mapInArrow(_assign(centroids), "code binary, weight long, cluster int, distance long"))
    sums = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)") * F.col("weight")).cast("long").alias("cluster_inertia")).collect()  # k rows
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    inertia = sum(r["cluster_inertia"] for r in sums)
    facts = spark.createDataFrame([(r["cluster"], r["cluster_inertia"], inertia, names[r["cluster"]]) for r in sums], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    labelled = placed.drop("weight").join(F.broadcast(facts), "cluster")  # at most k rows
    return rows.join(labelled, "code").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
