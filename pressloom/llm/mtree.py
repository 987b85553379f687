"""Exact top-k by integer inner product over a forest of M-trees.

Vectors are dealt by hash into blocks of bounded size; each block becomes one
M-tree whose pages (nodes with pivot, covering radius and distance to the parent
pivot) are rows of an index table.  Inner product turns into a metric by one more
coordinate: with M the largest norm of a block and a(x) = sqrt(M^2 - |x|^2),
d(q, x)^2 = |q|^2 + M^2 - 2 q.x, so the nearest vectors have the largest product.
Blocks of queries search each tree best-first and skip a distance whenever
|d(q, parent) - d(o, parent)| - radius already exceeds the k-th distance found.
Bounds carry a slack for rounding; scores themselves are exact integers.

Defined cases: vectors that are null or hold null or non-finite components, and
rows with a null id, take no part; an empty vector scores 0 with other empty ones;
only vectors of the query's length are candidates; a row with the query's own id is
never its candidate; other repeated rows each count; repeated identical query rows
give one result; ties go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAF, FANOUT = 96, 12
NODES = "block long, dim int, node int, parent int, leaf boolean, radius double, to_parent double, top double, pivot array<long>, ids array<long>, vectors array<long>, dists array<double>"


def quantized(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) for each component; null if a component is null or not finite."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(ok, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((a - b) ** 2).sum(axis=-1), 0.0))


def build_tree(ids: np.ndarray, vectors: np.ndarray) -> list[dict]:
    """The pages of one M-tree, bulk-loaded top down around far-apart pivots."""
    v = vectors.astype(np.float64)
    norms = (v**2).sum(axis=1)
    top = float(norms.max(initial=0.0))
    points = np.column_stack([v, np.sqrt(np.maximum(top - norms, 0.0))])
    pages: list[dict] = []
    todo = [(np.arange(len(ids)), int(np.argmin(ids)) if len(ids) else 0, -1, 0.0)]
    while todo:
        rows, pivot, parent, to_parent = todo.pop()
        dist = _distances(points[rows], points[pivot])
        node, radius = len(pages), float(dist.max(initial=0.0))
        leaf = len(rows) <= LEAF
        pages.append({
            "node": node, "parent": parent, "leaf": leaf, "radius": radius, "to_parent": to_parent, "top": top,
            "pivot": vectors[pivot], "ids": ids[rows] if leaf else ids[:0],
            "vectors": vectors[rows].ravel() if leaf else vectors[:0].ravel(), "dists": dist if leaf else dist[:0],
        })
        if leaf:
            continue
        want = min(FANOUT, -(-len(rows) // LEAF))
        pivots, nearest = [int(rows[np.argmax(dist)])], np.full(len(rows), np.inf)
        owner = np.zeros(len(rows), np.int64)
        while True:
            d = _distances(points[rows], points[pivots[-1]])
            closer = d < nearest
            owner[closer], nearest[closer] = len(pivots) - 1, d[closer]
            if len(pivots) == want or nearest.max() == 0:
                break
            pivots.append(int(rows[np.argmax(nearest)]))
        if len(pivots) == 1:  # all the same point: pages of equal rows
            owner, pivots = np.arange(len(rows)) // LEAF, pivots * (-(-len(rows) // LEAF))
        for i, p in enumerate(pivots):
            if len(own := rows[owner == i]):
                todo.append((own, p, node, float(_distances(points[p], points[pivot]))))
    return pages


def search_tree(pages: list[dict], query: np.ndarray, own_id: int, k: int, seen: list[int] | None = None) -> list[tuple[int, int]]:
    """The k best (score, id) of one tree, best first; seen counts distances computed and avoided."""
    top = pages[0]["top"]
    q = query.astype(np.float64)
    q2 = float((q**2).sum())
    slack = 1e-6 * (1.0 + np.sqrt(top) + np.sqrt(q2))
    dist_of = lambda dot: float(np.sqrt(max(q2 + top - 2.0 * dot, 0.0)))
    best: list[tuple[int, int]] = []  # heap of (score, -id): the worst on top
    bound = np.inf
    root = dist_of(int(pages[0]["pivot"] @ query))
    heap = [(max(root - pages[0]["radius"], 0.0), 0, root)]
    while heap:
        low, node, here = heapq.heappop(heap)
        if low > bound + slack:
            break
        page = pages[node]
        if page["leaf"]:
            near = np.abs(here - page["dists"]) <= bound + slack
            if seen is not None:
                seen[0] += int(near.sum())
                seen[1] += int((~near).sum())
            scores = page["vectors"][near] @ query
            cand = page["ids"][near]
            if len(best) == k:
                keep = scores >= best[0][0]
                scores, cand = scores[keep], cand[keep]
            for s, i in zip(scores.tolist(), cand.tolist(), strict=True):
                if i == own_id:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
            if len(best) == k:
                bound = dist_of(best[0][0])
        else:
            for c in page["children"]:
                child = pages[c]
                if abs(here - child["to_parent"]) - child["radius"] > bound + slack:
                    if seen is not None:
                        seen[1] += 1
                    continue
                d = dist_of(int(child["pivot"] @ query))
                if seen is not None:
                    seen[0] += 1
                low = max(d - child["radius"], 0.0)
                if low <= bound + slack:
                    heapq.heappush(heap, (low, c, d))
    return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1]))


def _flat(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    values = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return values.reshape(-1, dim) if dim else np.zeros((len(column), 0), np.int64)


def _index_block(table: pa.Table) -> pa.Table:
    dim, block = table["dim"][0].as_py(), table["block"][0].as_py()
    pages = build_tree(table["vec_id"].to_numpy(), _flat(table["vector"], dim))
    kinds = {"block": pa.int64(), "dim": pa.int32(), "node": pa.int32(), "parent": pa.int32(), "leaf": pa.bool_(), "radius": pa.float64(), "to_parent": pa.float64(), "top": pa.float64(), "pivot": pa.list_(pa.int64()), "ids": pa.list_(pa.int64()), "vectors": pa.list_(pa.int64()), "dists": pa.list_(pa.float64())}
    return pa.table({c: pa.array([{"block": block, "dim": dim, **p}[c] for p in pages], t) for c, t in kinds.items()})


def build_index(vectors: DataFrame, *, block_rows: int = 16384) -> DataFrame:
    """Pages of the forest for rows (vec_id, vector, dim); a block holds about block_rows vectors."""
    blocks = F.lit(1 + vectors.count() // block_rows)
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id", "vector"), blocks))
    return dealt.groupBy("block", "dim").applyInArrow(_index_block, NODES)


def _search(k: int):
    def run(pages: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(pages) and len(queries):
            dim = pages["dim"][0].as_py()
            tree = sorted(pages.drop_columns(["ids", "vectors", "dists", "pivot"]).to_pylist(), key=lambda p: p["node"])
            order = np.argsort(pages["node"].to_numpy())
            for p, at in zip(tree, order.tolist(), strict=True):
                p["pivot"] = np.array(pages["pivot"][at].values, np.int64)
                p["ids"] = np.array(pages["ids"][at].values, np.int64)
                p["vectors"] = np.array(pages["vectors"][at].values, np.int64).reshape(len(p["ids"]), dim)
                p["dists"] = np.array(pages["dists"][at].values, np.float64)
                p["children"] = []
            for p in tree[1:]:
                tree[p["parent"]]["children"].append(p["node"])
            for qid, row, vec in zip(queries["query_id"].to_pylist(), queries["query_row"].to_pylist(), _flat(queries["vector"], dim), strict=True):
                out += [(qid, row, i, s) for s, i in search_tree(tree, vec, qid, k)]
        cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["query_id", "query_row", "vec_id", "score"])

    return run


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 10,
    block_rows: int = 16384,
    query_rows: int = 4096,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of vectors for every row of queries."""

    def prepared(df: DataFrame) -> DataFrame:
        got = df.select(F.col(id_col).cast("long").alias("vec_id"), quantized(F.col(vector_col)).alias("vector"))
        return got.where("vec_id IS NOT NULL AND vector IS NOT NULL").withColumn("dim", F.size("vector"))

    index = build_index(prepared(vectors), block_rows=block_rows)
    asked = prepared(queries).distinct().withColumn("query_row", F.xxhash64("vector")).withColumnRenamed("vec_id", "query_id")
    n_blocks = 1 + prepared(vectors).count() // block_rows
    n_parts = 1 + asked.count() // query_rows
    # Every block of queries meets every tree: the stated query set against all rows.
    pages = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(n_parts)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")))
    )
    found = (
        pages.groupBy("block", "dim", "part").cogroup(asked.groupBy("block", "dim", "part"))
        .applyInArrow(_search(k), "query_id long, query_row long, vec_id long, score long")
    )
    w = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
