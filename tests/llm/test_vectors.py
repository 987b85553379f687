"""Centroid clustering and embedding near-dedup against brute force, and their defined cases."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest
from pressloom.llm import rotated
from pressloom.llm.lloyd import cluster_vectors, nearest
from pressloom.llm.rotated import bands_for, codes_of, near_vectors, unit

SHAPE = "vec_id long, label int, embedding array<double>, code string, times int, mark long, weight int, cluster int"
NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    return spark.createDataFrame([(i, label, v, "x", 1, 2, 3, 4) for i, label, v in rows], SHAPE)


def lloyd(rows, dims, k, rounds, scale, seed):
    """Plain rounds over all rows with Python integers."""
    kept = [(i, [int(np.floor(scale * x)) for x in v]) for i, _, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    named = [(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), np.array(q, "<i4").tobytes(), q) for i, q in kept if i is not None]
    centroids = [q for _, _, q in sorted(named)[:k]]
    best = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = [best(q)[1] for _, q in kept]
        for c in range(len(centroids)):
            mine = [q for (_, q), o in zip(kept, own, strict=True) if o == c]
            if mine:
                centroids[c] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    out = [(i, *best(q)[::-1]) for i, q in kept]
    inertia = Counter()
    for _, c, d in out:
        inertia[c] += d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, c, d, inertia[c], sum(inertia.values()), names[c]) for i, c, d in out)


def some_vectors(rng, n, dims):
    base = rng.normal(size=(n // 4, dims))
    rows = [(int(i), int(i) % 3, (base[i % len(base)] + 0.05 * (i % 5) * rng.normal(size=dims)).tolist()) for i in range(n)]
    rows += [rows[3], rows[3], (rows[4][0], 2, rows[7][2]), (None, 1, rows[5][2]), (9001, None, rows[5][2]), (9002, 1, None), (9003, 1, [])]
    rows += [(9004, 1, [0.0] * dims), (9005, 1, [NAN] + [1.0] * (dims - 1)), (9006, 1, [None] + [1.0] * (dims - 1)), (9007, 1, [INF] * dims), (9008, 1, [1.0] * (dims + 1)), (9009, 1, [2.0] * (dims + 1))]
    return rows


@pytest.mark.parametrize("dims", [3, 16])
def test_clusters_are_those_of_plain_rounds(spark, dims):
    rows = some_vectors(np.random.default_rng(dims), 120, dims)
    for k in (1, 7, 500):
        got = cluster_vectors(table(spark, rows), dims=dims, k=k, rounds=4, scale=16, seed="s").collect()
        assert Counter(tuple(r) for r in got) == lloyd(rows, dims, k, 4, 16, "s")
    assert cluster_vectors(table(spark, []), dims=dims).count() == cluster_vectors(table(spark, [(1, 1, None)]), dims=dims).count() == 0


def test_large_components_stay_exact_or_are_refused(spark):
    x = np.array([[1 << 26, -(1 << 26)], [(1 << 26) - 1, 5]], np.int64)
    c = np.array([[1 << 26, 1 - (1 << 26)], [0, 0]], np.int64)
    owner, distance = nearest(x, c)
    assert owner.tolist() == [0, 1] and distance.tolist() == [1, ((1 << 26) - 1) ** 2 + 25]
    with pytest.raises(Exception, match="quantised component"):
        cluster_vectors(table(spark, [(1, 1, [1e9, 0.0])]), dims=2).collect()


def links(rows, threshold=0.93):
    """Links and components of all pairs; equal ids of different rows are different nodes."""
    ok = lambda i, label, v: i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    n, near = len(rows), [set() for _ in rows]
    for a in range(n):
        for b in range(a):
            if ok(*rows[a]) and ok(*rows[b]) and rows[a][1] == rows[b][1] and len(rows[a][2]) == len(rows[b][2]):
                x, y = np.array(rows[a][2]), np.array(rows[b][2])
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    near[a].add(b)
                    near[b].add(a)
    out = Counter()
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            todo += (new := near[todo.pop()] - seen)
            seen |= new
        root = min((rows[s][0] for s in seen), default=None) if rows[a][0] is not None else None
        out[rows[a][0], len(near[a]), root, rows[a][0] == root if root is not None else True] += 1
    return out


@pytest.mark.parametrize("dims", [1, 2, 16, 70])
def test_near_vectors_are_those_of_all_pairs(spark, dims):
    rows = some_vectors(np.random.default_rng(dims), 160, dims)
    assert Counter(tuple(r) for r in near_vectors(table(spark, rows)).collect()) == links(rows)
    assert near_vectors(table(spark, [])).count() == 0


def test_large_buckets_are_dealt_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=24)
    rows = [(i, 1, (centre + 0.09 * rng.normal(size=24) * (i % 4)).tolist()) for i in range(300)]
    monkeypatch.setattr(rotated, "BIN_ROWS", 64)
    assert Counter(tuple(r) for r in near_vectors(table(spark, rows), block_rows=32).collect()) == links(rows)


def test_estimates_have_no_bias_and_bounds_hold():
    rng = np.random.default_rng(3)
    o = unit(rng.normal(size=(4000, 64)))
    q = unit(0.8 * o + 0.06 * rng.normal(size=o.shape))
    got = codes_of(o, 8, 4)
    signs = (np.unpackbits(got["code"], axis=1) * 2.0 - 1) / 8
    other = codes_of(q, 8, 4)
    estimate = (signs * other["small"] * other["step"][:, None]).sum(axis=1) / got["factor"]
    error = estimate - (o * q).sum(axis=1)
    assert abs(error.mean()) < 3 * error.std() / np.sqrt(len(error)) + 1e-4
    sine = np.sqrt(1 - (o * q).sum(axis=1) ** 2)
    assert (np.abs(error) <= sine * np.sqrt(1 - got["factor"] ** 2) / got["factor"] * rotated.EPSILON / np.sqrt(63) + 3 * other["step"] / got["factor"]).all()


def test_bands_meet_the_chance_of_a_miss_at_every_size():
    angle = np.arccos(0.93) / np.pi
    for n in (1, 5000, 10**6, 10**9):
        bits, bands = bands_for(n, 0.93, 1e-4)
        assert (1 - (1 - angle) ** bits) ** bands <= 1e-4 and n / 2**bits <= 1 << rotated.BUCKET_BITS
