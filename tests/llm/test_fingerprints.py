"""Likeness of fingerprints against true shingle sets, and what sketches tell when merged."""

from __future__ import annotations

import random

from pressloom.llm import sketch as S
from pyspark.sql import functions as F


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(text, following):
    n = len(text)
    return text[: n - n // 2] + following[: n // 2]


def test_likeness_is_that_of_the_shingle_sets(spark):
    rnd = random.Random(3)
    stock = [f"w{i}" for i in range(400)]
    texts = {i: " ".join(rnd.choice(stock) for _ in range(rnd.choice([0, 1, 3, 5, 40, 100, 900]))) for i in range(60)}
    for i in range(0, 60, 7):
        texts[i] = texts[i + 1] if i % 2 else None
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in S.fingerprint_edits(rows).collect()}
    order = sorted(texts, reverse=True)
    for at, i in enumerate(order):
        text, following = texts[i] or "", texts[order[(at + 1) % len(order)]] or ""
        own, cut, nxt = shingles(text), shingles(edited(text, following)), shingles(following)
        # both sketches hold all hashes of small sets: the likeness is exact; else it is within four standard errors
        for value, other in ((got[i].near_edited, cut), (got[i].near_next, nxt)):
            assert abs(value - jaccard(own, other)) <= (1e-9 if len(own | other) < S.K else 4 * 0.045), i
        assert got[i].n_chars == len(text)
        assert abs(got[i].n_shingles_estimate - len(own)) <= (0 if len(own) < S.K else 0.4 * len(own))


def test_containment_and_merged_parts(spark):
    words = [f"v{i}" for i in range(2000)]
    whole, half = " ".join(words), " ".join(words[:1000])
    df = spark.createDataFrame([(1, "k", whole), (2, "k", half), (3, "m", "one two"), (4, "m", None)], "id int, key string, text string")
    sk = df.select("id", "key", S.word_codes(F.col("text")).alias("c")).select("id", "key", S.sketch(F.col("c")).alias("s")).cache()
    pair = sk.where("id = 2").select(F.col("s").alias("a")).crossJoin(sk.where("id = 1").select(F.col("s").alias("b")))
    got = pair.select(S.containment(F.col("a"), F.col("b")).alias("ab"), S.containment(F.col("b"), F.col("a")).alias("ba"), S.resemblance(F.col("a"), F.col("b")).alias("r")).first()
    assert got.ab > 0.8 and abs(got.ba - 0.5) < 0.2 and abs(got.r - 0.5) < 0.2
    parts = {r.key: r.s for r in S.merged(sk, "key", "s").collect()}
    alone = {r.id: r.s for r in sk.collect()}
    assert parts["k"] == sorted(set(alone[1]) | set(alone[2]))[: S.K] and parts["m"] == alone[3]
