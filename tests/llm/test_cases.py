"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names for every document operator."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import pytest
from pressloom.llm.apportion import mix_to_weights
from pressloom.llm.bpe import bpe_digests, encode_texts
from pressloom.llm.chat import chat_digests, format_chats, parse
from pressloom.llm.lm import score_documents
from pressloom.llm.minhash import near_duplicates
from pressloom.llm.mtree import top_k
from pressloom.llm.sketch import fingerprint_edits
from pressloom.llm.suffix import dedup_digests, remove_repeats
from pressloom.llm.toxicity import learn, score

import public_tokenizers

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, source string, id string, n long, size long, key string, code long, words string, bucket long, u long, v long"
LONG = " ".join(f"w{i % 977}x{i % 89}" for i in range(40_000))
TEXTS = [
    (1, "one two three four five six", "a"), (2, "one two three four five six", "a"), (2, "one two three four five six", "a"), (3, None, "b"), (4, "", None),
    (5, " \t\n", "b"), (None, "no id here at all", "a"), (None, None, None), (6, "naïve Ünïcode 中文 \U0001f600 text", "c"), (7, LONG, "c"), (8, "x", "a"), (9, LONG + " tail", "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, s, "i", 1, 2, "k", 3, "w", 4, 5, 6) for i, t, s in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_every_row_is_returned_and_empty_tables_are_empty(docs, none):
    for operator in (lambda d: bpe_digests(d, PATH), dedup_digests, fingerprint_edits, near_duplicates, mix_to_weights, score_documents):
        assert Counter(r.doc_id for r in operator(docs).select("doc_id").collect()) == Counter(i for i, _, _ in TEXTS)
        assert operator(none).count() == 0


def test_columns_are_kept_where_the_operator_returns_documents(docs, none):
    assert remove_repeats(docs).columns == docs.columns
    assert encode_texts(docs, PATH).columns == [*docs.columns, "ids"]
    assert remove_repeats(none).count() == encode_texts(none, PATH).count() == 0


def test_null_is_empty(docs):
    empty = hashlib.sha256(b"").hexdigest()
    assert {(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_digests(docs, PATH).where("doc_id IN (3, 4)").collect()} == {(0, empty, empty)}
    assert {(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in dedup_digests(docs).where("doc_id IN (3, 4)").collect()} == {(0, 0, 0, empty)}
    assert {(r.n_shingles, r.kept) for r in near_duplicates(docs).where("doc_id IN (3, 4, 5)").collect()} == {(0, True)}
    assert {(r.size, r.taken) for r in mix_to_weights(docs).where("doc_id IN (3, 4, 5)").collect()} == {(0, 0)}


def test_toxicity_without_labels_or_text(spark, docs, none):
    nothing = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(0 <= r.p < 1e-20 for r in score(docs, learn(docs, nothing), score_col="p").collect())
    assert score(none, learn(docs, nothing), score_col="p").count() == 0


def test_language_model_base_score(spark):
    rows = [(i, t) for i, t in enumerate(["a b a", "A c", None, "", "b b zz", "a new word", "q a b"] * 6)]
    train, sets = Counter(), {}
    for i, t in rows:
        words = [*(t or "").lower().split(), "\n"]
        sets[i] = words
        if zlib.crc32(str(i).encode()) % 7 != 2:
            train.update(words)
    n, v = sum(train.values()), len(train)
    got = {r.doc_id: r for r in score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, words in sets.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 7 == 2, len(words), sum(train[w] > 0 for w in words), n)
        assert r.base_score == pytest.approx(sum(math.log10((train[w] + 1) / (n + 1 * (v + 1))) for w in words), rel=1e-9)
        assert math.isfinite(r.score) and r.score < 0


CHATS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] ok [/INST] <\\/s>"), (1, 2, "user", None), (1, 3, "assistant", ""), (2, None, None, "a\n<s>b"), (2, 5, "x\ny", "t"),
    (2, 5, "x\ny", "t"), (None, 0, "assistant", "<<SYS>> \\ é \U0001f600"), (3, 0, "assistant", "word " * 50_000),
]


def test_chats_read_back(spark):
    chats = spark.createDataFrame([(*c, "z") for c in CHATS], "conv_id long, turn long, role string, text string, formatted string")
    formatted = format_chats(chats)
    for r in formatted.collect():
        turns = sorted((c for c in CHATS if c[0] == r.conv_id), key=lambda c: (c[1] is not None, c[1] or 0, c[2] or "", c[3] or ""))
        assert parse(r.formatted) == [(c[2] or "", c[3] or "") for c in turns]
    for r in chat_digests(formatted).collect():
        turns = [c for c in CHATS if c[0] == r.conv_id]
        said = "".join(c[3] or "" for c in turns if c[2] == "assistant")
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(turns), len(said), hashlib.sha256(said.encode()).hexdigest())
    assert format_chats(chats.where("false")).count() == 0


def test_top_k_leaves_out_broken_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [2.0, 1.0]), (None, [9.0, 9.0]), (6, [float("inf"), 0.0]), (7, [-1.0, 0.5])]
    vectors = spark.createDataFrame([(i, x, 1) for i, x in rows], "vec_id long, embedding array<double>, score int")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in top_k(vectors, vectors.where("vec_id = 0"), k=10).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 4 * 1024 * 1024), (0, 2, 5, 4 * 1024 * 1024), (0, 3, 7, 0)]
    assert top_k(vectors.where("false"), vectors.where("false"), k=10).count() == 0


def test_long_batches_of_conversations_are_cut():
    import pyarrow as pa

    from pressloom.llm.chat import _runs

    table = pa.table({"conv_id": pa.array([1, 1, 2, 3, None, None]), "role": ["user"] * 6, "text": ["x" * 10, None, "y" * 100, "z", "", "w" * 5]})
    assert list(_runs(table, 40)) == [(0, 2), (2, 3), (3, 6)]


def test_neighbouring_large_ids_stay_apart_beside_a_null(spark):
    big = 1 << 53
    chats = spark.createDataFrame([(None, 0, "user", "n"), (big, 0, "user", "a"), (big + 1, 0, "user", "b"), (0, 0, "user", "z")], "conv_id long, turn long, role string, text string").coalesce(1)
    got = {r.conv_id: [t for _, t in parse(r.formatted)] for r in format_chats(chats).collect()}
    assert got == {None: ["n"], big: ["a"], big + 1: ["b"], 0: ["z"]}
