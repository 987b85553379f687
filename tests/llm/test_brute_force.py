"""Operators whose results SQL cannot give, against brute force, the library itself or held-out labels."""

from __future__ import annotations

import hashlib
import random
import zlib

import public_tokenizers
import pytest
from pressloom import llm
from pressloom.llm.extract import blocks, extract, train_labeller
from pressloom.llm.minhash import near_duplicates
from pressloom.llm.sketch import fingerprint_edits
from pressloom.llm.suffix import dedup_digests, remove_repeats
from tokenizers import Tokenizer

from tests.oracle import assert_same

Q, SQL = llm.queries(), llm.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf, name):
    assert_same(Q[name](spark, sf), sf, SQL[name])


def texts_of(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def test_bpe_is_the_library(spark, sf):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation(), library.no_padding()
    texts = texts_of(spark, sf)
    for r in Q["op3_bpe"](spark, sf).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def repeated(texts: list[bytes], length: int) -> list[list[bool]]:
    at: dict[bytes, list] = {}
    for d, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            at.setdefault(t[i : i + length], []).append((d, i))
    out = [[False] * len(t) for t in texts]
    for places in at.values():
        for d, i in places if len(places) > 1 else ():
            out[d][i : i + length] = [True] * length
    return out


def check_dedup(rows, texts: dict[int, bytes], length: int):
    keys = list(texts)
    for r, marks in ((rows[k], m) for k, m in zip(keys, repeated([texts[k] for k in keys], length), strict=True)):
        kept = bytes(b for b, m in zip(texts[r.doc_id], marks, strict=True) if not m)
        spans = sum(m and not (i and marks[i - 1]) for i, m in enumerate(marks))
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(marks), sum(marks), spans, hashlib.sha256(kept).hexdigest())


def test_suffix_dedup_on_documents(spark, sf):
    some = {k: t.encode() for k, t in texts_of(spark, sf).items()}
    check_dedup({r.doc_id: r for r in Q["op5_suffix_dedup"](spark, sf).collect()}, some, 200)


def test_suffix_dedup_on_repetitive_texts(spark):
    rng = random.Random(3)
    parts = ["ab" * 150, "z" * 450, "".join(rng.choice("abc") for _ in range(230)), "é" * 110, "q" * 199]
    texts = {i: "".join(rng.choice(parts)[: rng.randrange(150, 460)] for _ in range(rng.randrange(4))) for i in range(40)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check_dedup({r.doc_id: r for r in dedup_digests(df).collect()}, {k: t.encode() for k, t in texts.items()}, 200)
    kept = {r.doc_id: r.text for r in remove_repeats(df).collect()}
    assert set(kept) == set(texts) and any(len(kept[k]) < len(texts[k]) for k in texts)


def shingles(text: str, width: int) -> set:
    words = text.translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())


def smallest_reachable(sets: dict[int, set]) -> dict[int, int]:
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in sets}


def test_near_duplicates_in_a_chain(spark):
    words = [f"t{i}" for i in range(60)]
    texts = {i: " ".join([*words[: 60 - i], *(f"s{i}x{j}" for j in range(i))]) for i in range(0, 30)}
    texts |= {100 + i: f"Short text {i % 3}" for i in range(9)} | {200: "", 201: "one"}
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), width=4).collect()}
    sets = {k: shingles(t, 4) for k, t in texts.items()}
    want = smallest_reachable(sets)
    assert got == {k: (want[k], len(sets[k])) for k in texts}


def test_fingerprints_of_edits(spark):
    texts = {1: "a b c d e f g h", 2: "a b c d e f g h", 3: "", 4: "naïve 中文 text of words that goes on for a while", 5: "x"}
    got = {r.doc_id: r for r in fingerprint_edits(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    order = sorted(texts, reverse=True)
    for k, following in zip(order, [*order[1:], order[0]], strict=True):
        half = len(texts[k]) // 2
        edited = texts[k][: len(texts[k]) - half] + texts[following][:half]
        assert got[k].n_chars == len(texts[k]) and got[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[k].near_edited <= 1 and 0 <= got[k].near_next <= 1
    assert got[1].fingerprint == got[2].fingerprint and got[2].near_next == 1.0


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"  # some 300 toxic examples to learn from, in four languages
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    pairs = [(r.predicted, toxic[r.doc_id]) for r in Q["op2_toxicity"](spark, sf).collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and r.held_out and r.doc_id in toxic]
    assert sum(t for _, t in pairs) >= 3
    assert sum(p == t for p, t in pairs) >= 0.95 * len(pairs)
    assert sum(p for p, t in pairs if t) >= 0.7 * sum(t for _, t in pairs)


PAGE = """<html><head><title>Site</title><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></nav>
<div class="cookie-notice"><p>We use cookies to improve your visit.</p><button>Accept</button></div><main><article><h1>Bridge &amp; river</h1>
<p>The old bridge over the river was opened again on Monday after two years of careful repair work by the town.</p>
<p>Engineers replaced most of the timber, and the  mayor said that the cost stayed within the   planned budget.</p></article></main>
<aside class="sidebar"><h3>Related</h3><ul><li><a href=/a>Ten other stories</a></ul></aside><div id="comments"><p>Great news, thanks for this!</p></div>
<footer><p>Copyright 2024 Site. All rights reserved.</p></footer><script>var x = "<p>no</p>";</script></body></html>"""


def test_main_text_of_pages(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>a<b")], "page_id long, url string, html string")
    model = train_labeller()
    got = {r.page_id: r.text for r in extract(pages, model).collect()}
    assert "opened again on Monday after two years" in got[1] and "the mayor said that the cost stayed within the planned budget." in got[1]
    assert not any(x in got[1] for x in ("cookies", "Home", "Ten other", "Great news", "Copyright", "var x"))
    assert got[2] == got[3] == "" and isinstance(got[4], str)
    assert extract(pages.where("false"), model).count() == 0
    assert [b[0] for b in blocks("<p>a &lt; b</p><script>x</script>c")] == ["a < b", "c"]


def test_language_model_beats_its_base_on_held_out(spark):
    rows = [r for r in Q["op1_lm_score"](spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert rows and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_seats_go_to_the_highest_quotients():
    import numpy as np

    from pressloom.llm.apportion import sainte_lague

    rng = np.random.default_rng(0)
    for _ in range(100):
        votes, seats = rng.integers(0, 20, rng.integers(1, 12)), int(rng.integers(0, 60))
        want = [0] * len(votes)
        for _ in range(seats if votes.sum() else 0):
            want[max(range(len(votes)), key=lambda i: (votes[i] / (2 * want[i] + 1), -i))] += 1
        assert sainte_lague(votes, seats).tolist() == want
