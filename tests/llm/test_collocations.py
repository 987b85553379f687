"""Phrase collocations against counts written out by hand, and their defined cases."""

from __future__ import annotations

import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pressloom.llm import collocations as K
from pressloom.llm.collocations import collocations

SHAPE = "doc_id long, text string, lang string, phrase string, n long, a long, size int, word string, first string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, g, "p", 1, 2, 3, "w", "f") for i, (t, g) in enumerate(rows)], SHAPE)


def by_hand(rows, least, most_words, top):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            words = re.findall("[^ \t]+", piece)
            totals[lang if lang is not None else "und"] += len(words)
            for k in range(1, most_words + 1):
                counts.update((lang if lang is not None else "und", tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    frequent = {p: c for p, c in counts.items() if c >= least}
    found = {}
    for (lang, p), a in frequent.items():
        if len(p) < 2:
            continue
        inside = any(g == lang and len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for (g, q), b in frequent.items())
        if not inside:
            score, k = min((1000 * a * totals[lang] // (frequent[lang, p[:k]] * frequent[lang, p[k:]]), k) for k in range(1, len(p)))
            found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), frequent[lang, p[:k]], frequent[lang, p[k:]]))
    out = []
    for lang, items in found.items():
        for rank, (score, a, p, left, right) in enumerate(sorted(items)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def texts():
    rnd = random.Random(4)
    words = ["the", "The", "of", "ünï", "中文", "a", "b c", "x\x00y", " ", "d'e"]
    rows = []
    for i in range(260):
        n = rnd.randrange(0, 60)
        rows.append(("".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", " \r\n"]) for _ in range(n)), ["en", "en", "fr", None, ""][i % 5]))
    return [*rows, rows[1], rows[1], (None, "en"), ("", None), (" \t\n", "fr"), ("of the a " * 4000, "en"), ("end of", "en"), ("the start", "en"), ("solo", "solo")]


@pytest.mark.parametrize("least,most_words,top", [(5, 5, 2000), (40, 3, 7), (100, 2, 1)])
def test_collocations_are_those_counted_by_hand(spark, least, most_words, top):
    rows = texts()
    got = collocations(table(spark, rows), least=least, most_words=most_words, top=top).collect()
    assert sorted(tuple(r) for r in got) == by_hand(rows, least, most_words, top)


def test_small_blocks_and_a_full_filter_change_nothing(spark, monkeypatch):
    rows = texts()
    monkeypatch.setattr(K, "BLOCK_BYTES", 500)
    monkeypatch.setattr(K, "FILTER_BITS", 64)  # nearly every bit is set: phrases fall to their exact counts
    got = collocations(table(spark, rows), least=20).collect()
    assert sorted(tuple(r) for r in got) == by_hand(rows, 20, 5, 2000)


def test_nothing_frequent_gives_nothing(spark):
    assert collocations(table(spark, [])).count() == collocations(table(spark, [("a b", "en"), (None, None)])).count() == 0


def test_a_block_hands_its_phrases_on_in_pieces():
    text = " ".join(f"w{i}" for i in range(3 * K.PIECE // 2))
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text])], names=["lang", "text"])
    sizes = [b.num_rows for b in K._counted(1, [])(iter([batch]))]
    assert max(sizes) <= K.PIECE and sum(sizes) == 3 * K.PIECE // 2 + 1
