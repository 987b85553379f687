"""The source mix cuts the blocks it chose, with their white space."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline as P
from pressloom.llm.apportion import mix_to_weights


def test_partly_taken_documents_are_cut_at_the_chosen_blocks(spark, sf):
    text = lambda i: "  " + "".join(f"d{i}w{k}" + ("\n\n" if k % 9 == 8 else "\t ") for k in range(50 + 37 * i))
    docs = spark.createDataFrame([(i, text(i), "en", "abc"[i % 3], 0) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    plan = {r.doc_id: r for r in mix_to_weights(P.with_row_keys(docs, "doc_id"), id_col="row_key", chosen=True).collect()}
    keys = {r.row_key: r.doc_id for r in P.with_row_keys(docs, "doc_id").collect()}
    expected = Counter()
    for key, r in plan.items():
        whole = text(keys[key])
        words = whole.split()
        starts, at = [], 0
        for w in words:
            at = whole.index(w, at)
            starts.append(at)
            at += len(w)
        starts = [0, *starts[1:], len(whole)]
        assert r.passes * r.size + sum(c.stop - c.first for c in r.chosen) == r.taken
        expected[keys[key], whole] += r.passes
        if r.chosen:
            expected[keys[key], "".join(whole[starts[c.first] : starts[c.stop]] for c in r.chosen)] += 1
    assert any(c.first > 0 for r in plan.values() for c in r.chosen) and any(r.chosen and r.chosen[-1].stop == r.size for r in plan.values())
    got = Counter((r.doc_id, r.text) for r in P.mix_sources(spark, docs, sf).collect())
    assert got == +expected
