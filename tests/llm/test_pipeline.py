"""The pipeline: stages keep the columns of documents, decisions take effect, ids are the library's."""

from __future__ import annotations

import corpus_pipeline as P
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.test_brute_force import shingles, smallest_reachable


def test_stages_one_by_one(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    columns, seen = docs.columns, {}
    for i, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert i == len(P.STAGES) - 1 or docs.columns == columns
        seen[name] = docs.collect()
    toxic, clean = ({r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where(f"toxic = {x}").collect()} for x in (1, 0))
    after = {r.doc_id for r in seen["toxicity"]}
    assert after <= set(before) and len(toxic - after) >= 0.75 * len(toxic) and len(clean & after) >= 0.97 * len(clean)
    roots = smallest_reachable({k: shingles(before[k] or "", 5) for k in after})
    assert sorted(r.doc_id for r in seen["near_duplicates"]) == sorted(k for k, v in roots.items() if k == v)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation(), library.no_padding()
    mixed = sorted((r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids) for r in seen["source_mix"])
    assert sorted((r.doc_id, list(r.ids)) for r in seen["bpe"]) == mixed


def test_empty_documents(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0
