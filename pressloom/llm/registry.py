"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pressloom.llm import sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pressloom.llm.apportion import mix_to_weights

    return mix_to_weights(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pressloom.llm.lm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from pressloom.llm.toxicity import held_out, learn, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model, score_col="score")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from pressloom.llm.bpe import bpe_digests

    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pressloom.llm.suffix import dedup_digests

    return dedup_digests(table(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pressloom.llm.sketch import fingerprint_edits

    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pressloom.llm.chat import chat_digests, format_chats

    said = "</s>[INST] ok [/INST]"
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], chats.schema)
    return chat_digests(format_chats(chats.unionByName(extra)))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pressloom.llm.mtree import top_k

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from pressloom.llm.extract import extract, train_labeller

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, train_labeller()).withColumn("n_chars", F.char_length("text").cast("long"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pressloom.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pressloom.llm.lloyd import cluster_vectors

    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pressloom.llm.rotated import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pressloom.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_lm_score": op1_lm_score,
        "op2_toxicity": op2_toxicity,
        "op3_bpe": op3_bpe,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_fingerprints": op6_fingerprints,
        "op7_chat_format": op7_chat_format,
        "op8_exact_top_k": op8_exact_top_k,
        "op9_main_text": op9_main_text,
        "op10_near_duplicates": op10_near_duplicates,
        "op11_centroids": op11_centroids,
        "op12_near_vectors": op12_near_vectors,
        "op13_collocations": op13_collocations,
        "pipeline": pipeline,
        "op4_mix_sources": op4_mix_sources,
    }


def oracle_sql() -> dict:
    return sql.ORACLES
