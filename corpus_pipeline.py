"""From raw documents to token ids: toxicity, near duplicates, repeated passages, source mix, BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents.  Stages work on whatever their predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.llm.apportion import mix_to_weights
from pressloom.llm.bpe import encode_texts
from pressloom.llm.durable import durable
from pressloom.llm.minhash import near_duplicates
from pressloom.llm.suffix import remove_repeats, with_row_keys
from pressloom.llm.toxicity import learn, score

#: SQL cannot express trained scores or content hashes of this kind; tests/llm compares with brute force.
ORACLE_SQL = None
#: A word with the white space around it that belongs to it.
SPACED_WORD = r"(?:\A[\x20\x09-\x0D]+)?[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.7 or more go; null texts stay."""
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, score_col="_toxicity").where("_toxicity < 0.7").drop("_toxicity")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of the smallest id."""
    keyed = with_row_keys(docs, "doc_id")
    kept = near_duplicates(keyed, id_col="row_key").where("kept").select(F.col("doc_id").alias("row_key"))
    return keyed.join(kept, "row_key", "left_semi").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 200-byte strings that occur more than once go from the texts."""
    return remove_repeats(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: whole copies, then one copy of the words in chosen blocks.

    A word goes with the white space behind it, the first one also with the white space before it.
    """
    keyed = with_row_keys(docs, "doc_id")
    taken = mix_to_weights(keyed, id_col="row_key", chosen=True).where("taken > 0")
    taken = taken.select(F.col("doc_id").alias("row_key"), F.col("passes").alias("_copies"), F.col("chosen").alias("_chosen"))
    copies = F.sequence(F.lit(1), F.col("_copies") + F.when(F.size("_chosen") > 0, 1).otherwise(0))
    rows = keyed.join(taken, "row_key").withColumn("_copy", F.explode(copies))
    words = rows.withColumn("_words", F.when(F.col("_copy") > F.col("_copies"), F.regexp_extract_all("text", F.lit(SPACED_WORD), 0)))
    pieces = F.transform("_chosen", lambda r: F.array_join(F.slice("_words", r["first"].cast("int") + 1, (r["stop"] - r["first"]).cast("int")), ""))
    cut = words.withColumn("text", F.when(F.col("_copy") > F.col("_copies"), F.array_join(pieces, "")).otherwise(F.col("text")))
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text."""
    out = encode_texts(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("source_mix", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are kept in the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = durable(docs)
    return docs
