"""Corpus cleaning pipeline: each stage works on what the one before it kept.

Stages take and return ``documents`` rows with all their columns, whatever further columns are called; the last returns
packed sequences. Nothing is removed without evidence: without labelled rows of both classes no
document is toxic, and null and blank texts pass every stage. Rows with a null ``doc_id`` are never copies and
keep their texts whole. Rows that repeat a ``doc_id`` are judged by their own texts. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ngram_join, packing, suffix_dedup, toxicity
from tessera.llm.words import fresh
from tessera.storage import hand_on, materialize, scratch_files


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, does not reject."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if not model.evidence:
        return docs
    score = fresh(docs, "_toxicity")
    scored = toxicity.score(docs, model, score_col=score)
    blank = F.coalesce(~F.col("text").rlike(r"\S"), F.lit(True))
    return scored.where(blank | (F.col(score) < toxicity.THRESHOLD)).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near duplicates."""
    key = fresh(docs, "_text_key")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    found = ngram_join.near_duplicates(keyed, keep=(key,))
    copies = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id", key).distinct()
    return keyed.join(copies, ["doc_id", key], "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller id has."""
    return suffix_dedup.remove_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining texts in sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, writing each stage's rows and reading them again.

    What a stage wrote for itself is deleted when its rows are written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with scratch_files(spark):
            docs = hand_on(materialize(stage(spark, docs, sf_dir), f"stage{k}"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained classifier and a tokenizer have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None
