"""A training corpus from documents: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.llm import mixing, neardup, pii, sentence_pieces, toxicity
from loamwork.llm.store import materialise

#: The stages hold a classifier, signatures and a scheduler, which SQL cannot express.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, trained on the labelled ones among them, does not call toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    chain = toxicity.train(docs.select("doc_id", "text"), labels.select("doc_id", "quality", "toxic"))
    return docs.filter(toxicity.score(F.col("text"), chain)["toxic"] < 0.3)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, by text alone: rows that share an id but not their text all count."""
    return neardup.deduplicate(docs)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without personal data and the terms that give it away; n_chars follows the new text."""
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in files and rows ordered by the mix of sources."""
    return mixing.mix_in_order(docs, rows_per_file=5_000).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, n_tokens, and whether decoding gives the text back."""
    return sentence_pieces.tokenize(docs).select("doc_id", "source", "ids", "n_tokens", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("pii", remove_personal_data),
    ("mixing", mix_sources),
    ("sentencepiece", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
