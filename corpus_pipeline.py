"""A training-corpus pipeline: each stage applies one operator to all that its predecessor kept.

Every stage handles nulls, empty and very long texts, repeated rows and empty tables as its operator's docstring
says. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.llm import bpe, jaccard, mixing, phrases, quality
from trackspark.llm.store import staged


def free(name: str, docs: DataFrame) -> str:
    """``name``, or a longer one that no column of ``docs`` has."""
    while name.lower() in (x.lower() for x in docs.columns):
        name += "_"
    return name


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules."""
    return quality.keep(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that smaller documents have; ``n_chars`` follows, and texts of which nothing is left go."""
    before = free("words_before", docs)
    cut = phrases.cut(docs, before=before)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.where((F.col(before) == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]")).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or dropped to give all sources the same weight, in a random order."""
    return mixing.replicated(docs, rate=free("rate", docs), copy=free("copy", docs)).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's number of tokens, and hashes of its ids and of the bytes they decode to."""
    return bpe.digests(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("substring dedup", substring_dedup),
    ("mixing sources to target weights", source_mixing),
    ("byte-level BPE encoding and decoding", byte_bpe),
]

#: SQL can't express the near-duplicate groups or the encoding; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another on ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
