"""The registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, jaccard, lm, media, merkle, mixing, phrases, quality, suffixes, trie, urls, warc


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score(_table(spark, folder, "documents"))


def op2_byte_level_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(_table(spark, folder, "documents"))


def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.digests(_table(spark, folder, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, folder, "documents"))


def op5_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.digests(_table(spark, folder, "documents"))


def op6_media_columns(spark: SparkSession, folder: str) -> DataFrame:
    return media.described(_table(spark, folder, "documents")).drop("digest")


def op7_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return urls.filtered(_table(spark, folder, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op8_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and number -7, whose two texts are control strings."""
    rows = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], rows.schema)
    return chat.digests(chat.formatted(chat.from_rows(rows.union(planted), "conv_id")), "conv_id")


def op9_mixing_to_target_weights(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.replicated(_table(spark, folder, "documents")).select("doc_id", "source", "text", "copy")


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score(_table(spark, folder, "documents"))


def op11_warc_archives(spark: SparkSession, folder: str) -> DataFrame:
    return warc.described(_table(spark, folder, "pages"))


def op12_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie.nodes(trie.rebuilt(trie.sequences(_table(spark, folder, "conversations"))))


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.manifest(_table(spark, folder, "documents"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_lm_scoring, op2_byte_level_bpe, op3_substring_dedup, op4_ngram_jaccard_join, op5_suffix_array_dedup, op6_media_columns, op7_url_filters, op8_chat_formatting, op9_mixing_to_target_weights, op10_quality_rules, op11_warc_archives, op12_conversation_trie, op13_merkle_manifest)
    return {f.__name__: f for f in found} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op7_url_filters": urls.SQL, "op8_chat_formatting": chat.SQL, "op9_mixing_to_target_weights": mixing.SQL, "op11_warc_archives": warc.SQL, "op12_conversation_trie": trie.SQL, "op13_merkle_manifest": merkle.SQL}
