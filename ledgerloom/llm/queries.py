"""One query a training-data operator, over its whole table: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import chat_format, embedding_dedup, mixing, ngram_join
from ledgerloom.llm.common import residue
from ledgerloom.llm.embedding_dedup import dedup_embeddings
from ledgerloom.llm.html_text import extract_pages
from ledgerloom.llm.language_id import fit_language_id, identify_languages
from ledgerloom.llm.mixing import mix_sources
from ledgerloom.llm.packing import pack_documents
from ledgerloom.llm.quality_classifier import fit_quality_classifier, score_quality
from ledgerloom.llm.quality_rules import apply_quality_rules, fit_quality_rules
from ledgerloom.llm.sharding import shard_documents


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), k=4, p=85, q=100)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(residue(F.col("doc_id"), 5) != 0)
    scored = score_quality(docs, fit_quality_classifier(docs, labels), threshold=0.3)
    return scored.select("doc_id", (residue(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_language_id(docs.where(residue(F.col("doc_id"), 4) != 2))
    scored = identify_languages(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (residue(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), window=2048, end_id=1)


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_embeddings(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat_format.digests(chat_format.format_conversations(turns))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return apply_quality_rules(docs, fit_quality_rules(docs, table(spark, sf_dir, "labels")))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=8)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), cycle=(3, 1, 2), share=1.5, repeats=2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_html_extraction": op3_html_extraction,
    "op4_language_id": op4_language_id,
    "op5_packing": op5_packing,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_chat_format": op7_chat_format,
    "op8_quality_rules": op8_quality_rules,
    "op9_sharding": op9_sharding,
    "op10_mixing": op10_mixing,
}

ORACLES: dict[str, str] = {
    "op1_ngram_join": ngram_join.ORACLE,
    "op6_embedding_dedup": embedding_dedup.ORACLE,
    "op7_chat_format": chat_format.ORACLE,
    "op10_mixing": mixing.ORACLE,
}
