"""The corpus pipeline over documents: quality, language, near copies, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one
before kept; all but the last return the columns of documents. Null columns,
repeated rows and empty tables pass through each stage as its operator defines.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import residue, written
from ledgerloom.llm.language_id import fit_language_id, identify_languages
from ledgerloom.llm.mixing import mix_sources
from ledgerloom.llm.ngram_join import jaccard_components
from ledgerloom.llm.packing import pack_documents
from ledgerloom.llm.quality_classifier import fit_quality_classifier, score_quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
QUALITY_THRESHOLD = 0.3
LANGUAGE_THRESHOLD = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose calibrated quality is at least QUALITY_THRESHOLD; texts without a word go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(residue(F.col("doc_id"), 5) != 0)
    model = fit_quality_classifier(docs, labels)
    return score_quality(docs.select(COLUMNS), model, QUALITY_THRESHOLD).where("predicted = 1").select(COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of a recognised language: not ``und``, and a score of at least LANGUAGE_THRESHOLD."""
    model = fit_language_id(docs.where(residue(F.col("doc_id"), 4) != 2))
    return identify_languages(docs.select(COLUMNS), model).where((F.col("lang_pred") != "und") & (F.col("score") >= LANGUAGE_THRESHOLD)).select(COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity 0.8 or more): that of the least id.

    Rows are told apart by id and content, so different texts under one id (or
    none) each count; rows that agree in all columns are one.
    """
    rest = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in COLUMNS[1:]]
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64(*rest).alias("content"))
    rows = docs.select(COLUMNS).withColumn("own", own)
    found = jaccard_components(rows.select(F.col("own").alias("doc_id"), "text"), k=5, p=80, q=100)
    kept = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("own")).distinct()
    return rows.join(kept, "own", "left_semi").dropDuplicates(["own"]).select(COLUMNS).coalesce(max(12, docs.count() // 10_000))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many whole copies of each row as the mix takes; the last one of a source is whole or left out, whichever is nearer."""
    mixed = mix_sources(docs.select(COLUMNS), cycle=(3, 1, 2), share=1.5, repeats=2, carry=COLUMNS[1:])
    copies = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    return mixed.where("taken > 0").withColumn("copy", F.explode(F.array_repeat(F.lit(1), copies))).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 2048-token sequences, filled with lexical neighbours."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), window=2048, end_id=1)


STAGES = [
    ("quality_classifier", quality),
    ("language_id", language),
    ("ngram_jaccard_join", near_copies),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL can't express the trained stages; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole documents table; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
