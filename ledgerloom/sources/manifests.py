"""Manifests (JSON) and the documents they name, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.parsing import as_list, as_text, child, has_key, number_only, parse_json, string_only

SOURCES = "candidate_id string, pos int, type string, path string, timestamp string, trust double, location string"


def read_manifests(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row a source entry of each manifest: SOURCES; manifests without entries have one row with a null pos.

    A manifest that isn't a JSON object raises. ``location`` is the entry's
    path relative to its manifest.
    """
    raw = spark.read.text(paths, wholetext=True).select(F.col("value"), F.col("_metadata.file_path").alias("file"))
    found = raw.withColumn("doc", parse_json(F.col("value")))
    usable = F.coalesce(F.schema_of_variant("doc").startswith("OBJECT"), F.lit(False))
    found = found.withColumn("doc", F.when(usable, F.col("doc")).otherwise(F.raise_error(F.concat(F.lit("manifest is not a JSON object: "), F.col("file"))).cast("variant")))
    base = F.regexp_replace("file", r"/[^/]*$", "")
    entries = found.select(F.coalesce(string_only(child(F.col("doc"), "candidate_id")), F.lit("unknown")).alias("candidate_id"), base.alias("base"), F.posexplode_outer(as_list(child(F.col("doc"), "sources"))).alias("pos", "entry"))
    entry = F.col("entry")
    path = string_only(child(entry, "path"))
    stamp = F.when(has_key(entry, "timestamp"), F.coalesce(as_text(child(entry, "timestamp")), F.lit("null")))
    return entries.select(
        "candidate_id",
        "pos",
        string_only(child(entry, "type")).alias("type"),
        path.alias("path"),
        stamp.alias("timestamp"),
        number_only(child(entry, "trust")).alias("trust"),
        F.when(path.startswith("/"), path).otherwise(F.concat("base", F.lit("/"), path)).alias("location"),
    )


def read_documents(spark: SparkSession, sources: DataFrame, paths: str | list[str]) -> DataFrame:
    """sources with ``content``: the whole text of the file at its location, null where there is none.

    paths: the files or folders to look in (read once, by Spark; malformed
    UTF-8 becomes U+FFFD).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    texts = files.select(F.regexp_replace("path", r"^file:/+", "/").alias("file"), F.expr("make_valid_utf8(cast(content AS string))").alias("content"))
    key = F.regexp_replace(F.regexp_replace("location", r"^file:/+", "/"), r"/\./", "/")
    return sources.withColumn("file", key).join(texts, "file", "left").drop("file")


def latest_of(sources: DataFrame) -> DataFrame:
    """sources with ``src_order``: how many usable entries (column ok) of the candidate come before."""
    # Entries of equal pos (never so in a manifest) are ordered by what else they have, so the order is fixed.
    ties = [c for c in ("type", "path", "timestamp", "trust") if c in sources.columns]
    before = Window.partitionBy("candidate_id").orderBy("pos", *ties).rowsBetween(Window.unboundedPreceding, -1)
    return sources.withColumn("src_order", F.coalesce(F.sum(F.col("ok").cast("int")).over(before), F.lit(0)).cast("int"))
