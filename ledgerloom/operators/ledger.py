"""The claim ledger: documents unpivoted into traced claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import lookups as L
from ledgerloom.functions.parsing import parse_json
from ledgerloom.functions.text import lookup
from ledgerloom.sources.adapters import NO_DRAFTS, Adapter, registry
from ledgerloom.sources.manifests import latest_of


def default_trust(source: Column) -> Column:
    return F.coalesce(lookup({k: str(v) for k, v in L.DEFAULT_TRUST.items()}, source).cast("double"), F.lit(L.UNKNOWN_TRUST))


def field_trust(source: Column, base: Column, field: Column) -> Column:
    """The exact (source, field) override, else that of the field's first segment, else ``base``; overrides beat any base."""
    table = {f"{s}|{f}": str(v) for (s, f), v in L.FIELD_TRUST.items()}
    find = lambda f: lookup(table, F.concat(source, F.lit("|"), f)).cast("double")
    return F.coalesce(find(field), find(F.substring_index(field, ".", 1)), base)


def extract(documents: DataFrame, adapters: dict[str, Adapter] | None = None) -> DataFrame:
    """documents with drafts, ok and error.

    documents: candidate_id, pos, type, path, content. An unknown type, a
    missing content and a faulty document have no drafts and an error; other
    documents aren't affected.
    """
    adapters = registry() if adapters is None else adapters
    kinds = [name for name, a in adapters.items() if a.json]
    content, rows = F.col("content"), documents
    if kinds:
        rows = rows.withColumn("doc", F.when(F.col("type").isin(kinds), parse_json(content)))
    added = ["doc"] if kinds else []
    for level in range(max((len(a.stages) for a in adapters.values()), default=0)):
        made = {c: F.when(F.col("type") == name, x) for name, a in adapters.items() if level < len(a.stages) for c, x in a.stages[level].items()}
        rows, added = rows.withColumns(made), [*added, *made]
    drafts, fault = F.lit(None).cast(NO_DRAFTS), F.lit(None).cast("string")
    for name, a in adapters.items():
        drafts, fault = F.when(F.col("type") == name, a.drafts).otherwise(drafts), F.when(F.col("type") == name, a.fault).otherwise(fault)
    unknown = ~F.coalesce(F.col("type").isin(list(adapters)), F.lit(False))
    error = (
        F.when(unknown, F.concat(F.lit("unknown source type '"), F.coalesce("type", F.lit("null")), F.lit("'")))
        .when(content.isNull(), F.concat(F.lit("read failed: "), F.coalesce("path", F.lit("null"))))
        .otherwise(fault)
    )
    named = rows.withColumn("error", error).withColumn("ok", F.col("error").isNull())
    return named.withColumn("drafts", F.when(F.col("ok"), F.coalesce(drafts, F.array().cast(NO_DRAFTS))).otherwise(F.array().cast(NO_DRAFTS))).drop(*added)


def source_log(extracted: DataFrame) -> DataFrame:
    """candidate_id, pos, type, path, ok, claims, error: what became of each entry."""
    return extracted.where("pos IS NOT NULL").select("candidate_id", "pos", "type", "path", "ok", F.size("drafts").alias("claims"), "error")


def build_ledger(extracted: DataFrame) -> DataFrame:
    """The claims, one a row, stamped with source, trust, date and order."""
    base = F.coalesce("trust", default_trust(F.col("type")))
    rows = latest_of(extracted).select(
        "candidate_id",
        F.col("type").alias("source_id"),
        base.alias("base"),
        F.coalesce("timestamp", F.lit(L.EPOCH)).alias("observed_at"),
        "src_order",
        # outer: else the optimizer would infer a filter on drafts and push the whole adapter down with it
        F.posexplode_outer("drafts").alias("claim_seq", "d"),
    )
    return rows.where("claim_seq IS NOT NULL").select(
        "candidate_id",
        "d.field_path",
        "d.raw",
        "d.value_str",
        "d.value_num",
        "d.value_exp",
        "d.value_edu",
        "d.method",
        "source_id",
        field_trust(F.col("source_id"), F.col("base"), F.col("d.field_path")).alias("trust"),
        "observed_at",
        "src_order",
        "claim_seq",
    )
