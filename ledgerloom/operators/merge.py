"""Reductions of the ledger: each takes claims and returns one row a candidate and field (or list).

All groupings begin with candidate_id, so a ledger dealt by candidate_id needs
no further exchange. Each reduces in two levels: first by value (partially
aggregated before any exchange, so repeated claims of one candidate shrink
early), then over the different values.

Defined results: claims without a value never win, agree or conflict; repeated
claims of one source count once; ties are broken by trust, date, source order,
value (by UTF-8 bytes) and place, so results don't depend on the rows' order;
an empty ledger gives empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import lookups as L
from ledgerloom.functions.scoring import recency_key, round3, scalar_confidence, skill_confidence

PROVENANCE = "array<struct<field:string,source:string,method:string>>"


def _ordered(entries: Column, key: str, *fields: str) -> Column:
    """An array of structs sorted by their field ``key``, brought to the given fields."""
    laid = F.transform(entries, lambda e: F.struct(e[key].alias("key"), *(e[f].alias(f) for f in fields)))
    return F.transform(F.array_sort(laid), lambda e: e[fields[0]] if len(fields) == 1 else F.struct(*(e[f].alias(f) for f in fields)))


def resolve_scalars(ledger: DataFrame) -> DataFrame:
    """candidate_id, field_path, value_str, value_num, confidence, winning_source, method, agreed, conflicted.

    The winner has the greatest trust, then the latest date, then the first
    source, then the least value. Fields whose claims all lack a value have a
    null winner and confidence 0.
    """
    own = ledger.where(F.col("field_path").isin(L.SCALAR_FIELDS))
    value = F.coalesce("value_str", F.col("value_num").cast("string"))
    rank = F.struct((-F.col("trust")).alias("t"), recency_key(F.col("observed_at")).alias("d"), F.col("src_order").alias("o"), value.alias("v"), F.col("claim_seq").alias("s"))
    known = value.isNotNull()
    by_value = own.groupBy("candidate_id", "field_path", "value_str", "value_num").agg(
        F.min(F.when(known, F.struct(rank.alias("rank"), F.col("source_id").alias("source"), "method", "trust"))).alias("best"),
        F.collect_set(F.when(known, F.col("source_id"))).alias("sources"),
    )
    entry = F.struct("best", "value_str", "value_num")
    won = by_value.groupBy("candidate_id", "field_path").agg(
        F.min(F.when(F.col("best").isNotNull(), entry)).alias("w"),
        F.collect_list(F.struct("value_str", "value_num", "sources")).alias("all"),
    )
    same = lambda x: x["value_str"].eqNullSafe(F.col("w.value_str")) & x["value_num"].eqNullSafe(F.col("w.value_num"))
    agreed = F.size(F.flatten(F.transform(F.filter("all", same), lambda x: x["sources"])))
    conflicted = F.size(F.array_distinct(F.flatten(F.transform(F.filter("all", lambda x: ~same(x)), lambda x: x["sources"]))))
    found = F.col("w").isNotNull()
    counted = won.select("candidate_id", "field_path", "w", F.when(found, agreed).otherwise(0).alias("agreed"), F.when(found, conflicted).otherwise(0).alias("conflicted"))
    confidence = F.when(found, scalar_confidence(F.col("w.best.trust"), F.col("agreed"), F.col("conflicted"))).otherwise(0.0)
    return counted.select(
        "candidate_id",
        "field_path",
        F.col("w.value_str").alias("value_str"),
        F.col("w.value_num").alias("value_num"),
        confidence.alias("confidence"),
        F.col("w.best.source").alias("winning_source"),
        F.col("w.best.method").alias("method"),
        "agreed",
        "conflicted",
    )


def dedup_lists(ledger: DataFrame, fields: Sequence[str] = tuple(L.MULTI_FIELDS)) -> DataFrame:
    """candidate_id, field_path, values, provenance: each value once (ignoring case), by trust, then order; first spelling kept."""
    own = ledger.where(F.col("field_path").isin(list(fields)) & F.col("value_str").isNotNull())
    first = F.min(F.struct((-F.col("trust")).alias("t"), "src_order", "claim_seq", "value_str", "source_id", "method"))
    once = own.groupBy("candidate_id", "field_path", F.lower("value_str").alias("folded")).agg(first.alias("x"))
    key = F.struct("x.t", "x.src_order", "x.claim_seq")
    entry = F.struct(key.alias("key"), F.col("x.value_str").alias("value"), F.col("field_path").alias("field"), F.col("x.source_id").alias("source"), F.col("x.method").alias("method"))
    lists = once.groupBy("candidate_id", "field_path").agg(F.collect_list(entry).alias("e"))
    return lists.select("candidate_id", "field_path", _ordered(F.col("e"), "key", "value").alias("values"), _ordered(F.col("e"), "key", "field", "source", "method").cast(PROVENANCE).alias("provenance"))


def fold_skills(ledger: DataFrame) -> DataFrame:
    """candidate_id, skills (name, confidence, sources), provenance: skills by name ignoring case, sorted by it."""
    own = ledger.where((F.col("field_path") == "skills") & F.col("value_str").isNotNull())
    folded = own.groupBy("candidate_id", F.lower("value_str").alias("folded")).agg(
        F.min(F.struct((-F.col("trust")).alias("t"), "value_str")).alias("display"),
        F.sort_array(F.collect_set("source_id")).alias("sources"),
        F.max("trust").alias("best"),
        F.min(F.struct("src_order", "claim_seq", "method")).alias("first"),
    )
    entry = F.struct(
        F.col("folded").alias("key"),
        F.col("display.value_str").alias("name"),
        skill_confidence(F.greatest(F.lit(0.0), F.col("best")), F.size("sources")).alias("confidence"),
        "sources",
        F.concat(F.lit("skills:"), F.col("display.value_str")).alias("field"),
        F.array_min("sources").alias("source"),
        F.col("first.method").alias("method"),
    )
    lists = folded.groupBy("candidate_id").agg(F.collect_list(entry).alias("e"))
    return lists.select("candidate_id", _ordered(F.col("e"), "key", "name", "confidence", "sources").alias("skills"), _ordered(F.col("e"), "key", "field", "source", "method").cast(PROVENANCE).alias("provenance"))


def merge_records(ledger: DataFrame, field: str, value: str, keys: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """candidate_id, records, provenance of one record field: equal keys (ignoring case) are one record.

    The first record by trust and order wins; its null or empty attributes are
    filled from the next one that has them. Records come in first-seen order.
    """
    own = ledger.where((F.col("field_path") == field) & F.col(value).isNotNull())
    rank = F.struct((-F.col("trust")).alias("t"), "src_order", "claim_seq")
    of = lambda a: F.col(f"{value}.{a}")
    filled = lambda a: of(a).isNotNull() & (of(a).cast("string") != "")
    key = F.concat_ws("", *(F.concat(F.coalesce(F.lower(of(k).cast("string")), F.lit("null")), F.lit("\x01")) for k in keys))
    merged = own.groupBy("candidate_id", key.alias("record_key")).agg(
        F.min(F.struct(rank.alias("rank"), F.col("source_id").alias("source"), "method", value)).alias("first"),
        *(F.min(F.when(filled(a), F.struct(rank.alias("rank"), of(a).alias("v")))).alias(f"fill_{a}") for a in attributes),
    )
    record = F.struct(*(F.coalesce(F.col(f"fill_{a}.v"), F.col(f"first.{value}.{a}")).alias(a) for a in attributes))
    entry = F.struct(F.col("first.rank").alias("key"), record.alias("record"), F.lit(field).alias("field"), F.col("first.source").alias("source"), F.col("first.method").alias("method"))
    lists = merged.groupBy("candidate_id").agg(F.collect_list(entry).alias("e"))
    return lists.select("candidate_id", _ordered(F.col("e"), "key", "record").alias("records"), _ordered(F.col("e"), "key", "field", "source", "method").cast(PROVENANCE).alias("provenance"))


def merge_experience(ledger: DataFrame) -> DataFrame:
    return merge_records(ledger, "experience", "value_exp", ["company", "title"], ["company", "title", "start", "end", "summary"])


def merge_education(ledger: DataFrame) -> DataFrame:
    return merge_records(ledger, "education", "value_edu", ["institution", "degree"], ["institution", "degree", "field", "end_year"])


def overall_confidence(present: dict[str, Column]) -> Column:
    """The weighted mean of the confidences that aren't null, 0 without any; summed in the weights' order."""
    score = weight = F.lit(0.0)
    for field, w in L.OVERALL_WEIGHTS.items():
        c = present.get(field, F.lit(None).cast("double"))
        score = score + F.when(c.isNotNull(), F.lit(w) * c).otherwise(0.0)
        weight = weight + F.when(c.isNotNull(), F.lit(w)).otherwise(0.0)
    return F.when(weight == 0, 0.0).otherwise(round3(score / weight))


def mean_skill_confidence(skills: Column) -> Column:
    total = F.aggregate(skills, F.lit(0.0), lambda acc, s: acc + s["confidence"])
    return F.when(F.size(skills) > 0, round3(total / F.size(skills)))
