"""The canonical record: one row a candidate, in a fixed nested schema, and its checks.

Defined results: candidates without a claim have empty lists and confidence 0;
a null candidate_id isn't joined to anything and fails validation; repeated
claims count once a source; an empty ledger gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import lookups as L
from ledgerloom.operators import merge as M
from ledgerloom.sources.adapters import EDUCATION, EXPERIENCE

SKILLS = "array<struct<name:string,confidence:double,sources:array<string>>>"
COLUMNS = ["candidate_id", "full_name", "emails", "phones", "location", "links", "headline", "years_experience", "skills", "experience", "education", "provenance", "overall_confidence", "field_confidence"]


def canonical_records(ledger: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """COLUMNS of each candidate of the ledger (and of ``candidates``: candidate_id).

    The parts stay separate columns until the end, so a projection of a few of
    them prunes the reductions that it doesn't need.
    """
    scalars = M.resolve_scalars(ledger)
    entry = F.struct("value_str", "value_num", "confidence", F.col("winning_source").alias("source"), "method")
    wide = scalars.groupBy("candidate_id").agg(*(F.max(F.when(F.col("field_path") == f, entry)).alias(f.replace(".", "_")) for f in L.SCALAR_FIELDS))
    lists = M.dedup_lists(ledger)
    lists = lists.groupBy("candidate_id").agg(*(F.max(F.when(F.col("field_path") == f, F.struct("values", "provenance"))).alias(f"list_{f.replace('.', '_')}") for f in L.MULTI_FIELDS))
    named = lambda df, records: df.select("candidate_id", F.col(records[0]).alias(records[1]), F.col("provenance").alias(f"provenance_{records[1]}"))
    base = (candidates or ledger).select("candidate_id").distinct()
    joined = base
    for part in (
        wide,
        lists,
        named(M.fold_skills(ledger), ("skills", "skills")),
        named(M.merge_experience(ledger), ("records", "experience")),
        named(M.merge_education(ledger), ("records", "education")),
    ):
        joined = joined.join(part, "candidate_id", "left")
    return assemble(joined)


def assemble(parts: DataFrame) -> DataFrame:
    """Canonical records from one row a candidate of resolved parts."""
    column = lambda f: f.replace(".", "_")
    text = lambda f: F.col(f"{column(f)}.value_str")
    strings = lambda f: F.coalesce(F.col(f"list_{column(f)}.values"), F.array().cast("array<string>"))
    value = lambda f: F.coalesce(text(f), F.col(f"{column(f)}.value_num").cast("string"))
    confidence = lambda f: F.when(value(f).isNotNull(), F.col(f"{column(f)}.confidence"))
    none = lambda kind: F.array().cast(kind)
    skills = F.coalesce("skills", none(SKILLS))
    roles, studies = F.coalesce("experience", none(f"array<{EXPERIENCE}>")), F.coalesce("education", none(f"array<{EDUCATION}>"))
    present = {f: confidence(f) for f in L.SCALAR_FIELDS}
    present |= {f: F.when(F.size(x) > 0, F.lit(L.LIST_CONFIDENCE[f])) for f, x in (("emails", strings("emails")), ("phones", strings("phones")), ("experience", roles), ("education", studies))}
    present["skills"] = M.mean_skill_confidence(skills)
    traced = [
        F.filter(F.array(*(F.when(value(f).isNotNull(), F.struct(F.lit(f).alias("field"), F.col(f"{column(f)}.source").alias("source"), F.col(f"{column(f)}.method").alias("method"))) for f in L.SCALAR_FIELDS)), lambda x: x.isNotNull()).cast(M.PROVENANCE),
        *(F.coalesce(F.col(f"list_{column(f)}.provenance"), none(M.PROVENANCE)) for f in L.MULTI_FIELDS),
        *(F.coalesce(F.col(f"provenance_{f}"), none(M.PROVENANCE)) for f in ("skills", "experience", "education")),
    ]
    scored = F.filter(F.array(*(F.when(value(f).isNotNull(), F.struct(F.lit(f).alias("key"), F.col(f"{column(f)}.confidence").alias("value"))) for f in L.SCALAR_FIELDS)), lambda x: x.isNotNull())
    part = lambda group, *names: F.struct(*(text(f"{group}.{n}").alias(n) for n in names), *([strings("links.other").alias("other")] if group == "links" else []))
    return parts.select(
        "candidate_id",
        text("full_name").alias("full_name"),
        strings("emails").alias("emails"),
        strings("phones").alias("phones"),
        part("location", "city", "region", "country").alias("location"),
        part("links", "linkedin", "github", "portfolio").alias("links"),
        text("headline").alias("headline"),
        F.col("years_experience.value_num").alias("years_experience"),
        skills.alias("skills"),
        roles.alias("experience"),
        studies.alias("education"),
        F.concat(*traced).alias("provenance"),
        M.overall_confidence(present).alias("overall_confidence"),
        F.map_from_entries(scored).alias("field_confidence"),
    )


def without_confidence(canonical: DataFrame) -> DataFrame:
    bare = F.transform("skills", lambda s: F.struct(s["name"].alias("name"), s["sources"].alias("sources")))
    return canonical.withColumn("skills", bare).drop("overall_confidence", "field_confidence")


def without_provenance(canonical: DataFrame) -> DataFrame:
    return canonical.drop("provenance")


def validation_errors(schema: T.StructType) -> Column:
    """What is wrong with a canonical record, as an array of messages. Types are checked against the schema, so those checks cost a null test a row."""
    bad = lambda wrong, message: F.when(F.coalesce(wrong, F.lit(True)), message)

    def typed(at: Column, kind: T.DataType | None, allowed: tuple, message: str) -> Column:
        """A value of another type is wrong; null isn't."""
        return F.when(at.isNotNull(), message) if kind is not None and not isinstance(kind, allowed) else F.lit(None).cast("string")

    kind = {f.name: f.dataType for f in schema.fields}
    text = (T.StringType, T.NullType)
    checks = [bad(F.col("candidate_id").isNull() if isinstance(kind["candidate_id"], text) else F.lit(True), "candidate_id must be a string")]
    checks += [typed(F.col(c), kind[c], text, f"{c} must be string|null") for c in ("full_name", "headline") if c in kind]
    for c in ("emails", "phones"):
        fits = isinstance(kind[c], T.ArrayType) and isinstance(kind[c].elementType, text)
        checks.append(bad(~F.forall(F.col(c), lambda x: x.isNotNull()) if fits else F.lit(True), f"{c} must be string[]"))
    if "years_experience" in kind:
        checks.append(typed(F.col("years_experience"), kind["years_experience"], (T.NumericType, T.NullType), "years_experience must be number|null"))
    for c, names in (("location", ("city", "region", "country")), ("links", ("linkedin", "github", "portfolio"))):
        if not isinstance(kind[c], T.StructType):
            checks.append(F.lit(f"{c} must be an object"))
            continue
        checks.append(bad(F.col(c).isNull(), f"{c} must be an object"))
        checks += [typed(F.col(f"{c}.{n}"), kind[c][n].dataType, text, f"{c}.{n} must be string|null") for n in names if n in kind[c].names]
        if c == "links" and "other" in kind[c].names:
            is_list = isinstance(kind[c]["other"].dataType, T.ArrayType)
            checks.append(F.when(F.col("links").isNotNull() & (F.col("links.other").isNull() if is_list else F.lit(True)), "links.other must be string[]"))
    named = isinstance(kind["skills"], T.ArrayType) and isinstance(kind["skills"].elementType, T.StructType) and "name" in kind["skills"].elementType.names
    checks.append(F.when(F.exists(F.col("skills"), lambda s: s.isNull() if named else F.lit(True)), "each skill must be an object with a name"))
    for c in ("experience", "education"):
        is_list = isinstance(kind[c], T.ArrayType)
        checks.append(F.when(F.col(c).isNull() if is_list else F.lit(True), f"{c} must be an array"))
        if is_list:
            wrong = (lambda r: r.isNull()) if isinstance(kind[c].elementType, T.StructType) else (lambda r: F.lit(True))
            checks.append(F.when(F.exists(F.col(c), wrong), f"each {c} entry must be an object"))
    if "overall_confidence" in kind:
        within = F.col("overall_confidence").between(0.0, 1.0) if isinstance(kind["overall_confidence"], T.NumericType) else F.lit(False)
        checks.append(F.when(F.col("overall_confidence").isNotNull() & ~within, "overall_confidence must be a number in [0,1]"))
    return F.array_compact(F.array(*checks))


def validate(canonical: DataFrame) -> DataFrame:
    """canonical with validation_errors."""
    return canonical.withColumn("validation_errors", validation_errors(canonical.schema))
