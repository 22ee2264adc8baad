"""Scalar normalizers: string Column -> normalized string Column, null where the value can't be normalized."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import lookups as L
from ledgerloom.functions.text import full_match, jtrim, lookup


def email(x: Column) -> Column:
    s = F.lower(jtrim(x))
    return F.when(full_match(s, L.EMAIL), s)


def phone_e164(x: Column) -> Column:
    """7 to 15 digits; a leading + or 00 keeps the country code, bare ten digits get +1."""
    s = jtrim(x)
    digits = F.regexp_replace(s, F.lit(r"\D"), F.lit(""))
    digits = F.when(s.startswith("00"), F.substr(digits, F.lit(3))).otherwise(digits)
    international = s.startswith("+") | s.startswith("00")
    prefix = F.when(~international & (F.length(digits) == 10), "+1").otherwise("+")
    return F.when(F.length(digits).between(7, 15), F.concat(prefix, digits))


def country(x: Column) -> Column:
    """Two letters as they are in upper case, else by the spellings known."""
    s = jtrim(x)
    return F.when(full_match(s, "[A-Za-z]{2}"), F.upper(s)).otherwise(lookup(L.COUNTRIES, F.lower(s)))


def skill(x: Column) -> Column:
    """The display name of a known spelling, else the trimmed text; null for dots alone."""
    s = jtrim(x)
    key = F.regexp_replace(F.lower(s), F.lit(r"\.+\z"), F.lit(""))
    return F.when(key != "", F.coalesce(lookup(L.SKILLS, key), s))


def date_ym(x: Column) -> Column:
    """YYYY-MM, YYYY or ``present``; months aren't checked for their range."""
    s = F.lower(jtrim(x))
    group = lambda pattern, i: F.regexp_extract(s, rf"\A(?:{pattern})\z", i)
    month = lookup(L.MONTHS, F.substr(group(L.DATE_NAMED_MONTH, 1), F.lit(1), F.lit(3)))
    year_month = lambda pattern, y, m: F.concat(group(pattern, y), F.lit("-"), F.lpad(group(pattern, m), 2, "0"))
    return (
        F.when(s.isin(L.PRESENT_WORDS), "present")
        .when(full_match(s, L.DATE_YEAR_MONTH), year_month(L.DATE_YEAR_MONTH, 1, 2))
        .when(full_match(s, L.DATE_MONTH_YEAR), year_month(L.DATE_MONTH_YEAR, 2, 1))
        .when(full_match(s, L.DATE_NAMED_MONTH) & month.isNotNull(), F.concat(group(L.DATE_NAMED_MONTH, 2), F.lit("-"), month))
        .when(full_match(s, r"\d{4}"), s)
    )


def text(x: Column) -> Column:
    """White space collapsed and trimmed; null if nothing is left."""
    return F.nullif(jtrim(F.regexp_replace(x, F.lit(r"\s+"), F.lit(" "))), F.lit(""))


name = text


def year(x: Column) -> Column:
    """The first run of four digits as a number."""
    return F.nullif(F.regexp_extract(x, r"\d{4}", 0), F.lit("")).cast("long")


REGISTRY: dict[str, Callable[[Column], Column]] = {"email": email, "E164": phone_e164, "country": country, "canonical": skill, "date": date_ym, "name": name, "text": text}


def register_sql(spark: SparkSession, prefix: str = "norm_") -> list[str]:
    """Every normalizer as a temporary SQL function (inlined by the optimizer; no Python at run time)."""
    made = []
    for key, function in REGISTRY.items():
        body = _sql_of(spark, function)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{key.lower()}(x STRING) RETURNS STRING RETURN {body}")
        made.append(f"{prefix}{key.lower()}")
    return made


def _sql_of(spark: SparkSession, function: Callable[[Column], Column]) -> str:
    # The expression's own SQL text, from the analyzed plan of a projection over x.
    frame = spark.createDataFrame([], "x string").select(function(F.col("x")).alias("y"))
    expression = frame._jdf.queryExecution().analyzed().expressions().head().child()
    return expression.sql()
