"""Parsers that turn one text or JSON value into arrays of parts, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions import lookups as L
from ledgerloom.functions.text import BLANKS, blank, jtrim, lookup, strip

NUMBERS = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"


# ---- JSON (VARIANT) ----


def parse_json(text: Column) -> Column:
    """The one JSON value that the text is, strictly or else leniently; null if it is none, or something follows it."""
    return F.coalesce(_parse_strict(text), F.when(~blank(text), _parse_strict(strict_json(text))))


def _parse_strict(text: Column) -> Column:
    whole = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).cast("array<variant>")
    return F.when(F.size(whole) == 1, F.get(whole, F.lit(0)))


#: Tokens of lenient JSON: space and comments, quoted texts, marks, bare words.
_TOKENS = r"""\s++|//[^\n]*+|#[^\n]*+|/\*(?s:.*?)\*/|"(?:[^"\\]++|\\(?s:.))*+"|'(?:[^'\\]++|\\(?s:.))*+'|=>|[{}\[\],:;=]|[^\s{}\[\],:;=/\\#"'][^\s{}\[\],:;=/\\#]*+"""
_PLAIN_WORD = r"true|false|null|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?"


def strict_json(text: Column) -> Column:
    """Lenient JSON as strict JSON: single quotes, bare names and words, ``;`` for a comma, ``=`` or ``=>`` for a colon, comments.

    Null for a text that isn't made of such tokens; whether they are in a
    sensible order is for the parser to see.
    """
    every = F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0))
    tokens = F.filter(every, lambda t: ~t.rlike(r"\A(?:\s|//|#|/\*)"))
    quote = lambda x: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.regexp_replace(x, F.lit("\n"), F.lit(r"\\n")), F.lit("\r"), F.lit(r"\\r")), F.lit("\t"), F.lit(r"\\t")), F.lit('"'))
    inner = lambda t: F.substr(t, F.lit(2), F.length(t) - 2)
    unescaped = lambda x: F.regexp_replace(F.regexp_replace(x, F.lit(r"\\'"), F.lit("'")), F.lit(r'(?<!\\)((?:\\\\)*)"'), F.lit(r'$1\\"'))

    def strict(token: Column, following: Column) -> Column:
        name = F.coalesce(following.isin(":", "=", "=>"), F.lit(False))
        return (
            F.when(token.startswith('"'), quote(inner(token)))
            .when(token.startswith("'"), quote(unescaped(inner(token))))
            .when(token == ";", ",")
            .when(token.isin("=", "=>"), ":")
            .when(token.rlike(r"\A[{}\[\],:]\z"), token)
            .when(~name & F.lower(token).rlike(rf"\A(?:{_PLAIN_WORD})\z"), F.lower(token))
            .otherwise(F.concat(F.lit('"'), F.replace(token, F.lit('"'), F.lit('\\"')), F.lit('"')))
        )

    made = F.zip_with(tokens, F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), strict)
    return F.when(F.array_join(every, "") == text, F.array_join(made, ""))


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_object(v: Column) -> Column:
    return F.coalesce(kind(v).startswith("OBJECT"), F.lit(False))


def child(v: Column, key: str) -> Column:
    """The value of an object's key; null if it is absent or JSON null."""
    found = F.try_variant_get(v, f"$['{key}']", "variant")
    return F.when(~F.is_variant_null(found), found)


def has_key(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$['{key}']", "variant").isNotNull()


def string_only(v: Column) -> Column:
    """A JSON string's text; null for values of any other type."""
    return F.when(kind(v) == "STRING", v.cast("string"))


def number_only(v: Column) -> Column:
    return F.when(kind(v).rlike(NUMBERS), v.cast("double"))


def as_text(v: Column) -> Column:
    """Any scalar as text; numbers print as doubles."""
    return F.when(kind(v).rlike(NUMBERS), v.cast("double").cast("string")).when(kind(v).rlike("^(OBJECT|ARRAY)"), F.to_json(v)).otherwise(v.cast("string"))


def first_of(v: Column, *keys: str) -> Column:
    """The first key's value that isn't absent, null, "" or []."""
    values = [child(v, k) for k in keys]
    return F.coalesce(*(F.when(~((kind(x) == "STRING") & (F.coalesce(x.cast("string"), F.lit("")) == "")) & ~kind(x).isin("ARRAY<VOID>", "ARRAY<>") | _filled(x), x) for x in values))


def _filled(x: Column) -> Column:
    return F.when(kind(x).startswith("ARRAY"), F.size(x.cast("array<variant>")) > 0).otherwise(F.lit(False))


def as_list(v: Column) -> Column:
    """An array's elements, a scalar as a list of one, nothing as an empty list; JSON nulls are null."""
    items = F.when(kind(v).startswith("ARRAY"), v.cast("array<variant>")).when(v.isNotNull(), F.array(v))
    return F.transform(F.coalesce(items, F.array().cast("array<variant>")), lambda x: F.when(~F.is_variant_null(x), x))


# ---- text ----


def location_parts(s: Column) -> Column:
    return F.transform(F.filter(F.split(s, ","), lambda p: ~blank(p)), lambda p: strip(p))


def link_field(url: Column) -> Column:
    """Which link field a URL belongs to."""
    low = F.lower(url)
    return F.when(low.contains("linkedin.com"), "links.linkedin").when(low.contains("github.com"), "links.github").otherwise("links.other")


def sections(text: Column) -> Column:
    """The headed sections of a text in order: array of (kind, body). A header is a line of its own, which may end with a colon.

    One pass of one pattern over the whole text; a body is what lies between
    two headers, its first line break included.
    """
    header = _header_line()
    names = F.regexp_extract_all(text, F.lit(header), F.lit(1))
    bodies = F.split(text, header)
    return F.zip_with(names, F.slice(bodies, 2, F.size(names)), lambda name, body: F.struct(lookup(L.SECTIONS, F.lower(name)).alias("kind"), body.alias("body")))


def _header_line() -> str:
    """A pattern of header lines (lines end at LF only); its group is the header."""
    words = "|".join(re.escape(h).replace("k", "[k\u212a]") for h in sorted(L.SECTIONS, key=len, reverse=True))  # U+212A in lower case is k
    return rf"(?dm)^{BLANKS}*((?i:{words})):?{BLANKS}*$"


def lines_under(found: Column, section: str) -> Column:
    """Lines of the last of the sections of one kind."""
    own = F.filter(F.transform(found, lambda x, i: F.struct(x["kind"].alias("kind"), x["body"].alias("body"), (i == F.size(found) - 1).alias("last"))), lambda x: x["kind"] == section)
    held = F.try_element_at(own, F.lit(-1))
    # The line break after the header goes, and so does the one before the next header.
    body = F.when(held["last"], F.substr(held["body"], F.lit(2))).otherwise(F.substr(held["body"], F.lit(2), F.length(held["body"]) - 2))
    empty = F.when(held["last"], F.length(held["body"]) == 0).otherwise(F.length(held["body"]) < 2)
    return F.when(held.isNotNull() & ~empty, F.split(body, "\n")).otherwise(F.array().cast("array<string>"))


def section_lines(text: Column, section: str) -> Column:
    """Lines of the last section so headed, up to the next header."""
    return lines_under(sections(text), section)


def skill_tokens(lines: Column) -> Column:
    """Skills of a skills section: split, edges cleaned, at most LONGEST_SKILL characters."""
    parts = F.flatten(F.transform(lines, lambda line: F.split(line, L.SKILL_SEPARATOR)))
    clean = F.transform(parts, lambda t: F.regexp_replace(strip(t), F.lit(L.SKILL_EDGES), F.lit("")))
    return F.filter(clean, lambda t: (t != "") & (F.length(t) <= L.LONGEST_SKILL))


def phrase_skills(text: Column) -> Column:
    """Skills of the first phrase like ``strong in a, b and c``."""
    phrase = F.regexp_extract(text, L.SKILL_PHRASE, 1)
    clean = F.transform(
        F.split(phrase, L.NOTES_SEPARATOR),
        lambda t: strip(F.regexp_replace(F.regexp_replace(strip(t), F.lit(r"[.\s]+$"), F.lit("")), F.lit(L.FILLER), F.lit(""))),
    )
    return F.filter(clean, lambda t: (t != "") & (F.length(t) <= L.LONGEST_SKILL))


def csv_fields(line: Column) -> Column:
    """Fields of one CSV line: quotes toggle anywhere, a doubled quote within quotes is one."""
    quoted = r'"((?:[^"]++|"")*+)(?:"|\z)'
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(rf',((?:[^",]++|{quoted.replace("((", "(?:(", 1)})*+)'), F.lit(1))
    # What is left of quotes once the toggling ones are gone are the doubled ones.
    plain = lambda x: F.replace(F.regexp_replace(x, F.lit(quoted), F.lit("$1")), F.lit('""'), F.lit('"'))
    return F.transform(raw, lambda x: F.when(F.contains(x, F.lit('"')), plain(x)).otherwise(x))


def csv_value(header: Column, row: Column, column: str) -> Column:
    """The row's trimmed value under the last header of that name; empty if there is none."""
    pairs = F.zip_with(header, row, lambda h, v: F.struct(h.alias("h"), v.alias("v")))
    found = F.filter(pairs, lambda z: (F.lower(jtrim(z["h"])) == column) & z["v"].isNotNull())
    return F.coalesce(jtrim(F.try_element_at(found, F.lit(-1))["v"]), F.lit(""))
