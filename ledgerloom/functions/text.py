"""Text primitives with java.lang.String's rules, as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Character.isWhitespace: no-break spaces aren't among them.
_WHITE = r"[\t-\r\x1c-\x20  -  -    　]"


#: The same within a line.
BLANKS = _WHITE.replace(r"\t-\r", r"\t\x0b-\r")


def jtrim(x: Column) -> Column:
    """Without characters up to U+0020 at both ends."""
    return F.regexp_replace(x, F.lit(r"\A[\x00-\x20]+|[\x00-\x20]+\z"), F.lit(""))


def strip(x: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(x, F.lit(rf"\A{_WHITE}+|{_WHITE}+\z"), F.lit(""))


def blank(x: Column) -> Column:
    """Only white space or empty (null stays null)."""
    return x.rlike(rf"\A{_WHITE}*\z")


def full_match(x: Column, pattern: str) -> Column:
    return x.rlike(rf"\A(?:{pattern})\z")


def lookup(mapping: Mapping[str, str], key: Column) -> Column:
    """The mapping's value or null, through a map literal (parsed as one expression: a call a literal would take longer than most queries)."""
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.try_element_at(F.expr(f"map({', '.join(quoted(v) for kv in mapping.items() for v in kv)})"), key)


def lines_of(text: Column) -> Column:
    """Lines ended by LF, CR or CRLF."""
    return F.split(text, r"\r\n|\r|\n")


def find_distinct(text: Column, pattern: str) -> Column:
    """All matches, each once, in the order of their first occurrence."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
