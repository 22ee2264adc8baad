"""JSON text of any column, by its type: as Column expressions, compact or indented by two spaces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Escapes of a JSON string besides \u00xx.
_SHORT = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")]
_OTHER_CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"


def string_json(x: Column) -> Column:
    out = x
    for raw, escaped in _SHORT:
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    hexed = F.array_join(F.transform(F.split(out, ""), lambda c: F.when(c.rlike(_OTHER_CONTROLS), F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(F.ascii(c))), 4, "0"))).otherwise(c)), "")
    return F.concat(F.lit('"'), F.when(out.rlike(_OTHER_CONTROLS), hexed).otherwise(out), F.lit('"'))


def number_json(x: Column) -> Column:
    """Doubles of whole value print without a fraction."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(whole, x.cast("long").cast("string")).otherwise(x.cast("string"))


def json_text(x: Column, kind: T.DataType, indent: int | None = None) -> Column:
    """The value as JSON; null becomes ``null``. ``indent``: the depth of the surrounding object when indented, else compact."""
    return F.coalesce(_value(x, kind, indent), F.lit("null"))


def _wrapped(opens: str, items: Column, closes: str, indent: int | None) -> Column:
    """items: an array of texts."""
    if indent is None:
        return F.concat(F.lit(opens), F.array_join(items, ","), F.lit(closes))
    inner, outer = "\n" + "  " * (indent + 1), "\n" + "  " * indent
    body = F.concat(F.lit(opens + inner), F.array_join(items, "," + inner), F.lit(outer + closes))
    return F.when(F.size(items) == 0, opens + closes).when(items.isNotNull(), body)


def _value(x: Column, kind: T.DataType, indent: int | None) -> Column:
    deeper = None if indent is None else indent + 1
    colon = '": ' if indent is not None else '":'
    if isinstance(kind, T.StringType):
        return string_json(x)
    if isinstance(kind, T.DoubleType | T.FloatType):
        return number_json(x)
    if isinstance(kind, T.ArrayType):
        return _wrapped("[", F.transform(x, lambda e: json_text(e, kind.elementType, deeper)), "]", indent)
    if isinstance(kind, T.StructType):
        parts = [F.concat(F.lit('"' + f.name + colon), json_text(x[f.name], f.dataType, deeper)) for f in kind.fields]
        return F.when(x.isNotNull(), _wrapped("{", F.array(*parts), "}", indent))
    if isinstance(kind, T.MapType):
        entry = lambda e: F.concat(string_json(e["key"]), F.lit(colon[1:]), json_text(e["value"], kind.valueType, deeper))
        return F.when(x.isNotNull(), _wrapped("{", F.transform(F.map_entries(x), entry), "}", indent))
    return x.cast("string")


def object_json(items: list[tuple[str, Column]], indent: int | None = None) -> Column:
    """An object of (name, JSON text) items; items whose text is null are left out."""
    colon = '": ' if indent is not None else '":'
    parts = [F.concat(F.lit('"' + name + colon), text) for name, text in items]
    return _wrapped("{", F.array_compact(F.array(*parts)) if parts else F.array().cast("array<string>"), "}", indent)
