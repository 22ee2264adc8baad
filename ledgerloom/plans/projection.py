"""Runtime projection: a configuration compiled to Columns over canonical records.

    fields: [{path, from?, type?, required?, normalize?}], include_confidence?,
    include_provenance?, on_missing? (null, omit or error)

Paths: dotted names, ``[n]`` (element), ``[]`` (rest of the path of every
element). All that the schema decides (missing names, type mismatches) is
decided here, once; what depends on a row becomes part of its expression.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.normalize import REGISTRY
from ledgerloom.plans.json_text import json_text, object_json

# A name with indices, and an index.
_PART = re.compile(r"([A-Za-z_][A-Za-z0-9_]*)((?:\[[0-9]*\])*)")
_INDEX = re.compile(r"\[([0-9]*)\]")
POLICIES = ("null", "omit", "error")


class ProjectionError(ValueError):
    """A configuration that can't be compiled, or (in strict use) a row that breaks it."""


@dataclass
class Value:
    """A column and its type; no column: the path leads nowhere in any row."""

    column: Column | None
    kind: T.DataType | None


NOWHERE = Value(None, None)


def tokens_of(path: str) -> list[str | int]:
    """Names, indices and ``[]`` marks of a path."""
    parts = path.split(".")
    while parts and parts[-1] == "":
        parts.pop()
    out: list[str | int] = []
    for part in parts:
        m = _PART.fullmatch(part)
        if not m:
            out.append(part)
            continue
        out.append(m[1])
        out += [int(i) if i else "[]" for i in _INDEX.findall(m[2])]
    return out


def resolve(value: Value, path: str) -> Value:
    """Follows a path from a value."""
    for token in tokens_of(path):
        column, kind = value.column, value.kind
        if token == "[]":
            return _pluck(value, path) if isinstance(kind, T.ArrayType) else NOWHERE
        if isinstance(token, int):
            if not isinstance(kind, T.ArrayType):
                return NOWHERE
            value = Value(F.get(column, F.lit(token)), kind.elementType)
        elif isinstance(kind, T.StructType) and token in kind.names:
            value = Value(column[token], kind[token].dataType)
        elif isinstance(kind, T.MapType):
            value = Value(F.try_element_at(column, F.lit(token)), kind.valueType)
        else:
            return NOWHERE
    return value


def _pluck(value: Value, path: str) -> Value:
    after = path.split("[]", 1)[1].removeprefix(".")
    if not after:
        return value
    inner = resolve(Value(F.lit(None), value.kind.elementType), after)
    if inner.column is None:
        return Value(F.when(value.column.isNotNull(), F.array().cast("array<string>")), T.ArrayType(T.StringType()))
    plucked = F.transform(value.column, lambda e: resolve(Value(e, value.kind.elementType), after).column)
    return Value(F.filter(plucked, lambda v: v.isNotNull()), T.ArrayType(inner.kind))


def is_missing(value: Value) -> Column:
    """Absent, null, an empty text or an empty list."""
    if value.column is None:
        return F.lit(True)
    gone = value.column.isNull()
    if isinstance(value.kind, T.StringType):
        return gone | (value.column == "")
    if isinstance(value.kind, T.ArrayType):
        return gone | (F.size(value.column) == 0)
    return gone


def normalized(value: Value, name: str | None) -> Value:
    """A normalizer of the registry on a text (or on each element of a list, nulls kept); unknown names change nothing."""
    if name not in REGISTRY:
        return value
    function = REGISTRY[name]

    def one(x: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            return function(x)
        if name == "E164" and isinstance(kind, T.NumericType):
            return function(x.cast("string"))
        return F.lit(None).cast("string")

    if isinstance(value.kind, T.ArrayType):
        return Value(F.transform(value.column, lambda e: one(e, value.kind.elementType)), T.ArrayType(T.StringType()))
    return Value(one(value.column, value.kind), T.StringType())


def coerced(value: Value, kind: str) -> tuple[Value, Column | None]:
    """Texts to numbers and numbers to texts where asked; and which rows (beyond type_fault) don't fit."""
    x = value.column
    if kind == "number" and isinstance(value.kind, T.StringType):
        number = F.when(x.contains("."), x.try_cast("double")).otherwise(F.when(x.rlike(r"^[+-]?\d+\z"), x.try_cast("bigint").cast("double")))
        return Value(number, T.DoubleType()), number.isNull()
    if kind == "string" and isinstance(value.kind, T.NumericType):
        return Value(x.cast("string"), T.StringType()), None
    return value, None


def type_fault(value: Value, kind: str) -> Column:
    """Which rows' (present) value isn't of the asserted type; unknown types always fit."""
    checks = {"string": T.StringType, "number": T.NumericType, "boolean": T.BooleanType, "object": (T.StructType, T.MapType)}
    if kind in checks:
        return F.lit(not isinstance(value.kind, checks[kind]))
    if kind.endswith("[]"):
        if not isinstance(value.kind, T.ArrayType):
            return F.lit(True)
        inner = kind[:-2]
        wrong = F.exists(value.column, lambda e: type_fault(Value(e, value.kind.elementType), inner))
        return wrong | F.exists(value.column, lambda e: e.isNull()) if inner in checks or inner.endswith("[]") else F.lit(False)
    return F.lit(False)


@dataclass
class Field:
    path: str
    value: Value  # null where missing
    missing: Column
    fault: Column  # a message, or null


def compile_fields(schema: T.StructType, config: Mapping[str, Any]) -> list[Field]:
    """The configured fields in order, each with its value, whether it is missing, and what is wrong."""
    policy = config.get("on_missing", "null")
    if policy not in POLICIES:
        raise ProjectionError(f"on_missing must be null|omit|error, got {policy}")
    strict = policy == "error"
    out = []
    for spec in config.get("fields") or []:
        path = spec["path"]
        source = spec.get("from", path)
        first = _from_columns(schema, source)  # the row's own columns, so that unused ones are pruned
        required = spec.get("required") is True
        fault = F.when(is_missing(first), F.lit(f"required field '{path}' missing (from '{source}')")) if required and strict else F.lit(None).cast("string")
        value, missing = first, is_missing(first)
        if "normalize" in spec and first.column is not None:
            value = normalized(first, spec["normalize"])
            missing = missing | is_missing(value)
            if required and strict:
                fault = F.coalesce(fault, F.when(is_missing(value), F.lit(f"required field '{path}' empty after normalize")))
        kind = spec.get("type")
        if kind and value.column is not None:
            before = value
            value, unfit = coerced(value, kind)
            wrong = type_fault(value, kind) if unfit is None else unfit
            message = F.concat(F.lit(f"field '{path}' = "), F.coalesce(json_text(before.column, before.kind), F.lit("null")), F.lit(f" is not of type '{kind}'"))
            fault = F.coalesce(fault, F.when(~missing & wrong, message))
        if value.column is None:
            value = Value(F.lit(None).cast("string"), T.StringType())
        value = Value(F.when(~missing, value.column), value.kind)
        out.append(Field(path, value, missing, fault))
    return out


def _from_columns(schema: T.StructType, path: str) -> Value:
    tokens = tokens_of(path)
    if not tokens or tokens[0] not in schema.names:
        return NOWHERE
    name = tokens[0]
    rest = path[len(name) :]
    root = Value(F.col(f"`{name}`"), schema[name].dataType)
    if rest.startswith("["):  # indices of the first part
        head, _, tail = rest.partition(".")
        for i in _INDEX.findall(head):
            if i == "":
                return _pluck(root, path) if isinstance(root.kind, T.ArrayType) else NOWHERE
            if not isinstance(root.kind, T.ArrayType):
                return NOWHERE
            root = Value(F.get(root.column, F.lit(int(i))), root.kind.elementType)
        return resolve(root, tail)
    return resolve(root, rest.removeprefix("."))


def _tree(fields: list[Field]) -> dict:
    """Fields by output path: nested dicts, later ones replace earlier ones."""
    root: dict = {}
    for f in fields:
        parts = f.path.split(".")
        while len(parts) > 1 and parts[-1] == "":
            parts.pop()
        at = root
        for p in parts[:-1]:
            at = at.setdefault(p, {})
            if not isinstance(at, dict):
                raise ProjectionError(f"output path '{f.path}' lies below a value")
        at[parts[-1]] = f
    return root


def _column(node: dict | Field) -> Column:
    return node.value.column if isinstance(node, Field) else F.struct(*(_column(v).alias(k) for k, v in node.items()))


def _json(node: dict | Field, omit: bool, indent: int | None) -> Column:
    if isinstance(node, Field):
        text = json_text(node.value.column, node.value.kind, indent)
        return F.when(~node.missing, text) if omit else text
    deeper = None if indent is None else indent + 1
    whole = object_json([(k, _json(v, omit, deeper)) for k, v in node.items()], indent)
    return F.when(F.coalesce(*(_json(v, omit, deeper) for v in node.values())).isNotNull(), whole) if omit and node else whole


def _extras(schema: T.StructType, config: Mapping[str, Any]) -> list[str]:
    confidence = config.get("include_confidence") if isinstance(config.get("include_confidence"), bool) else True
    provenance = config.get("include_provenance") if isinstance(config.get("include_provenance"), bool) else False
    return [c for c, wanted in (("overall_confidence", confidence), ("provenance", provenance)) if wanted and c in schema.names]


def project(canonical: DataFrame, config: Mapping[str, Any]) -> DataFrame:
    """The configured columns (nested by output path), the included extras, and projection_error (null where all is well).

    Under ``omit`` a column can't be absent from one row: missing values are
    null here, and absent from the text that project_json() makes.
    """
    fields = compile_fields(canonical.schema, config)
    columns = [_column(v).alias(k) for k, v in _tree(fields).items()]
    extras = [c for c in _extras(canonical.schema, config) if c not in _tree(fields)]
    return canonical.select(*columns, *extras, _error(fields).alias("projection_error"))


def project_json(canonical: DataFrame, config: Mapping[str, Any] | None, pretty: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """``output`` (JSON text; without config the whole record) and projection_error of each row, beside ``keep`` columns."""
    schema = canonical.schema
    at = 0 if pretty else None
    deeper = 1 if pretty else None
    if config is None:
        items = [(f.name, json_text(F.col(f.name), f.dataType, deeper)) for f in schema.fields if f.name not in keep or f.name == "candidate_id"]
        return canonical.select(*keep, object_json(items, at).alias("output"), F.lit(None).cast("string").alias("projection_error"))
    fields = compile_fields(schema, config)
    omit = config.get("on_missing") == "omit"
    items = {k: _json(v, omit, deeper) for k, v in _tree(fields).items()}
    items |= {c: json_text(F.col(c), schema[c].dataType, deeper) for c in _extras(schema, config)}
    error = _error(fields)
    return canonical.select(*keep, F.when(error.isNull(), object_json(list(items.items()), at)).alias("output"), error.alias("projection_error"))


def _error(fields: list[Field]) -> Column:
    return F.coalesce(*(f.fault for f in fields)) if fields else F.lit(None).cast("string")


def strict(projected: DataFrame) -> DataFrame:
    """The projection without its error column; a row with an error fails the query."""
    checked = projected.withColumn("projection_error", F.when(F.col("projection_error").isNotNull(), F.raise_error("projection_error")))
    return checked.where(F.col("projection_error").isNull()).drop("projection_error")
