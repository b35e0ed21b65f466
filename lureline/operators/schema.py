"""P23 from a schema document: constraints compiled to columns, over tables or over raw JSON rows.

Of JSON Schema the parts that records need: type, required, enum, const, pattern, minLength, maxLength, minimum, maximum, minItems, maxItems,
uniqueItems, format date, items (of texts or objects), and additionalProperties false. A keyword that is not known is an error, not ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lureline.operators.checks import violations

_PLAIN = {"string": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType()}
_NOTES = {"$schema", "$id", "title", "description", "$comment"}
_KNOWN = _NOTES | {"type", "required", "properties", "additionalProperties", "enum", "const", "pattern", "minLength", "maxLength", "minimum", "maximum", "minItems", "maxItems", "uniqueItems", "format", "items"}


def _kind(prop: dict[str, Any]) -> tuple[str, bool]:
    """The type of a property, and whether null will do."""
    kinds = prop.get("type", "string")
    kinds = [kinds] if isinstance(kinds, str) else list(kinds)
    own = [k for k in kinds if k != "null"]
    if len(own) != 1:
        raise ValueError(f"one type is needed beside null: {kinds}")
    return own[0], "null" in kinds


def type_of(prop: dict[str, Any]) -> T.DataType:
    unknown = set(prop) - _KNOWN
    if unknown:
        raise ValueError(f"unknown keywords: {sorted(unknown)}")
    kind, _ = _kind(prop)
    if kind == "array":
        return T.ArrayType(type_of(prop.get("items", {"type": "string"})))
    if kind == "object":
        return T.StructType([T.StructField(n, type_of(p)) for n, p in prop.get("properties", {}).items()])
    return _PLAIN[kind]


def _tests(c: Column, prop: dict[str, Any]) -> list[tuple[str, Column]]:
    """(keyword, column that is true on good values) of a property that is there."""
    kind, _ = _kind(prop)
    of: dict[str, Callable[[Any], Column]] = {
        "enum": lambda v: c.isin(*[x for x in v if x is not None]),
        "const": lambda v: c == F.lit(v),
        "pattern": lambda v: c.rlike(v),
        "minLength": lambda v: F.length(c) >= v,
        "maxLength": lambda v: F.length(c) <= v,
        "minimum": lambda v: c >= v,
        "maximum": lambda v: c <= v,
        "minItems": lambda v: F.size(c) >= v,
        "maxItems": lambda v: F.size(c) <= v,
        "uniqueItems": lambda v: F.size(c) == F.size(F.array_distinct(c)) if v else F.lit(True),
    }
    out = [(k, of[k](v)) for k, v in prop.items() if k in of]
    if "format" in prop:
        if prop["format"] != "date":
            raise ValueError(f"unknown format: {prop['format']}")
        out.append(("format", c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).isNotNull()))
    if kind == "array" and "items" in prop:
        out += [(f"items.{n}", F.forall(c, _holds(n, prop["items"]))) for n, _ in _of_value(c, prop["items"], probe=True)]
    return out


def _holds(name: str, item: dict[str, Any]) -> Callable[[Column], Column]:
    return lambda x: F.coalesce(dict(_of_value(x, item))[name], F.lit(False))


def _of_value(c: Column, prop: dict[str, Any], probe: bool = False) -> list[tuple[str, Column]]:
    """The tests of an item: of the text itself, or of each field of an object. ``probe``: only the names count."""
    if _kind(prop)[0] != "object":
        return _tests(F.lit(None).cast(type_of(prop)) if probe else c, prop)
    whole = F.lit(None).cast(type_of(prop)) if probe else c
    return [(f"{n}.{k}" if k else n, x) for n, p in prop.get("properties", {}).items() for k, x in _field(whole[n], p, n in prop.get("required", ()))]


def _field(c: Column, prop: dict[str, Any], required: bool) -> list[tuple[str, Column]]:
    """Tests of a field: there if required (and no null unless null will do), and good where it is there."""
    out = [("required", c.isNotNull())] if required and not _kind(prop)[1] else []
    return out + [(k, c.isNull() | x) for k, x in _tests(c, prop)]


def constraints(schema: dict[str, Any]) -> dict[str, Column]:
    """`field.keyword`: a column that is true on good rows, for a table with the schema's fields as columns."""
    type_of(schema)  # unknown keywords are an error
    return {f"{n}.{k}": x for n, p in schema.get("properties", {}).items() for k, x in _field(F.col(n), p, n in schema.get("required", ()))}


def line_violations(lines: DataFrame, key: list[str], column: str, schema: dict[str, Any]) -> DataFrame:
    """The broken constraints of raw JSON rows: those of the schema, `json` for what is no object, and `unknown:<field>` for fields it does not
    name (where additionalProperties is false). A field of another type than the schema's is read as missing. Key columns may have any name."""
    fields = schema.get("properties", {})
    rows = lines.select(F.struct(*key).alias("_key"), F.from_json(column, type_of(schema), {"mode": "PERMISSIVE"}).alias("_r"), F.json_object_keys(column).alias("_names"))
    broken = violations(rows.where(F.col("_names").isNotNull()).select("_key", "_names", "_r.*"), ["_key"], constraints(schema))
    no_object = rows.where(F.col("_names").isNull()).select("_key", F.lit("json").alias("constraint"))
    out = broken.unionByName(no_object)
    if schema.get("additionalProperties") is False:
        more = rows.select("_key", F.explode(F.array_except("_names", F.array(*map(F.lit, fields)))).alias("_name"))
        out = out.unionByName(more.select("_key", F.concat(F.lit("unknown:"), "_name").alias("constraint")))
    return out.select("_key.*", "constraint")
