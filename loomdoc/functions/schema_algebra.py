"""Schemas built from others: unions, intersections, property filters, utility types, and the schemas of tables."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import types as T

from loomdoc.functions.schema import json_schema

Schema = dict


def nullable(schema: Schema) -> Schema:
    """A reference or an ``allOf`` beside null; anything else gets the flag."""
    return {"anyOf": [schema, {"type": "null"}]} if "$ref" in schema or "allOf" in schema else schema | {"nullable": True}


def union(parts: Sequence[Schema | None]) -> Schema:
    """Undefined parts (None) go, a null part makes the rest nullable, enums of one type become one, and more than one part is an ``anyOf``."""
    left = [p for p in parts if p is not None]
    plain = [p for p in left if p.get("type") != "null"]
    if not plain:
        return {"type": "null"} if left else {}
    kinds = {p.get("type") for p in plain}
    if len(plain) > 1 and len(kinds) == 1 and all("enum" in p for p in plain):
        out = {"type": kinds.pop(), "enum": list(dict.fromkeys(v for p in plain for v in p["enum"]))}
    else:
        out = plain[0] if len(plain) == 1 else {"anyOf": plain}
    return nullable(out) if len(plain) < len(left) else out


def intersection(parts: Sequence[Schema]) -> Schema:
    """One object with all properties (the last of a name) and all required names; a primitive among objects that only brand it is the result."""
    primitive = [p for p in parts if p.get("type") in ("string", "number", "integer", "boolean")]
    if primitive:
        return primitive[0]
    properties = {k: v for p in parts for k, v in p.get("properties", {}).items()}
    needed = list(dict.fromkeys(k for p in parts for k in p.get("required", [])))
    return {"type": "object", "properties": properties} | ({"required": needed} if needed else {})


def extend(base: Schema, more: Schema) -> Schema:
    """Properties of both (the extension's of a name) and their required names in order, less those that the extension makes optional."""
    optional = set(more.get("properties", {})) - set(more.get("required", []))
    needed = [k for k in dict.fromkeys([*base.get("required", []), *more.get("required", [])]) if k not in optional]
    out = {k: v for k, v in base.items() if k != "required"} | {"properties": base.get("properties", {}) | more.get("properties", {})}
    return out | ({"required": needed} if needed else {})


def discriminated(key: str, variants: Sequence[Schema], literals: dict[str, str]) -> Schema:
    """A ``oneOf`` with its discriminator; ``literals`` maps references to the key's value, others have no mapping."""
    mapping = {literals[v["$ref"]]: v["$ref"] for v in variants if v.get("$ref") in literals}
    return {"oneOf": list(variants), "discriminator": {"propertyName": key} | ({"mapping": mapping} if mapping else {})}


def deep_partial(schema: Schema) -> Schema:
    """No required names at any depth of properties, items and compositions."""
    out = {k: v for k, v in schema.items() if k != "required"}
    if isinstance(out.get("properties"), dict):
        out["properties"] = {k: deep_partial(v) for k, v in out["properties"].items()}
    if isinstance(out.get("items"), dict):
        out["items"] = deep_partial(out["items"])
    return out | {k: [deep_partial(x) for x in out[k]] for k in ("allOf", "anyOf", "oneOf") if k in out}


def required_all(schema: Schema) -> Schema:
    return schema | {"required": list(schema.get("properties", {}))}


def read_only(schema: Schema) -> Schema:
    return schema | {"readOnly": True}


def non_nullable(schema: Schema) -> Schema:
    return {k: v for k, v in schema.items() if k != "nullable"}


def exclude(schema: Schema, values: Sequence) -> Schema:
    return schema | {"enum": [v for v in schema.get("enum", []) if v not in values]}


def extract(schema: Schema, values: Sequence) -> Schema:
    return schema | {"enum": [v for v in schema.get("enum", []) if v in values]}


def key_of(schema: Schema) -> Schema:
    return {"type": "string", "enum": list(schema.get("properties", {}))}


#: String maps of enums by their names.
ENUM_MAPS = {"Uppercase": str.upper, "Lowercase": str.lower, "Capitalize": lambda s: s[:1].upper() + s[1:], "Uncapitalize": lambda s: s[:1].lower() + s[1:]}


def map_enum(schema: Schema, kind: str) -> Schema:
    return schema | {"enum": [ENUM_MAPS[kind](v) if isinstance(v, str) else v for v in schema.get("enum", [])]}


def template_enum(parts: Sequence[Sequence[str]]) -> Schema:
    """Every text that a template of finite parts can give, in order."""
    return {"type": "string", "enum": ["".join(p) for p in product(*parts)]}


def tuple_of(items: Sequence[Schema], optional: int = 0, rest: Schema | None = None) -> Schema:
    """A tuple whose last ``optional`` items may be missing, open at its end if ``rest`` is given."""
    out = {"type": "array", "prefixItems": list(items), "minItems": len(items) - optional}
    return out | ({"items": rest} if rest is not None else {"maxItems": len(items)})


def table_schema(table: T.StructType, mode: str = "select") -> Schema:
    """A table's schema for ``select`` (all columns required), ``insert`` (those that can't be null and have neither default nor generation) or ``update`` (none).

    Field metadata may hold ``default``, ``generated``, ``maxLength`` and ``format``. Nested columns and variants are dropped.
    """
    plain = [f for f in table.fields if not isinstance(f.dataType, T.StructType | T.ArrayType | T.MapType) and json_schema(f.dataType)]
    properties = {}
    for f in plain:
        schema = {k: v for k, v in json_schema(f.dataType).items() if k == "type" or v in ("date", "date-time")}
        schema |= {k: f.metadata[k] for k in ("maxLength", "format") if k in f.metadata}
        properties[f.name] = nullable(schema) if f.nullable else schema
    if mode == "select":
        needed = list(properties)
    elif mode == "insert":
        needed = [f.name for f in plain if not f.nullable and "default" not in f.metadata and not f.metadata.get("generated")]
    else:
        needed = []
    return {"type": "object", "properties": properties} | ({"required": needed} if needed else {})
