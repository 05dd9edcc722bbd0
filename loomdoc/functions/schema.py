"""Spark types as JSON Schema, and rewrites between the nullable styles of its versions."""

from __future__ import annotations

from pyspark.sql import types as T

#: Type and format of the plain types.
PLAIN = {
    "string": ("string", None), "boolean": ("boolean", None), "byte": ("integer", "int32"), "short": ("integer", "int32"), "integer": ("integer", "int32"), "long": ("integer", "int64"),
    "float": ("number", "float"), "double": ("number", "double"), "date": ("string", "date"), "timestamp": ("string", "date-time"), "timestamp_ntz": ("string", "date-time"), "binary": ("string", "binary"),
}


def json_schema(kind: T.DataType) -> dict:
    """The JSON Schema of a Spark type; fields that can't be null are required, decimals are numbers, variants anything."""
    if isinstance(kind, T.StructType):
        needed = [f.name for f in kind.fields if not f.nullable]
        return {"type": "object", "properties": {f.name: json_schema(f.dataType) for f in kind.fields}} | ({"required": needed} if needed else {})
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": json_schema(kind.elementType)}
    if isinstance(kind, T.MapType):
        return {"type": "object", "additionalProperties": json_schema(kind.valueType)}
    if isinstance(kind, T.DecimalType):
        return {"type": "number"}
    name, form = PLAIN.get(kind.typeName(), (None, None))
    return {} if name is None else {"type": name} | ({"format": form} if form else {})


def nullable_as_type_list(schema: dict) -> dict:
    """``nullable: true`` rewritten as a type list with ``null``, at every depth."""
    out = {k: nullable_as_type_list(v) if isinstance(v, dict) else [nullable_as_type_list(x) if isinstance(x, dict) else x for x in v] if isinstance(v, list) else v for k, v in schema.items() if k != "nullable"}
    if schema.get("nullable") is True and isinstance(out.get("type"), str):
        out["type"] = [out["type"], "null"]
    return out


def type_list_as_nullable(schema: dict) -> dict:
    """A type list of one type and ``null`` rewritten as ``nullable: true``, at every depth."""
    out = {k: type_list_as_nullable(v) if isinstance(v, dict) else [type_list_as_nullable(x) if isinstance(x, dict) else x for x in v] if isinstance(v, list) else v for k, v in schema.items()}
    kinds = out.get("type")
    if isinstance(kinds, list) and "null" in kinds and len(kinds) == 2:
        out |= {"type": next(k for k in kinds if k != "null"), "nullable": True}
    return out


def pick(schema: dict, names: list[str]) -> dict:
    """An object schema with some of its properties."""
    return schema | {"properties": {k: v for k, v in schema.get("properties", {}).items() if k in names}, "required": [k for k in schema.get("required", []) if k in names]}


def omit(schema: dict, names: list[str]) -> dict:
    return pick(schema, [k for k in schema.get("properties", {}) if k not in names])


def partial(schema: dict) -> dict:
    return {k: v for k, v in schema.items() if k != "required"}
