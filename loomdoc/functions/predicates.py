"""Row predicates over paths, names, statuses and JSON objects, as boolean Columns that stay inside the JVM. Null in, null out unless a docstring says otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomdoc.functions.text import METHODS

#: Names of the built-in utility types.
UTILITY_TYPES = (
    "Awaited", "Partial", "Required", "Readonly", "Record", "Pick", "Omit", "Exclude", "Extract", "NonNullable", "Parameters", "ConstructorParameters", "ReturnType", "InstanceType",
    "ThisParameterType", "OmitThisParameter", "ThisType", "Uppercase", "Lowercase", "Capitalize", "Uncapitalize", "Promise", "Array", "ReadonlyArray", "Map", "Set", "WeakMap", "WeakSet",
)

#: Characters of a pattern that stand for themselves in names.
_META = set(r".+?^${}()|[]\\")


def any_match(value: Column, patterns: Sequence[str]) -> Column:
    """Whether one of the regular expressions matches; none given: false."""
    return value.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def route_ignored(path: Column, globs: Sequence[str], flag: Column | None = None) -> Column:
    """A path that matches an ignore glob, or whose ``flag`` is true. ``*`` stands for anything; other metacharacters keep their regular-expression meaning."""
    found = any_match(path, ["^" + g.replace("*", ".*") + "$" for g in globs])
    return found if flag is None else F.coalesce(flag, F.lit(False)) | found


def name_excluded(name: Column, globs: Sequence[str]) -> Column:
    """A name that matches an exclusion glob: ``*`` stands for anything, every other character for itself."""
    return any_match(name, ["^" + "".join(".*" if c == "*" else "\\" + c if c in _META else c for c in g) + "$" for g in globs])


def generic_parameter(name: Column) -> Column:
    return name.rlike("^(?:[A-Z]|T[A-Z][a-zA-Z]*)$")


def invalid_name(name: Column) -> Column:
    return name.rlike(r"[{}:?\s]")


def utility_type(name: Column) -> Column:
    return name.isin(*UTILITY_TYPES)


def component_name(name: Column) -> Column:
    """A name that a component may have."""
    return ~(generic_parameter(name) | invalid_name(name) | utility_type(name))


def is_method(name: Column) -> Column:
    return F.lower(name).isin(*METHODS)


def takes_body(method: Column) -> Column:
    return F.upper(method).isin("PATCH", "POST", "PUT")


def is_redirect(status: Column) -> Column:
    return status.try_cast("int").between(300, 399)


def status_token(value: Column) -> Column:
    return value.rlike(r"^(?:\d{3}|[1-5]XX|default)$")


def reference_object(value: Column) -> Column:
    """JSON text of an object with a string ``$ref`` and nothing beside ``summary`` and ``description``; anything else, null too, is none."""
    keys = F.json_object_keys(value)
    link = F.try_variant_get(F.try_parse_json(value), '$["$ref"]', "string")
    text = F.schema_of_variant(F.try_variant_get(F.try_parse_json(value), '$["$ref"]', "variant")) == "STRING"
    return F.coalesce(F.forall(keys, lambda k: k.isin("$ref", "summary", "description")) & link.isNotNull() & text, F.lit(False))


def parameter_object(value: Column) -> Column:
    """JSON text of an object that isn't a reference and has ``in`` and ``name``."""
    keys = F.json_object_keys(value)
    return F.coalesce(F.array_contains(keys, "in") & F.array_contains(keys, "name"), F.lit(False)) & ~reference_object(value)


def concrete_schema(value: Column) -> Column:
    """JSON text of a schema that says something: a reference, properties, an enum, a composition, items, or a type other than object."""
    keys = F.json_object_keys(value)
    telling = F.exists(keys, lambda k: k.isin("$ref", "enum", "const", "allOf", "anyOf", "oneOf", "items"))
    fields = F.size(F.json_object_keys(F.get_json_object(value, "$.properties"))) > 0
    kind = F.get_json_object(value, "$.type")
    return F.coalesce(telling, F.lit(False)) | F.coalesce(fields, F.lit(False)) | F.coalesce(kind != "object", F.lit(False))
