"""Calls of schema helpers as schemas, and stages of a pipeline as schemas with two sides: what goes in and what comes out.

A call is ``(helper, args)``: arguments as JSON texts (values, lists, schemas of inner calls) or, where they are no JSON, as they stand (names of classes, functions).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdoc.functions.text import escape_regex
from loomdoc.operators.diagnostics import rows_where

_BINARY = '{"type":"string","contentMediaType":"application/octet-stream"}'
_TEXT, _ANY, _OBJECT = '{"type":"string"}', "{}", '{"type":"object"}'

#: Helpers of one schema, classes of instances, and types of custom schemas that are files.
HELPERS = {
    "string": _TEXT, "number": '{"type":"number"}', "boolean": '{"type":"boolean"}', "bigint": '{"type":"integer","format":"int64"}', "date": '{"type":"string","format":"date-time"}', "int": '{"type":"integer"}', "any": _ANY, "unknown": _ANY, "null": '{"type":"null"}',
    "never": '{"not":{}}', "function": _ANY, "file": _BINARY, "symbol": _TEXT,
}
INSTANCES = {"File": _BINARY, "Blob": _BINARY, "Date": '{"type":"string","format":"date-time"}', "RegExp": _TEXT, "URL": _TEXT, "URLSearchParams": _TEXT}
FILES = ("File", "Blob", "Buffer", "ArrayBuffer", "Uint8Array", "ReadableStream")
TARGET_LAST = ("pipeline", "pipe", "codec")
COMBINED = ("literal", "instanceof", "promise", "preprocess", *TARGET_LAST, "lazy", "object", "strictObject", "looseObject", "templateLiteral", "custom")


def _table(values: dict[str, str], name: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), name)


def _schema(arg: Column) -> Column:
    """An argument that is a schema, or null."""
    return F.when(F.try_parse_json(arg).isNotNull() & arg.rlike(r"^\s*\{"), arg)


def _set(schema: Column, name: str, value: str) -> Column:
    """A schema's text with a field at its end, which must not be in it yet."""
    return F.when(schema.rlike(r"^\s*\{\s*\}\s*$"), f'{{"{name}":{value}}}').otherwise(F.concat(F.regexp_replace(schema, r"\}\s*$", ""), F.lit(f',"{name}":{value}}}')))


def literal_schema(arg: Column) -> Column:
    """One value or a list of values: their type (integer for whole numbers) and the values; a text where there is none."""
    value = F.try_parse_json(arg)
    kind = lambda v: F.schema_of_variant(v)
    name = lambda v: F.when(kind(v) == "STRING", "string").when(kind(v) == "BOOLEAN", "boolean").when(kind(v) == "VOID", "null").when(kind(v).rlike("^(BIGINT|DECIMAL|DOUBLE)"), F.when(F.try_variant_get(v, "$", "double") == F.floor(F.try_variant_get(v, "$", "double")), "integer").otherwise("number"))
    listed = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.when(value.isNotNull(), F.array(value)))
    scalars = F.filter(listed, lambda v: name(v).isNotNull())
    types = F.filter(F.transform(scalars, lambda v: name(v)), lambda n: n != "null")
    first = F.get(types, F.lit(0))
    whole = F.when(first.isNull(), "null").when(first.isin("integer", "number"), F.when(F.forall(scalars, lambda v: F.coalesce(name(v) == "integer", F.lit(False))), "integer").otherwise("number")).otherwise(first)
    texts = F.array_join(F.transform(scalars, lambda v: F.to_json(v)), ",")
    return F.when(F.coalesce(F.size(scalars), F.lit(0)) > 0, F.concat(F.lit('{"type":"'), whole, F.lit('","enum":['), texts, F.lit("]}"))).otherwise(_TEXT)


def template_schema(parts: Column) -> Column:
    """A pattern of texts, numbers and inner schemas; a text without parts."""
    value = lambda p: F.try_parse_json(p)
    of = lambda p, n: F.try_variant_get(value(p), f"$.{n}", "string")
    choices = lambda p: F.try_variant_get(value(p), "$.enum", "array<string>")
    scalar = lambda p: F.when(F.schema_of_variant(value(p)).rlike("^(STRING|BIGINT|DECIMAL|DOUBLE)"), F.try_variant_get(value(p), "$", "string"))
    one = lambda p: (
        F.when(scalar(p).isNotNull(), escape_regex(scalar(p))).when(F.size(choices(p)) > 0, F.concat(F.lit("(?:"), F.array_join(F.transform(choices(p), lambda c: escape_regex(c)), "|"), F.lit(")")))
        .when(of(p, "type") == "integer", r"-?\d+").when(of(p, "type") == "number", r"-?\d+(?:\.\d+)?").when(of(p, "type") == "boolean", "(?:true|false)").otherwise(".+")
    )
    pattern = F.concat(F.lit("^"), F.array_join(F.transform(parts, one), ""), F.lit("$"))
    listed = F.to_json(F.array(pattern))
    return F.when(F.coalesce(F.size(parts), F.lit(0)) > 0, F.concat(F.lit('{"type":"string","pattern":'), F.substr(listed, F.lit(2), F.length(listed) - 2), F.lit("}"))).otherwise(_TEXT)


def helper_schema(helper: Column, args: Column) -> Column:
    """The schema, as JSON text, of a call: a text for helpers that nothing is known of.

    ``pipeline``, ``pipe`` and ``codec`` show their last schema, ``preprocess`` its second, ``promise`` and ``lazy`` (given its body) their only one, ``{}`` where that is no schema. ``coerce.X`` is ``X``.
    """
    name = F.regexp_replace(helper, r"^coerce\.", "")
    arg = lambda i: F.get(args, F.lit(i))
    inner = lambda c: F.coalesce(_schema(c), F.lit(_ANY))
    body = F.coalesce(_schema(arg(0)), F.lit(_OBJECT))
    parts = F.transform(F.try_variant_get(F.try_parse_json(arg(0)), "$", "array<variant>"), lambda v: F.to_json(v))
    custom = F.when(arg(0).isin(*FILES), _BINARY).when(arg(0).rlike("=>"), '{"type":"object","additionalProperties":true}')
    return (
        F.when(name == "literal", literal_schema(arg(0))).when(name == "instanceof", F.coalesce(_table(INSTANCES, arg(0)), F.lit(_ANY))).when(name.isin("promise", "lazy"), inner(arg(0))).when(name == "preprocess", inner(arg(1)))
        .when(name.isin(*TARGET_LAST), inner(F.try_element_at(args, F.lit(-1)))).when(name == "object", body).when(name == "strictObject", _set(body, "additionalProperties", "false")).when(name == "looseObject", _set(body, "additionalProperties", "true"))
        .when(name == "templateLiteral", template_schema(parts)).when(name == "custom", F.coalesce(custom, F.lit(_TEXT))).otherwise(F.coalesce(_table(HELPERS, name), F.lit(_TEXT)))
    )


def unknown_helpers(calls: DataFrame, subject: str) -> DataFrame:
    """A warning for each call of a helper that nothing is known of, once for each name of a subject."""
    name = F.regexp_replace("helper", r"^coerce\.", "")
    rows = calls.where(~name.isin(*HELPERS, *COMBINED)).select(subject, name.alias("name")).distinct()
    return rows_where(rows, F.lit(True), "unknown-zod-helper", "warning", F.col(subject), F.concat(F.lit('Unknown Zod helper "'), "name", F.lit('" was approximated as a string schema.')))


def two_sided(stages: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, side, attribute, value)``: both sides of pipelines of stages ``(keys, ord, stage, given, made)``, with sides ``input`` and ``output``; attributes' values are JSON texts.

    ``given`` is a stage's first schema and ``made`` its second. ``schema`` and ``lazy``: ``given`` on both sides. ``transform``: what comes out is unknown. ``pipe``: ``given`` comes out, and goes in where what went in was unknown and nothing
    was given before. ``codec``: ``given`` goes in (if nothing stands before it) and ``made`` comes out. ``preprocess``: anything goes in, ``given`` comes out. ``coerce``: anything goes in, a value of ``given`` comes out. ``optional``
    and ``default`` let nothing go in; with ``optional`` nothing may come out as well; ``catch`` lets anything go in. ``readonly`` marks what comes out.
    """
    one = F.struct("ord", "stage", F.coalesce("given", F.lit("{}")).alias("given"), F.coalesce("made", F.lit("{}")).alias("made"))
    chains = stages.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("stages"))
    text = lambda v: F.lit(v)
    begin = F.struct(text("{}").alias("input"), text("{}").alias("output"), F.lit(False).alias("begun"), F.array().cast("array<string>").alias("in_flags"), F.array().cast("array<string>").alias("out_flags"))

    def side(s: Column, x: Column) -> Column:
        name = x["stage"]
        first = ~s["begun"]
        went = F.when(name.isin("schema", "lazy"), x["given"]).when(name.isin("preprocess", "coerce", "catch"), "{}").when(name.isin("codec", "pipe") & first, x["given"]).otherwise(s["input"])
        came = F.when(name.isin("schema", "lazy", "pipe", "preprocess", "coerce"), x["given"]).when(name == "codec", x["made"]).when(name == "transform", "{}").otherwise(s["output"])
        into = F.when(name.isin("optional", "default"), F.array_union(s["in_flags"], F.array(F.lit("optional")))).otherwise(s["in_flags"])
        out = F.when(name == "optional", F.array_union(s["out_flags"], F.array(F.lit("optional")))).when(name == "default", F.array_remove(s["out_flags"], "optional")).when(name == "readonly", F.array_union(s["out_flags"], F.array(F.lit("readOnly")))).when(name.isin("pipe", "codec", "transform"), F.array().cast("array<string>")).otherwise(s["out_flags"])
        return F.struct(went.alias("input"), came.alias("output"), (s["begun"] | ~name.isin("optional", "readonly", "default", "catch")).alias("begun"), into.alias("in_flags"), out.alias("out_flags"))

    sides = chains.withColumn("s", F.aggregate("stages", begin, side))
    fields = lambda c, flags: F.concat(F.map_entries(F.transform_values(F.from_json(c, "map<string,variant>"), lambda _, v: F.to_json(v))), F.transform(flags, lambda f: F.struct(f.alias("key"), F.lit("true").alias("value"))))
    rows = sides.select(*keys, F.explode(F.array(F.struct(F.lit("input").alias("side"), fields(F.col("s.input"), F.col("s.in_flags")).alias("f")), F.struct(F.lit("output").alias("side"), fields(F.col("s.output"), F.col("s.out_flags")).alias("f")))).alias("e"))
    return rows.select(*keys, "e.side", F.explode("e.f").alias("f")).select(*keys, "side", F.col("f.key").alias("attribute"), F.col("f.value").alias("value"))
