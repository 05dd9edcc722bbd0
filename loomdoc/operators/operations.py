"""Projections of operations: parameters, bodies, responses and media types as rows.

Properties of schemas are rows ``(owner, ord, name, value variant, required)``; what a projection makes is a row again, so that documents of any size are grouped and joined by Spark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdoc.functions import http, registries
from loomdoc.functions.text import default_success_code as success_code
from loomdoc.operators.records import computed_once

#: Keys of a parameter that its schema doesn't have, keywords that make a schema, keys of the configuration that a document drops.
PARAMETER_KEYS = ("in", "name", "required", "example", "content", "style", "explode", "allowReserved")
SCHEMA_KEYS = ("$ref", "type", "properties", "items", "prefixItems", "allOf", "anyOf", "oneOf", "additionalProperties", "enum", "const", "format", "contentEncoding", "contentMediaType")
CONFIG_KEYS = (
    "apiDir", "routerType", "schemaDir", "docsUrl", "ui", "outputFile", "outputDir", "includeOpenApiRoutes", "ignoreRoutes", "schemaType", "schemaBackends", "schemaFiles", "defaultResponseSet",
    "responseSets", "errorConfig", "errorDefinitions", "openapiVersion", "framework", "next", "diagnostics", "debug", "authPresets", "excludeSchemas", "cache", "experimental", "arazzo",
    "overlay", "generatedDir", "watch", "clientSdk", "docs", "hooks", "basePath",
)
PRIMITIVES = ("string", "number", "integer", "boolean")


def _text(value: Column | str, key: str) -> Column:
    return F.try_variant_get(value, f"$['{key}']", "string")


def _has(value: Column | str, key: str) -> Column:
    return F.try_variant_get(value, f"$['{key}']", "variant").isNotNull()


def properties(schemas: DataFrame, key: str = "name", schema: str = "schema") -> DataFrame:
    """The properties of object schemas ``(key, schema variant)`` as ``(owner, ord, name, value, required)``; schemas without properties give no row. Order is that of the names."""
    found = schemas.select(F.col(key).alias("owner"), F.try_variant_get(schema, "$.required", "array<string>").alias("__required"), F.try_variant_get(schema, "$.properties", "variant").alias("__p"))
    found = found.lateralJoin(found.sparkSession.tvf.variant_explode(F.col("__p").outer()))
    return found.select("owner", F.col("pos").alias("ord"), F.col("key").alias("name"), "value", F.coalesce(F.array_contains("__required", F.col("key")), F.lit(False)).alias("required"))


def is_deep_object(value: Column | str) -> Column:
    """Whether a query parameter's schema is an object: by type, properties or additional properties."""
    additional = F.try_variant_get(value, "$.additionalProperties", "variant")
    given = additional.isNotNull() & (F.coalesce(F.try_variant_get(additional, "$", "string"), F.lit("x")) != "false")
    return F.coalesce(_text(value, "type") == "object", F.lit(False)) | _has(value, "properties") | given


def primary_type(value: Column | str) -> Column:
    """A schema's type; of a list the first that isn't null; ``string`` by default."""
    several = F.try_variant_get(value, "$.type", "array<string>")
    return F.coalesce(F.get(F.filter(several, lambda x: x != "null"), F.lit(0)), F.get(several, F.lit(0)), F.when(~_text(value, "type").startswith("["), _text(value, "type")), F.lit("string"))


def parameters(rows: DataFrame, path: bool = False, where: str | None = None) -> DataFrame:
    """Property rows as parameters: ``location``, ``is_required``, ``type`` (null where a schema has other keywords alone), ``style``, ``explode``, ``description``, ``example`` (text).

    A location is ``where``, else the property's ``in``, else the path or query. Path parameters are required. Objects in a query are deep objects unless a style is given. An example is the property's, else
    one that fits its schema; none for parameters with ``content``.
    """
    given = F.coalesce(_text("value", "in"), F.lit("path" if path else "query"))
    location = F.lit(where) if where else given
    content, style = _has("value", "content"), _text("value", "style")
    schema = F.coalesce(F.try_variant_get("value", "$.schema", "variant"), F.col("value"))
    bare = ~_one_of(schema, SCHEMA_KEYS)
    deep = (F.col("location") == "query") & ~content & style.isNull() & is_deep_object("value")
    enum, kind = F.try_variant_get(schema, "$.enum", "array<string>"), F.when(bare, "string").otherwise(primary_type(schema))
    example = http.parameter_example(F.col("name"), kind, enum, _text(schema, "format"))
    own = F.coalesce(F.try_variant_get("value", "$.required", "boolean"), F.lit(False))
    return rows.withColumn("location", location).withColumns(
        {
            "is_required": F.when(F.col("location") == "path", True).otherwise(F.col("required") | own),
            "type": F.when(~content, F.when(bare, "string").otherwise(_text(schema, "type"))),
            "style": F.when(deep, "deepObject").otherwise(style),
            "explode": F.when(deep, True).otherwise(F.try_variant_get("value", "$.explode", "boolean")),
            "description": F.nullif(_text("value", "description"), F.lit("")),
            "example": F.coalesce(_text("value", "example"), F.when(~content, example)),
        }
    )


def parameter_schemas(rows: DataFrame) -> DataFrame:
    """The members ``(owner, name, key, value)`` of property rows' schemas: those under ``schema`` if there are, else all but the parameter's own keys; text where no keyword of a schema is left."""
    inner = F.try_variant_get("value", "$.schema", "variant")
    found = rows.select("owner", "name", inner.isNotNull().alias("__given"), F.coalesce(inner, F.col("value")).alias("__s"))
    members = found.lateralJoin(found.sparkSession.tvf.variant_explode(F.col("__s").outer()).toDF("__pos", "key", "value"))
    kept = members.where(F.col("key").isNotNull() & (F.col("__given") | ~F.col("key").isin(*PARAMETER_KEYS))).select("owner", "name", "key", "value")
    bare = found.where(~F.col("__given")).join(kept.where(F.col("key").isin(*SCHEMA_KEYS)).select("owner", "name"), ["owner", "name"], "left_anti")
    return kept.unionByName(bare.select("owner", "name", F.lit("type").alias("key"), F.parse_json(F.lit('"string"')).alias("value")))


def _one_of(value: Column, keys: Sequence[str]) -> Column:
    out = F.lit(False)
    for key in keys:
        out = out | _has(value, key)
    return out


def cookie_parameters(rows: DataFrame) -> DataFrame:
    """Property rows of a cookie schema as parameters."""
    return parameters(rows, where="cookie")


def default_path_parameters(routes: DataFrame, names: str = "names") -> DataFrame:
    """One required text parameter for each name in a list, in order: ``ord``, ``name``, ``location``, ``is_required``, ``type``, ``example``, ``description``."""
    rows = routes.select(*[c for c in routes.columns if c != names], F.posexplode(names).alias("ord", "name"))
    return rows.withColumns(
        {"location": F.lit("path"), "is_required": F.lit(True), "type": F.lit("string"), "example": http.parameter_example(F.col("name"), F.lit("string")), "description": F.concat(F.lit("Path parameter: "), "name")}
    )


def querystring_parameter(kind: Column, name: Column) -> Column:
    """The one parameter of a whole query string; null without a type."""
    return F.when(F.coalesce(kind, F.lit("")) != "", F.struct(F.lit("querystring").alias("location"), F.coalesce(F.nullif(name, F.lit("")), F.lit("query")).alias("name"), F.lit(False).alias("is_required"), F.lit("application/x-www-form-urlencoded").alias("content_type"), schema_reference(kind).alias("ref")))


def schema_reference(name: Column) -> Column:
    return F.concat(F.lit("#/components/schemas/"), name)


def type_reference(name: Column) -> Column:
    """``(type, ref, depth)``: a primitive or a reference, inside as many arrays as the name ends in ``[]``."""
    bare = F.when(name.endswith("[]"), F.regexp_replace(name, r"(\[\])+$", "")).otherwise(name)
    depth = ((F.length(name) - F.length(bare)) / 2).cast("int")
    return F.struct(F.when(bare.isin(*PRIMITIVES), bare).alias("type"), F.when(~bare.isin(*PRIMITIVES), schema_reference(bare)).alias("ref"), depth.alias("depth"))


def request_bodies(operations: DataFrame) -> DataFrame:
    """Operations ``(body_type, content_type, item_type, description, required, method, ...)`` with ``body (content_type, ref, item_ref, description, required)``.

    Without a body type, a multipart operation gets the body of one file (``default_file``); others get none.
    """
    kind = http.content_type(F.col("body_type"), F.col("content_type"))
    text = F.nullif(F.col("description"), F.lit(""))
    typed = F.coalesce(F.col("body_type"), F.lit("")) != ""
    item = F.when(F.coalesce(F.col("item_type"), F.lit("")) != "", schema_reference(F.col("item_type")))
    full = F.struct(kind.alias("content_type"), schema_reference(F.col("body_type")).alias("ref"), item.alias("item_ref"), text.alias("description"), F.coalesce("required", F.lit(False)).alias("required"), F.lit(False).alias("default_file"))
    none = F.lit(None).cast("string")
    file = F.struct(F.lit("multipart/form-data").alias("content_type"), none.alias("ref"), none.alias("item_ref"), F.coalesce(text, F.lit("Multipart form data containing a file upload.")).alias("description"), F.lit(True).alias("required"), F.lit(True).alias("default_file"))
    return operations.withColumn("body", F.when(typed, full).when(kind == "multipart/form-data", file))


def is_file_like(name: Column, value: Column | str) -> Column:
    """Whether an object property means a file, by its name or description."""
    text = F.coalesce(F.lower(_text(value, "description")), F.lit(""))
    return F.coalesce(_text(value, "type") == "object", F.lit(False)) & (F.contains(F.lower(name), F.lit("file")) | F.contains(text, F.lit("file")))


def form_data(rows: DataFrame) -> DataFrame:
    """Property rows of a multipart body with ``type`` and ``media_type``: file-like objects are binary text."""
    file = is_file_like(F.col("name"), "value")
    return rows.withColumns({"type": F.when(file, "string").otherwise(_text("value", "type")), "media_type": F.when(file, "application/octet-stream").otherwise(_text("value", "contentMediaType"))})


def multipart_encoding(rows: DataFrame) -> DataFrame:
    """The content type of each part of a multipart body that has one: its list of media types, its media type, binary text, or a file. Of a list property, that of its items."""
    items = F.when(_text("value", "type") == "array", F.try_variant_get("value", "$.items", "variant"))

    def kind(value: Column) -> Column:
        binary = (_text(value, "type") == "string") & (_text(value, "format") == "binary")
        return F.coalesce(_text(value, "contentMediaType"), F.when(binary | is_file_like(F.col("name"), value), "application/octet-stream"))

    several = F.coalesce(F.try_variant_get("value", "$['x-contentMediaTypes']", "array<string>"), F.try_variant_get(items, "$['x-contentMediaTypes']", "array<string>"))
    return rows.withColumn("part_type", F.coalesce(F.nullif(F.array_join(several, ", "), F.lit("")), kind(F.col("value")), kind(items))).where("part_type IS NOT NULL")


def responses(rows: DataFrame) -> DataFrame:
    """Response rows ``(code, type, item_type, description, content_type, method, ...)`` with ``response (code, description, content_type, sequential, schema, item_schema, location_header)``.

    The code is the method's usual one unless given. 204 and untyped responses have a description alone, redirects a Location header too. A sequential media type holds its type as the schema of items.
    """
    none = lambda c: F.nullif(F.col(c), F.lit(""))
    code = F.coalesce(none("code"), success_code(F.col("method")))
    text = F.coalesce(none("description"), F.when(code == "204", "No Content").otherwise("Successful response"))
    untyped = (code == "204") | (none("type").isNull() & none("item_type").isNull())
    kind = F.coalesce(none("content_type"), F.lit("application/json"))
    sequential = registries.is_sequential(kind)
    item = F.coalesce(none("item_type"), F.when(sequential, none("type")))
    redirect = F.try_to_number(code, F.lit("999")).between(300, 399)
    empty = F.struct(code.alias("code"), text.alias("description"), F.lit(None).cast("string").alias("content_type"), F.lit(False).alias("sequential"), F.lit(None).cast("struct<type:string,ref:string,depth:int>").alias("schema"), F.lit(None).cast("struct<type:string,ref:string,depth:int>").alias("item_schema"), F.coalesce(redirect, F.lit(False)).alias("location_header"))
    full = F.struct(code.alias("code"), text.alias("description"), kind.alias("content_type"), sequential.alias("sequential"), F.when(item.isNull(), type_reference(F.col("type"))).alias("schema"), F.when(item.isNotNull(), type_reference(item)).alias("item_schema"), F.lit(False).alias("location_header"))
    return computed_once(rows, response=F.when(untyped, empty).otherwise(full))


def named_responses(rows: DataFrame, default: str | None = None) -> DataFrame:
    """Rows ``(code, response variant)`` with ``ref`` (a response that is a name), else ``description`` and ``schema`` (its schema, or all of it)."""
    is_name = F.schema_of_variant("response") == "STRING"
    return rows.withColumns(
        {
            "ref": F.when(is_name, F.concat(F.lit("#/components/responses/"), F.try_variant_get("response", "$", "string"))),
            "description": F.when(~is_name, F.coalesce(F.nullif(_text("response", "description"), F.lit("")), F.lit(default), F.lit("Response"))),
            "schema": F.when(~is_name, F.coalesce(F.try_variant_get("response", "$.schema", "variant"), F.col("response"))),
        }
    )


def single_response(schema: Column, description: Column) -> Column:
    """The one successful JSON response of a schema."""
    return F.struct(F.lit("200").alias("code"), F.coalesce(F.nullif(description, F.lit("")), F.lit("Successful response")).alias("description"), F.lit("application/json").alias("content_type"), schema.alias("schema"))


def callback_map(callbacks: Column) -> Column:
    """``(name, expression, reference)`` items as ``(name, expression, ref)``: of repeated names the last, with a reference to a component or none."""
    kept = F.filter(callbacks, lambda c, i: ~F.exists(F.slice(callbacks, i + 2, F.greatest(F.size(callbacks), F.lit(1))), lambda x: x["name"] == c["name"]))
    return F.transform(kept, lambda c: F.struct(c["name"].alias("name"), c["expression"].alias("expression"), F.concat(F.lit("#/components/callbacks/"), c["reference"]).alias("ref")))


def attach(responses_: DataFrame, extras: DataFrame, keys: Sequence[str], name: str, order: str) -> DataFrame:
    """Extras (headers, links) whose response is there and no reference, by ``keys`` and status: of one name the last by ``order``. ``responses_`` has ``code`` and ``ref``, ``extras`` has ``status``."""
    there = responses_.where("ref IS NULL").select(*keys, F.col("code").alias("status")).distinct()
    last = extras.groupBy(*keys, "status", name).agg(F.max_by(F.struct(*[c for c in extras.columns if c not in (*keys, "status", name)]), order).alias("__x"))
    return last.join(there, [*keys, "status"], "left_semi").select(*keys, "status", name, "__x.*")


def summaries(responses_: DataFrame, key: str, primary: str = "primary", by_status: str = "by_status") -> DataFrame:
    """Responses ``(key, code, is_primary, ...)`` with ``summary``: the one of its status, else the plain one for the primary response."""
    return responses_.withColumn("summary", F.coalesce(F.try_element_at(F.col(by_status), F.col("code")), F.when(F.col("is_primary"), F.col(primary))))


def parameter_examples(params: DataFrame, examples: DataFrame, key: str) -> DataFrame:
    """Example rows ``(key, location, name, value variant)`` as rows of parameters ``(key, location, param, example_name, value)``.

    An example with a parameter's name is that parameter's; of another one whose value is an object, each member with a parameter's name is.
    """
    known = params.select(key, "location", F.col("name").alias("param")).distinct()
    direct = examples.withColumn("param", F.col("name")).join(known, [key, "location", "param"], "left_semi").select(key, "location", "param", F.col("name").alias("example_name"), "value")
    other = examples.join(known.select(key, "location", F.col("param").alias("name")), [key, "location", "name"], "left_anti").where(F.schema_of_variant("value").startswith("OBJECT"))
    members = other.lateralJoin(other.sparkSession.tvf.variant_explode(F.col("value").outer()).toDF("__pos", "param", "__member")).select(key, "location", "param", F.col("name").alias("example_name"), F.col("__member").alias("value"))
    return direct.unionByName(members.join(known, [key, "location", "param"], "left_semi"))


def register_routes(routes: DataFrame, opt_in: bool = False) -> DataFrame:
    """Routes ``(path, is_ignored, is_openapi, tag, path_params_type, ...)`` that stay, with ``tag`` (the path's first fixed part, capitalised, unless given) and ``missing_path_type`` (the check ``missing-path-params-type``)."""
    kept = routes.where(~F.coalesce("is_ignored", F.lit(False)))
    if opt_in:
        kept = kept.where("is_openapi")
    first = F.get(F.filter(F.split("path", "/"), lambda x: (x != "") & ~x.startswith("{")), F.lit(0))
    named = F.coalesce(F.nullif(F.trim("tag"), F.lit("")), F.concat(F.upper(F.left(first, F.lit(1))), F.substr(first, F.lit(2))))
    return kept.withColumns({"tag": named, "missing_path_type": F.contains("path", F.lit("{")) & (F.coalesce("path_params_type", F.lit("")) == "")})


def strip_config(documents: DataFrame, doc: str = "doc", keys: Sequence[str] = CONFIG_KEYS) -> DataFrame:
    """Top-level members ``(..., key, value)`` of documents without the configuration's."""
    found = documents.lateralJoin(documents.sparkSession.tvf.variant_explode(F.col(doc).outer()))
    return found.drop(doc, "pos").where(~F.col("key").isin(*keys))


def path_examples(params: DataFrame) -> DataFrame:
    """Parameters ``(path, name, location, example, ...)``: path parameters of paths with braces get an example if they have none."""
    needs = (F.col("location") == "path") & F.contains("path", F.lit("{")) & F.contains("path", F.lit("}")) & (F.coalesce("example", F.lit("")) == "")
    return params.withColumn("example", F.when(needs, http.path_example(F.col("name"))).otherwise(F.col("example")))
