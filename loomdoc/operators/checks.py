"""The coded checks: each takes the rows it looks at and gives diagnostics ``(code, severity, subject, message)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdoc.functions import http, registries
from loomdoc.functions.text import path_parameters
from loomdoc.operators.chains import effects, unknown_methods
from loomdoc.operators.diagnostics import rows_where
from loomdoc.sources.files import IGNORED_FOLDERS





def _said(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _given(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


def inferred_types(routes: DataFrame) -> DataFrame:
    """Information on each type that was inferred: ``(path, inferred_path_type, inferred_query_type, inferred_body_type)``."""
    kinds = (("inferred_path_type", "inferred-path-params", "path parameter"), ("inferred_query_type", "inferred-query-params", "query parameter"), ("inferred_body_type", "inferred-body", "request body"))
    out = None
    for column, code, what in kinds:
        part = rows_where(routes, _given(column), code, "info", F.col("path"), _said(f"Inferred {what} schema from handler validation: ", F.col(column)))
        out = part if out is None else out.unionByName(part)
    return out


def missing_types(routes: DataFrame) -> DataFrame:
    """Warnings for routes ``(path, path_type, query_type, reads_query, content_type, body_type)`` that use parameters or a form without saying their types."""
    names = path_parameters(F.col("path"))
    paths = rows_where(routes, (F.size(names) > 0) & ~_given("path_type"), "missing-path-params-type", "warning", F.col("path"), _said("Route ", F.col("path"), " contains path parameters ", F.array_join(names, ", "), " but no @path type is defined."))
    query = rows_where(routes, F.coalesce("reads_query", F.lit(False)) & ~_given("query_type"), "missing-query-params-type", "warning", F.col("path"), F.lit("Query parameters were inferred from searchParams usage, but no @query type is defined."))
    form = rows_where(routes, (F.col("content_type") == "multipart/form-data") & ~_given("body_type"), "multipart-missing-body-schema", "warning", F.col("path"), F.lit("Route declares @requestContentType multipart/form-data without @requestBody; using the default file-only multipart request body."))
    return paths.unionByName(query).unionByName(form)


def path_schema_conflicts(params: DataFrame, schemas: DataFrame) -> DataFrame:
    """Information on path parameters ``(path, name, schema_name)`` that fall back to inference though the schema is there."""
    known = params.join(schemas.select("schema_name"), "schema_name", "left_semi")
    return rows_where(known, F.lit(True), "path-param-schema-conflict", "info", F.col("path"), _said('Path parameter "', F.col("name"), '" is using fallback schema inference even though "', F.col("schema_name"), '" exists. Add @path or validate context.params with that schema to preserve constraints.'))


def schemas_not_found(used: DataFrame, schemas: DataFrame) -> DataFrame:
    """Warnings for types ``(schema_name, subject)`` in use that have no definition."""
    missing = used.join(schemas.select("schema_name"), "schema_name", "left_anti").where("schema_name IS NOT NULL")
    return rows_where(missing, F.lit(True), "schema-not-found", "warning", F.col("subject"), _said('No TypeScript or Zod schema definition found for "', F.col("schema_name"), '"; emitting an empty schema.'))


def type_fallbacks(types: DataFrame) -> DataFrame:
    """Information on types ``(subject, kind)`` that nothing more exact is known of."""
    return rows_where(types, F.lit(True), "type-resolution-fallback", "info", F.col("subject"), _said("Type ", F.col("kind"), " is emitted as an object."))


def tag_kinds(tags: DataFrame) -> DataFrame:
    """Information on tags ``(subject, kind)`` of a kind that isn't registered."""
    return rows_where(tags, _given("kind") & ~registries.is_tag_kind(F.col("kind")), "unregistered-tag-kind", "info", F.col("subject"), _said('Tag kind "', F.col("kind"), '" is not in the OAI Tag Kind registry.'))


def chain_checks(calls: DataFrame, key: str) -> DataFrame:
    """Formats that aren't registered (information) and unknown methods (warning) in chains ``(key, type, method, arg)``."""
    made = calls.withColumn("__e", F.explode(effects(F.col("type"), F.col("method"), F.col("arg")))).where("__e.attribute = 'unregistered'")
    formats = rows_where(made, F.lit(True), "unregistered-format", "info", F.col(key), _said('Zod format "', F.col("method"), '" is not in the OAI Format registry; emitting a pattern or registered equivalent instead.'))
    return formats.unionByName(rows_where(unknown_methods(calls), F.lit(True), "unknown-zod-method", "warning", F.col(key), _said('Unknown method "', F.col("method"), '"')))


def route_files(files: DataFrame) -> DataFrame:
    """Information on route files ``(file, method)`` that neither name nor tag gives a method."""
    none = http.file_method(F.col("file")).isNull() & ~_given("method")
    return rows_where(files, none, "unspecified-http-method", "info", F.col("file"), F.lit("Route file has no HTTP method suffix or @method tag; documenting as GET. Add a .get.ts suffix or @method."))


def folders(listed: DataFrame, wanted: DataFrame, kind: str) -> DataFrame:
    """Warnings for folders ``(folder)`` that a scan leaves out, and, for schemas, for configured ones that aren't there."""
    name = F.regexp_extract("folder", r"([^/]+)/*$", 1)
    out = rows_where(listed, name.isin(*IGNORED_FOLDERS), f"{kind}-directory-ignored", "warning", F.col("folder"), _said(f"Skipped automatically ignored {kind} directory: ", F.col("folder")))
    if kind != "schema":
        return out
    gone = wanted.select("folder").join(listed.select("folder"), "folder", "left_anti")
    return out.unionByName(rows_where(gone, F.lit(True), "schema-dir-empty", "warning", F.col("folder"), _said("Configured schema directory does not exist: ", F.col("folder"))))


def discriminated_unions(unions: DataFrame) -> DataFrame:
    """Warnings for discriminated unions ``(subject, key, variants)`` without a key or variants."""
    reason = F.when(~_given("key"), "no discriminator key").when(F.coalesce(F.size("variants"), F.lit(0)) < 1, "no variants")
    return rows_where(unions.withColumn("__r", reason), F.col("__r").isNotNull(), "malformed-zod-discriminated-union", "warning", F.col("subject"), _said("Malformed z.discriminatedUnion() was approximated as an object schema: ", F.col("__r"), "."))


def enums(uses: DataFrame, known: DataFrame) -> DataFrame:
    """Warnings for enums ``(subject, name)`` whose values aren't known."""
    missing = uses.join(known.select("name"), "name", "left_anti")
    return rows_where(missing, F.lit(True), "unresolved-zod-enum", "warning", F.col("subject"), _said('Unable to resolve values for enum identifier "', F.col("name"), '"; approximated as a string schema.'))


def computed_keys(properties: DataFrame) -> DataFrame:
    """Information on properties ``(subject, name)`` without a name that is known before the run."""
    return rows_where(properties, F.col("name").isNull(), "zod-computed-key-skipped", "info", F.col("subject"), F.lit("Skipped a Zod object property because its computed key is not statically resolvable."))


def responses(inferred: DataFrame) -> DataFrame:
    """Warnings for return statements ``(subject, type)`` of no known type."""
    return rows_where(inferred, ~_given("type"), "response-inference-unresolved", "warning", F.col("subject"), F.lit("Could not fully infer a response schema from a return statement. Add an explicit @response tag to make the output deterministic."))


def example_references(refs: DataFrame, values: DataFrame) -> DataFrame:
    """Warnings for examples ``(subject, name)`` that name nothing, or something ``(name, value variant)`` that isn't JSON (null)."""
    gone = refs.join(values.select("name"), "name", "left_anti")
    broken = refs.join(values.where("value IS NULL").select("name"), "name", "left_semi")
    text = _said('Example reference "', F.col("name"), '" could not be reduced to a serializable value. Use an exported literal, object, array, or schema.parse(...) result instead.')
    return rows_where(gone, F.lit(True), "example-reference-unresolved", "warning", F.col("subject"), _said('Example reference "', F.col("name"), '" could not be resolved.')).unionByName(
        rows_where(broken, F.lit(True), "example-reference-unserializable", "warning", F.col("subject"), text)
    )


def overlay_formats(overlays: DataFrame) -> DataFrame:
    """Errors for overlays ``(file, target_format, doc variant)`` whose document has another format than the one they are for."""
    found = http.detected_format(F.col("doc"))
    return rows_where(overlays, ~http.format_matches(F.col("doc"), F.col("target_format")), "OVERLAY_TARGET_FORMAT_MISMATCH", "error", F.col("file"), _said('Overlay targetFormat "', F.col("target_format"), '" does not match the target document format "', found, '".'))


#: Hints on what a handler does, by the flag that says so: the code and what is said.
HANDLER_HINTS = {
    "not_found": ("unsupported-route-feature", "Handler calls notFound(); add an explicit @response for 404 if you want it documented in OpenAPI."),
    "streams": ("stream-response-hint", "Handler appears to return a streaming body. Consider @responseContentType text/event-stream (or another sequential media type) with @itemSchema for accurate OpenAPI output."),
}


def handler_hints(handlers: DataFrame) -> DataFrame:
    """Information on handlers ``(file, not_found, streams)`` that show nothing or a stream; nulls are no."""
    found = F.array_compact(F.array(*[F.when(F.col(flag), F.struct(F.lit(code).alias("code"), F.lit(said).alias("message"))) for flag, (code, said) in HANDLER_HINTS.items()]))
    each = handlers.select("file", F.explode(found).alias("h"))
    return each.select(F.col("h.code").alias("code"), F.lit("info").alias("severity"), F.col("file").cast("string").alias("subject"), F.col("h.message").alias("message"))
