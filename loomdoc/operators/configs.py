"""Configurations as rows of settings: given values, and defaults where none is given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdoc.operators.diagnostics import rows_where

#: Settings with their defaults as JSON; settings that have none and are taken as they are; names of frameworks.
DEFAULTS = {
    "apiDir": '"./src/app/api"', "routerType": '"app"', "schemaDir": '"./src"', "docsUrl": '"api-docs"', "ui": '"scalar"', "outputFile": '"openapi.json"', "outputDir": '"./public"', "includeOpenApiRoutes": "false",
    "ignoreRoutes": "[]", "excludeSchemas": "[]", "schemaType": '"typescript"', "schemaFiles": "[]", "cache": "true", "debug": "false", "diagnostics.enabled": "true", "diagnostics.failOn": '"never"',
}
AS_GIVEN = ("defaultResponseSet", "responseSets", "errorConfig", "errorDefinitions", "experimental", "arazzo", "overlay", "next.adapterPath")
FRAMEWORKS = {
    "next": "nextjs", "nextjs": "nextjs", "tanstack": "tanstack", "react-router": "reactrouter", "reactrouter": "reactrouter", "remix": "remix", "sveltekit": "sveltekit", "nuxt": "nuxt", "astro": "astro", "hono": "hono",
    "express": "express",
}
PRESETS = {"bearer": "BearerAuth", "basic": "BasicAuth", "apikey": "ApiKeyAuth"}


def version_target(openapi: Column) -> Column:
    """The version that a document's ``openapi`` asks for: its own minor one; the newest for what isn't released, but for a preview that is named; 3.0 for anything else."""
    v = F.coalesce(F.nullif(openapi, F.lit("")), F.lit("3.0.0"))
    return F.when(v.startswith("3.2"), "3.2").when(v.startswith("3.1"), "3.1").when(v.startswith("3.0"), "3.0").when(v.rlike(r"^3\.3(\.0)?-preview"), "3.3-preview").when(v.startswith("3.3") | v.startswith("4."), "3.2").otherwise("3.0")


def normalized(configs: DataFrame, key: str, doc: str = "doc") -> DataFrame:
    """``(key, name, value)`` of configurations ``(key, doc variant)``: every setting by its path with its value as JSON; those without a value and a default have no row.

    A null counts as not given. Backends of schemas are each once, in order; presets are the fixed ones with a configuration's own over them. A framework's module is the adapter path where none is given; without a framework it is the
    first of the names with the router and the adapter of ``next``. Unknown kinds have no row of a kind: see ``unknown_frameworks``.
    """
    get = lambda path: F.try_variant_get(doc, f"$.{path}", "variant")
    text = lambda path: F.try_variant_get(doc, f"$.{path}", "string")
    said = lambda path: F.when(~F.coalesce(F.is_variant_null(get(path)), F.lit(True)), F.to_json(get(path)))
    quoted = lambda c: F.when(c.isNotNull(), F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
    settings = {name: F.coalesce(said(name), F.lit(default)) for name, default in DEFAULTS.items()} | {name: said(name) for name in AS_GIVEN}
    listed = F.try_variant_get(doc, "$.schemaType", "array<string>")
    backends = F.array_distinct(F.coalesce(listed, F.array(F.coalesce(text("schemaType"), F.lit("typescript")))))
    settings["schemaBackends"] = F.to_json(backends)
    settings["openapiVersion"] = quoted(version_target(text("openapi")))
    has = F.coalesce(F.schema_of_variant(get("framework")).startswith("OBJECT"), F.lit(False))
    kind = F.when(has & text("framework.kind").isNotNull(), F.try_element_at(F.create_map(*[F.lit(x) for p in FRAMEWORKS.items() for x in p]), text("framework.kind"))).otherwise("nextjs")
    given = lambda path: F.nullif(text(path), F.lit(""))
    router = F.coalesce(text("routerType"), F.lit("app"))
    adapter = F.when(has & (kind == "nextjs"), F.coalesce(given("framework.adapterPath"), text("next.adapterPath"))).when(has, text("framework.adapterPath")).otherwise(text("next.adapterPath"))
    settings["framework.kind"] = quoted(kind)
    settings["framework.router"] = quoted(F.when(has & (kind == "nextjs"), F.coalesce(given("framework.router"), router)).when(has, text("framework.router")).otherwise(router))
    settings["framework.adapterPath"] = quoted(adapter)
    settings["framework.modulePath"] = quoted(F.when(has, F.coalesce(given("framework.modulePath"), adapter)).otherwise(text("next.adapterPath")))
    own = F.map_entries(F.coalesce(F.try_variant_get(doc, "$.authPresets", "map<string,string>"), F.create_map().cast("map<string,string>")))
    fixed = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in PRESETS.items()])
    kept = F.filter(fixed, lambda f: ~F.exists(own, lambda o: o["key"] == f["key"]))
    presets = F.transform(F.concat(kept, own), lambda e: F.struct(F.concat(F.lit("authPresets."), e["key"]).alias("name"), quoted(e["value"]).alias("value")))
    rows = F.concat(F.array(*[F.struct(F.lit(name).alias("name"), value.alias("value")) for name, value in settings.items()]), presets)
    return configs.where(F.col(doc).isNotNull()).select(key, F.explode(rows).alias("s")).select(key, "s.name", "s.value").where("value IS NOT NULL")


def unknown_frameworks(configs: DataFrame, key: str, doc: str = "doc") -> DataFrame:
    """An error for each configuration whose framework is of no known kind."""
    kind = F.try_variant_get(doc, "$.framework.kind", "string")
    said = F.concat(F.lit('Unknown framework kind "'), kind, F.lit(f'". Expected one of: {", ".join(FRAMEWORKS)}.'))
    return rows_where(configs, kind.isNotNull() & ~kind.isin(*FRAMEWORKS), "unknown-framework", "error", F.col(key), said)
