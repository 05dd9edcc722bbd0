"""Documents out of node rows: the inverse of ``nodes.nodes``, a fold of pointers from the deepest level up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdoc.sources.shared import written

#: How many levels are folded before the rows are written.
WRITTEN_LEVELS = 8


def _name(pointer: Column) -> Column:
    return F.replace(F.replace(F.substring_index(pointer, "/", -1), F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))


def _quoted(text: Column) -> Column:
    listed = F.to_json(F.array(text))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def assemble(rows: DataFrame, key: str, lists: DataFrame | None = None) -> DataFrame:
    """``(key, doc variant)`` of leaf rows ``(key, pointer, value)``, value as JSON text.

    ``lists`` has the pointers ``(key, pointer)`` of lists (``nodes.lists``): their members go by number, gaps close. Without it, what has the names 0 to n-1 alone is a list.
    All other inner nodes are objects. Of rows with one pointer the least value counts, and a leaf with rows below it gives way to these. Each level is one grouping by
    (key, parent) with the marks of lists among its rows, so a wide document is spread over tasks until its last levels. Keys without a row have no document.
    """
    rows = written(rows.groupBy(key, "pointer").agg(F.min("value").alias("value")).withColumn("depth", F.size(F.split("pointer", "/")) - 1), "nodes")
    parent = F.regexp_replace("pointer", "/[^/]*$", "").alias("parent")
    marked = None if lists is None else lists.select(key, F.col("pointer").alias("parent"), F.lit(None).cast("struct<n:int,name:string,leaf:boolean,value:string>").alias("member"), F.lit(True).alias("listed"), F.size(F.split("pointer", "/")).alias("depth"))
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    folded = None
    for depth in range(deepest, 0, -1):
        level = rows.where(F.col("depth") == depth).select(key, "pointer", "value", F.lit(True).alias("leaf"))
        if folded is not None:
            level = level.unionByName(folded)
        name = _name(F.col("pointer"))
        at = level.select(key, parent, F.struct(name.try_cast("int").alias("n"), name.alias("name"), "leaf", "value").alias("member"), F.lit(False).alias("listed"))
        if marked is not None:
            at = at.unionByName(marked.where(F.col("depth") == depth).drop("depth"))
        grouped = at.groupBy(key, "parent").agg(F.array_sort(F.collect_list("member")).alias("members"), F.max("listed").alias("listed"))
        # of a leaf and what was folded below it the latter stands in front
        alone = F.filter("members", lambda m, i: (i == 0) | (F.get("members", i - 1)["name"] != m["name"]))
        grouped = grouped.where(F.size("members") > 0).select(key, "parent", alone.alias("members"), "listed")
        if marked is None:
            size = F.size("members")
            fits = F.size(F.filter("members", lambda m: m["n"].cast("string") == m["name"])) == size
            grouped = grouped.withColumn("listed", fits & (F.get("members", F.lit(0))["n"] == 0) & (F.get("members", size - 1)["n"] == size - 1))
        values = F.array_join(F.transform("members", lambda m: m["value"]), ",")
        fields = F.array_join(F.transform("members", lambda m: F.concat(_quoted(m["name"]), F.lit(":"), m["value"])), ",")
        text = F.when(F.col("listed"), F.concat(F.lit("["), values, F.lit("]"))).otherwise(F.concat(F.lit("{"), fields, F.lit("}")))
        folded = grouped.select(key, F.col("parent").alias("pointer"), text.alias("value"), F.lit(False).alias("leaf"))
        if depth > 1 and depth % WRITTEN_LEVELS == 0:
            folded = written(folded, "folded")
    roots = rows.where("depth = 0").select(key, "pointer", "value")
    whole = roots if folded is None else folded.drop("leaf").unionByName(roots.join(folded.select(key, "pointer"), [key, "pointer"], "left_anti"))
    return whole.select(key, F.parse_json("value").alias("doc"))


def operation_nodes(operations: DataFrame, key: str, path: str, place: str, doc: str) -> DataFrame:
    """Node rows of operations (``doc`` as VARIANT or a struct's JSON) under ``/paths/<path>/<place>``, for ``assemble``: ``(key, pointer, value)``; an operation stays one leaf.

    ``place`` is a method or ``additionalOperations/NAME``. Of two operations at one place the later in the order of their texts gives way.
    """
    token = lambda c: F.replace(F.replace(c, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
    return operations.select(key, F.concat(F.lit("/paths/"), token(F.col(path)), F.lit("/"), F.col(place)).alias("pointer"), F.to_json(doc).alias("value"))


#: Settings of a run that no document shows.
INTERNAL = (
    "apiDir", "routerType", "schemaDir", "docsUrl", "ui", "outputFile", "outputDir", "includeOpenApiRoutes", "ignoreRoutes", "schemaType", "schemaBackends", "schemaFiles", "defaultResponseSet", "responseSets",
    "errorConfig", "errorDefinitions", "openapiVersion", "framework", "next", "diagnostics", "debug", "authPresets", "excludeSchemas", "cache", "experimental", "arazzo", "overlay", "generatedDir", "watch",
    "clientSdk", "docs", "hooks", "basePath",
)


def clean(rows: DataFrame, key: str) -> DataFrame:
    """Node rows of documents without the settings of a run, and with an example for every path parameter that has none: 123 for ids, texts for all others."""
    p = F.col("pointer")
    kept = rows.where(~F.regexp_extract(p, "^/([^/]+)", 1).isin(*INTERNAL))
    place = r"^(/paths/[^/]*\{[^/]*\}[^/]*/(?:[^/]+|additionalOperations/[^/]+)/parameters/\d+)/(in|name|example)(?:/|$)"
    fields = kept.where(p.rlike(place)).select(key, F.regexp_extract(p, place, 1).alias("parent"), F.regexp_extract(p, place, 2).alias("field"), "value")
    pick = lambda n: F.max(F.when(F.col("field") == n, F.col("value")))
    lacking = fields.groupBy(key, "parent").agg(pick("in").alias("i"), pick("name").alias("n"), F.max(F.col("field") == "example").alias("has")).where("i = '\"path\"' AND NOT has AND n IS NOT NULL")
    example = F.when((F.col("n") == '"id"') | F.col("n").endswith('Id"'), "123").when(F.col("n") == '"slug"', '"example-slug"').otherwise('"example"')
    return kept.unionByName(lacking.select(key, F.concat("parent", F.lit("/example")).alias("pointer"), example.alias("value")))
