"""Names, tags, components and runs: lookups, unions, sums and orders that whole documents are made with."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdoc.functions.text import METHODS
from loomdoc.sources.shared import written

COLLATION = "UNICODE_CI_AI"


def operation_tags(primary: Column, more: Column) -> Column:
    """The primary tag and the others, trimmed, without blanks, each once, in order."""
    every = F.concat(F.array(primary), F.transform(F.coalesce(more, F.array().cast("array<string>")), lambda x: F.trim(x)))
    return F.array_distinct(F.filter(every, lambda x: F.coalesce(x, F.lit("")) != ""))


def operation_place(method: Column) -> Column:
    """Where an operation stands in its path item: under its lower-cased native method, else among the additional operations by its name."""
    return F.when(F.lower(method).isin(*METHODS), F.lower(method)).otherwise(F.concat(F.lit("additionalOperations/"), method))


def registered_tags(routes: DataFrame, order: str, fields: Sequence[str] = ("summary", "description", "kind", "parent")) -> DataFrame:
    """One row for each tag of routes ``(tag, path, fields)``: the path's capitalised first part where no tag is given, of each field the last value that isn't blank."""
    first = F.get(F.filter(F.split("path", "/"), lambda x: (x != "") & ~x.startswith("{")), F.lit(0))
    name = F.coalesce(F.nullif(F.trim("tag"), F.lit("")), F.concat(F.upper(F.left(first, F.lit(1))), F.substr(first, F.lit(2))))
    given = lambda f: F.coalesce(F.trim(F.col(f)), F.lit("")) != ""
    return routes.withColumn("__tag", name).groupBy(F.col("__tag").alias("tag")).agg(*[F.max_by(f, F.when(given(f), F.col(order))).alias(f) for f in fields])


def merged_tags(template: DataFrame, generated: DataFrame, name: str, fields: Sequence[str]) -> DataFrame:
    """Template tags first, then generated ones by name; generated fields that aren't null win."""
    t, g = template.select(F.col(name), F.lit(0).alias("__t"), *[F.col(f).alias(f"__t_{f}") for f in fields]), generated.select(name, *fields)
    both = t.join(g, name, "full")
    return both.select(name, *[F.coalesce(F.col(f), F.col(f"__t_{f}")).alias(f) for f in fields], F.col("__t").isNotNull().alias("from_template"))


def schema_delta(before: DataFrame, after: DataFrame, name: str, schema: str) -> DataFrame:
    """Schemas that are new or whose JSON text has changed."""
    old = before.select(name, F.col(schema).alias("__old"), F.lit(True).alias("__had"))
    return after.join(old, name, "left").where(F.col("__had").isNull() | ~F.col(schema).eqNullSafe(F.col("__old"))).select(*after.columns)


def route_schema_names(routes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The distinct type names that a file's routes use, without array marks and blanks."""
    each = routes.select(key, F.explode(F.array(*columns)).alias("__n")).select(key, F.regexp_replace(F.trim("__n"), r"(\[\])+$", "").alias("name"))
    return each.where("name <> ''").distinct()


def example_map(examples: DataFrame, keys: Sequence[str], target: str, order: str) -> DataFrame:
    """Examples of one target by name: of a name the last."""
    rest = [c for c in examples.columns if c not in (*keys, "target", "name", order)]
    return examples.where(F.col("target") == target).groupBy(*keys, "name").agg(F.max_by(F.struct(*rest), order).alias("__e")).select(*keys, "name", "__e.*")


def expanded_examples(examples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Example rows ``(keys, name, value variant)``: the items of a list are ``name1``, ``name2`` and so on, the members of an object that all are objects with a ``value`` are examples by their names, anything else stays."""
    kind = F.schema_of_variant("value")
    listed = examples.where(kind.startswith("ARRAY"))
    items = listed.lateralJoin(listed.sparkSession.tvf.variant_explode(F.col("value").outer()).toDF("__pos", "__key", "__item")).select(*keys, F.concat("name", (F.col("__pos") + 1).cast("string")).alias("name"), F.col("__item").alias("value"))
    named = examples.where(kind.startswith("OBJECT"))
    members = named.lateralJoin(named.sparkSession.tvf.variant_explode(F.col("value").outer()).toDF("__pos", "__key", "__item"))
    inner = F.try_variant_get("__item", "$.value", "variant")
    whole = members.groupBy(*keys, "name").agg(F.bool_and(inner.isNotNull()).alias("__all"))
    split = members.join(whole.where("__all"), [*keys, "name"], "left_semi").select(*keys, F.col("__key").alias("name"), inner.alias("value"))
    other = named.join(whole.where("__all"), [*keys, "name"], "left_anti").select(*keys, "name", "value")
    plain = examples.where(~kind.startswith("ARRAY") & ~kind.startswith("OBJECT")).select(*keys, "name", "value")
    return items.unionByName(split).unionByName(other).unionByName(plain)


def phase_sums(timings: DataFrame, phase: str = "phase", ms: str = "ms") -> DataFrame:
    """Milliseconds and calls of each phase, and their mean to three places."""
    return timings.groupBy(phase).agg(F.sum(ms).alias("ms"), F.count("*").alias("calls"), F.round(F.avg(ms), 3).alias("mean"))


def slowest_phases(timings: DataFrame, n: int = 5, phase: str = "phase", ms: str = "ms", total: str = "total") -> DataFrame:
    """The phases of the most milliseconds but the total, ties by name: a report of ``n`` rows."""
    return phase_sums(timings.where(F.col(phase) != total), phase, ms).orderBy(F.desc("ms"), phase).limit(n).select(phase, "ms")


def document_counts(operations: DataFrame, schemas: DataFrame, key: str) -> DataFrame:
    """Paths, operations and schemas of each document; 0 where it has none of a kind."""
    o = operations.groupBy(key).agg(F.countDistinct("path").alias("paths"), F.count("*").alias("operations"))
    s = schemas.groupBy(key).agg(F.countDistinct("name").alias("schemas"))
    return o.join(s, key, "full").na.fill(0, ["paths", "operations", "schemas"])


def named_order(rows: DataFrame, name: str, within: Sequence[str] = ()) -> DataFrame:
    """``ord`` of component schemas, tags or other names within each document: letters without case and accents first, then as written."""
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy(*within).orderBy(F.collate(F.col(name), COLLATION), name)))


def path_sort(rows: DataFrame, path: str, tag: str, within: Sequence[str]) -> DataFrame:
    """``ord`` of a document's paths: by tag, number of parts, then part after part without case and accents; equal ones as written."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    joined = F.array_join(parts, "\u0001")  # a sign below all others, so that the text compares as its parts do
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy(*within).orderBy(F.collate(F.col(tag), "UNICODE"), F.size(parts), F.collate(joined, COLLATION), path)))


def component_union(layers: Sequence[DataFrame], keys: Sequence[str] = ("kind", "name")) -> DataFrame:
    """Components of several layers; of a kind and name the last layer's."""
    every = reduce(DataFrame.unionByName, [layer.withColumn("__layer", F.lit(i)) for i, layer in enumerate(layers)])
    rest = [c for c in every.columns if c not in (*keys, "__layer")]
    return every.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__layer").alias("__c")).select(*keys, "__c.*")


def shallow_last(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Field by field the last value that is given (not null) for each key."""
    fields = [c for c in rows.columns if c not in (*keys, order)]
    return rows.groupBy(*keys).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields])


def merged_comments(blocks: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Fields of several comment blocks of one thing: the last that isn't blank, flags if any block has them, lists one after another."""
    kinds = dict(blocks.dtypes)

    def merged(c: str) -> Column:
        if kinds[c] == "boolean":
            return F.coalesce(F.bool_or(c), F.lit(False)).alias(c)
        if kinds[c].startswith("array"):
            return F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, c))), lambda x: x[c])).alias(c)
        given = F.coalesce(F.col(c), F.lit("")) != "" if kinds[c] == "string" else F.col(c).isNotNull()
        return F.coalesce(F.max_by(c, F.when(given, F.col(order))), *([F.lit("")] if kinds[c] == "string" else [])).alias(c)

    return blocks.groupBy(*keys).agg(*[merged(c) for c in blocks.columns if c not in (*keys, order)])


def intersections(parts: DataFrame, key: str, order: str) -> DataFrame:
    """Intersections of parts ``(key, order, ref, is_object)`` as ``all_of`` where a part is a reference or no object, else ``merged``: how a part list comes together, with its references in order."""
    refs = F.transform(F.filter(F.array_sort(F.collect_list(F.struct(order, "ref"))), lambda x: x["ref"].isNotNull()), lambda x: x["ref"])
    return parts.groupBy(key).agg(F.when(F.bool_or(F.col("ref").isNotNull() | ~F.col("is_object")), "all_of").otherwise("merged").alias("form"), refs.alias("refs"))


def piped(stages: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Attributes ``(keys, order, attribute, value)`` of piped schemas: of each attribute the last stage's, but the type of the last stage that has one."""
    return stages.where(F.col("value").isNotNull()).groupBy(*keys, "attribute").agg(F.max_by("value", order).alias("value"))


def reusable_actions(actions: DataFrame, components: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Actions ``(file, seq, ref, ...)`` with what their reference ``(file, name, target, copy, update, remove)`` gives and they lack, in order; and those whose reference leads nowhere."""
    name = F.replace(F.replace(F.regexp_extract("ref", r"^#/components/actions/([^/]+)$", 1), F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))
    used = actions.withColumn("name", F.when(F.col("ref").isNotNull(), name))
    fields = [c for c in components.columns if c not in ("file", "name")]
    given = components.select("file", "name", F.lit(True).alias("__found"), *[F.col(f).alias(f"__c_{f}") for f in fields])
    both = used.join(given, ["file", "name"], "left")
    lost = both.where("ref IS NOT NULL AND __found IS NULL").select(*actions.columns)
    made = both.where("ref IS NULL OR __found")
    return made.select("file", "seq", *[F.coalesce(F.col(f) if f in actions.columns else F.lit(None), F.col(f"__c_{f}")).alias(f) for f in fields]), lost


def refined_columns(columns: DataFrame, refinements: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Column attributes ``(keys, attribute, value)`` with those that refinements give in their place or besides."""
    every = columns.withColumn("__rank", F.lit(0)).unionByName(refinements.withColumn("__rank", F.lit(1)))
    return every.groupBy(*keys, "attribute").agg(F.max_by("value", "__rank").alias("value"))


def referenced_schemes(requirements: DataFrame, key: str, column: str = "security") -> DataFrame:
    """The distinct scheme names of requirement lists (arrays of maps)."""
    return requirements.select(key, F.explode(F.flatten(F.transform(column, lambda m: F.map_keys(m)))).alias("name")).distinct()


def auto_wired(routes: DataFrame, schemas: DataFrame, suffixes: dict[str, str]) -> DataFrame:
    """Routes ``(route, base)`` with, for each role, the schema named ``base`` and the role's suffix if there is one: ``(route, role, name)``."""
    roles = routes.select("route", F.explode(F.array(*[F.struct(F.lit(role).alias("role"), F.concat("base", F.lit(s)).alias("name")) for role, s in suffixes.items()])).alias("r")).select("route", "r.*")
    return roles.join(schemas.select("name").distinct(), "name", "left_semi").select("route", "role", "name")


def path_object_candidates(routes: DataFrame, properties: DataFrame) -> DataFrame:
    """Object schemas ``(schema_name, property)`` that have a property for every path parameter of a route ``(route, names)``; of several the first by name."""
    wanted = routes.select("route", F.size(F.array_distinct("names")).alias("__n"), F.explode(F.array_distinct("names")).alias("property"))
    hits = wanted.join(properties.select("schema_name", "property").distinct(), "property").groupBy("route", "schema_name").agg(F.count("*").alias("__k"), F.first("__n").alias("__n"))
    return hits.where("__k = __n").groupBy("route").agg(F.min("schema_name").alias("schema_name"))


def inlined(nodes: DataFrame, excluded: DataFrame, schemas: DataFrame, key: str) -> DataFrame:
    """Nodes ``(key, pointer, value)`` with references to excluded schemas ``(key, name)`` replaced by the schemas' own nodes ``(key, name, below, value)``, round by round until none is left.

    A schema that leads back to itself stays a reference where it does: the schemas that a place came through are carried along, so rounds end with the longest chain of different schemas.
    A reference to an excluded schema without nodes loses its place.
    """
    prefix = "#/components/schemas/"
    hidden = written(excluded.select(key, "name").distinct(), "hidden")
    done, open_ = None, nodes.withColumn("__via", F.array().cast("array<string>"))
    while True:
        name = F.when(F.col("pointer").endswith("/$ref"), F.regexp_extract("value", rf'^"{prefix}([^"]+)"$', 1))
        named = open_.withColumn("name", name).join(hidden.withColumn("__hidden", F.lit(True)), [key, "name"], "left")
        named = written(named.withColumn("__go", F.coalesce(F.col("__hidden") & ~F.array_contains("__via", F.col("name")), F.lit(False))), "inlined")
        rest = named.where("NOT __go").select(key, "pointer", "value")
        done = rest if done is None else done.unionByName(rest)
        going = named.where("__go").select(key, "name", F.regexp_replace("pointer", r"/\$ref$", "").alias("__at"), "__via")
        if going.isEmpty():
            return done
        open_ = going.join(schemas.withColumnRenamed("value", "__v"), [key, "name"]).select(key, F.concat("__at", "below").alias("pointer"), F.col("__v").alias("value"), F.array_append("__via", F.col("name")).alias("__via"))


def scheme_texts(codes: DataFrame, template: str, variables: dict[str, str]) -> DataFrame:
    """Error codes ``(document, ord, code, status, description, own map)`` as responses ``(document, status, description, schema)``: the template filled with the run's variables, a code's own, and the built-in ones; of a status the last."""
    from loomdoc.functions.http import STATUS_KEYWORDS
    from loomdoc.functions.text import fill_template, guess_status

    status = F.coalesce("status", guess_status(F.col("code"), STATUS_KEYWORDS)).cast("string")
    own = F.coalesce("own", F.create_map().cast("map<string,string>"))
    built = F.create_map(F.lit("ERROR_CODE"), F.col("code"), F.lit("DESCRIPTION"), F.col("description"), F.lit("HTTP_STATUS"), status)
    text = fill_template(F.lit(template), built)
    text = fill_template(text, own)
    if variables:
        text = fill_template(text, F.create_map(*[F.lit(x) for p in variables.items() for x in p]))
    made = codes.select("document", "ord", status.alias("status"), "description", text.alias("schema"))
    return made.groupBy("document", "status").agg(F.max_by(F.struct("description", "schema"), "ord").alias("__r")).select("document", "status", "__r.*")
