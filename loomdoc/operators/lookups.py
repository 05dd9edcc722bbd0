"""Lookups by name as joins: prioritised sources, first or complete candidates, response sets, references, imports.

The sides that are looked up are tables like any other; which join is used is left to Catalyst and AQE, so a side that has grown is not broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Source extensions in the order in which they are tried.
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx")


def by_priority(wanted: DataFrame, sources: Sequence[DataFrame], key: str, value: str) -> DataFrame:
    """``wanted`` with ``value`` from the first source that has a value for the key, and ``found_in`` (its place from 0, or null).

    The sources are reduced to one row a key before the join, so repeated keys never multiply rows; within a source the least value counts.
    """
    parts = [s.select(key, F.col(value).alias("__v"), F.lit(i).alias("__p")) for i, s in enumerate(sources)]
    every = reduce(DataFrame.union, parts).where(F.col("__v").isNotNull())
    best = every.groupBy(key).agg(F.min(F.struct("__p", "__v")).alias("__b"))
    return wanted.join(best, key, "left").select(*[wanted[c] for c in wanted.columns], F.col("__b.__v").alias(value), F.col("__b.__p").alias("found_in"))


def first_candidate(rows: DataFrame, row_id: str, candidates: Column, index: DataFrame, name: str) -> DataFrame:
    """``row_id`` and ``candidate``: the first of each row's candidates that the index holds; rows without one go."""
    tried = rows.select(row_id, F.posexplode(candidates).alias("__pos", name))
    return tried.join(index.select(name), name, "left_semi").groupBy(row_id).agg(F.min_by(name, "__pos").alias("candidate"))


def all_candidates(rows: DataFrame, row_id: str, candidates: Column, index: DataFrame, name: str) -> DataFrame:
    """``row_id`` and ``candidates`` of the rows of which the index holds every candidate; rows with no candidate go."""
    tried = rows.select(row_id, F.size(candidates).alias("__n"), F.posexplode(candidates).alias("__pos", name))
    held = tried.join(index.select(name), name, "left_semi")
    every = held.groupBy(row_id, "__n").agg(F.array_sort(F.collect_list(F.struct("__pos", name))).alias("__c"))
    return every.where(F.size("__c") == F.col("__n")).select(row_id, F.col("__c")[name].alias("candidates"))


def query_candidates(root: Column) -> Column:
    """Names under which a route's query parameters may be declared, in order."""
    return F.array(*[F.concat(root, F.lit(s)) for s in ("QuerySchema", "ParamsSchema", "QueryParamsSchema")])


def undeclared(inferred: DataFrame, declared: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Declared rows, then the inferred ones that no declared row names."""
    return declared.unionByName(inferred.join(declared.select(*keys), list(keys), "left_anti"))


def expand_response_sets(rows: DataFrame, sets: DataFrame, row_id: str, names: str) -> DataFrame:
    """``row_id``, ``code`` and ``reference`` for every code of the sets that a comma list names; ``none`` anywhere disables the list. ``sets`` has ``name`` and ``codes``."""
    listed = F.transform(F.split(names, ","), lambda p: F.trim(p))
    asked = rows.where(~F.array_contains(listed, "none")).select(row_id, F.explode(listed).alias("name"))
    codes = asked.join(sets.select("name", F.explode("codes").alias("code")), "name").select(row_id, "code").distinct()
    return codes.withColumn("reference", F.concat(F.lit("#/components/responses/"), "code"))


def additional_responses(listed: Column, descriptions: Mapping[str, str]) -> Column:
    """Array of (code, reference, description) of a list ``code:Type:description``; parts without a code go.

    Without a type the response itself is referred to. 204 has no content. The description is what the part says, else that of its code, else a plain one.
    """
    known = F.create_map(*[F.lit(x) for pair in descriptions.items() for x in pair]) if descriptions else F.create_map().cast("map<string,string>")

    def one(part: Column) -> Column:
        pieces = F.split(part, ":", 3)
        code, kind = pieces[0], F.try_element_at(pieces, F.lit(2))
        own = F.nullif(F.trim(F.coalesce(F.try_element_at(pieces, F.lit(3)), F.lit(""))), F.lit(""))
        plain = F.when(code == "204", "No Content").otherwise(F.concat(F.lit("HTTP "), code, F.lit(" response")))
        typed = F.coalesce(kind, F.lit("")) != ""
        link = F.when(~typed, F.concat(F.lit("#/components/responses/"), code)).when(code != "204", F.concat(F.lit("#/components/schemas/"), kind))
        return F.struct(code.alias("code"), link.alias("reference"), F.when(typed, F.coalesce(own, F.try_element_at(known, code), plain)).alias("description"))

    return F.filter(F.transform(F.transform(F.split(listed, ","), lambda p: F.trim(p)), one), lambda r: r["code"] != "")


def responses_by_priority(layers: Sequence[DataFrame], row_id: str, code: str) -> DataFrame:
    """One row for each id and code from layers in rising priority: a later layer replaces an earlier one's response whole."""
    parts = [layer.withColumn("__p", F.lit(i)) for i, layer in enumerate(layers)]
    every = reduce(DataFrame.unionByName, parts)
    rest = [c for c in every.columns if c not in (row_id, code, "__p")]
    return every.groupBy(row_id, code).agg(F.max_by(F.struct(*rest), "__p").alias("__r")).select(row_id, code, "__r.*")


def with_headers(responses: DataFrame, headers: DataFrame, row_id: str, code: str, order: str | None = None) -> DataFrame:
    """``responses`` with ``headers`` (map of name to value, or null) joined by id and code; ``headers`` has ``name`` and ``value``, of a repeated name the last by ``order`` (else by value) counts."""
    one = headers.groupBy(row_id, code, "name").agg(F.max_by("value", order or "value").alias("value"))
    maps = one.groupBy(row_id, code).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("headers"))
    return responses.join(maps, [row_id, code], "left")


def missing_schemes(used: DataFrame, presets: DataFrame, defined: DataFrame, name: str) -> DataFrame:
    """Presets that are used and not yet defined."""
    return presets.join(used.select(name), name, "left_semi").join(defined.select(name), name, "left_anti")


def schema_references(doc: Column) -> Column:
    """Distinct names of component schemas that JSON text refers to, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(doc, F.lit(r'"\$ref"\s*:\s*"#/components/schemas/([^"/]+)"'), F.lit(1)))


def stale_fragments(fragments: DataFrame, changed: DataFrame, file: str = "file", dependencies: str = "dependencies") -> DataFrame:
    """Fragments that stay: neither their file nor a dependency (a file or a folder above it) is among ``changed`` (one column, ``path``)."""
    parts = F.transform(F.split("path", "/"), lambda _, i: F.array_join(F.slice(F.split(F.col("path"), "/"), F.lit(1), i + 1), "/"))
    touched = changed.select(F.explode(parts).alias("__d")).where("__d <> ''").distinct()
    needs = fragments.select(F.col(file).alias("__f"), F.explode(F.array_union(F.array(file), F.coalesce(dependencies, F.array().cast("array<string>")))).alias("__d"))
    gone = needs.join(touched, "__d", "left_semi").select("__f").distinct()
    return fragments.join(gone, fragments[file] == F.col("__f"), "left_anti")


def import_candidates(current: Column, source: Column) -> Column:
    """Paths that a relative import may mean, in order: itself, with an extension, as a folder's index; others (packages) give an empty array."""
    folder = F.slice(F.split(current, "/"), F.lit(1), F.greatest(F.size(F.split(current, "/")) - 1, F.lit(0)))
    steps = F.concat(folder, F.filter(F.split(source, "/"), lambda p: (p != ".") & (p != "")))
    up = lambda kept, p: F.when(p == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(p)))
    base = F.array_join(F.aggregate(steps, F.array().cast("array<string>"), up), "/")
    more = [F.concat(base, F.lit(e)) for e in EXTENSIONS] + [F.concat(base, F.lit("/index" + e)) for e in EXTENSIONS]
    whole = base.rlike(r"\.(ts|tsx|js|jsx)$")
    return F.when(~source.startswith("."), F.array().cast("array<string>")).when(whole, F.array(base)).otherwise(F.array(base, *more))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``imports`` (``current``, ``source``) with ``resolved``: the first candidate among ``files`` (``path``), else null. Each distinct import is tried once."""
    each = imports.select("current", "source").distinct().withColumn("__id", F.struct("current", "source"))
    found = first_candidate(each, "__id", import_candidates(F.col("current"), F.col("source")), files, "path")
    found = found.select(F.col("__id.current").alias("current"), F.col("__id.source").alias("source"), F.col("candidate").alias("resolved"))
    return imports.join(found, ["current", "source"], "left")


def variant_names(schemas: DataFrame, name: str = "name", side: str = "side", text: str = "text") -> DataFrame:
    """Rows with ``stored``: a name whose input and output schemas are equal is shared; where they differ the output gets ``Output`` at its end."""
    differs = schemas.groupBy(name).agg((F.min(text) != F.max(text)).alias("__d"))
    stored = F.when(F.col("__d") & (F.col(side) == "output"), F.concat(name, F.lit("Output"))).otherwise(F.col(name))
    return schemas.join(differs, name).withColumn("stored", stored).drop("__d")
