"""Documents as node rows, and their rewriting between versions by rules over JSON pointers.

A node is ``(doc, pointer, value)``: a leaf of a document, its JSON pointer (``/`` in a name is ``~1``) and its value as JSON text; empty objects and lists are leaves. A rewrite drops and renames parts of
pointers, so a document of any size is a set of rows that Spark deals out, never one object in a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdoc.functions.registries import EXTENSIONS, VERSIONS
from loomdoc.operators.diagnostics import rows_where
from loomdoc.sources.shared import written

#: The grammar of a document from its root. What stands in values, examples' values, schemas and extensions is in none of these places.
_ITEM = r"/(?:paths|webhooks)/[^/]+"
_OPERATION = rf"{_ITEM}/(?:get|put|post|delete|options|head|patch|trace|query|additionalOperations/[^/]+)"
_PARAMETER = rf"(?:{_ITEM}/parameters/\d+|{_OPERATION}/parameters/\d+|/components/parameters/[^/]+)"
_BODY = rf"(?:{_OPERATION}/requestBody|/components/requestBodies/[^/]+)"
_RESPONSE = rf"(?:{_OPERATION}/responses/[^/]+|/components/responses/[^/]+)"
_CONTENT = rf"(?:{_PARAMETER}|{_BODY}|{_RESPONSE})/content/[^/]+"
_EXAMPLE = rf"(?:{_PARAMETER}|{_CONTENT})/examples/[^/]+"
_SCHEME = r"/components/securitySchemes/[^/]+"

#: Where fields stand that older versions hold as extensions, and those of them that no version takes back.
PLACES = {
    "$self": "", "identifier": "/info/license", "name": r"/servers/\d+", "summary": _RESPONSE, "itemSchema": _CONTENT, "itemEncoding": _CONTENT, "prefixEncoding": _CONTENT, "dataValue": _EXAMPLE, "serializedValue": _EXAMPLE,
    "deviceAuthorization": rf"{_SCHEME}/flows", "deprecated": _SCHEME,
}
ONLY_DOWN = ("itemSchema", "deprecated")

#: What a version drops (from the version in front on, it is kept).
DROPPED = (("3.1", r"^/jsonSchemaDialect(/|$)"), ("3.1", r"^/webhooks(/|$)"), ("3.2", r"^/components/mediaTypes(/|$)"), ("3.2", r"^/tags/\d+/(summary|parent|kind)(/|$)"), ("3.2", r"^/components/securitySchemes/[^/]+/oauth2MetadataUrl(/|$)"))
_PATH = rf"^({_ITEM})"

#: How many levels of a document one pass goes down (more make a method that the JVM does not compile), and from how many characters on a text's members are parsed anew.
LEVELS = 4
LONG = 16_384


def _token(key: Column) -> Column:
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def _walk(documents: DataFrame, key: str, doc: str) -> DataFrame:
    """The leaves of documents as ``(k, pointer, text, above)``, in the shared folder; ``above`` has the pointers of the lists whose first leaf it is.

    A pass goes ``LEVELS`` down without a shuffle, what lies deeper goes into the next one. A VARIANT taken out of another keeps all names of it, so members of long documents are parsed anew by themselves: else each member of a
    wide document would be as wide as the document. Only texts with whole numbers as doubles stay, as ``1.0`` would be parsed as a decimal.
    """
    rows = documents.where(F.col(doc).isNotNull()).select(F.col(key).alias("k"), F.lit("").alias("pointer"), F.array().cast("array<string>").alias("above"), F.col(doc).alias("v"), (F.length(F.to_json(doc)) > LONG).alias("long"))
    pointer = F.when(F.col("pos").isNull(), F.col("pointer")).otherwise(F.concat("pointer", F.lit("/"), F.coalesce(_token(F.col("name")), F.col("pos").cast("string"))))
    first = F.when(F.col("name").isNull(), F.concat("above", F.array("pointer"))).otherwise(F.col("above"))
    above = F.when(F.col("pos").isNull(), F.col("above")).when(F.col("pos") == 0, first).otherwise(F.array().cast("array<string>"))
    own = F.when(F.col("long"), F.to_json("value"))
    kept = F.col("own").rlike(r"\d\.0([,\]}]|$)")
    found = None
    while True:
        for _ in range(LEVELS):
            members = rows.lateralJoin(rows.sparkSession.tvf.variant_explode_outer(F.col("v").outer()).toDF("pos", "name", "value"))
            members = members.select("k", pointer.alias("pointer"), above.alias("above"), F.coalesce("value", "v").alias("v"), own.alias("own"))
            rows = members.select("k", "pointer", "above", F.when(F.col("own").isNull() | kept, F.col("v")).otherwise(F.parse_json("own")).alias("v"), F.coalesce(kept | (F.length("own") > LONG), F.lit(False)).alias("long"))
        text = F.col("text")
        rows = rows.withColumn("text", F.to_json("v")).withColumn("inner", F.substr(text, F.lit(1), F.lit(1)).isin("{", "[") & (F.length(text) > 2))
        rows = written(rows.select("k", "pointer", "above", "long", "inner", F.when(~F.col("inner"), text).alias("text"), F.when(F.col("inner"), F.col("v")).alias("v")), "walk")
        leaves = rows.where("NOT inner").select("k", "pointer", "text", "above")
        found = leaves if found is None else found.unionByName(leaves)
        rows = rows.where("inner").select("k", "pointer", "above", "v", "long")
        if not rows.take(1):
            return found


def nodes_and_lists(documents: DataFrame, key: str, doc: str = "doc") -> tuple[DataFrame, DataFrame]:
    """``nodes`` and ``lists`` of the same documents in one walk."""
    walk = _walk(documents, key, doc)
    listed = walk.select("k", F.explode("above").alias("pointer")).unionByName(walk.where("text = '[]'").select("k", "pointer"))
    return walk.select(F.col("k").alias(key), "pointer", F.col("text").alias("value")), listed.select(F.col("k").alias(key), "pointer")


def nodes(documents: DataFrame, key: str, doc: str = "doc") -> DataFrame:
    """The leaves of documents ``(key, doc variant)`` as ``(key, pointer, value)``; null documents have none."""
    return nodes_and_lists(documents, key, doc)[0]


def lists(documents: DataFrame, key: str, doc: str = "doc") -> DataFrame:
    """The pointers ``(key, pointer)`` of lists in documents."""
    return nodes_and_lists(documents, key, doc)[1]


def _under(pointer: Column, pattern: str) -> Column:
    """The part of a pointer that a pattern (with the pointer's begin) names, if the pointer is it or lies below; else an empty string."""
    return F.regexp_extract(pointer, rf"^({pattern})(?:/|$)", 1)


def move_extensions(rows: DataFrame, key: str, version: str) -> DataFrame:
    """Nodes with fields that a version lacks under their extensions' names and with extensions of fields that it has under the fields' names.

    A field takes the place of an extension that is there too when it moves down; an extension stays where its field is there. Responses that are references without a description keep their summary, examples that are references
    their values.
    Each node names the places whose field or extension it lies in; what moves is decided once for each place and joined back to these nodes alone.
    """
    rank, p = VERSIONS.index(version), F.col("pointer")
    found = []
    for field, place in PLACES.items():
        extension, since = EXTENSIONS[field]
        down = rank < VERSIONS.index(since)
        if field in ONLY_DOWN and not down:
            continue
        source, goal = (field, extension) if down else (extension, field)
        for name, side in ((source, "from"), (goal, "to"), *((("$ref", "ref"), ("description", "said")) if field == "summary" else (("$ref", "ref"),) if place == _EXAMPLE else ())):
            # most nodes hold no such name at all: their pointers meet no pattern
            at = F.when(F.contains(p, F.lit(f"/{name}")), _under(p, f"{place}/{name.replace('$', chr(92) + '$')}")).otherwise("")
            hit = F.struct(F.lit(field).alias("field"), F.regexp_replace(at, r"/[^/]*$", "").alias("parent"), F.lit(side).alias("side"), F.lit(goal).alias("goal"), F.lit(down).alias("down"), F.length(at).alias("length"))
            found.append(F.when(at != "", hit))
    # the patterns are tried once a node: what is marked is read for the places, their nodes and all others
    marked = written(rows.select(key, "pointer", "value", F.array_compact(F.array(*found)).alias("__hits")), "marked")
    each = marked.where(F.size("__hits") > 0).select(key, "pointer", "value", F.explode("__hits").alias("h"))
    has = lambda side: F.max(F.col("h.side") == side)
    places = each.groupBy(key, "h.field", "h.parent").agg(has("from").alias("source"), has("to").alias("goal"), has("ref").alias("ref"), has("said").alias("said"), F.first("h.down").alias("down"))
    moves = places.where("source AND (down OR NOT goal) AND NOT (ref AND NOT said)").select(key, "field", "parent", F.lit(True).alias("moves"))
    joined = each.withColumns({"field": F.col("h.field"), "parent": F.col("h.parent")}).join(moves, [key, "field", "parent"], "left")
    renames = F.when(F.col("moves") & (F.col("h.side") == "from"), F.struct(F.col("h.length").alias("length"), F.col("parent").alias("parent"), F.col("h.goal").alias("goal")))
    # a node has a handful of places at most: the longest is renamed first, so that the lengths of the others stay true
    one = joined.groupBy(key, "pointer", "value").agg(F.sort_array(F.collect_list(renames), False).alias("renames"), F.max(F.coalesce(F.col("moves") & (F.col("h.side") == "to"), F.lit(False))).alias("gone"))
    new = F.aggregate("renames", p, lambda s, r: F.concat(r["parent"], F.lit("/"), r["goal"], F.substr(s, r["length"] + 1)))
    renamed = written(one.where("NOT gone").select(key, new.alias("pointer"), "value"), "renamed")
    return marked.where(F.size("__hits") == 0).select(key, "pointer", "value").unionByName(renamed)


def path_items(rows: DataFrame, key: str, version: str) -> DataFrame:
    """Nodes with the query operation and additional operations of path items where a version has them: under an extension below 3.2, native from it on. What is native already stays."""
    p = F.col("pointer")
    extension = "x-oai-additionalOperations"
    if VERSIONS.index(version) < VERSIONS.index("3.2"):
        new = F.regexp_replace(F.regexp_replace(p, _PATH + r"/query(/|$)", rf"$1/{extension}/query$2"), _PATH + r"/additionalOperations(/|$)", rf"$1/{extension}$2")
    else:
        new = F.regexp_replace(F.regexp_replace(p, _PATH + rf"/{extension}/query(/|$)", "$1/query$2"), _PATH + rf"/{extension}(/|$)", "$1/additionalOperations$2")
    may = F.contains(p, F.lit("/query")) | F.contains(p, F.lit("dditionalOperations"))
    moved = rows.withColumn("__new", F.when(may, new).otherwise(p)).withColumns({"__root": F.when(may, F.regexp_extract("__new", _PATH + rf"/(?:query|additionalOperations/[^/]+|{extension}/[^/]+)(?=/|$)", 0)).otherwise("")})
    stay = moved.where("__root <> '' AND __new = pointer").select(key, "__root").distinct()
    clash = moved.where("__root <> '' AND __new <> pointer").join(stay, [key, "__root"], "left_anti")
    return moved.where("__root = '' OR __new = pointer").unionByName(clash).select(key, F.col("__new").alias("pointer"), "value")


def examples_as_values(rows: DataFrame, key: str) -> DataFrame:
    """Nodes with an example's ``dataValue`` as its ``value`` too, where it has no value and is no reference."""
    at = _under(F.col("pointer"), f"{_EXAMPLE}/dataValue")
    found = rows.withColumn("__at", at).where("__at <> ''").withColumn("__p", F.regexp_replace("__at", r"/[^/]*$", ""))
    other = rows.withColumn("__at", _under(F.col("pointer"), rf"{_EXAMPLE}/(?:value|\$ref)")).where("__at <> ''").select(key, F.regexp_replace("__at", r"/[^/]*$", "").alias("__p")).distinct()
    more = found.join(other, [key, "__p"], "left_anti").select(key, F.concat("__p", F.lit("/value"), F.substr("pointer", F.length("__at") + 1)).alias("pointer"), "value")
    return rows.unionByName(more)


def finalize(rows: DataFrame, key: str, version: str) -> DataFrame:
    """Nodes of documents for a version: what it lacks is dropped or held as an extension, what it has is native again, ``openapi`` says the version.

    Fields are known by their place in a document's structure, so example payloads, extensions and schemas may hold the same names; schemas are left to ``schema_versions``. Operations that an extension holds
    move as they are.
    """
    rank = VERSIONS.index(version)
    for since, pattern in DROPPED:
        if rank < VERSIONS.index(since):
            rows = rows.where(~F.col("pointer").rlike(pattern))
    if rank < VERSIONS.index("3.2"):
        rows = examples_as_values(written(rows, "nodes"), key)
        location = F.col("pointer").rlike(rf"^{_PARAMETER}/in$") & (F.col("value") == '"querystring"')
        rows = rows.withColumn("value", F.when(location, F.lit('"query"')).otherwise(F.col("value")))
    rows = path_items(move_extensions(rows, key, version), key, version)
    said = {"3.0": "3.0.0", "3.1": "3.1.0", "3.2": "3.2.0"}.get(version, version)
    head = rows.select(key).distinct().select(key, F.lit("/openapi").alias("pointer"), F.lit(f'"{said}"').alias("value"))
    return rows.where("pointer <> '/openapi'").unionByName(head)


def tag_definitions(rows: DataFrame, key: str, version: str) -> DataFrame:
    """Nodes with tags as a version has them."""
    return rows if VERSIONS.index(version) >= VERSIONS.index("3.2") else rows.where(~F.col("pointer").rlike(DROPPED[3][1]))


#: What overlays below a version lack, by the pointer of its root: the version, the pattern, the code and what is said.
OVERLAY_LACKS = (
    ("1.1", r"^/actions/\d+/copy$", "OVERLAY_COPY_UNSUPPORTED", "Overlay 1.0 does not support the copy action; the action was omitted."),
    ("1.2", r"^/\$self$", "OVERLAY_SELF_UNSUPPORTED", "Overlay 1.0 and 1.1 do not support $self; the field was omitted."),
    ("1.2", r"^/targetFormat$", "OVERLAY_TARGET_FORMAT_UNSUPPORTED", "Overlay 1.0 and 1.1 do not support targetFormat; the field was omitted."),
)
REUSABLE_INLINED = ("OVERLAY_REUSABLE_ACTION_INLINED", "Overlay 1.0 and 1.1 do not support reusable actions; $ref actions were inlined and components were omitted.")


def overlay_versions(rows: DataFrame, key: str, version: str) -> tuple[DataFrame, DataFrame]:
    """Nodes of overlays for 1.0, 1.1 or 1.2, and a warning for each thing that a version drops: ``copy`` (from 1.1), ``$self``, the target's format and reusable actions (from 1.2).

    An action that is a reference to a reusable one takes that one's fields, its own go before them; one that refers to none keeps its own.
    """
    found = None
    for since, pattern, code, said in OVERLAY_LACKS:
        if version < since:
            hit = rows_where(rows, F.col("pointer").rlike(pattern), code, "warning", F.col(key), F.lit(said))
            found = hit if found is None else found.unionByName(hit)
            rows = rows.where(~F.col("pointer").rlike(pattern))
    if version < "1.2":
        p = F.col("pointer")
        reusable, reference = r"^/components/actions(/|$)", r"^(/actions/\d+)/\$ref$"
        uses = rows.where(p.rlike(reusable) | p.rlike(reference)).select(key).distinct()
        found = found.unionByName(rows_where(uses, F.lit(True), REUSABLE_INLINED[0], "warning", F.col(key), F.lit(REUSABLE_INLINED[1])))
        field = r"^/components/actions/([^/]+)/fields(/.+)$"
        bodies = rows.where(p.rlike(field)).select(key, F.regexp_extract(p, field, 1).alias("name"), F.regexp_extract(p, field, 2).alias("below"), "value")
        asked = rows.where(p.rlike(reference)).select(key, F.regexp_extract(p, reference, 1).alias("at"), F.regexp_extract("value", r'^"#/components/actions/([^"]+)"$', 1).alias("name"))
        own = rows.where(~p.rlike(reference) & ~p.rlike(reusable))
        top = F.regexp_extract("below", "^(/[^/]+)", 1)
        given = own.where(p.rlike(r"^/actions/\d+/")).select(key, F.regexp_extract(p, r"^(/actions/\d+)", 1).alias("at"), F.regexp_extract(p, r"^/actions/\d+(/[^/]+)", 1).alias("top")).distinct()
        taken = asked.join(bodies, [key, "name"]).withColumn("top", top).join(given, [key, "at", "top"], "left_anti")
        rows = own.unionByName(taken.select(key, F.concat("at", "below").alias("pointer"), "value"))
    empty = rows_where(rows, F.lit(False), "", "", F.col(key), F.lit(""))
    return rows, empty if found is None else found


def children(rows: DataFrame, key: str, place: Sequence[str]) -> DataFrame:
    """The names directly below a pointer: ``(key, name)``, once each."""
    prefix = "/" + "/".join(place) + "/"
    below = rows.where(F.col("pointer").startswith(prefix))
    return below.select(key, F.replace(F.replace(F.substring_index(F.substr("pointer", F.lit(len(prefix) + 1)), "/", 1), F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")).alias("name")).distinct()
