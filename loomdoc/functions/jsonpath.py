"""A JSONPath subset over VARIANT columns: the path is parsed on the driver, each segment is one DataFrame step.

Matches keep document order and duplicates. Members are visited in the order VARIANT stores them (by key). A missing member is no match; a JSON null is one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import takewhile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdoc.operators.records import computed_once
from loomdoc.sources.shared import written

_NAME = re.compile(r"[A-Za-z_][\w-]*")
_INTEGER = re.compile(r"-?\d+")
_PREDICATE = re.compile(r"""@(?:\.(\w+)|\[['"]([^'"]+)['"]\])\s*(==|!=)\s*(.+)""")

#: Levels that ``..`` goes down in its first pass, and in each later one.
LEVELS, LATER_LEVELS = 16, 32


@dataclass(frozen=True)
class Segment:
    """One of child, wildcard, index, slice, filter, descendant; ``value`` is its name, index, bounds or predicate."""

    kind: str
    value: object = None


class JsonPathError(ValueError):
    pass


def parse_json_path(path: str) -> list[Segment]:
    """Segments of a path; raises JsonPathError where it can't be read."""
    path = path.strip()
    if not path.startswith("$"):
        raise JsonPathError(f"a path starts with $: {path}")
    found, at = [], 1
    while at < len(path):
        if path.startswith("..", at):
            at += 2
            if path.startswith("*", at):
                found.append(Segment("descendant"))
                at += 1
            elif path.startswith("[", at):
                segment, at = _bracket(path, at)
                found.append(Segment("descendant", segment.value if segment.kind == "child" else None) if segment.kind in ("child", "wildcard") else segment)
            elif name := _NAME.match(path, at):
                found.append(Segment("descendant", name[0]))
                at = name.end()
            else:
                raise JsonPathError(f"a name, * or [ follows ..: {path}")
        elif path[at] == ".":
            at += 1
            if path.startswith("*", at):
                found.append(Segment("wildcard"))
                at += 1
            elif name := _NAME.match(path, at):
                found.append(Segment("child", name[0]))
                at = name.end()
            else:
                raise JsonPathError(f"a name or * follows a dot: {path}")
        elif path[at] == "[":
            segment, at = _bracket(path, at)
            found.append(segment)
        else:
            raise JsonPathError(f"unexpected {path[at]!r} at {at}: {path}")
    return found


def _bracket(path: str, start: int) -> tuple[Segment, int]:
    quoted = re.compile(r"""\[\s*(['"])((?:\\.|(?!\1).)*)\1\s*\]""", re.S).match(path, start)
    if quoted:
        return Segment("child", re.sub(r"\\(.)", r"\1", quoted[2], flags=re.S)), quoted.end()
    end = path.find("]", start)
    text = path[start + 1 : end].strip()
    if end < 0 or text[:1] in ("'", '"'):
        raise JsonPathError(f"a bracket or a quoted name isn't closed: {path}")
    if text == "*":
        return Segment("wildcard"), end + 1
    if text.startswith("?"):
        # a name in brackets belongs to the filter
        inner = re.compile(r"""\[\s*\?((?:[^\]\['"]|'[^']*'|"[^"]*"|\[[^\]]*\])*)\]""").match(path, start)
        raw, end = (inner[1], inner.end()) if inner else (text[1:], end + 1)
        return Segment("filter", re.sub(r"^\(|\)$", "", raw.strip()).strip()), end
    if ":" in text:
        bounds = [b.strip() for b in text.split(":")]
        if len(bounds) != 2 or any(b and not _INTEGER.fullmatch(b) for b in bounds):
            raise JsonPathError(f"a slice has two whole numbers at most: {path}")
        return Segment("slice", tuple(int(b) if b else None for b in bounds)), end + 1
    if _INTEGER.fullmatch(text):
        return Segment("index", int(text)), end + 1
    raise JsonPathError(f"a bracket can't be read: {path}")


def filter_literal(raw: str) -> object:
    """true, false, null, a quoted text or a number; anything else is text as it stands."""
    raw = raw.strip()
    if raw in ("true", "false", "null"):
        return {"true": True, "false": False, "null": None}[raw]
    if len(raw) >= 2 and raw[0] == raw[-1] and raw[0] in "'\"":
        return raw[1:-1]
    if re.fullmatch(r"-?\d+(\.\d+)?", raw):
        return float(raw)
    return raw


def _children(nodes: DataFrame) -> DataFrame:
    """One row for each member or item: ``ord`` grows by its position."""
    keep = [c for c in nodes.columns if c not in ("ord", "value", "key")]
    found = nodes.drop("key").lateralJoin(nodes.sparkSession.tvf.variant_explode(F.col("value").outer()).toDF("__pos", "key", "__value"))
    return found.select(*keep, F.concat("ord", F.array("__pos")).alias("ord"), "key", F.col("__value").alias("value"))


def _is_plain(segment: Segment) -> bool:
    return segment.kind == "child" and "'" not in segment.value and "\\" not in segment.value or segment.kind == "index" and segment.value >= 0


def _place(nodes: DataFrame, segments: list[Segment]) -> DataFrame:
    """The one node at a place, read by its whole path at once: a JSON null is a node, a missing one is none."""
    path = "$" + "".join(f"['{s.value}']" if s.kind == "child" else f"[{s.value}]" for s in segments)
    at = F.array(*[F.lit(s.value if s.kind == "index" else 0) for s in segments])
    key = segments[-1].value if segments[-1].kind == "child" else None
    found = computed_once(nodes, __found=F.try_variant_get("value", path, "variant")).where("__found IS NOT NULL")
    return found.withColumns({"ord": F.concat("ord", at), "key": F.lit(key).cast("string"), "value": F.col("__found")}).drop("__found")


def _matches(value, predicate: str):
    """The predicate as a Column: ``@`` keeps non-null values, ``@.name == / != literal`` compares value and type, anything else is false."""
    if predicate == "@":
        return ~F.is_variant_null(value)
    found = _PREDICATE.fullmatch(predicate)
    if not found:
        return F.lit(False)
    name, op, raw = found[1] or found[2], found[3], found[4]
    literal = filter_literal(raw)
    member = F.try_variant_get(value, f"$['{name}']", "variant")
    kind = F.schema_of_variant(member)
    if literal is None:
        same = F.coalesce(F.is_variant_null(member), F.lit(False))
    elif isinstance(literal, bool):
        same = (kind == "BOOLEAN") & (F.try_variant_get(member, "$", "boolean") == literal)
    elif isinstance(literal, float):
        same = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)") & (F.try_variant_get(member, "$", "double") == literal)
    else:
        same = (kind == "STRING") & (F.try_variant_get(member, "$", "string") == literal)
    same = F.coalesce(same, F.lit(False))
    return same if op == "==" else ~same


def query_json_path(docs: DataFrame, path: str, doc_col: str = "doc") -> DataFrame:
    """Matches of ``path`` in the VARIANT column: the other columns of ``docs``, ``ord`` (the place in document order), ``key`` and ``value``. Null documents match nothing."""
    keep = [c for c in docs.columns if c != doc_col]
    segments = parse_json_path(path)
    # a place in a null document is none; anywhere else a document is made once, before it is asked whether it is null
    given = docs if segments and _is_plain(segments[0]) else computed_once(docs, **{doc_col: F.col(doc_col)}).where(F.col(doc_col).isNotNull())
    nodes = given.select(*keep, F.array().cast("array<int>").alias("ord"), F.lit(None).cast("string").alias("key"), F.col(doc_col).alias("value"))
    while segments:
        if plain := list(takewhile(_is_plain, segments)):
            nodes, segments = _place(nodes, plain), segments[len(plain) :]
            continue
        segment, segments = segments[0], segments[1:]
        kind = F.schema_of_variant("value")
        is_object, is_array = kind.startswith("OBJECT"), kind.startswith("ARRAY")
        if segment.kind == "child":
            nodes = _children(nodes.where(is_object)).where(F.col("key") == segment.value)
        elif segment.kind == "wildcard":
            nodes = _children(nodes)
        elif segment.kind == "filter":
            nodes = _children(nodes).where(_matches(F.col("value"), segment.value))
        elif segment.kind in ("index", "slice"):
            size = F.size(F.try_variant_get("value", "$", "array<variant>"))
            items = _children(nodes.where(is_array).withColumn("__n", size))
            at = F.element_at("ord", -1)
            if segment.kind == "index":
                wanted = at == (segment.value if segment.value >= 0 else F.col("__n") + segment.value)
            else:
                low, high = (F.lit(b) if b is None or b >= 0 else F.greatest(F.lit(0), F.col("__n") + b) for b in segment.value)
                wanted = (at >= F.coalesce(low, F.lit(0))) & (at < F.coalesce(high, F.col("__n")))
            nodes = items.where(wanted).drop("__n")
        else:
            nodes = _descendants(nodes, keep, segment.value)
    return nodes


def _level(rows: str, keep: list[str], wanted: str) -> str:
    """SQL for the members of the values of ``rows``. What is wanted is held in ``__hits`` and goes on with a value's first member, or with the row itself, without a value, where there is none."""
    held, at = "CASE WHEN coalesce(e.pos, 0) = 0 THEN r.__hits END", "concat(r.__at, array(e.pos))"
    hits = f"CASE WHEN {wanted} THEN concat(coalesce({held}, array()), array(struct({at} AS at, e.key, e.value, false AS open))) ELSE {held} END"
    kept = "".join(f"r.`{c}`, " for c in keep).replace("{", "{{").replace("}", "}}")  # braces name tables in the text
    return f"(SELECT {kept}r.ord, if(e.pos IS NULL, r.__at, {at}) AS __at, e.value, {hits} AS __hits FROM {rows} AS r, LATERAL variant_explode_outer(r.value) AS e WHERE e.pos IS NOT NULL OR r.__hits IS NOT NULL)"


def _descendants(nodes: DataFrame, keep: list[str], name: str | None = None) -> DataFrame:
    """All nodes below, or those of a name, each once for every node that it is below of (sort by ``ord`` for pre-order). Each pass is written once.

    The levels of a pass are one SQL text, as a plan that is made by calls is analysed anew at each. A member that ``variant_explode`` takes out is a cut of the document's bytes beside all names of it; what is written is built
    anew with its own names, but for a first member of first members, of which a pass has one a document.
    """
    spark, levels, found = nodes.sparkSession, LEVELS, None
    wanted = "e.pos IS NOT NULL" if name is None else "e.key = :name"
    item = "struct<at:array<int>,key:string,value:variant,open:boolean>"
    going = nodes.select(*keep, "ord", "value")
    own = F.when(F.col("value").isNotNull(), F.array(F.struct(F.col("__at").alias("at"), F.lit(None).cast("string").alias("key"), "value", F.lit(True).alias("open"))))
    each = F.explode(F.concat(*[F.coalesce(c, F.array().cast(f"array<{item}>")) for c in (F.col("__hits"), own)])).alias("__e")
    value = F.when(F.col("__e.open") & (F.array_max("__e.at") == 0), F.col("__e.value")).otherwise(F.try_variant_get("__e.value", "$", "variant"))
    while True:
        query = f"(SELECT *, CAST(array() AS array<int>) AS __at, CAST(NULL AS array<{item}>) AS __hits FROM {{going}})"
        for _ in range(levels):
            query = _level(query, keep, wanted)
        walk = spark.sql(f"SELECT * FROM {query}", args={"name": name}, going=going).select(*keep, "ord", each)
        passed = written(walk.select(*keep, F.concat("ord", "__e.at").alias("ord"), "__e.key", value.alias("value"), F.col("__e.open").alias("__open")), "walk")
        done = passed.where("NOT __open").select(*keep, "ord", "key", "value")
        found = done if found is None else found.unionByName(done)
        going, levels = passed.where("__open").select(*keep, "ord", "value"), LATER_LEVELS
        if going.isEmpty():
            return found
