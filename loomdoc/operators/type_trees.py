"""Type expressions as trees of rows, and their JSON Schemas folded bottom-up.

A text is cut into token rows; running sums over a text's tokens give each one its bracket depth, the bracket that holds it, and there its member, its alternative of a
union and its part of an intersection. These numbers are the tree: no parser state, and a text of any nesting takes the same windows.
Schemas follow level by level from the deepest bracket: tokens become operands, these parts, alternatives and members, and a bracket's members stand at its opener one level up.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdoc.operators.chains import TYPE_NAMES
from loomdoc.sources.shared import written

_TOKEN = r"""("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`|/\*[\s\S]*?\*/|//[^\n]*|=>|\.\.\.|[\p{L}_$][\p{L}\p{N}_$.]*|\d+(?:\.\d+)?|\n\s*|[^\s\w])"""
_OPEN, _CLOSE = ("{", "[", "(", "<"), ("}", "]", ")", ">")
#: A line's end closes no member of an object behind or before one of these.
_GOES_ON = ("|", "&", ":", ",", ";", "{", "[", "(", "<", "=>", "?", "extends", "keyof", "readonly")
_CONTINUES = ("|", "&", "}", "]", ")", ">", "=>", ":", "?", ",", ";", "<", "extends")

#: Names that stand for their argument, lists, sets and maps, and words before a type.
_UNWRAPPED, _LISTS, _SETS, _MAPS, _BEFORE = ("Promise", "Awaited", "Readonly", "InstanceType", "NoInfer"), ("Array", "ReadonlyArray"), ("Set", "ReadonlySet"), ("Map", "ReadonlyMap", "Record"), ("keyof", "readonly", "unique")

#: How many levels are folded before the rows are written.
WRITTEN_LEVELS = 4


def tokens(types: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``(key, pos, token, depth, opener, kind, member, alternative, part, named)`` of type texts; null and empty texts have no rows.

    ``opener`` is the position of the bracket that holds a token (-1 outside of all) and ``kind`` its character; separators of members, unions and intersections
    are counted and left out, as are closing brackets and comments. ``named`` says that a token stands before the colon of its member.
    """
    t = F.col("token")
    cut = types.select(F.col(key).alias("key"), F.posexplode(F.regexp_extract_all(F.col(text), F.lit(_TOKEN), F.lit(1))).alias("pos", "token")).where(~t.rlike(r"^/[/*]"))
    whole = Window.partitionBy("key").orderBy("pos")
    line = t.startswith("\n")
    ends = line & ~F.lag("token", 1, "{").over(whole).isin(*_GOES_ON) & ~F.lead("token", 1, "}").over(whole).isin(*_CONTINUES)
    cut = cut.withColumn("token", F.when(line, F.when(ends, "\n")).otherwise(t)).where("token IS NOT NULL")
    step = F.when(t.isin(*_OPEN), 1).when(t.isin(*_CLOSE), -1).otherwise(0)
    deep = cut.withColumn("after", F.sum(step).over(whole)).withColumn("depth", F.col("after") - F.when(t.isin(*_OPEN), 1).otherwise(0))
    # a token is held by the last bracket that was opened one level up: an opener stands once as a token and once as what opens the level below
    twice = F.when(t.isin(*_OPEN), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    both = deep.withColumn("below", F.explode(twice)).select("key", "pos", "token", (F.col("depth") + F.col("below")).alias("depth"), (F.col("below") == 1).alias("opens"))
    held = Window.partitionBy("key", "depth").orderBy("pos")
    placed = both.withColumn("h", F.last(F.when(F.col("opens"), F.struct("pos", "token")), ignorenulls=True).over(held)).where("NOT opens")
    placed = placed.select("key", "pos", "token", "depth", F.coalesce("h.pos", F.lit(-1)).alias("opener"), F.coalesce("h.token", F.lit("")).alias("kind")).where(~t.isin(*_CLOSE))
    group = Window.partitionBy("key", "opener").orderBy("pos")
    separator = t.isin(",", ";") | (t == "\n")
    member = placed.withColumn("member", F.count_if(separator).over(group)).where(~separator)
    own = Window.partitionBy("key", "opener", "member")
    colons = F.count_if(t == ":").over(own.orderBy("pos"))
    named = F.when(F.col("kind") == "{", F.col("colons") == 0).when(F.col("kind") == "[", (F.col("colons") == 0) & (F.max("colons").over(own) > 0)).otherwise(False)
    phased = member.withColumn("colons", colons).withColumn("named", named)
    # what follows an arrow belongs to the function
    splits = ~F.col("named") & (F.col("arrows") == 0)
    phased = phased.withColumn("arrows", F.count_if(t == "=>").over(own.orderBy("pos"))).withColumn("alternative", F.count_if((t == "|") & splits).over(own.orderBy("pos")))
    part = F.count_if((t == "&") & splits).over(Window.partitionBy("key", "opener", "member", "alternative").orderBy("pos"))
    first_colon = (t == ":") & (F.col("colons") == 1) & F.col("kind").isin("{", "[")
    out = phased.withColumn("part", part).where(~(t.isin("|", "&") & ~F.col("named")) & ~first_colon)
    return out.select(F.col("key").alias(key), "pos", "token", "depth", "opener", "kind", "member", "alternative", "part", "named")


def type_tree(types: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``(key, node, parent, ord, kind, text)``: every operand of a type text, by the position of its first token; its parent is the operand whose bracket holds it (null at the top).

    ``ord`` is (member, alternative, part) there; ``kind`` is name, generic, literal, object, tuple, group, function, or operator for ``keyof`` and the like; ``text`` is the first token.
    """
    rows = written(tokens(types, key, text), "tokens").where("NOT named")
    operand = [key, "opener", "member", "alternative", "part"]
    items = F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"])
    found = rows.groupBy(*operand).agg(F.min("pos").alias("node"), items.alias("items"), F.collect_list("pos").alias("own"))
    first, second = F.col("items")[0], F.try_element_at("items", F.lit(2))
    kind = (
        F.when(F.array_contains("items", "=>"), "function").when(first == "{", "object").when(first == "[", "tuple").when(first == "(", "group").when(first.isin(*_BEFORE), "operator")
        .when(first.rlike("""^["'`0-9]""") | first.isin("true", "false"), "literal").when(second == "<", "generic").otherwise("name")
    )
    nodes = found.select(key, "node", "opener", F.struct("member", "alternative", "part").alias("ord"), kind.alias("kind"), first.alias("text"), "own")
    owner = nodes.select(key, F.explode("own").alias("opener"), F.col("node").alias("parent"))
    # a bracket in the name of a member (a computed name, an index signature) belongs to no operand
    return nodes.drop("own").join(owner, [key, "opener"], "left").select(key, "node", "parent", "ord", "kind", "text")


def _obj(**fields: Column | str) -> Column:
    """A JSON object of JSON texts, in the given order; null ones are left out."""
    parts = [F.concat(F.lit(f'"{k}":'), F.lit(v) if isinstance(v, str) else v) for k, v in fields.items()]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("}"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _flagged(schema: Column, name: str) -> Column:
    """A schema's text with a flag that is true."""
    return _let(schema, lambda s: F.when(F.get_json_object(s, f"$.{name}") == "true", s).when(s == "{}", f'{{"{name}":true}}').otherwise(F.concat(F.substr(s, F.lit(1), F.length(s) - 1), F.lit(f',"{name}":true}}'))))


def _text(value: Column) -> Column:
    """A text as JSON."""
    return _let(F.to_json(F.array(value)), lambda t: F.substr(t, F.lit(2), F.length(t) - 2))


def _bare(token: Column) -> Column:
    """A quoted token's text."""
    return F.regexp_replace(F.regexp_replace(token, r"""^["'`]|["'`]$""", ""), r"\\(.)", "$1")


def _list(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(values, ","), F.lit("]"))


def _properties(names: Column, values: Column) -> Column:
    """The JSON object of names and values (later ones count, first places stay)."""

    def listed(both: Column) -> Column:
        names = F.array_distinct(F.transform(both, lambda p: p["n"]))
        pairs = F.transform(names, lambda n: F.concat(_text(n), F.lit(":"), F.try_element_at(F.filter(both, lambda p: p["n"] == n), F.lit(-1))["v"]))
        return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))

    return _let(F.arrays_zip(names.alias("n"), values.alias("v")), listed)


def _object(members: Column) -> Column:
    """An object literal's schema: properties, which are required, and the value of an index signature."""
    own = F.filter(members, lambda m: m["name"].isNotNull())
    index = F.try_element_at(F.filter(members, lambda m: m["index"]), F.lit(-1))["schema"]
    schemas = F.transform(own, lambda m: F.when(m["readonly"], _flagged(m["schema"], "readOnly")).otherwise(m["schema"]))
    required = F.transform(F.filter(own, lambda m: ~m["optional"]), lambda m: _text(m["name"]))
    names = F.transform(own, lambda m: m["name"])
    return _obj(type='"object"', properties=_properties(names, schemas), required=F.when(F.size(required) > 0, _list(required)), additionalProperties=index)


def _tuple(members: Column) -> Column:
    rest = F.try_element_at(F.filter(members, lambda m: m["rest"]), F.lit(1))
    fixed = F.filter(members, lambda m: ~m["rest"] & (rest.isNull() | (m["ord"] < rest["ord"])))
    least = F.size(F.filter(fixed, lambda m: ~m["optional"])).cast("string")
    prefix = _list(F.transform(fixed, lambda m: m["schema"]))
    inner = F.coalesce(F.when(F.get_json_object(rest["schema"], "$.type") == "array", F.get_json_object(rest["schema"], "$.items")), rest["schema"])
    opened = _obj(type='"array"', prefixItems=F.when(F.size(fixed) > 0, prefix), items=inner, minItems=least)
    return F.when(rest.isNotNull(), opened).otherwise(_obj(type='"array"', prefixItems=prefix, items="false", minItems=least, maxItems=F.size(fixed).cast("string")))


def _map(members: Column) -> Column:
    key, value = F.get(members, F.lit(0))["schema"], F.try_element_at(members, F.lit(2))["schema"]
    get = lambda n: F.get_json_object(key, f"$.{n}")
    trivial = (get("type") == "string") & get("enum").isNull() & get("pattern").isNull() & get("format").isNull()
    names = F.when(get("type").isNotNull() & ~F.coalesce(trivial, F.lit(False)), key)
    return F.when(F.size(members) > 1, _obj(type='"object"', additionalProperties=value, propertyNames=names)).otherwise('{"type":"object","additionalProperties":true}')


def _template(token: Column) -> Column:
    """A template's schema: one text without open parts, a pattern where the open ones are texts and numbers, else a text."""
    body = F.regexp_replace(token, "^`|`$", "")
    fixed = F.regexp_replace(body, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    pattern = F.replace(F.replace(fixed, F.lit(r"\$\{string\}"), F.lit(".+")), F.lit(r"\$\{number\}"), F.lit(r"\d+"))
    return F.when(~body.contains("${"), _obj(type='"string"', enum=_list(F.array(_text(body))))).when(~pattern.contains(r"\$\{"), _obj(type='"string"', pattern=_text(F.concat(F.lit("^"), pattern, F.lit("$"))))).otherwise('{"type":"string"}')


def _named() -> Column:
    """The schemas of the fixed names."""
    made = {}
    for name, (kind, form, more) in TYPE_NAMES.items():
        made[name] = json.dumps(({"type": kind} if kind else {}) | ({"format": form} if form else {}) | (json.loads(more) if more else {}), separators=(",", ":"))
    return F.create_map(*[F.lit(x) for pair in made.items() for x in pair])


def _operand(items: Column) -> Column:
    """``(schema, literal, of, nullish)`` of an operand's tokens ``(pos, token, members)``."""
    before = F.size(F.filter(items, lambda x: x["token"].isin(*_BEFORE) & x["members"].isNull()))
    generic = lambda rest: F.coalesce(F.try_element_at(rest, F.lit(2))["token"] == "<", F.lit(False))
    behind = lambda rest: F.slice(rest, F.when(generic(rest), 3).otherwise(2), F.greatest(F.size(rest), F.lit(1)))

    def cut(rest: Column) -> Column:
        """A word, the members that it opens, its arguments and what stands behind it."""
        given = F.when(generic(rest), F.try_element_at(rest, F.lit(2))["members"])
        return F.struct(F.get(rest, F.lit(0))["token"].alias("word"), F.coalesce(F.get(rest, F.lit(0))["members"], F.array()).alias("own"), generic(rest).alias("generic"), given.alias("given"), behind(rest).alias("behind"))

    parts = _let(F.slice(items, before + 1, F.greatest(F.size(items), F.lit(1))), cut)
    return _let(F.struct(before.alias("before"), parts.alias("p")), lambda v: _read(items, v["before"], v["p"]))


def _read(items: Column, before: Column, parts: Column) -> Column:
    """An operand's schema, from its tokens, the number of words before its type, and that type's parts."""
    word, own, generic, given, behind = (parts[n] for n in ("word", "own", "generic", "given", "behind"))
    first = F.try_element_at(given, F.lit(1))["schema"]
    fixed = F.try_element_at(_named(), word)
    literal = F.when(word.rlike("""^["']"""), _text(_bare(word))).when(word.rlike("^[0-9]"), F.regexp_replace(word, r"\.0+$", "")).when(word.isin("true", "false"), word)
    kind = F.when(word.rlike("""^["']"""), '"string"').when(word.isin("true", "false"), '"boolean"').otherwise('"number"')
    basic = (
        F.when(word == "{", _object(own)).when(word == "[", _tuple(own)).when(word == "(", F.coalesce(F.try_element_at(own, F.lit(1))["schema"], F.lit('{"type":"object"}')))
        .when(literal.isNotNull(), _obj(type=kind, enum=_list(F.array(literal)))).when(word.startswith("`"), _template(word)).when(fixed.isNotNull() & ~generic, fixed)
        .when(word.isin(*_UNWRAPPED) & (first.isNotNull() | word.isin("Promise", "Awaited")), F.coalesce(first, F.lit("{}")))
        .when(word.isin(*_LISTS), F.when(first.isNotNull(), _obj(type='"array"', items=first)).otherwise('{"type":"array"}'))
        .when(word.isin(*_SETS), F.when(first.isNotNull(), _obj(type='"array"', items=first, uniqueItems="true")).otherwise('{"type":"array","uniqueItems":true}'))
        .when(word.isin(*_MAPS), F.when(generic, _map(given)).otherwise('{"type":"object","additionalProperties":true}'))
        .when(word.rlike(r"^[\p{L}_$]"), F.concat(F.lit('{"$ref":"#/components/schemas/'), word, F.lit('"}'))).otherwise('{"type":"object"}')
    )
    plain = F.lit('{"type":"object"}')

    def index(schema: Column, item: Column) -> Column:
        at = F.try_element_at(item["members"], F.lit(1))
        number, name = F.when(at["of"] == '"number"', at["literal"]), F.when(at["of"] == '"string"', at["literal"])
        prefix = F.from_json(F.get_json_object(schema, "$.prefixItems"), "array<string>")
        one = F.when(prefix.isNotNull(), F.try_element_at(prefix, number.try_cast("int") + 1)).when(F.get_json_object(schema, "$.items").startswith("{"), F.get_json_object(schema, "$.items"))
        field = F.try_element_at(F.from_json(F.get_json_object(schema, "$.properties"), "map<string,string>"), F.from_json(F.concat(F.lit("["), name, F.lit("]")), "array<string>")[0])
        return F.when(item["members"].isNull() | (F.size(item["members"]) == 0), _obj(type='"array"', items=schema)).otherwise(F.coalesce(F.when(number.isNotNull(), one), F.when(name.isNotNull(), field), plain))

    whole = F.aggregate(F.filter(behind, lambda x: x["token"] == "["), basic, index)

    def prefix(schema: Column, item: Column) -> Column:
        keys = F.map_keys(F.from_json(F.get_json_object(schema, "$.properties"), "map<string,string>"))
        listed = F.when(keys.isNotNull(), _obj(type='"string"', enum=_list(F.transform(keys, lambda k: _text(k))))).otherwise('{"type":"string"}')
        return F.when(item["token"] == "keyof", listed).when(item["token"] == "readonly", _flagged(schema, "readOnly")).otherwise(schema)

    schema = F.aggregate(F.reverse(F.slice(items, 1, before)), whole, prefix)
    alone = F.size(items) == 1
    function, conditional = F.exists(items, lambda x: x["token"] == "=>"), F.exists(items, lambda x: x["token"].isin("extends", "typeof", "infer"))
    grouped = F.when(alone & (word == "("), F.try_element_at(own, F.lit(1)))
    return F.struct(
        F.when(function, "{}").when(conditional, plain).otherwise(schema).alias("schema"), F.coalesce(F.when(alone, literal), grouped["literal"]).alias("literal"),
        F.coalesce(F.when(alone & literal.isNotNull(), kind), grouped["of"]).alias("of"), F.when(alone & word.isin("null", "undefined", "void"), word).alias("nullish"),
    )


def _intersection(parts: Column) -> Column:
    """Properties of all parts that are objects, later ones first; a brand's object leaves the type that it brands."""
    schemas = F.transform(parts, lambda p: p["schema"])
    kind = lambda s: F.get_json_object(s, "$.type")
    fields = lambda s: F.from_json(F.get_json_object(s, "$.properties"), "map<string,string>")
    simple = F.try_element_at(F.filter(schemas, lambda s: kind(s).isNotNull() & (kind(s) != "object")), F.lit(1))
    objects = F.filter(schemas, lambda s: (kind(s) == "object") & fields(s).isNotNull())
    brands = (F.size(objects) > 0) & F.forall(objects, lambda s: F.forall(F.map_keys(fields(s)), lambda k: k.isin("__brand", "brand")))
    entries = F.flatten(F.transform(objects, lambda s: F.map_entries(fields(s))))
    required = F.array_distinct(F.flatten(F.transform(objects, lambda s: F.coalesce(F.from_json(F.get_json_object(s, "$.required"), "array<string>"), F.array().cast("array<string>")))))
    merged = _obj(type='"object"', properties=_properties(F.transform(entries, lambda e: e["key"]), F.transform(entries, lambda e: e["value"])), required=F.when(F.size(required) > 0, _list(F.transform(required, lambda r: _text(r)))))
    none = F.lit(None).cast("string")
    return F.struct(F.when(simple.isNotNull() & brands, simple).otherwise(merged).alias("schema"), none.alias("literal"), none.alias("of"), none.alias("nullish"))


def _union(alternatives: Column) -> Column:
    """One list of values for literals of one type, a flag for null, and ``oneOf`` else; undefined and void are left out."""
    real = F.filter(alternatives, lambda a: a["nullish"].isNull())
    nullable = F.exists(alternatives, lambda a: a["nullish"] == "null")
    same = (F.size(real) > 0) & F.forall(real, lambda a: a["literal"].isNotNull() & (a["of"] == F.get(real, F.lit(0))["of"]))
    several = F.when(same, _obj(type=F.get(real, F.lit(0))["of"], enum=_list(F.transform(real, lambda a: a["literal"])))).when(F.size(real) == 1, F.get(real, F.lit(0))["schema"]).otherwise(_obj(oneOf=_list(F.transform(real, lambda a: a["schema"]))))
    none = F.lit(None).cast("string")
    return F.struct(_let(several, lambda s: F.when(nullable, _flagged(s, "nullable")).otherwise(s)).alias("schema"), none.alias("literal"), none.alias("of"), none.alias("nullish"))


def _fold(level: DataFrame, key: str) -> DataFrame:
    """The members of the brackets of one level, from its tokens with the members of the brackets they open: ``(key, opener, members)``."""
    # all groupings refine the key, so one exchange serves them all
    level = level.repartition(F.col(key))
    ordered = lambda name, *columns: F.array_sort(F.collect_list(F.struct(name, *columns)))
    token = F.struct("pos", "token", "members")
    names = F.transform(F.array_sort(F.collect_list(F.when(F.col("named"), token))), lambda x: x["token"])
    places = [key, "opener", "kind", "member"]
    mark = (F.col("token") == "?") & ~F.col("named")
    rest = (F.col("token") == "...") & ~F.col("named")
    operands = level.groupBy(*places, "alternative", "part").agg(
        F.array_sort(F.collect_list(F.when(~F.col("named") & ~mark & ~rest, token))).alias("items"), names.alias("names"), F.max(mark).alias("mark"), F.max(rest).alias("rest"),
    ).withColumn("o", F.when(F.size("items") > 0, _operand(F.col("items"))))
    flags = [F.flatten(F.collect_list("names")).alias("names"), F.max("mark").alias("mark"), F.max("rest").alias("rest")]
    inner = lambda name: F.transform(F.filter(name, lambda x: x["o"].isNotNull()), lambda x: x["o"])
    parts = operands.groupBy(*places, "alternative").agg(ordered("part", "o").alias("parts"), *flags).withColumn("p", inner("parts"))
    parts = parts.withColumn("o", F.when(F.size("p") == 1, F.get("p", F.lit(0))).when(F.size("p") > 1, _intersection(F.col("p"))))
    members = parts.groupBy(*places).agg(ordered("alternative", "o").alias("alternatives"), *flags).withColumn("a", inner("alternatives"))
    lost = F.struct(F.lit('{"type":"object"}').alias("schema"), *[F.lit(None).cast("string").alias(n) for n in ("literal", "of", "nullish")])
    members = members.withColumn("o", F.when(F.size("a") == 1, F.get("a", F.lit(0))).when(F.size("a") > 1, _union(F.col("a"))).otherwise(lost))
    n = F.filter(F.col("names"), lambda x: ~x.isin("?"))
    readonly = (F.size(n) > 1) & (F.get(n, F.lit(0)) == "readonly")
    word = F.when(readonly, F.get(n, F.lit(1))).otherwise(F.try_element_at(n, F.lit(1)))
    index = (F.col("kind") == "{") & (word == "[")
    name = F.when((F.col("kind") == "{") & ~F.array_contains("names", "(") & ~F.array_contains("names", "<") & word.rlike(r"""^["'\p{L}_$]"""), _bare(word))
    optional = F.array_contains("names", "?") | F.col("mark")
    made = F.struct(F.col("member").alias("ord"), name.alias("name"), F.coalesce(optional, F.lit(False)).alias("optional"), readonly.alias("readonly"), F.coalesce(index, F.lit(False)).alias("index"), F.coalesce("rest", F.lit(False)).alias("rest"), "o.*")
    return members.select(key, "opener", made.alias("m")).groupBy(key, "opener").agg(F.array_sort(F.collect_list("m")).alias("members"))


def type_schemas(types: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``(key, schema)``: the JSON Schema of each type text, as JSON text; ``{"type":"object"}`` for null and empty texts. Rows have distinct keys.

    Names that are nothing else are references. Functions come to ``{}``; conditional types and queries, which need a compiler, to ``{"type":"object"}``.
    """
    rows = written(tokens(types, key, text), "tokens")
    deepest = rows.agg(F.max("depth")).first()[0]
    members = None
    empty = "array<struct<ord:bigint,name:string,optional:boolean,readonly:boolean,index:boolean,rest:boolean,schema:string,literal:string,of:string,nullish:string>>"
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        level = rows.where(F.col("depth") == depth)
        if members is None:
            level = level.withColumn("members", F.lit(None).cast(empty))
        else:
            level = level.join(members.withColumnRenamed("opener", "pos"), [key, "pos"], "left")
        members = _fold(level, key)
        if depth and depth % WRITTEN_LEVELS == 0:
            members = written(members, "members")
    whole = types.select(F.col(key))
    if members is None:
        return whole.withColumn("schema", F.lit('{"type":"object"}'))
    return whole.join(members.where("opener = -1").select(key, F.get("members", F.lit(0))["schema"].alias("schema")), key, "left").withColumn("schema", F.coalesce("schema", F.lit('{"type":"object"}')))
