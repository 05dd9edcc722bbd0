"""Chains of schema methods as rows: each call is ``(key, ord, type, method, arg)``, its effect is rows of attributes, and of an attribute's rows the last in the chain counts.

``type`` is a JSON type, or ``tuple`` for a list with fixed items. ``arg`` is text as it stands in the call (a number, a text, a list between commas or JSON). Values of attributes are text too: numbers and flags as they are written in JSON, texts bare.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdoc.functions import registries
from loomdoc.functions.text import escape_regex
from loomdoc.sources.shared import written
from loomdoc.sources.tables import spread

#: What a format method comes to; formats that are none of these are registered ones or come to a pattern.
FORMATS = {
    **{f: f for f in ("email", "hostname", "uuid", "date", "time", "duration", "ipv4", "ipv6", "uri", "int32", "int64", "float", "double")},
    "uuidv4": "uuid", "uuidv6": "uuid", "uuidv7": "uuid", "guid": "uuid", "url": "uri", "httpUrl": "uri", "datetime": "date-time", "iso.datetime": "date-time", "iso.date": "date",
    "iso.time": "time", "iso.duration": "duration", "cidrv4": "ipv4-cidr", "cidrv6": "ipv6-cidr",
}
ENCODINGS = {"base64": "base64", "base64url": "base64url", "byte": "base64"}
PATTERNS = {
    "cuid": r"^c[^\s-]{8,}$", "cuid2": r"^[0-9a-z]+$", "ulid": r"^[0-9A-HJKMNP-TV-Z]{26}$", "nanoid": r"^[A-Za-z0-9_-]{21}$", "jwt": r"^[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+$", "hex": r"^[0-9a-fA-F]+$",
    "e164": r"^\+[1-9]\d{1,14}$", "xid": r"^[0-9a-v]{20}$", "ksuid": r"^[0-9A-Za-z]{27}$",
}
EITHER = {"ip": ("ipv4", "ipv6"), "cidr": ("ipv4-cidr", "ipv6-cidr")}
FORMAT_METHODS = (
    "email", "url", "uri", "uuid", "uuidv4", "uuidv6", "uuidv7", "guid", "cuid", "cuid2", "ulid", "nanoid", "jwt", "xid", "ksuid", "hostname", "hex", "hash", "base64", "base64url", "emoji",
    "ip", "cidr", "cidrv4", "cidrv6", "e164", "ipv4", "ipv6", "duration", "iso.duration", "httpUrl", "datetime", "date", "time",
)

#: Methods with one effect (attribute, value), and methods without any.
PLAIN = {
    "nullable": ("nullable", "true"), "nullish": ("nullable", "true"), "deprecated": ("deprecated", "true"), "int": ("type", "integer"), "positive": ("exclusiveMinimum", "0"), "nonnegative": ("minimum", "0"),
    "negative": ("exclusiveMaximum", "0"), "nonpositive": ("maximum", "0"), "readonly": ("readOnly", "true"),
}
WITH_ARGUMENT = {"regex": "pattern", "multipleOf": "multipleOf", "step": "multipleOf", "minSize": "minLength", "maxSize": "maxLength", "default": "default"}
NO_EFFECT = ("optional", "trim", "toLowerCase", "toUpperCase", "finite", "refine", "superRefine", "transform", "overwrite", "nonoptional", "brand", "strip", "exactOptional")
BOUNDS = {
    "min": {"string": "minLength", "number": "minimum", "integer": "minimum", "array": "minItems", "tuple": "minItems"}, "max": {"string": "maxLength", "number": "maximum", "integer": "maximum", "array": "maxItems", "tuple": "maxItems"},
}
CHECKS = {"gt": "min", "gte": "min", "lt": "max", "lte": "max", "minLength": "min", "maxLength": "max", "minimum": "min", "maximum": "max"}
OTHER = ("describe", "length", "nonempty", "rest", "startsWith", "endsWith", "includes", "safe", "mime", "prefault", "catch", "meta", "passthrough", "catchall", "strict", "min", "max")
KNOWN = (*FORMAT_METHODS, *PLAIN, *WITH_ARGUMENT, *NO_EFFECT, *OTHER)


def format_effects(name: Column) -> Column:
    """What a format's name sets, as ``(attribute, value)`` rows: a registered format; an encoding, a media type or ``unregistered`` (with a pattern, where the chain has none, if one is known) in place of a format;
    either of two formats (``anyOf``) in place of all that the chain has set (``*``)."""
    one = lambda a, v: F.array(F.struct(F.lit(a).alias("attribute"), (F.lit(v) if isinstance(v, str) else v).alias("value")))
    table = lambda values: F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    either = {k: "|".join(v) for k, v in EITHER.items()}
    gone = one("format", F.lit(None).cast("string"))
    return (
        F.when(F.map_contains_key(table(FORMATS), name), one("format", F.try_element_at(table(FORMATS), name)))
        .when(F.map_contains_key(table(either), name), F.concat(one("*", F.lit(None).cast("string")), one("anyOf", F.try_element_at(table(either), name))))
        .when(F.map_contains_key(table(ENCODINGS), name), F.concat(gone, one("contentEncoding", F.try_element_at(table(ENCODINGS), name))))
        .when(name == "binary", F.concat(gone, one("contentMediaType", "application/octet-stream")))
        .when(registries.is_registered_format(name), one("format", name))
        .when(F.map_contains_key(table(PATTERNS), name), F.concat(gone, one("unregistered", name), one("?pattern", F.try_element_at(table(PATTERNS), name))))
        .otherwise(F.concat(gone, one("unregistered", name)))
    )


def effects(kind: Column, method: Column, arg: Column) -> Column:
    """The ``(attribute, value)`` rows that one call sets for a schema of a type; an empty list for calls without effect."""
    pair = lambda a, v: F.struct((F.lit(a) if isinstance(a, str) else a).alias("attribute"), (F.lit(v) if isinstance(v, str) else v).cast("string").alias("value"))
    none = F.array().cast("array<struct<attribute:string,value:string>>")
    bound = {m: F.create_map(*[F.lit(x) for p in t.items() for x in p]) for m, t in BOUNDS.items()}
    low, high = F.try_element_at(bound["min"], kind), F.try_element_at(bound["max"], kind)
    sized = kind.isin("string", "array", "tuple")
    number = F.when(arg.rlike(r"^-?\d+(\.\d+)?$"), arg)
    items = F.filter(F.transform(F.split(arg, ","), lambda x: F.trim(x)), lambda x: x != "")
    words = F.trim(F.regexp_replace(arg, "^@deprecated", ""))
    out = F.when(method.isin(*FORMAT_METHODS), format_effects(method))
    for name, (attribute, value) in PLAIN.items():
        out = out.when(method == name, F.array(pair(attribute, value)))
    for name, attribute in WITH_ARGUMENT.items():
        out = out.when((method == name) & arg.isNotNull(), F.array(pair(attribute, arg)))
    out = out.when((method == "describe") & arg.startswith("@deprecated"), F.array(pair("deprecated", "true"), pair("description", words))).when((method == "describe") & arg.isNotNull(), F.array(pair("description", arg)))
    out = out.when((method == "min") & low.isNotNull() & number.isNotNull(), F.array(pair(low, number))).when((method == "max") & high.isNotNull() & number.isNotNull(), F.array(pair(high, number)))
    out = out.when((method == "length") & sized & number.isNotNull(), F.array(pair(low, number), pair(high, number)))
    out = out.when((method == "nonempty") & sized, F.array(pair(F.concat(F.lit("+"), low), "1")))
    out = out.when((method == "rest") & (kind == "array"), F.array(pair("maxItems", F.lit(None)))).when((method == "rest") & (kind == "tuple"), F.array(pair("maxItems", F.lit(None)), pair("items", arg)))
    out = out.when(method == "startsWith", F.array(pair("pattern", F.concat(F.lit("^"), escape_regex(arg))))).when(method == "endsWith", F.array(pair("pattern", F.concat(escape_regex(arg), F.lit("$"))))).when(method == "includes", F.array(pair("pattern", escape_regex(arg))))
    out = out.when(method == "safe", F.array(pair("minimum", "-9007199254740991"), pair("maximum", "9007199254740991")))
    out = out.when((method == "mime") & (F.size(items) == 1), F.array(pair("contentMediaType", items[0]))).when((method == "mime") & (F.size(items) > 1), F.array(pair("contentMediaType", F.lit(None)), pair("x-contentMediaTypes", F.array_join(items, ","))))
    out = out.when(method.isin("prefault", "catch") & arg.isNotNull(), F.array(pair("?default", arg)))
    # a title and a description are texts, examples are a list and deprecated is true, or they do nothing; anything else is taken as it is
    fields = F.from_json(arg, "map<string,variant>")
    of = lambda e: F.schema_of_variant(e["value"])
    fits = lambda e: F.when(e["key"].isin("title", "description"), of(e) == "STRING").when(e["key"] == "examples", of(e).startswith("ARRAY")).when(e["key"] == "deprecated", F.to_json(e["value"]) == "true").otherwise(e["key"] != "id")
    out = out.when((method == "meta") & fields.isNotNull(), F.transform(F.filter(F.map_entries(fields), fits), lambda e: pair(e["key"], F.when(of(e) == "STRING", F.try_variant_get(e["value"], "$", "string")).otherwise(F.to_json(e["value"])))))
    out = out.when((method == "catchall") & (kind == "object"), F.array(pair("additionalProperties", F.coalesce(arg, F.lit("true"))))).when((method == "passthrough") & (kind == "object"), F.array(pair("additionalProperties", "true")))
    out = out.when((method == "strict") & (kind == "object"), F.array(pair("additionalProperties", "false")))
    return F.coalesce(out, none)


def chain_attributes(calls: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, attribute, value)`` of chains ``(keys, ord, type, method, arg)``: of each attribute the last value; removed ones are left out.

    ``nonempty`` raises a lower bound to 1 and leaves a higher one; ``prefault`` and ``catch`` give a default only where the chain gives none. An ``int`` makes bounds behind it those of a number as before.
    """
    method = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in CHECKS.items() for x in p]), F.col("method")), F.col("method"))
    each = calls.select(*keys, "ord", F.posexplode(effects(F.col("type"), method, F.col("arg"))).alias("__i", "__e")).select(*keys, "ord", "__i", F.regexp_replace("__e.attribute", r"^[+?]", "").alias("attribute"), F.substr("__e.attribute", F.lit(1), F.lit(1)).alias("__how"), "__e.value")
    each = spread(each, *keys)  # a shuffle before the calls came to rows is small, and its few tasks would sort all of these
    plain = F.col("__how").isin("+", "?")
    # a call that begins anew takes away what stands before it
    anew = F.max(F.when(F.col("attribute") == "*", F.struct("ord", "__i"))).over(Window.partitionBy(*keys))
    each = each.withColumn("__anew", anew).where("__anew IS NULL OR struct(ord, __i) > __anew")
    last = each.groupBy(*keys, "attribute").agg(
        F.max_by(F.struct("value"), F.when(~plain, F.struct("ord", "__i"))).alias("__set"), F.max(F.when(~plain, F.col("ord"))).alias("__at"), F.min_by(F.struct("value"), F.when(F.col("__how") == "?", F.col("ord"))).alias("__else"),
        F.max(F.when(F.col("__how") == "+", F.col("ord"))).alias("__raised"),
    )
    given = F.col("__set.value")
    raised = F.when(F.col("__raised").isNotNull() & (F.col("__at").isNull() | (F.col("__at") < F.col("__raised"))), F.greatest(F.coalesce(given.try_cast("double"), F.lit(0.0)), F.lit(1.0)))
    value = F.when(raised.isNotNull(), F.regexp_replace(raised.cast("string"), r"\.0$", "")).otherwise(F.coalesce(given, F.when(F.col("__set").isNull(), F.col("__else.value"))))
    return last.select(*keys, "attribute", value.alias("value")).where("value IS NOT NULL AND attribute <> 'unregistered'")


def unknown_methods(calls: DataFrame) -> DataFrame:
    """Calls of methods that nothing is known of."""
    return calls.where(~F.col("method").isin(*KNOWN, *CHECKS))


#: Schemas of type names as (type, format, more); ``more`` is JSON text that is added.
TYPE_NAMES = {
    "string": ("string", None, None), "number": ("number", None, None), "boolean": ("boolean", None, None), "bigint": ("integer", "int64", None), "symbol": ("string", None, None),
    "object": ("object", None, '{"additionalProperties":true}'), "never": (None, None, '{"not":{}}'), "any": (None, None, None), "unknown": (None, None, None), "void": ("null", None, None),
    "null": ("null", None, None), "undefined": ("null", None, None), "Date": ("string", "date-time", None), "File": ("string", None, '{"contentMediaType":"application/octet-stream"}'),
    "Blob": ("string", None, '{"contentMediaType":"application/octet-stream"}'), "Buffer": ("string", None, '{"contentMediaType":"application/octet-stream"}'),
}


def type_name_schema(name: Column) -> Column:
    """``(type, format, more, literal, ref, arrays)`` of a type's name: ``Promise``, ``Awaited``, ``InstanceType`` and ``Readonly`` are taken off, ``Array`` and ``[]`` are counted; other names are references.

    What is no name then (maps, unions, object literals) has no value at all: ``type_trees`` reads whole expressions.
    """
    wrapped, listed = r"^(?:Promise|Awaited|InstanceType|Readonly)<(.+)>$", r"^(?:(?:Array|ReadonlyArray)<(.+)>|(.+)\[\])$"

    def peel(state: Column) -> Column:
        n = state["name"]
        inner = F.coalesce(F.nullif(F.regexp_extract(n, listed, 1), F.lit("")), F.regexp_extract(n, listed, 2))
        list_ = F.struct(F.trim(inner).alias("name"), (state["arrays"] + 1).alias("arrays"))
        return F.when(n.rlike(wrapped), F.struct(F.trim(F.regexp_extract(n, wrapped, 1)).alias("name"), state["arrays"].alias("arrays"))).when(n.rlike(listed), list_).otherwise(state)

    # a name is at least two characters longer than what it wraps
    steps = F.sequence(F.lit(0), F.coalesce(F.length(name), F.lit(0)).cast("int"))
    peeled = F.aggregate(steps, F.struct(F.trim(name).alias("name"), F.lit(0).alias("arrays")), lambda s, _: peel(s))
    return _bare_schema(peeled["name"], peeled["arrays"])


def _bare_schema(bare: Column, depth: Column) -> Column:
    literal = bare.rlike(r"""^(".*"|'.*'|-?\d+(\.\d+)?|true|false)$""")
    pick = lambda i: F.try_element_at(F.create_map(*[F.lit(x) for k, v in TYPE_NAMES.items() for x in (k, v[i] or "")]), bare)
    known = bare.isin(*TYPE_NAMES)
    kind = F.when(literal, F.when(bare.isin("true", "false"), "boolean").when(bare.rlike("^[\"']"), "string").otherwise("number")).when(known, F.nullif(pick(0), F.lit("")))
    return F.struct(
        kind.alias("type"), F.when(known, F.nullif(pick(1), F.lit(""))).alias("format"), F.when(known, F.nullif(pick(2), F.lit(""))).alias("more"), F.when(literal, F.regexp_replace(bare, "^[\"']|[\"']$", "")).alias("literal"),
        F.when(~literal & ~known & bare.rlike(r"^[\p{L}_$][\p{L}\p{N}_$.]*$"), F.concat(F.lit("#/components/schemas/"), bare)).alias("ref"), depth.alias("arrays"),
    )


def enum_schema(members: DataFrame, keys: list[str]) -> DataFrame:
    """Enums of member rows ``(keys, ord, name, value)``: numbers if any value is a number, members with 0, an empty or no value by their names, values in order."""
    numeric = F.max(F.coalesce(F.col("value").rlike(r"^-?\d+(\.\d+)?$"), F.lit(False)))
    shown = F.when(F.coalesce("value", F.lit("")).isin("", "0"), F.col("name")).otherwise(F.col("value"))
    return members.groupBy(*keys).agg(F.when(numeric, "number").otherwise("string").alias("type"), F.transform(F.array_sort(F.collect_list(F.struct("ord", shown.alias("v")))), lambda x: x["v"]).alias("enum"))


def extended_interfaces(properties: DataFrame, parents: DataFrame) -> DataFrame:
    """Properties ``(owner, name, value, required)`` of interfaces with those of all their ancestors ``(owner, parent, ord)`` that they lack, which are not required; of two parents' properties the later parent's counts.

    Without ``ord`` parents go by name. Each round goes one generation up; an interface that leads back to itself adds nothing there.
    """
    ranked = parents if "ord" in parents.columns else parents.withColumn("ord", F.row_number().over(Window.partitionBy("owner").orderBy("parent")))
    above = written(ranked.where("owner IS NOT NULL AND parent IS NOT NULL").select(F.col("owner").alias("child"), "parent", (-F.col("ord")).cast("long").alias("place")), "parents")
    # the way up to an ancestor: of two the one counts that is less, so a nearer one before a farther one on its way, and a later parent before an earlier one
    way = written(above.select(F.col("child").alias("owner"), F.col("parent").alias("at"), F.array("place").alias("way"), F.array("child", "parent").alias("seen")).where("owner <> at"), "ancestors")
    found = None
    while way.take(1):
        found = way.select("owner", "at", "way") if found is None else written(found.unionByName(way.select("owner", "at", "way")), "ancestors")
        up = way.join(above, F.col("at") == F.col("child")).where("NOT array_contains(seen, parent)")
        way = written(up.select("owner", F.col("parent").alias("at"), F.array_append("way", F.col("place")).alias("way"), F.array_append("seen", F.col("parent")).alias("seen")), "ancestors")
    own = properties.select("owner", "name", "value", "required", F.array().cast("array<bigint>").alias("way"))
    if found is not None:
        more = found.join(properties.select(F.col("owner").alias("at"), "name", "value"), "at").select("owner", "name", "value", F.lit(False).alias("required"), "way")
        own = own.unionByName(more)
    return own.groupBy("owner", "name").agg(F.min_by(F.struct("value", "required"), "way").alias("__p")).select("owner", "name", "__p.*")


def template_pattern(parts: Column) -> Column:
    """An anchored pattern for a template: ``(fixed, text)`` parts, where an open part's text is a type: digits for numbers, either word for booleans, anything else."""
    open_ = lambda t: F.when(t.isin("number", "bigint", "integer"), r"-?\d+(\.\d+)?").when(t == "boolean", "(true|false)").otherwise(".*")
    return F.concat(F.lit("^"), F.array_join(F.transform(parts, lambda p: F.when(p["fixed"], escape_regex(p["text"])).otherwise(open_(p["text"]))), ""), F.lit("$"))
