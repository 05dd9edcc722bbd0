"""Queries over document nodes, chains of schema methods and coded checks that are made of the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomdoc.functions.jsonpath import query_json_path
from loomdoc.operators import chains, checks, nodes, overlay
from loomdoc.plans.named import register
from loomdoc.sources.tables import spread, table


def _documents(spark, sf):
    """A document of every part, with a little of all that versions treat in different ways."""
    text = (
        '{"openapi":"3.2.0","$self":"u{k}","jsonSchemaDialect":"d","info":{"license":{"identifier":"MIT"}},"servers":[{"name":"s{k}","url":"/"}],"tags":[{"name":"t","kind":"nav","parent":"p"}],'
        '"paths":{"/a/{id}":{"query":{"summary":"q"},"additionalOperations":{"LINK":{"x":{k}}},"get":{"parameters":[{"in":"querystring","name":"n"}],"responses":{"200":{"summary":"r{k}","description":"ok",'
        '"content":{"text/event-stream":{"itemSchema":{"type":"string"},"examples":{"e":{"dataValue":{k}}}}}},"404":{"$ref":"#/x","summary":"kept"}}}}},'
        '"components":{"mediaTypes":{"m":1},"securitySchemes":{"o":{"oauth2MetadataUrl":"m","deprecated":true,"flows":{"deviceAuthorization":{"u":1}}}}},"webhooks":{"w":{"get":{"z":1}}}}'
    )
    return spread(table(spark, sf, "part")).select("p_partkey", F.parse_json(F.replace(F.lit(text), F.lit("{k}"), F.col("p_partkey").cast("string"))).alias("doc"))


_K = "CAST(p_partkey AS VARCHAR)"
_SAME = [("/tags/0/name", "'\"t\"'"), ("/servers/0/url", "'\"/\"'"), ("/paths/~1a~1{id}/get/parameters/0/name", "'\"n\"'"), ("/paths/~1a~1{id}/get/responses/200/description", "'\"ok\"'"), ("/paths/~1a~1{id}/get/responses/404/$ref", "'\"#/x\"'"), ("/paths/~1a~1{id}/get/responses/404/summary", "'\"kept\"'")]
_MEDIA = "/paths/~1a~1{id}/get/responses/200/content/text~1event-stream"
_OLD = _SAME + [
    ("/x-oai-$self", f"'\"u' || {_K} || '\"'"), ("/servers/0/x-oai-name", f"'\"s' || {_K} || '\"'"), ("/paths/~1a~1{id}/x-oai-additionalOperations/query/summary", "'\"q\"'"), ("/paths/~1a~1{id}/x-oai-additionalOperations/LINK/x", _K),
    ("/paths/~1a~1{id}/get/parameters/0/in", "'\"query\"'"), ("/paths/~1a~1{id}/get/responses/200/x-oai-summary", f"'\"r' || {_K} || '\"'"), (f"{_MEDIA}/x-oai-itemSchema/type", "'\"string\"'"), (f"{_MEDIA}/examples/e/x-oai-dataValue", _K),
    (f"{_MEDIA}/examples/e/value", _K), ("/components/securitySchemes/o/x-oai-deprecated", "'true'"), ("/components/securitySchemes/o/flows/x-oai-deviceAuthorization/u", "'1'"),
]
_NEW = _SAME + [
    ("/$self", f"'\"u' || {_K} || '\"'"), ("/servers/0/name", f"'\"s' || {_K} || '\"'"), ("/paths/~1a~1{id}/query/summary", "'\"q\"'"), ("/paths/~1a~1{id}/additionalOperations/LINK/x", _K), ("/paths/~1a~1{id}/get/parameters/0/in", "'\"querystring\"'"),
    ("/paths/~1a~1{id}/get/responses/200/summary", f"'\"r' || {_K} || '\"'"), (f"{_MEDIA}/itemSchema/type", "'\"string\"'"), (f"{_MEDIA}/examples/e/dataValue", _K), ("/components/securitySchemes/o/deprecated", "'true'"),
    ("/components/securitySchemes/o/flows/deviceAuthorization/u", "'1'"), ("/tags/0/kind", "'\"nav\"'"), ("/tags/0/parent", "'\"p\"'"), ("/components/mediaTypes/m", "'1'"), ("/components/securitySchemes/o/oauth2MetadataUrl", "'\"m\"'"),
    ("/jsonSchemaDialect", "'\"d\"'"), ("/webhooks/w/get/z", "'1'"), ("/info/license/identifier", "'\"MIT\"'"), ("/openapi", "'\"3.2.0\"'"),
]


def _rows(pairs):
    return " UNION ALL ".join(f"SELECT p_partkey, '{p}' AS pointer, {v} AS value FROM part" for p, v in pairs)


@register(_rows(_OLD + [("/info/license/x-oai-license-identifier", "'\"MIT\"'"), ("/openapi", "'\"3.0.0\"'")]))
def document_downgrade(spark, sf):
    return nodes.finalize(nodes.nodes(_documents(spark, sf), "p_partkey"), "p_partkey", "3.0")


@register(_rows(_OLD + [("/jsonSchemaDialect", "'\"d\"'"), ("/webhooks/w/get/z", "'1'"), ("/info/license/identifier", "'\"MIT\"'"), ("/openapi", "'\"3.1.0\"'")]))
def document_middle(spark, sf):
    return nodes.finalize(nodes.nodes(_documents(spark, sf), "p_partkey"), "p_partkey", "3.1")


@register(_rows(_NEW + [(f"{_MEDIA}/examples/e/value", _K)]).replace("UNION ALL SELECT p_partkey, '/components/mediaTypes/m' AS pointer, '1' AS value FROM part ", "").replace("/itemSchema/", "/x-oai-itemSchema/").replace("/o/deprecated'", "/o/x-oai-deprecated'"))
def document_round_trip(spark, sf):
    """Down to 3.1 without what it drops for good, and up to 3.2 again; item schemas and a scheme's deprecation stay extensions."""
    whole = nodes.nodes(_documents(spark, sf), "p_partkey")
    lost = whole.where("pointer RLIKE '^/tags/0/(kind|parent)$' OR pointer LIKE '%/oauth2MetadataUrl'")
    back = nodes.finalize(nodes.finalize(whole, "p_partkey", "3.1"), "p_partkey", "3.2")
    location = F.when(F.col("pointer").endswith("/parameters/0/in"), F.lit('"querystring"')).otherwise(F.col("value"))
    return back.withColumn("value", location).unionByName(lost)


@register("SELECT p_partkey, n AS name FROM part, (VALUES ('openapi'), ('$self'), ('info'), ('servers'), ('tags'), ('paths'), ('components'), ('webhooks'), ('jsonSchemaDialect')) AS v(n)")
def document_members(spark, sf):
    whole = nodes.nodes(_documents(spark, sf), "p_partkey")
    return whole.select("p_partkey", F.regexp_extract("pointer", "^/([^/]*)", 1).alias("name")).distinct()


@register("SELECT p_partkey, '/a/{id}' AS name FROM part")
def document_paths(spark, sf):
    return nodes.children(nodes.nodes(_documents(spark, sf), "p_partkey"), "p_partkey", ["paths"])


def _lines(spark, sf):
    """Lines by order and number, with the least and the greatest whole quantity."""
    q = F.col("l_quantity").cast("int")
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(q).alias("a"), F.max(q).alias("b"))


def _calls(lines):
    """A chain of a few calls for every line of an order; the key's kind is the line's."""
    lines = lines.select("l_orderkey", "l_linenumber", (F.col("l_linenumber") % 4).alias("m"), F.col("a").cast("string").alias("q"))
    call = lambda kind, method, arg: F.struct(F.lit(kind).alias("type"), F.lit(method).alias("method"), (F.lit(arg) if not isinstance(arg, F.Column) else arg).cast("string").alias("arg"))
    q = F.col("q")
    made = (
        F.when(F.col("m") == 0, F.array(call("string", "min", q), call("string", "email", None), call("string", "min", "3"), call("string", "nonempty", None), call("string", "trim", None)))
        .when(F.col("m") == 1, F.array(call("number", "min", q), call("number", "positive", None), call("number", "int", None), call("integer", "lte", "900"), call("number", "catch", "1"), call("number", "default", q)))
        .when(F.col("m") == 2, F.array(call("tuple", "length", q), call("tuple", "rest", "#/R"), call("array", "meta", '{"id":"x","title":"T"}'), call("array", "nullable", None), call("array", "describe", "@deprecated old")))
        .otherwise(F.array(call("string", "ulid", None), call("string", "startsWith", "a.b"), call("string", "mime", "a/b, c/d"), call("object", "strict", None), call("string", "odd", None)))
    )
    return lines.select("l_orderkey", "l_linenumber", F.posexplode(made).alias("ord", "c")).select("l_orderkey", "l_linenumber", "ord", "c.*")


_LINES = "(SELECT l_orderkey, l_linenumber, max(CAST(l_quantity AS INTEGER)) AS q, min(CAST(l_quantity AS INTEGER)) AS q2, l_linenumber % 4 AS m FROM lineitem GROUP BY ALL)"


def _attributes(m, pairs):
    return " UNION ALL ".join(f"SELECT l_orderkey, l_linenumber, '{a}' AS attribute, {v} AS value FROM {_LINES} WHERE m = {m} AND q = q2" for a, v in pairs)


@register(
    " UNION ALL ".join(
        [
            _attributes(0, [("minLength", "'3'"), ("format", "'email'")]),
            _attributes(1, [("minimum", "CAST(q AS VARCHAR)"), ("exclusiveMinimum", "'0'"), ("type", "'integer'"), ("maximum", "'900'"), ("default", "CAST(q AS VARCHAR)")]),
            _attributes(2, [("minItems", "CAST(q AS VARCHAR)"), ("items", "'#/R'"), ("title", "'T'"), ("nullable", "'true'"), ("deprecated", "'true'"), ("description", "'old'")]),
            _attributes(3, [("pattern", "'^a\\.b'"), ("x-contentMediaTypes", "'a/b,c/d'"), ("additionalProperties", "'false'")]),
        ]
    )
)
def chain_attributes(spark, sf):
    """Lines that stand once for their order and number, so that the quantity is one."""
    return chains.chain_attributes(_calls(_lines(spark, sf).where("a = b")), ["l_orderkey", "l_linenumber"])


@register(
    "SELECT DISTINCT l_orderkey AS subject, 'unregistered-format' AS code, 'info' AS severity FROM lineitem WHERE l_linenumber % 4 = 3 UNION ALL SELECT DISTINCT l_orderkey, 'unknown-zod-method', 'warning' FROM lineitem WHERE l_linenumber % 4 = 3"
)
def chain_checks(spark, sf):
    return checks.chain_checks(_calls(_lines(spark, sf)), "l_orderkey").select(F.col("subject").cast("long").alias("subject"), "code", "severity").distinct()


@register(
    "SELECT CAST(event_id AS VARCHAR) AS subject, 'missing-path-params-type' AS code, 'Route ' || event_id || '/{a}/{b} contains path parameters a, b but no @path type is defined.' AS message FROM events WHERE event_type = 'view' UNION ALL "
    "SELECT CAST(event_id AS VARCHAR), 'missing-query-params-type', 'Query parameters were inferred from searchParams usage, but no @query type is defined.' FROM events WHERE event_type = 'error' UNION ALL "
    "SELECT CAST(event_id AS VARCHAR), 'inferred-body', 'Inferred request body schema from handler validation: B' || event_id FROM events WHERE event_type = 'purchase'"
)
def route_checks(spark, sf):
    kind, k = F.col("event_type"), F.col("event_id").cast("string")
    routes = table(spark, sf, "events").select(
        F.when(kind == "view", F.concat(k, F.lit("/{a}/{b}"))).otherwise(k).alias("path"), F.lit("").alias("path_type"), F.lit("").alias("query_type"), (kind == "error").alias("reads_query"), F.lit("").alias("content_type"), F.lit("").alias("body_type"),
        F.lit("").alias("inferred_path_type"), F.lit(None).cast("string").alias("inferred_query_type"), F.when(kind == "purchase", F.concat(F.lit("B"), k)).alias("inferred_body_type"),
    )
    return checks.missing_types(routes).unionByName(checks.inferred_types(routes)).select(F.regexp_extract("subject", r"^(\d+)", 1).alias("subject"), "code", "message")


@register(
    "SELECT CAST(c_custkey AS VARCHAR) AS subject, 'schema-not-found' AS code FROM customer WHERE c_nationkey >= 20 UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'unregistered-tag-kind' FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL "
    "SELECT CAST(c_custkey AS VARCHAR), 'OVERLAY_TARGET_FORMAT_MISMATCH' FROM customer WHERE c_custkey % 3 = 1 UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'unspecified-http-method' FROM customer WHERE c_custkey % 2 = 1"
)
def document_checks(spark, sf):
    rows = table(spark, sf, "customer").withColumn("subject", F.col("c_custkey").cast("string"))
    known = table(spark, sf, "nation").where("n_nationkey < 20").select(F.concat(F.lit("N"), "n_nationkey").alias("schema_name"))
    used = checks.schemas_not_found(rows.select("subject", F.concat(F.lit("N"), "c_nationkey").alias("schema_name")), known)
    kinds = checks.tag_kinds(rows.select("subject", F.when(F.col("c_mktsegment") == "BUILDING", "nav").otherwise(F.col("c_mktsegment")).alias("kind")))
    third = F.col("c_custkey") % 3
    formats = checks.overlay_formats(rows.select(F.col("subject").alias("file"), F.when(third > 0, "arazzo").alias("target_format"), F.parse_json(F.when(third == 1, '{"openapi":"3"}').when(third == 2, '{"arazzo":"1"}').otherwise("{}")).alias("doc")))
    files = checks.route_files(rows.select(F.concat("subject", F.when(F.col("c_custkey") % 2 == 0, ".get.ts").otherwise(".ts")).alias("file"), F.lit("").alias("method")))
    found = used.unionByName(kinds).unionByName(formats).unionByName(files)
    return found.select(F.regexp_extract("subject", r"^(\d+)", 1).alias("subject"), "code")


@register(
    "SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'string' WHEN 1 THEN 'integer' WHEN 3 THEN 'number' WHEN 4 THEN 'object' END AS type, CASE p_size % 6 WHEN 0 THEN 'date-time' WHEN 1 THEN 'int64' END AS format, "
    "CASE p_size % 6 WHEN 2 THEN '#/components/schemas/P' || p_partkey END AS ref, CASE p_size % 6 WHEN 0 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS arrays, CASE p_size % 6 WHEN 3 THEN '42' END AS literal FROM part"
)
def type_names(spark, sf):
    names = F.array(F.lit("Promise<Date[]>"), F.lit("bigint"), F.concat(F.lit("Array<P"), "p_partkey", F.lit("[]>")), F.lit("42"), F.lit("Readonly<Promise<object>>"), F.lit("Map<string, X>"))
    made = chains.type_name_schema(F.element_at(names, F.col("p_size") % 6 + 1))
    return table(spark, sf, "part").select("p_partkey", made["type"].alias("type"), made["format"].alias("format"), made["ref"].alias("ref"), made["arrays"].alias("arrays"), made["literal"].alias("literal"))


@register(
    "SELECT l_orderkey, 'number' AS type, string_agg(CASE WHEN n = 0 THEN 'M' || n ELSE CAST(n AS VARCHAR) END, ',' ORDER BY n) AS enum FROM (SELECT DISTINCT l_orderkey, l_linenumber - 1 AS n FROM lineitem) GROUP BY l_orderkey"
)
def enum_schemas(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("ord")).distinct()
    made = chains.enum_schema(rows.withColumns({"name": F.concat(F.lit("M"), "ord"), "value": F.col("ord").cast("string")}), ["l_orderkey"])
    return made.select("l_orderkey", "type", F.array_join("enum", ",").alias("enum"))


@register("SELECT c_custkey AS owner, 'own' AS name, true AS required FROM customer UNION ALL SELECT c_custkey, 'both', true FROM customer UNION ALL SELECT c_custkey, 'base', false FROM customer")
def extended_interfaces(spark, sf):
    owners = table(spark, sf, "customer").select(F.col("c_custkey").alias("owner"), (-1 - F.col("c_nationkey")).cast("long").alias("parent"))
    own = owners.select("owner", F.explode(F.array(F.lit("own"), F.lit("both"))).alias("name"), F.lit("x").alias("value"), F.lit(True).alias("required"))
    base = owners.select("parent").distinct().select(F.col("parent").alias("owner"), F.explode(F.array(F.lit("base"), F.lit("both"))).alias("name"), F.lit("y").alias("value"), F.lit(True).alias("required"))
    return chains.extended_interfaces(own.unionByName(base), owners).where("owner >= 0").select("owner", "name", "required")


@register("SELECT event_id, user_id AS moved FROM events")
def overlay_copy(spark, sf):
    docs = table(spark, sf, "events").select("event_id", F.to_json(F.struct(F.struct(F.lit(1).alias("x")).alias("a"), F.struct(F.col("user_id").alias("z")).alias("b"))).alias("doc"))
    made = overlay.apply_overlay(docs, overlay.resolve_actions([{"target": "$.a", "copy": "$.b"}]))
    return made.where("get_json_object(doc, '$.a.x') IS NULL").select("event_id", F.get_json_object("doc", "$.a.z").cast("long").alias("moved"))


def _flags(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.parse_json(F.to_json(F.struct(F.array(F.struct(F.col("l_returnflag").alias("a b"), F.col("l_linenumber").alias("n"))).alias("rows")))).alias("doc"))


@register("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'")
def jp_unparenthesised_filter(spark, sf):
    return query_json_path(_flags(spark, sf), "$.rows[?@['a b'] == 'R']").select("l_orderkey", "l_linenumber")


@register("SELECT l_orderkey, l_linenumber, l_returnflag AS flag FROM lineitem")
def jp_spaced_bracket(spark, sf):
    return query_json_path(_flags(spark, sf), " $[ 'rows' ][ 0 ][ \"a b\" ] ").select("l_orderkey", "l_linenumber", F.try_variant_get("value", "$", "string").alias("flag"))


@register("SELECT p_partkey FROM part")
def jp_deep(spark, sf):
    """A value 100 levels down."""
    deep = F.concat(F.lit('{"d":' * 100 + '{"x":'), F.col("p_partkey").cast("string"), F.lit("}" * 101))
    found = query_json_path(spread(table(spark, sf, "part")).select(F.parse_json(deep).alias("doc")), "$..x")
    return found.select(F.try_variant_get("value", "$", "long").alias("p_partkey"))
