"""Queries over names, tags, components and runs that are made of the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomdoc.functions import annotations
from loomdoc.operators import catalog, nodes
from loomdoc.plans.named import register
from loomdoc.sources.tables import spread, table


@register("SELECT o_orderkey, 'Main' || CASE WHEN o_orderstatus = 'Main' THEN '' ELSE ',' || o_orderstatus END || ',x' AS tags, CASE WHEN o_orderkey % 2 = 0 THEN 'get' ELSE 'additionalOperations/LINK' END AS place FROM orders")
def operation_tags(spark, sf):
    more = F.array(F.concat(F.lit(" "), F.col("o_orderstatus")), F.lit("Main"), F.lit("  "), F.lit("x"), F.lit(" x "))
    method = F.when(F.col("o_orderkey") % 2 == 0, "GET").otherwise("LINK")
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(catalog.operation_tags(F.lit("Main"), more), ",").alias("tags"), catalog.operation_place(method).alias("place"))


@register("SELECT c_mktsegment AS tag, arg_max(c_name, c_custkey) FILTER (WHERE c_custkey % 2 = 0) AS summary, CAST(max(c_custkey) AS VARCHAR) AS description FROM customer GROUP BY 1")
def registered_tags(spark, sf):
    rows = table(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).otherwise("").alias("tag"), F.concat(F.lit("/{id}/"), "c_mktsegment", F.lit("/x")).alias("path"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(" ").alias("summary"), F.col("c_custkey").cast("string").alias("description"),
    )
    return catalog.registered_tags(rows, "c_custkey", ["summary", "description"])


@register(
    "SELECT coalesce(r_name, n_name) AS name, CASE WHEN n_name IS NOT NULL AND n_nationkey % 2 = 0 THEN 'n' || n_nationkey WHEN r_name IS NOT NULL THEN 'r' || r_regionkey END AS kind, r_name IS NOT NULL AS from_template FROM region FULL JOIN nation ON r_name = n_name"
)
def merged_tags(spark, sf):
    template = table(spark, sf, "region").select(F.col("r_name").alias("name"), F.concat(F.lit("r"), "r_regionkey").alias("kind"))
    made = table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("n"), "n_nationkey")).alias("kind"))
    return catalog.merged_tags(template, made, "name", ["kind"])


@register("SELECT event_id, props FROM events WHERE event_id % 5 IN (0, 1)")
def schema_delta(spark, sf):
    """A fifth of the rows is new, a fifth has changed."""
    events = table(spark, sf, "events").select("event_id", "props")
    before = events.where("event_id % 5 <> 0").withColumn("props", F.when(F.col("event_id") % 5 == 1, "old").otherwise(F.col("props")))
    return catalog.schema_delta(before, events, "event_id", "props")


@register("SELECT DISTINCT l_orderkey, l_returnflag AS name FROM lineitem UNION SELECT DISTINCT l_orderkey, 'Q' || l_linestatus FROM lineitem")
def route_schema_names(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", F.concat("l_returnflag", F.lit("[][]")).alias("a"), F.concat(F.lit(" Q"), "l_linestatus").alias("b"), F.lit("").alias("c"))
    return catalog.route_schema_names(rows, "l_orderkey", ["a", "b", "c"])


@register("SELECT user_id, event_type AS name, arg_max(props, event_id) AS value FROM events WHERE event_id % 2 = 0 GROUP BY ALL")
def example_map(spark, sf):
    rows = table(spark, sf, "events").select("user_id", F.when(F.col("event_id") % 2 == 0, "request").otherwise("query").alias("target"), F.col("event_type").alias("name"), "event_id", F.col("props").alias("value"))
    return catalog.example_map(rows, ["user_id"], "request", "event_id")


@register("SELECT p_partkey, 'e1' AS name, CAST(p_size AS VARCHAR) AS value FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 'e2', 'b' FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 'one', CAST(p_size AS VARCHAR) FROM part WHERE p_partkey % 3 = 1 UNION ALL SELECT p_partkey, 'two', '2' FROM part WHERE p_partkey % 3 = 1 UNION ALL SELECT p_partkey, 'e', CAST(p_size AS VARCHAR) FROM part WHERE p_partkey % 3 = 2")
def expanded_examples(spark, sf):
    size, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    text = F.when(kind == 0, F.concat(F.lit("["), size, F.lit(',"b"]'))).when(kind == 1, F.concat(F.lit('{"one":{"value":'), size, F.lit('},"two":{"value":2}}'))).otherwise(size)
    rows = table(spark, sf, "part").select("p_partkey", F.lit("e").alias("name"), F.parse_json(text).alias("value"))
    return catalog.expanded_examples(rows, ["p_partkey"]).select("p_partkey", "name", F.try_variant_get("value", "$", "string").alias("value"))


@register("SELECT event_type AS phase, round(sum(value), 2) AS ms, count(*) AS calls, round(avg(value), 2) AS mean FROM events GROUP BY 1")
def phase_sums(spark, sf):
    made = catalog.phase_sums(table(spark, sf, "events").select(F.col("event_type").alias("phase"), F.col("value").alias("ms")))
    return made.withColumns({"ms": F.round("ms", 2), "mean": F.round("mean", 2)})


@register("SELECT p_type AS phase, sum(p_size) AS ms FROM part WHERE p_type <> 'ECONOMY' GROUP BY 1 ORDER BY ms DESC, phase LIMIT 3")
def slowest_phases(spark, sf):
    return catalog.slowest_phases(table(spark, sf, "part").select(F.col("p_type").alias("phase"), F.col("p_size").cast("long").alias("ms")), 3, total="ECONOMY")


@register("SELECT l_orderkey, count(DISTINCT l_returnflag) AS paths, count(*) AS operations, count(DISTINCT l_linestatus) AS schemas FROM lineitem GROUP BY 1")
def document_counts(spark, sf):
    lines = table(spark, sf, "lineitem")
    return catalog.document_counts(lines.select("l_orderkey", F.col("l_returnflag").alias("path")), lines.select("l_orderkey", F.col("l_linestatus").alias("name")), "l_orderkey")


@register("SELECT n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY lower(n_name), n_name) AS ord FROM nation")
def sorted_components(spark, sf):
    return catalog.named_order(table(spark, sf, "nation"), "n_name", ["n_regionkey"]).select("n_name", "ord")


@register(
    "SELECT page_id, row_number() OVER (PARTITION BY page_id % 3 ORDER BY page_id % 2, CASE WHEN page_id % 4 = 0 THEN 2 ELSE 1 END, page_id % 5, CASE WHEN page_id % 4 = 0 THEN page_id % 7 ELSE -1 END, path) AS ord "
    "FROM (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN '/S' || page_id % 5 || '/x' || page_id % 7 ELSE '/s' || page_id % 5 END || '/' || lpad(CAST(page_id AS VARCHAR), 9, '0') AS path FROM pages)"
)
def sorted_paths(spark, sf):
    k = F.col("page_id")
    last = F.lpad(k.cast("string"), 9, "0")
    path = F.when(k % 4 == 0, F.concat(F.lit("/S"), k % 5, F.lit("/x"), k % 7, F.lit("/"), last)).otherwise(F.concat(F.lit("/s"), k % 5, F.lit("/"), last))
    rows = table(spark, sf, "pages").select("page_id", path.alias("path"), (k % 2).cast("string").alias("tag"), (k % 3).alias("doc"))
    return catalog.path_sort(rows, "path", "tag", ["doc"]).select("page_id", "ord")


@register("SELECT 'schemas' AS kind, coalesce(r_name, n_name) AS name, CASE WHEN r_name IS NOT NULL THEN 'region' ELSE 'nation' END AS body FROM region FULL JOIN nation ON r_name = n_name")
def component_union(spark, sf):
    layers = [table(spark, sf, "nation").select(F.lit("schemas").alias("kind"), F.col("n_name").alias("name"), F.lit("nation").alias("body")), table(spark, sf, "region").select(F.lit("schemas").alias("kind"), F.col("r_name").alias("name"), F.lit("region").alias("body"))]
    return catalog.component_union(layers)


@register("SELECT user_id, arg_max(event_type, event_id) FILTER (WHERE event_id % 2 = 0) AS a, max(event_id) FILTER (WHERE event_id % 3 = 0) AS b FROM events GROUP BY 1")
def shallow_last(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("a"), F.when(F.col("event_id") % 3 == 0, F.col("event_id")).alias("b"))
    return catalog.shallow_last(rows, ["user_id"], "event_id")


@register("SELECT user_id, coalesce(arg_max(event_type, event_id) FILTER (WHERE event_id % 2 = 0), '') AS summary, bool_or(event_type = 'error') AS deprecated, count(*) AS servers FROM events GROUP BY 1")
def merged_comments(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise("").alias("summary"), (F.col("event_type") == "error").alias("deprecated"), F.array("event_type").alias("servers"))
    return catalog.merged_comments(rows, ["user_id"], "event_id").withColumn("servers", F.size("servers").cast("long"))


@register(
    "SELECT c_custkey AS file, 1 AS seq, '$.a' AS target, 'u' || c_custkey AS \"update\" FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 2, '$.own', 'u' || c_custkey FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 3, '$.x', NULL FROM customer"
)
def reusable_actions(spark, sf):
    """Actions of each file: two name a reusable one that even files have, the last stands alone."""
    files = table(spark, sf, "customer").select(F.col("c_custkey").alias("file"))
    none = F.lit(None).cast("string")
    action = lambda n, ref, target: F.struct(F.lit(n).alias("seq"), ref.alias("ref"), target.alias("target"), none.alias("update"))
    made = F.array(action(1, F.lit("#/components/actions/a~1b"), none), action(2, F.lit("#/components/actions/a~1b"), F.lit("$.own")), action(3, none, F.lit("$.x")))
    actions = files.select("file", F.explode(made).alias("a")).select("file", "a.*")
    parts = files.where("file % 2 = 0").select("file", F.lit("a/b").alias("name"), F.lit("$.a").alias("target"), F.concat(F.lit("u"), "file").alias("update"))
    return catalog.reusable_actions(actions, parts)[0]


@register("SELECT DISTINCT o_orderkey, n AS name FROM orders, (VALUES ('Bearer'), ('key')) AS v(n) UNION ALL SELECT o_orderkey, 'S' || o_orderstatus FROM orders")
def referenced_schemes(spark, sf):
    raw = F.concat(F.lit("Bearer:a|b; key, S"), F.col("o_orderstatus"), F.lit(", Bearer"))
    return catalog.referenced_schemes(spread(table(spark, sf, "orders")).select("o_orderkey", annotations.security_requirements(raw).alias("security")), "o_orderkey")


@register("SELECT c_custkey AS route, 'body' AS role, n_name || 'Body' AS name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 2 = 0 UNION ALL SELECT c_custkey, 'query', n_name || 'Query' FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 3 = 0")
def auto_wired(spark, sf):
    nation = table(spark, sf, "nation")
    schemas = nation.where("n_nationkey % 2 = 0").select(F.concat("n_name", F.lit("Body")).alias("name")).unionByName(nation.where("n_nationkey % 3 = 0").select(F.concat("n_name", F.lit("Query")).alias("name")))
    routes = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("route"), F.col("n_name").alias("base"))
    return catalog.auto_wired(routes, schemas, {"body": "Body", "query": "Query"})


@register("SELECT l_orderkey AS route, min(CASE WHEN l_linenumber = 1 THEN 'A' WHEN l_linenumber = 2 THEN 'B' END) AS schema_name FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1 HAVING count(DISTINCT l_linenumber) = 1")
def path_object_candidates(spark, sf):
    """Orders with line 1 or 2 alone; schema A has a property for line 1, B for line 2."""
    routes = table(spark, sf, "lineitem").where("l_linenumber <= 2").groupBy(F.col("l_orderkey").alias("route")).agg(F.collect_set(F.concat(F.lit("p"), "l_linenumber")).alias("names"))
    properties = spark.createDataFrame([("A", "p1"), ("A", "x"), ("B", "p2")], "schema_name string, property string")
    return catalog.path_object_candidates(routes, properties)


@register(
    "SELECT p_partkey, '/a/schema/type' AS pointer, '\"string\"' AS value FROM part UNION ALL SELECT p_partkey, '/b/items/type', '\"string\"' FROM part UNION ALL SELECT p_partkey, '/c/$ref', '\"#/components/schemas/Kept\"' FROM part UNION ALL "
    "SELECT p_partkey, '/d/next/$ref', '\"#/components/schemas/Self\"' FROM part UNION ALL SELECT p_partkey, '/d/k', CAST(p_partkey AS VARCHAR) FROM part"
)
def inlined_schemas(spark, sf):
    """References to excluded schemas, one of them through another one and one that leads to itself."""
    ref = lambda n: f'{{"$ref":"#/components/schemas/{n}"}}'
    text = f'{{"a":{{"schema":{ref("Text")}}},"b":{ref("List")},"c":{ref("Kept")},"d":{ref("Self")}}}'
    parts = table(spark, sf, "part").select("p_partkey")
    docs = parts.select("p_partkey", F.parse_json(F.lit(text)).alias("doc"))
    body = f'{{"Text":{{"type":"string"}},"List":{{"items":{ref("Text")}}},"Self":{{"next":{ref("Self")},"k":0}}}}'
    inner = nodes.nodes(parts.select("p_partkey", F.parse_json(F.lit(body)).alias("doc")), "p_partkey")
    schemas = inner.select("p_partkey", F.regexp_extract("pointer", "^/([^/]*)", 1).alias("name"), F.regexp_replace("pointer", "^/[^/]*", "").alias("below"), F.when(F.col("pointer") == "/Self/k", F.col("p_partkey").cast("string")).otherwise(F.col("value")).alias("value"))
    excluded = parts.select("p_partkey", F.explode(F.array(F.lit("Text"), F.lit("List"), F.lit("Self"))).alias("name"))
    return catalog.inlined(nodes.nodes(docs, "p_partkey"), excluded, schemas, "p_partkey")


@register("SELECT user_id AS document, s AS status, 'd' || CAST(max(event_id) AS VARCHAR) AS description, 'x=' || s || ' run=7 ' || arg_max(event_type, event_id) AS schema FROM (SELECT *, CASE event_type WHEN 'error' THEN '404' WHEN 'view' THEN '401' ELSE '500' END AS s FROM events) GROUP BY user_id, s")
def error_responses(spark, sf):
    kind = F.col("event_type")
    rows = table(spark, sf, "events").select(F.col("user_id").alias("document"), F.col("event_id").alias("ord"), F.when(kind == "error", "user_not_found").when(kind == "view", "AUTH").otherwise("odd").alias("code"), F.lit(None).cast("int").alias("status"), F.concat(F.lit("d"), "event_id").alias("description"), F.create_map(F.lit("KIND"), kind).alias("own"))
    return catalog.scheme_texts(rows, "x={{HTTP_STATUS}} run={{RUN}} {{KIND}}", {"RUN": "7", "KIND": "never"})
