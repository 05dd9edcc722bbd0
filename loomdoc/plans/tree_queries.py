"""Queries over type texts, assembled documents, re-exports, references and paths that are made of the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomdoc.operators import assembly, exports, nodes, references, type_trees
from loomdoc.plans.named import register
from loomdoc.sources import paths
from loomdoc.sources.tables import spread, table


@register("""
    WITH b AS (SELECT p_partkey AS k, p_size % 5 AS a, p_partkey % 4 AS c, (p_partkey // 4) % 6 AS d, (p_partkey // 24) % 3 AS e,
        CASE p_size % 5 WHEN 0 THEN '{"type":"string"}' WHEN 1 THEN '{"type":"string","format":"date-time"}' WHEN 2 THEN '{"$ref":"#/components/schemas/P' || p_partkey % 7 || '"}' WHEN 3 THEN '{"type":"string","enum":["a","b"]}'
            ELSE '{"type":"object","properties":{"id":{"type":"number"}},"required":["id"]}' END AS s FROM part),
    l AS (SELECT *, CASE c WHEN 0 THEN '{"type":"array","items":' || s || ',"uniqueItems":true}' WHEN 1 THEN '{"type":"array","items":' || s || '}'
            WHEN 2 THEN '{"type":"object","additionalProperties":' || s || '}' ELSE '{"type":"object","properties":{"v":' || s || ',"w":{"$ref":"#/components/schemas/A"}},"required":["v"]}' END AS t FROM b),
    m AS (SELECT *, CASE d WHEN 0 THEN substr(t, 1, length(t) - 1) || ',"nullable":true}' WHEN 1 THEN t WHEN 2 THEN '{"type":"array","prefixItems":[' || t || ',{"$ref":"#/components/schemas/B"}],"items":false,"minItems":2,"maxItems":2}'
            WHEN 3 THEN '{"type":"object","properties":{},"additionalProperties":' || t || '}' WHEN 4 THEN '{"oneOf":[' || t || ',{"$ref":"#/components/schemas/C"}]}' ELSE t END AS u FROM l)
    SELECT k AS p_partkey, CASE e WHEN 0 THEN u WHEN 1 THEN '{"type":"array","items":{"type":"array","items":' || u || ',"uniqueItems":true}}'
        ELSE '{"type":"object","properties":{"deep":{"type":"object","additionalProperties":' || u || ',"propertyNames":{"type":"number"}}},"required":["deep"]}' END AS schema FROM m
""")
def type_texts_tree(spark, sf):
    """Nested type texts: names, unions of values and objects within sets, lists, maps and members, these with null, in tuples, unions and index signatures, and all of that in further brackets."""
    pick = lambda n, *texts: F.element_at(F.array(*[t if not isinstance(t, str) else F.lit(t) for t in texts]), (n + 1).cast("int"))
    key = F.col("p_partkey")
    basic = pick(F.col("p_size") % 5, "string", "Date", F.concat(F.lit("P"), key % 7), "'a' | \"b\"", "{ id: number }")
    around = lambda before, text, after: F.concat(F.lit(before), text, F.lit(after))
    one = pick(key % 4, around("Set<", basic, ">"), around("(", basic, ")[]"), around("Map<string, ", basic, ">"), around("{ v: ", basic, "; w?: A }"))
    two = pick(F.floor(key / 4) % 6, around("", one, " | null"), around("Promise<", one, ">"), around("[", one, ", B]"), around("{ [name: string]: ", one, " }"), around("", one, " | C"), around("[A, ", one, "][1]"))
    whole = pick(F.floor(key / 24) % 3, two, around("Array<ReadonlySet<", two, ">>"), around("{\n  readOnly(): void\n  deep: Record<number, ", two, ">\n}"))
    return type_trees.type_schemas(spread(table(spark, sf, "part")).select("p_partkey", whole.alias("text")), "p_partkey")


def _documents(spark, sf):
    rows = spread(table(spark, sf, "orders")).select(
        "o_orderkey", F.array(F.col("o_orderstatus"), F.lit(None).cast("string")).alias("list"), F.array().cast("array<int>").alias("none"), F.create_map(F.lit("a/b"), F.col("o_custkey")).alias("~x"),
        F.when(F.col("o_orderkey") % 3 == 0, F.create_map(F.lit("0"), F.lit("z"))).alias("zero"), F.array(F.array(F.struct(F.array(F.col("o_orderkey")).alias("in"))), F.array().cast("array<struct<in:array<bigint>>>")).alias("deep"),
    )
    return rows.select("o_orderkey", F.parse_json(F.to_json(F.struct("list", "none", "~x", "zero", "deep"))).alias("doc"))


@register("""SELECT o_orderkey, '{"deep":[[{"in":[' || o_orderkey || ']}],[]],"list":["' || o_orderstatus || '",null],"none":[]' || CASE WHEN o_orderkey % 3 = 0 THEN ',"zero":{"0":"z"}' ELSE '' END || ',"~x":{"a/b":' || o_custkey || '}}' AS doc FROM orders""")
def assembled_documents(spark, sf):
    """Documents to node rows and back: escaped names, empty containers, nulls, lists of lists, and an object whose only name is a number."""
    leaves, lists = nodes.nodes_and_lists(_documents(spark, sf), "o_orderkey")
    return assembly.assemble(leaves, "o_orderkey", lists).select("o_orderkey", F.to_json("doc").alias("doc"))


@register("""SELECT c_nationkey, '{"openapi":"3.1.0","paths":{' || string_agg('"/c/{id}/' || c_custkey || '":{"get":{"operationId":"op' || c_custkey || '","parameters":[{' || CASE WHEN c_custkey % 2 = 0 THEN '"example":7' ELSE '"example":123' END || ',"in":"path","name":"id"}]}}', ',' ORDER BY CAST(c_custkey AS VARCHAR)) || '}}' AS doc FROM customer GROUP BY c_nationkey""")
def assembled_operations(spark, sf):
    """A document for each nation, assembled of its customers' operations and settings, and cleaned: settings go, path parameters get examples."""
    rows = table(spark, sf, "customer")
    example = F.when(F.col("c_custkey") % 2 == 0, F.lit(7))
    made = F.struct(F.concat(F.lit("op"), "c_custkey").alias("operationId"), F.array(F.struct(F.lit("path").alias("in"), F.lit("id").alias("name"), example.alias("example"))).alias("parameters"))
    operations = rows.select("c_nationkey", F.concat(F.lit("/c/{id}/"), "c_custkey").alias("path"), F.lit("get").alias("place"), made.alias("operation"))
    fixed = rows.select("c_nationkey").distinct().select("c_nationkey", F.explode(F.create_map(F.lit("/openapi"), F.lit('"3.1.0"'), F.lit("/apiDir"), F.lit('"src"'))).alias("pointer", "value"))
    whole = assembly.assemble(assembly.operation_nodes(operations, "c_nationkey", "path", "place", "operation").unionByName(fixed), "c_nationkey")
    leaves, lists = nodes.nodes_and_lists(whole, "c_nationkey")
    return assembly.assemble(assembly.clean(leaves, "c_nationkey"), "c_nationkey", lists).select("c_nationkey", F.to_json("doc").alias("doc"))


@register("""
    WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, first_value(c_custkey) OVER w AS head, count(*) OVER (PARTITION BY c_nationkey) AS size FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey))
    SELECT 'f' || k AS file, 'T' AS name, CASE WHEN n % 5 < 3 THEN 'f' || head END AS from_file, CASE n % 5 WHEN 3 THEN 'missing' WHEN 4 THEN 'cycle' ELSE 'found' END AS state FROM c
""")
def reexport_index(spark, sf):
    """Files that re-export a name from the file before them in their nation, every third by a star; the first file defines it, or asks a file that isn't there, or closes a circle."""
    from pyspark.sql import Window

    by = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    last = F.last("c_custkey").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_nationkey") % 5).alias("n"), F.lag("c_custkey").over(by).alias("before"), last.alias("last"))
    file = lambda c: F.concat(F.lit("f"), F.col(c).cast("string"))
    first = F.col("before").isNull()
    star = ~first & (F.col("k") % 3 == 0)
    definitions = rows.where(first & (F.col("n") < 3)).select(file("k").alias("file"), F.lit("T").alias("name"))
    goal = F.when(~first, file("before")).when(F.col("n") == 3, "nowhere").otherwise(file("last"))
    named = rows.where(~star & ~(first & (F.col("n") < 3))).select(file("k").alias("file"), F.lit("T").alias("name"), goal.alias("source"), F.lit("T").alias("original"))
    stars = rows.where(star).select(file("k").alias("file"), file("before").alias("source"))
    found = exports.schema_index(definitions, named, stars)
    return found.select("file", "name", "from_file", "state")


@register("""
    WITH RECURSIVE e AS (SELECT DISTINCT n_nationkey AS src, (n_nationkey * 7 + 3) % 25 AS dst FROM nation UNION SELECT DISTINCT n_nationkey, (n_nationkey + 5) % 30 FROM nation),
    r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src)
    SELECT e.src, e.dst, e.src = e.dst OR EXISTS (SELECT 1 FROM r WHERE r.src = e.dst AND r.dst = e.src) AS stays FROM e
""")
def recursive_references(spark, sf):
    """Which references between schemas must stand, as their targets lead back; the others can be written out."""
    n = F.col("n_nationkey").cast("long")
    edges = table(spark, sf, "nation").select(n.alias("src"), F.explode(F.array((n * 7 + 3) % 25, (n + 5) % 30)).alias("dst"))
    return references.recursive_references(edges)


@register("""
    SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'string' WHEN 2 THEN 'number' END AS value,
        CASE o_orderkey % 6 WHEN 1 THEN 'cyclic' WHEN 3 THEN 'no-member' WHEN 4 THEN 'dangling' END AS code, CASE o_orderkey % 6 WHEN 5 THEN 'Customer' || o_custkey END AS leads_to FROM orders
""")
def indexed_accesses(spark, sf):
    """Accesses ``T["a"][0]...`` over orders' types: through aliases, items of lists and of tuples, into circles of aliases, to types that aren't there, and to names that a type lacks."""
    orders = table(spark, sf, "orders")
    k = F.col("o_orderkey").cast("string")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    none = F.lit(None).cast("string")
    entry = lambda t, n, to, v: F.struct(t.alias("type"), F.lit(n).alias("name"), to.alias("target"), v.alias("value"))
    order, lines = text("Order", k), text("Lines", k)
    members = orders.select(F.explode(F.array(
        entry(order, "lines", text("Alias", k), none), entry(lines, "*", text("Line", k), none), entry(text("Line", k), "flag", none, F.lit("string")), entry(order, "pair", text("Pair", k), none),
        entry(text("Pair", k), "1", none, F.lit("number")), entry(order, "owner", text("Owner", k), none), entry(order, "lost", text("Lost", k), none), entry(order, "loop", text("LoopA", k), none),
    )).alias("m")).select("m.*").unionByName(orders.select(text("Customer", F.col("o_custkey").cast("string")).alias("type"), F.lit("name").alias("name"), none.alias("target"), F.lit("string").alias("value")).distinct())
    to = lambda a, b: F.struct(a.alias("type"), b.alias("target"))
    links = orders.select(F.explode(F.array(to(text("Alias", k), lines), to(text("Owner", k), text("Customer", F.col("o_custkey").cast("string"))), to(text("LoopA", k), text("LoopB", k)), to(text("LoopB", k), text("LoopA", k)), to(text("My", k), order))).alias("l")).select("l.*")
    steps = [["lines", "4", "flag"], ["loop", "x"], ["pair", "1"], ["pair", "2"], ["lost", "x"], ["owner"]]
    chosen = F.element_at(F.array(*[F.array(*[F.lit(s) for s in one]) for one in steps]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    found = references.access_paths(orders.select(F.col("o_orderkey").alias("id"), text("My", k).alias("type"), chosen.alias("steps")), members, links)
    return found.select("id", "value", "code", F.when(F.col("value").isNull() & F.col("code").isNull(), F.col("type")).alias("leads_to"))


@register("""
    WITH f AS (SELECT c_custkey AS k, '/r' || c_nationkey || '/s' || c_custkey % 10 || '/c' || c_custkey AS d FROM customer), m AS (SELECT '/r' || n_nationkey AS d, '/r' || n_nationkey || '/package.json' AS p FROM nation WHERE n_nationkey % 2 = 0
        UNION ALL SELECT '/', '/tsconfig.json' UNION ALL SELECT '/r' || n_nationkey || '/s3', '/r' || n_nationkey || '/s3/tsconfig.json' FROM nation UNION ALL SELECT '/r' || n_nationkey || '/s3', '/r' || n_nationkey || '/s3/package.json' FROM nation)
    SELECT k AS c_custkey, row_number() OVER (PARTITION BY k ORDER BY length(m.d) DESC, CASE WHEN p LIKE '%tsconfig.json' THEN 0 ELSE 1 END) - 1 AS ord, p AS found FROM f JOIN m ON starts_with(f.d || '/', CASE WHEN m.d = '/' THEN '/' ELSE m.d || '/' END)
""")
def nearest_files(spark, sf):
    """The configuration files above each customer's place, the nearest first."""
    nation = table(spark, sf, "nation").select(F.concat(F.lit("/r"), "n_nationkey").alias("d"), "n_nationkey")
    name = lambda d, f: F.concat(d, F.lit(f))
    inner = nation.select(F.explode(F.array(name(F.col("d"), "/s3/tsconfig.json"), name(F.col("d"), "/s3/package.json"), F.when(F.col("n_nationkey") % 2 == 0, name(F.col("d"), "/package.json")), name(F.col("d"), "/s3/other.json"), F.lit("/tsconfig.json"))).alias("path")).where("path IS NOT NULL")
    places = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("/r"), "c_nationkey", F.lit("/s"), F.col("c_custkey") % 10, F.lit("/c"), "c_custkey", F.lit("/")).alias("path"))
    return paths.nearest_files(places, inner, ["tsconfig.json", "package.json"]).join(places, "path").select("c_custkey", "ord", "found")


@register("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'src/lib/x' || p_partkey WHEN 1 THEN 'src/b' || p_size WHEN 2 THEN 'only/exact' WHEN 3 THEN 'src/' || 'exact/y' END AS target FROM part""")
def aliased_imports(spark, sf):
    """Import sources with the longest alias that fits put in place."""
    k = F.col("p_partkey")
    source = F.when(k % 5 == 0, F.concat(F.lit("@/lib/x"), k)).when(k % 5 == 1, F.concat(F.lit("@/b"), "p_size")).when(k % 5 == 2, "@/exact").when(k % 5 == 3, "@/exact/y").otherwise(F.concat(F.lit("react"), "p_size"))
    aliases = spark.createDataFrame([("@/*", "src/*"), ("@/lib/*", "src/lib/*"), ("@/exact", "only/exact"), ("~/*", "home/*")], "alias string, path string")
    return paths.aliased(table(spark, sf, "part").select("p_partkey", source.alias("source")), aliases).select("p_partkey", "target")


_AT = "/paths/~1a/get/parameters/0"
_OUT = "/paths/~1a/get/responses/200"
_STRUCTURE = (
    ("/openapi", """'"3.1.0"'"""), (f"{_AT}/in", """'"query"'"""), (f"{_AT}/name", """'"q"'"""), (f"{_AT}/examples/e/x-oai-dataValue/examples/z/dataValue", "k"), (f"{_AT}/examples/e/x-oai-dataValue/parameters/0/in", """'"querystring"'"""),
    (f"{_AT}/examples/e/value/examples/z/dataValue", "k"), (f"{_AT}/examples/e/value/parameters/0/in", """'"querystring"'"""), (f"{_AT}/examples/r/$ref", """'"#/x"'"""), (f"{_AT}/examples/r/dataValue", "'2'"), (f"{_OUT}/x-oai-summary", """'"s"'"""),
    (f"{_OUT}/description", """'"d"'"""), (f"{_OUT}/content/m~1t/x-oai-itemSchema/properties/responses/properties/summary/type", "k"), (f"{_OUT}/content/m~1t/x-own/responses/200/summary", "k"), ("/components/securitySchemes/S/x-oai-deprecated", "'true'"),
    ("/components/schemas/responses/properties/summary/examples/e/dataValue", "k"), ("/x-team/paths/~1a/get/responses/200/summary", "k"),
)


@register(" UNION ALL ".join(f"SELECT p_partkey, '{pointer}' AS pointer, {'CAST(p_partkey AS VARCHAR)' if value == 'k' else value} AS value FROM part WHERE p_partkey % 3 > 0 OR '{pointer}' <> '/components/securitySchemes/S/x-oai-deprecated'" for pointer, value in _STRUCTURE))
def finalized_structures(spark, sf):
    """Documents for an older version whose examples, extensions and schemas hold the names of fields that move elsewhere; some say no version."""
    k = "@k@"
    scheme = ',"securitySchemes":{"S":{"deprecated":true}}'
    payload = f'{{"examples":{{"z":{{"dataValue":{k}}}}},"parameters":[{{"in":"querystring"}}]}}'
    parameter = f'{{"in":"querystring","name":"q","examples":{{"e":{{"dataValue":{payload}}},"r":{{"$ref":"#/x","dataValue":2}}}}}}'
    media = f'{{"itemSchema":{{"properties":{{"responses":{{"properties":{{"summary":{{"type":{k}}}}}}}}}}},"x-own":{{"responses":{{"200":{{"summary":{k}}}}}}}}}'
    operation = f'{{"parameters":[{parameter}],"responses":{{"200":{{"summary":"s","description":"d","content":{{"m/t":{media}}}}}}}}}'
    inner = f'{{"responses":{{"properties":{{"summary":{{"examples":{{"e":{{"dataValue":{k}}}}}}}}}}}}}'
    text = f'{{@v@"paths":{{"/a":{{"get":{operation}}}}},"components":{{"schemas":{inner}@s@}},"x-team":{{"paths":{{"/a":{{"get":{{"responses":{{"200":{{"summary":{k}}}}}}}}}}}}}}}'
    third = F.col("p_partkey") % 3
    filled = F.replace(F.replace(F.replace(F.lit(text), F.lit("@k@"), F.col("p_partkey").cast("string")), F.lit("@v@"), F.when(third == 1, '"openapi":"3.2.0",').otherwise("")), F.lit("@s@"), F.when(third > 0, scheme).otherwise(""))
    return nodes.finalize(nodes.nodes(spread(table(spark, sf, "part")).select("p_partkey", F.parse_json(filled).alias("doc")), "p_partkey"), "p_partkey", "3.1")
