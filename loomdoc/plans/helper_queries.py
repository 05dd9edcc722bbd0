"""Queries over helper calls, pipelines with two sides, repaired chains, interfaces and timings."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomdoc.operators import chains, checks, configs, helpers, nodes, timings
from loomdoc.plans.named import register
from loomdoc.sources.tables import spread, table

_HELPERS = (
    ("literal", ("k",), """'{"type":"integer","enum":[' || p_partkey || ']}'"""), ("literal", ('["a","b",null]',), """'{"type":"string","enum":["a","b",null]}'"""), ("literal", ("[1,2.5]",), """'{"type":"number","enum":[1,2.5]}'"""),
    ("literal", (), """'{"type":"string"}'"""), ("instanceof", ("Date",), """'{"type":"string","format":"date-time"}'"""), ("instanceof", ("Blob",), """'{"type":"string","contentMediaType":"application/octet-stream"}'"""), ("instanceof", ("Own",), "'{}'"),
    ("promise", ('{"type":"number"}',), """'{"type":"number"}'"""), ("function", (), "'{}'"), ("preprocess", ("x => x", '{"type":"boolean"}'), """'{"type":"boolean"}'"""), ("codec", ('{"type":"string"}', '{"type":"number"}'), """'{"type":"number"}'"""),
    ("pipeline", ('{"type":"string"}', "Named"), "'{}'"), ("lazy", ('{"$ref":"#/A"}',), """'{"$ref":"#/A"}'"""), ("strictObject", ('{"type":"object","properties":{"n":{}}}',), """'{"type":"object","properties":{"n":{}},"additionalProperties":false}'"""),
    ("looseObject", (), """'{"type":"object","additionalProperties":true}'"""), ("templateLiteral", ('["v.",1,{"enum":["a+","b"]},{"type":"integer"},{"type":"boolean"},{}]',), """'{"type":"string","pattern":"^v\\\\.1(?:a\\\\+|b)-?\\\\d+(?:true|false).+$"}'"""),
    ("custom", ("File",), """'{"type":"string","contentMediaType":"application/octet-stream"}'"""), ("custom", ("x => true",), """'{"type":"object","additionalProperties":true}'"""), ("coerce.bigint", (), """'{"type":"integer","format":"int64"}'"""), ("odd", (), """'{"type":"string"}'"""),
)


@register("SELECT p_partkey, CASE p_partkey % 20 " + " ".join(f"WHEN {i} THEN {sql}" for i, (_, _, sql) in enumerate(_HELPERS)) + " END AS schema, p_partkey % 20 = 19 AS unknown FROM part")
def helper_schemas(spark, sf):
    """Calls of every helper, by key; and those of one that nothing is known of."""
    none = F.array().cast("array<string>")
    args = lambda given: F.array(*[F.col("p_partkey").cast("string") if a == "k" else F.lit(a) for a in given]) if given else none
    kind = lambda i: (F.col("p_partkey") % 20 == i)
    helper, given = F.lit(None).cast("string"), none
    for i, (name, values, _) in enumerate(_HELPERS):
        helper, given = F.when(kind(i), name).otherwise(helper), F.when(kind(i), args(values)).otherwise(given)
    calls = table(spark, sf, "part").select("p_partkey", helper.alias("helper"), given.alias("args"))
    unknown = helpers.unknown_helpers(calls, "p_partkey").select(F.col("subject").cast("long").alias("p_partkey"), F.lit(True).alias("unknown"))
    return calls.select("p_partkey", helpers.helper_schema(F.col("helper"), F.col("args")).alias("schema")).join(unknown, "p_partkey", "left").withColumn("unknown", F.coalesce("unknown", F.lit(False)))


_S, _N = '{"type":"string"}', '{"type":"number","minimum":0}'
_STAGES = (
    ((("schema", _S, None), ("transform", None, None), ("pipe", _N, None)), ("string",), ("number", 0)), ((("codec", _S, _N),), ("string",), ("number", 0)), ((("preprocess", _N, None), ("optional", None, None)), ("optional",), ("number", 0, "optional")),
    ((("schema", _S, None), ("transform", None, None)), ("string",), ()), ((("coerce", '{"type":"boolean"}', None), ("default", None, None)), ("optional",), ("boolean",)), ((("schema", _S, None), ("optional", None, None), ("default", None, None), ("readonly", None, None)), ("string", "optional"), ("string", "readOnly")),
    ((("lazy", '{"$ref":"#/A"}', None), ("catch", None, None)), (), ("#/A",)), ((("schema", _N, None), ("codec", _N, _S)), ("number", 0), ("string",)),
)


def _side_rows():
    attribute = lambda v: ("minimum", "0") if v == 0 else (v, "true") if v in ("optional", "readOnly") else ("$ref", f'"{v}"') if v.startswith("#") else ("type", f'"{v}"')
    return [(i, side, *attribute(v)) for i, (_, *both) in enumerate(_STAGES) for side, values in zip(("input", "output"), both, strict=True) for v in values]


@register("SELECT c_custkey, v.side, v.attribute, v.value FROM customer JOIN (VALUES " + ", ".join(f"({i}, '{side}', '{a}', '{v}')" for i, side, a, v in _side_rows()) + ") v(i, side, attribute, value) ON c_custkey % 8 = v.i")
def two_sided_schemas(spark, sf):
    """What goes into pipelines of stages and what comes out: transforms, pipes, codecs, preprocessing, coercion and defaults."""
    stage = lambda n, g, m: F.struct(F.lit(n).alias("stage"), F.lit(g).cast("string").alias("given"), F.lit(m).cast("string").alias("made"))
    lists = F.array(*[F.array(*[stage(*one) for one in stages]) for stages, _, _ in _STAGES])
    rows = table(spark, sf, "customer").select("c_custkey", F.posexplode(F.element_at(lists, (F.col("c_custkey") % 8 + 1).cast("int"))).alias("ord", "s")).select("c_custkey", "ord", "s.*")
    return helpers.two_sided(rows, ["c_custkey"])


@register("""
    SELECT o_orderkey, a AS attribute, v AS value FROM orders JOIN (VALUES (0, 'contentEncoding', 'base64'), (1, 'pattern', '^c[^\\s-]{8,}$'), (2, 'anyOf', 'ipv4|ipv6'), (2, 'description', 'd'), (3, 'description', 'x'), (3, 'examples', '[1]'), (3, 'deprecated', 'true'), (3, 'x-own', '{"a":1}'),
        (4, 'nullable', 'true'), (5, 'items', '#/R')) t(i, a, v) ON o_orderkey % 6 = i
""")
def chain_repairs(spark, sf):
    """Chains in which a later call takes away what an earlier one set, and calls whose arguments are of the wrong kind."""
    call = lambda kind, method, arg=None: F.struct(F.lit(kind).alias("type"), F.lit(method).alias("method"), F.lit(arg).cast("string").alias("arg"))
    made = (
        (("string", "email"), ("string", "base64")), (("string", "email"), ("string", "cuid")), (("string", "min", "3"), ("string", "email"), ("string", "ip"), ("string", "describe", "d")),
        (("string", "meta", '{"title":5,"description":"x","examples":[1],"deprecated":true,"id":"i","x-own":{"a":1}}'), ("string", "meta", '{"examples":"no","deprecated":"true","description":7}')), (("array", "rest", "#/R"), ("array", "nullable")), (("tuple", "rest", "#/R"),),
    )
    calls = F.element_at(F.array(*[F.array(*[call(*c) for c in chain]) for chain in made]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    rows = table(spark, sf, "orders").select("o_orderkey", F.posexplode(calls).alias("ord", "c")).select("o_orderkey", "ord", "c.*")
    return chains.chain_attributes(rows, ["o_orderkey"])


@register("""
    WITH RECURSIVE up AS (SELECT c_custkey AS owner, c_custkey AS place, 0 AS hops FROM customer UNION ALL SELECT owner, place // 3, hops + 1 FROM up WHERE place // 3 > 0 AND place // 3 <> place)
    SELECT owner, name, arg_min(value, hops) AS value, bool_or(hops = 0) AS required FROM (SELECT owner, hops, 'p' || place % 5 AS name, 'v' || place AS value FROM up WHERE place IN (SELECT c_custkey FROM customer)) GROUP BY owner, name
""")
def inherited_properties(spark, sf):
    """Interfaces that extend one another over many generations: the nearest ancestor's property counts, inherited ones aren't required."""
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("owner"))
    own = rows.select("owner", F.concat(F.lit("p"), F.col("owner") % 5).alias("name"), F.concat(F.lit("v"), "owner").alias("value"), F.lit(True).alias("required"))
    parents = rows.select("owner", F.floor(F.col("owner") / 3).cast("long").alias("parent"), F.lit(0).alias("ord")).where("parent > 0")
    return chains.extended_interfaces(own, parents)


@register("SELECT 'read' AS phase, count(*) AS rows, round(sum(o_totalprice), 1) AS amount FROM orders UNION ALL SELECT 'kept', count(*), round(sum(o_totalprice), 1) FROM orders WHERE o_orderstatus = 'F'")
def timed_phases(spark, sf):
    """Counts of two phases, taken in the pass that writes nothing but runs both."""
    taken = timings.Timings(spark, "r")
    price = {"price": F.col("o_totalprice")}
    read = taken.observed(table(spark, sf, "orders"), "read", price)
    kept = taken.observed(read.where("o_orderstatus = 'F'"), "kept", price)
    kept.write.format("noop").mode("overwrite").save()
    taken.done("read")
    taken.done("kept")
    return taken.rows().select("phase", "rows", F.round(F.col("amounts")["price"], 1).alias("amount"))


@register("SELECT event_type AS phase, count(DISTINCT user_id) AS runs, round(avg(ms), 4) AS mean_ms, round(min(ms), 4) AS least_ms, round(max(ms), 4) AS most_ms, round(avg(ms) / sum(avg(ms)) OVER (), 6) AS share FROM (SELECT user_id, event_type, sum(value) AS ms FROM events GROUP BY ALL) GROUP BY event_type")
def phase_averages(spark, sf):
    """Events as timed phases of their users' runs."""
    made = timings.averages(table(spark, sf, "events").select(F.col("user_id").cast("string").alias("run"), F.col("event_type").alias("phase"), F.col("value").alias("ms")))
    return made.select("phase", "runs", *[F.round(c, 4).alias(c) for c in ("mean_ms", "least_ms", "most_ms")], F.round("share", 6).alias("share"))


_SETTINGS = tuple((name, f"'{default}'") for name, default in configs.DEFAULTS.items() if name not in ("apiDir", "schemaType", "cache", "routerType")) + (
    ("apiDir", """'"c' || c_custkey || '"'"""), ("schemaType", """CASE WHEN c_custkey % 2 = 0 THEN '["zod","typescript","zod"]' ELSE '"typescript"' END"""), ("cache", "CASE WHEN c_custkey % 2 = 0 THEN 'false' ELSE 'true' END"), ("routerType", """'"app"'"""),
    ("schemaBackends", """CASE WHEN c_custkey % 2 = 0 THEN '["zod","typescript"]' ELSE '["typescript"]' END"""), ("openapiVersion", """'"' || CASE c_custkey % 4 WHEN 0 THEN '3.1' WHEN 1 THEN '3.3-preview' WHEN 2 THEN '3.2' ELSE '3.0' END || '"'"""),
    ("framework.kind", """CASE c_custkey % 3 WHEN 0 THEN '"nextjs"' WHEN 1 THEN '"reactrouter"' END"""), ("framework.router", """CASE c_custkey % 3 WHEN 0 THEN '"app"' END"""), ("framework.adapterPath", """CASE WHEN c_custkey % 3 > 0 THEN '"a.ts"' END"""),
    ("framework.modulePath", """CASE WHEN c_custkey % 3 > 0 THEN '"a.ts"' END"""), ("authPresets.bearer", """'"Own"'"""), ("authPresets.basic", """'"BasicAuth"'"""), ("authPresets.apikey", """'"ApiKeyAuth"'"""), ("authPresets.more", """'"M"'"""), ("arazzo", """'{"a":1}'"""),
)


@register(" UNION ALL ".join(f"SELECT c_custkey, '{name}' AS name, {value} AS value FROM customer WHERE {value} IS NOT NULL" for name, value in _SETTINGS))
def normalized_configs(spark, sf):
    """Every customer's configuration with its defaults."""
    k = F.col("c_custkey")
    version = F.element_at(F.array(*[F.lit(v) for v in ("3.1.9", "3.3.0-preview", "4.1", "odd")]), (k % 4 + 1).cast("int"))
    framework = F.when(k % 3 > 0, F.struct(F.when(k % 3 == 1, "react-router").otherwise("unheard").alias("kind"), F.lit("a.ts").alias("adapterPath")))
    doc = F.struct(F.concat(F.lit("c"), k).alias("apiDir"), F.when(k % 2 == 0, F.array(F.lit("zod"), F.lit("typescript"), F.lit("zod"))).alias("schemaType"), F.when(k % 2 == 0, F.lit(False)).alias("cache"), version.alias("openapi"), framework.alias("framework"),
                   F.struct(F.lit("Own").alias("bearer"), F.lit("M").alias("more")).alias("authPresets"), F.struct(F.lit(1).alias("a")).alias("arazzo"))
    return configs.normalized(spread(table(spark, sf, "customer")).select("c_custkey", F.parse_json(F.to_json(doc)).alias("doc")), "c_custkey")


@register("""
    SELECT CAST(c_custkey AS VARCHAR) AS subject, v.code FROM customer JOIN (VALUES (1, 'unsupported-route-feature'), (2, 'stream-response-hint'), (3, 'unsupported-route-feature'), (3, 'stream-response-hint')) v(i, code) ON c_custkey % 4 = v.i
    UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'unknown-framework' FROM customer WHERE c_custkey % 5 = 0
""")
def handler_hints(spark, sf):
    """Hints on handlers that answer with nothing or a stream, and configurations of unknown frameworks."""
    rows = table(spark, sf, "customer")
    k = F.col("c_custkey")
    hints = checks.handler_hints(rows.select(k.alias("file"), (k % 4).isin(1, 3).alias("not_found"), F.when(k % 4 > 1, True).alias("streams")))
    kind = F.when(k % 5 == 0, '{"framework":{"kind":"odd"}}').when(k % 5 == 1, '{"framework":{"kind":"hono"}}').otherwise("{}")
    unknown = configs.unknown_frameworks(rows.select("c_custkey", F.parse_json(kind).alias("doc")), "c_custkey")
    return hints.unionByName(unknown).select("subject", "code")


@register("""
    SELECT n_nationkey, p AS pointer, CASE v WHEN 'k' THEN CAST(n_nationkey AS VARCHAR) ELSE v END AS value FROM nation JOIN (VALUES ('/actions/0/target', '"$.own"'), ('/actions/0/update/a', 'k'), ('/actions/1/target', '"$.b"'), ('/actions/1/remove', 'true'),
        ('/actions/2/description', '"lost"')) t(p, v) ON true
    UNION ALL SELECT n_nationkey, 'OVERLAY_REUSABLE_ACTION_INLINED', 'warning' FROM nation UNION ALL SELECT n_nationkey, 'OVERLAY_TARGET_FORMAT_UNSUPPORTED', 'warning' FROM nation
""")
def overlay_reusable(spark, sf):
    """Overlays with reusable actions for a version without them: the actions are written out, and warnings say what went."""
    body = '{"targetFormat":"arazzo","components":{"actions":{"R":{"fields":{"target":"$.r","update":{"a":@k@}}}}},"actions":[{"$ref":"#/components/actions/R","target":"$.own"},{"target":"$.b","remove":true},{"$ref":"#/components/actions/None","description":"lost"}]}'
    docs = table(spark, sf, "nation").select("n_nationkey", F.parse_json(F.replace(F.lit(body), F.lit("@k@"), F.col("n_nationkey").cast("string"))).alias("doc"))
    rows, said = nodes.overlay_versions(nodes.nodes(docs, "n_nationkey"), "n_nationkey", "1.1")
    return rows.unionByName(said.select(F.col("subject").cast("int").alias("n_nationkey"), F.col("code").alias("pointer"), F.col("severity").alias("value")))
