"""Named queries over the supplied tables, each with its DuckDB counterpart where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.functions import merges, predicates, schema_versions, text
from loomdoc.functions.jsonpath import query_json_path
from loomdoc.operators import diagnostics, documents, lookups, overlay, records, workflows
from loomdoc.plans import api_queries, catalog_queries, helper_queries, schema_queries, tree_queries  # noqa: F401
from loomdoc.plans.named import QUERIES, Query
from loomdoc.plans.named import register as _register
from loomdoc.sources.tables import table

#: Keywords of the status query, in order.
KEYWORDS = {"error": 500, "purchase": 402, "signup": 201, "view": 200}


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as documents: ``{"key", "lines": [{"n", "qty", "flag"}]}``, ordered by line."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", F.struct(F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("qty"), F.col("l_returnflag").alias("flag"), F.col("l_partkey").alias("part")).alias("line"))
    grouped = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    return grouped.select("l_orderkey", F.parse_json(F.to_json(F.struct(F.col("l_orderkey").alias("key"), "lines"))).alias("doc"))


def _int(name: str):
    return F.try_variant_get("value", f"$.{name}", "int")


_RANKED = "SELECT l_orderkey, l_linenumber AS n, l_returnflag AS flag, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_returnflag, l_partkey) AS pos, count(*) OVER (PARTITION BY l_orderkey) AS size FROM lineitem"


@_register("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def jp_child(spark, sf):
    docs = table(spark, sf, "events").select("event_id", F.try_parse_json("props").alias("doc"))
    return query_json_path(docs, "$.k").select("event_id", F.try_variant_get("value", "$", "int").alias("k"))


@_register("SELECT l_orderkey, l_linenumber AS n FROM lineitem")
def jp_wildcard(spark, sf):
    return query_json_path(_orders(spark, sf), "$.lines[*]").select("l_orderkey", _int("n").alias("n"))


@_register("SELECT l_orderkey, l_linenumber AS n FROM lineitem")
def jp_descendant(spark, sf):
    return query_json_path(_orders(spark, sf), "$..n").select("l_orderkey", F.try_variant_get("value", "$", "int").alias("n"))


@_register("SELECT l_orderkey, l_linenumber AS n FROM lineitem WHERE l_returnflag = 'R'")
def jp_filter_eq(spark, sf):
    return query_json_path(_orders(spark, sf), "$.lines[?(@.flag == 'R')]").select("l_orderkey", _int("n").alias("n"))


@_register("SELECT l_orderkey, l_linenumber AS n FROM lineitem WHERE l_returnflag <> 'R'")
def jp_filter_ne(spark, sf):
    return query_json_path(_orders(spark, sf), "$.lines[?(@.flag != 'R')]").select("l_orderkey", _int("n").alias("n"))


@_register(f"SELECT l_orderkey, n FROM ({_RANKED}) WHERE pos > greatest(0, size - 2)")
def jp_slice_neg(spark, sf):
    return query_json_path(_orders(spark, sf), "$.lines[-2:]").select("l_orderkey", _int("n").alias("n"))


@_register(f"SELECT l_orderkey, n FROM ({_RANKED}) WHERE pos = size")
def jp_index_neg(spark, sf):
    return query_json_path(_orders(spark, sf), "$.lines[-1]").select("l_orderkey", _int("n").alias("n"))


_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"


def _paths(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1).alias("path"))


@_register(f"SELECT page_id, regexp_full_match({_PATH}, '/en/[^/]*') AS ignored FROM pages")
def glob_ignore(spark, sf):
    return _paths(spark, sf).select("page_id", text.glob_matches(F.col("path"), "/en/*").alias("ignored"))


@_register("SELECT page_id, array_to_string(regexp_extract_all(regexp_replace(url, '/(\\d+)', '/{n\\1}', 'g'), '\\{([^}]+)\\}', 1), ',') AS names FROM pages")
def path_params(spark, sf):
    marked = F.regexp_replace("url", r"/(\d+)", "/{n$1}")
    return table(spark, sf, "pages").select("page_id", F.array_join(text.path_parameters(marked), ",").alias("names"))


@_register(f"SELECT page_id, 'get-' || regexp_replace(replace({_PATH}, '/', '-'), '^-', '') AS operation_id FROM pages")
def operation_id(spark, sf):
    return _paths(spark, sf).select("page_id", text.operation_id(F.col("path"), F.lit("get")).alias("operation_id"))


@_register("SELECT p_partkey, upper(left(p_name, 1)) || substr(p_name, 2) AS title FROM part")
def capitalize(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.capitalize(F.col("p_name")).alias("title"))


@_register("SELECT o_orderkey, '/orders/{id}/' || lower(o_orderstatus) AS path FROM orders")
def express_path(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", text.join_paths(F.lit("/orders//"), F.lit(":id?"), F.lower("o_orderstatus")).alias("path"))


@_register("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def last_wins(spark, sf):
    return records.last_wins(table(spark, sf, "events").select("user_id", "event_type", "event_id"), ["user_id"], "event_id")


@_register("SELECT user_id, arg_min(event_type, event_id) AS event_type, min(event_id) AS event_id FROM events GROUP BY user_id")
def dedupe_first(spark, sf):
    return records.first_wins(table(spark, sf, "events").select("user_id", "event_type", "event_id"), ["user_id"], "event_id")


@_register("SELECT k, coalesce(max(v) FILTER (layer = 0), max(v) FILTER (layer = 1)) AS v FROM (SELECT s_nationkey AS k, max(s_acctbal) AS v, 0 AS layer FROM supplier GROUP BY ALL UNION ALL SELECT c_nationkey, max(c_acctbal), 1 FROM customer GROUP BY ALL) GROUP BY k")
def layer_merge(spark, sf):
    upper = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.max("s_acctbal").alias("v"))
    lower = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.max("c_acctbal").alias("v"))
    return records.layered([upper, lower], ["k"])


@_register("SELECT user_id, arg_min(code, event_id) AS code FROM (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN '500' WHEN 'signup' THEN '201' WHEN 'view' THEN '2XX' ELSE '302' END AS code FROM events) WHERE code IN ('201', '2XX') GROUP BY user_id")
def first_success(spark, sf):
    code = F.when(F.col("event_type") == "error", "500").when(F.col("event_type") == "signup", "201").when(F.col("event_type") == "view", "2XX").otherwise("302")
    return records.first_success(table(spark, sf, "events").select("user_id", "event_id", code.alias("code")), ["user_id"], "code", "event_id")


@_register("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi_schemes(spark, sf):
    return table(spark, sf, "customer").select("c_custkey").join(table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@_register("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_unknown_ref(spark, sf):
    return table(spark, sf, "customer").select("c_custkey").join(table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@_register("SELECT l_orderkey, sha256(string_agg(CAST(l_linenumber AS VARCHAR) || '|' || CAST(l_partkey AS VARCHAR), chr(10) ORDER BY l_linenumber, CAST(l_linenumber AS VARCHAR) || '|' || CAST(l_partkey AS VARCHAR))) AS fingerprint FROM lineitem GROUP BY l_orderkey")
def fingerprint(spark, sf):
    return records.fingerprint(table(spark, sf, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey"], "l_linenumber")


@_register("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'added' WHEN doc_id % 10 = 1 THEN 'removed' ELSE 'changed' END AS change FROM documents WHERE doc_id % 10 IN (0, 1, 2)")
def input_diff(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    before, after = docs.where("doc_id % 10 <> 0"), docs.where("doc_id % 10 <> 1")
    return records.input_diff(before, after.withColumn("hash", F.when(F.col("doc_id") % 10 == 2, F.reverse("hash")).otherwise(F.col("hash"))), "doc_id", "hash")


@_register(f"SELECT event_type, count(*) AS n, min(CASE {' '.join(f'WHEN contains(event_type, {w!r}) THEN {c}' for w, c in KEYWORDS.items())} ELSE 400 END) AS status FROM events GROUP BY event_type")
def guess_status(spark, sf):
    status = text.guess_status(F.col("event_type"), KEYWORDS, 400)
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min(status).alias("status"))


@_register("SELECT n_nationkey, 'Nation ' || n_name || ' of ' || CAST(n_regionkey AS VARCHAR) AS line FROM nation")
def template_fill(spark, sf):
    variables = F.create_map(F.lit("NAME"), F.col("n_name"), F.lit("REGION"), F.col("n_regionkey").cast("string"))
    return table(spark, sf, "nation").select("n_nationkey", text.fill_template(F.lit("Nation {{NAME}} of {{REGION}}"), variables).alias("line"))


@_register("SELECT o_orderpriority AS severity, count(*) AS n FROM orders GROUP BY 1")
def severity_rollup(spark, sf):
    return records.severity_counts(table(spark, sf, "orders"), F.col("o_orderpriority"))


@_register("SELECT l_suppkey, sum(l_quantity) AS ms FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def top5(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("ms")).orderBy(F.desc("ms"), "l_suppkey").limit(5)


@_register("WITH RECURSIVE e AS (SELECT n_nationkey AS src, (n_nationkey * 2 + 1) % 25 AS dst FROM nation), r AS (SELECT src, dst, 1 AS steps FROM e UNION ALL SELECT r.src, e.dst, steps + 1 FROM r JOIN e ON r.dst = e.src WHERE steps < 8 AND r.src <> e.dst) SELECT src, dst, CAST(min(steps) AS INTEGER) AS steps FROM r GROUP BY ALL")
def ref_closure(spark, sf):
    edges = table(spark, sf, "nation").select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 2 + 1) % 25).alias("dst"))
    return records.closure(edges, 8).where("src <> dst OR steps = 1")


@_register("WITH RECURSIVE e AS (SELECT n_nationkey AS src, (n_nationkey * 2 + 1) % 25 AS dst FROM nation), r AS (SELECT src, dst, 1 AS steps FROM e UNION ALL SELECT r.src, e.dst, steps + 1 FROM r JOIN e ON r.dst = e.src WHERE steps < (SELECT count(*) FROM e)) SELECT src, dst, CAST(min(steps) AS INTEGER) AS steps FROM r GROUP BY ALL")
def ref_closure_whole(spark, sf):
    edges = table(spark, sf, "nation").select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 2 + 1) % 25).alias("dst"))
    return records.closure(edges)


@_register("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, CASE WHEN props IS NOT NULL THEN true END AS seen FROM events")
def overlay_update(spark, sf):
    docs = table(spark, sf, "events").select("event_id", F.col("props").alias("doc"))
    changed = overlay.apply_overlay(docs, overlay.resolve_actions([{"target": "$", "update": {"seen": True}}])).withColumn("doc", F.try_parse_json("doc"))
    return changed.select("event_id", F.try_variant_get("doc", "$.k", "int").alias("k"), F.try_variant_get("doc", "$.seen", "boolean").alias("seen"))


@_register("SELECT l_orderkey, count(*) FILTER (l_returnflag <> 'R') AS n FROM lineitem GROUP BY l_orderkey")
def overlay_remove(spark, sf):
    docs = _orders(spark, sf).withColumn("doc", F.to_json("doc"))
    changed = overlay.apply_overlay(docs, overlay.resolve_actions([{"target": "$.lines[?(@.flag == 'R')]", "remove": True}]))
    return changed.select("l_orderkey", F.json_array_length(F.get_json_object("doc", "$.lines")).cast("long").alias("n"))


@_register("SELECT n_nationkey, n_name || ',' || CAST(n_regionkey AS VARCHAR) AS names FROM nation")
def merge_fragment(spark, sf):
    base, more = (F.to_json(F.struct(F.array(F.col(c).cast("string")).alias("names"))) for c in ("n_name", "n_regionkey"))
    both = F.from_json(merges.merged(base, more, "fragment"), "names array<string>")
    return table(spark, sf, "nation").select("n_nationkey", F.array_join(both["names"], ",").alias("names"))


@_register("SELECT c_custkey, c_mktsegment AS segment, c_nationkey AS nation, true AS gone FROM customer")
def merge_patch(spark, sf):
    base = F.to_json(F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance")))
    more = F.concat(F.lit('{"balance": null, "nation": '), F.col("c_nationkey").cast("string"), F.lit("}"))
    got = F.from_json(merges.merged(base, more, "patch"), "segment string, balance double, nation int")
    return table(spark, sf, "customer").select("c_custkey", got.alias("d")).select("c_custkey", "d.segment", "d.nation", F.col("d.balance").isNull().alias("gone"))


@_register("SELECT n_regionkey AS region, '/' || n_name AS path, 'get' AS method, n_nationkey AS id FROM nation")
def operation_rows(spark, sf):
    item = F.create_map(F.lit("get"), F.struct(F.col("n_nationkey").alias("id")))
    entries = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("/"), "n_name"), item)))
    docs = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.parse_json(F.to_json(F.struct(entries.alias("paths")))).alias("doc"))
    return documents.operations_of(docs).select("region", "path", "method", F.try_variant_get("operation", "$.id", "int").alias("id"))


@_register("SELECT user_id, string_agg(m || '=' || CAST(v AS VARCHAR), ',' ORDER BY m) AS methods FROM (SELECT user_id, lower(event_type) AS m, max(event_id) AS v FROM events GROUP BY ALL) GROUP BY user_id")
def path_items(spark, sf):
    found = documents.path_items(table(spark, sf, "events"), "user_id", "event_type", "event_id", "event_id")
    return found.select("user_id", F.array_join(F.transform("methods", lambda m: F.concat_ws("=", m["method"], m["value"].cast("string"))), ",").alias("methods"))


@_register("SELECT event_type, arg_max(user_id, event_id) AS user_id, arg_max(value, event_id) AS value FROM events GROUP BY event_type")
def tag_fields(spark, sf):
    return documents.tag_fields(table(spark, sf, "events"), "event_type", ["user_id", "value"], "event_id")


@_register("SELECT l_returnflag, l_linestatus, min(l_orderkey) AS l_orderkey FROM lineitem GROUP BY ALL")
def distinct_responses(spark, sf):
    return documents.distinct_responses(table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_orderkey"), ["l_returnflag", "l_linestatus"], "l_orderkey")


@_register("SELECT p_partkey, p_name LIKE '%a%' AS ignored, regexp_matches(p_brand, '^Brand.*$') AS excluded, p_size BETWEEN 300 AND 399 AS redirect FROM part")
def name_predicates(spark, sf):
    ignored, excluded = predicates.route_ignored(F.col("p_name"), ["*a*"]), predicates.name_excluded(F.col("p_brand"), ["Brand*"])
    return table(spark, sf, "part").select("p_partkey", ignored.alias("ignored"), excluded.alias("excluded"), predicates.is_redirect(F.col("p_size").cast("string")).alias("redirect"))


@_register("SELECT o_orderkey, coalesce(c_name, s_name) AS name, CASE WHEN c_name IS NOT NULL THEN 0 WHEN s_name IS NOT NULL THEN 1 END AS found_in FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 2 = 0 LEFT JOIN supplier ON s_suppkey = o_custkey")
def lookup_priority(spark, sf):
    first = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    second = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    wanted = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("key"))
    return lookups.by_priority(wanted, [first, second], "key", "name").drop("key")


@_register("SELECT o_orderkey, CASE WHEN o_custkey * 3 IN (SELECT c_custkey FROM customer) THEN o_custkey * 3 WHEN o_custkey * 2 IN (SELECT c_custkey FROM customer) THEN o_custkey * 2 ELSE o_custkey END AS candidate FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) OR o_custkey * 2 IN (SELECT c_custkey FROM customer) OR o_custkey * 3 IN (SELECT c_custkey FROM customer)")
def lookup_first_candidate(spark, sf):
    tried = F.array(F.col("o_custkey") * 3, F.col("o_custkey") * 2, F.col("o_custkey"))
    return lookups.first_candidate(table(spark, sf, "orders"), "o_orderkey", tried, table(spark, sf, "customer"), "c_custkey")


@_register("SELECT o_orderkey, CAST(o_custkey AS VARCHAR) || ',' || CAST(o_custkey * 2 AS VARCHAR) AS candidates FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) AND o_custkey * 2 IN (SELECT c_custkey FROM customer)")
def lookup_all_candidates(spark, sf):
    tried = F.array(F.col("o_custkey"), F.col("o_custkey") * 2)
    found = lookups.all_candidates(table(spark, sf, "orders"), "o_orderkey", tried, table(spark, sf, "customer"), "c_custkey")
    return found.select("o_orderkey", F.array_join("candidates", ",").alias("candidates"))


@_register("SELECT event_id, '5' || CAST(n_nationkey AS VARCHAR) AS code FROM events JOIN region ON lower(r_name) LIKE left(event_type, 1) || '%' JOIN nation ON n_regionkey = r_regionkey")
def response_sets(spark, sf):
    sets = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("name", F.lower(F.left("r_name", F.lit(1))))
    sets = sets.groupBy("name").agg(F.collect_list(F.concat(F.lit("5"), F.col("n_nationkey").cast("string"))).alias("codes"))
    rows = table(spark, sf, "events").select("event_id", F.concat_ws(", ", F.left("event_type", F.lit(1)), F.lit("unknown")).alias("names"))
    return lookups.expand_response_sets(rows, sets, "event_id", "names").select("event_id", "code")


@_register("SELECT o_orderkey, '#/components/schemas/' || o_orderstatus AS reference, 'HTTP 4' || CAST(o_orderkey % 90 + 10 AS VARCHAR) || ' response' AS description FROM orders")
def extra_responses(spark, sf):
    listed = F.concat(F.lit("4"), (F.col("o_orderkey") % 90 + 10).cast("string"), F.lit(":"), F.col("o_orderstatus"), F.lit(", :gone"))
    return table(spark, sf, "orders").select("o_orderkey", F.explode(lookups.additional_responses(listed, {"500": "Server error"})).alias("r")).select("o_orderkey", "r.reference", "r.description")


@_register("SELECT user_id, event_type, max(event_id) FILTER (event_type <> 'click') AS last, CASE WHEN event_type = 'click' THEN 'low' ELSE 'high' END AS layer FROM events GROUP BY ALL")
def response_layers(spark, sf):
    low = table(spark, sf, "events").select("user_id", "event_type").distinct().select("user_id", "event_type", F.lit(None).cast("long").alias("last"), F.lit("low").alias("layer"))
    high = table(spark, sf, "events").where("event_type <> 'click'").groupBy("user_id", "event_type").agg(F.max("event_id").alias("last")).withColumn("layer", F.lit("high"))
    return lookups.responses_by_priority([low, high], "user_id", "event_type")


@_register("SELECT n_nationkey, '/src/region' || CAST(n_regionkey AS VARCHAR) || CASE WHEN n_regionkey % 2 = 0 THEN '.ts' ELSE '/index.js' END AS resolved FROM nation")
def import_paths(spark, sf):
    name = F.concat(F.lit("/src/region"), F.col("r_regionkey").cast("string"), F.when(F.col("r_regionkey") % 2 == 0, ".ts").otherwise("/index.js"))
    files = table(spark, sf, "region").select(name.alias("path"))
    imports = table(spark, sf, "nation").select("n_nationkey", F.lit("/src/nations/all.ts").alias("current"), F.concat(F.lit("../region"), F.col("n_regionkey").cast("string")).alias("source"))
    return lookups.resolve_imports(imports, files).select("n_nationkey", "resolved")


@_register("SELECT CAST(n_nationkey AS VARCHAR) AS name, 'input' AS side, CAST(n_nationkey AS VARCHAR) AS stored FROM nation UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 'output', CAST(n_nationkey AS VARCHAR) || CASE WHEN n_regionkey > 2 THEN 'Output' ELSE '' END FROM nation")
def schema_variants(spark, sf):
    rows = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("name"), "n_name", "n_regionkey")
    given = rows.select("name", F.lit("input").alias("side"), F.col("n_name").alias("text"))
    taken = rows.select("name", F.lit("output").alias("side"), F.when(F.col("n_regionkey") > 2, F.upper(F.concat("n_name", F.lit("x")))).otherwise(F.col("n_name")).alias("text"))
    return lookups.variant_names(given.union(taken)).select("name", "side", "stored")


@_register("SELECT 'unsupported-route-feature' AS code, 'info' AS severity, '/app/[[...' || n_name || ']]/page' AS subject FROM nation UNION ALL SELECT 'unknown-customer', 'error', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0)")
def diagnostic_rows(spark, sf):
    files = table(spark, sf, "nation").select(F.concat(F.lit("/app/[[..."), "n_name", F.lit("]]/page")).alias("file"))
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    unknown = diagnostics.unknown_references(orders, table(spark, sf, "customer").where("c_custkey % 5 <> 0"), "c_custkey", "unknown-customer", "error", F.col("o_orderkey"))
    return diagnostics.together([diagnostics.route_features(files, "file"), unknown]).drop("message")


@_register("SELECT l_orderkey, l_linenumber AS step FROM lineitem WHERE l_linenumber > 5")
def workflow_steps(spark, sf):
    step = F.struct(F.col("l_linenumber").cast("string").alias("stepId"), F.concat(F.lit("op"), F.col("l_linenumber").cast("string")).alias("operationId"))
    flows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(step).alias("steps"))
    text = F.to_json(F.struct(F.array(F.struct(F.lit("w").alias("workflowId"), "steps")).alias("workflows")))
    steps = workflows.steps_of(workflows.read_files(flows.select("l_orderkey", text.alias("text"))), "l_orderkey")
    known = table(spark, sf, "region").select(F.concat(F.lit("op"), (F.col("r_regionkey") + 1).cast("string")).alias("operationId"))
    return steps.join(known, "operationId", "left_anti").select("l_orderkey", F.col("stepId").cast("int").alias("step"))


@_register("SELECT p_partkey, p_size AS low, true AS above, true AS may_be_null, CASE WHEN p_size % 2 = 0 THEN 'string' ELSE 'integer' END AS kind FROM part")
def schema_downgrade(spark, sf):
    kind = F.when(F.col("p_size") % 2 == 0, "string").otherwise("integer")
    newer = F.to_json(F.struct(F.array(kind, F.lit("null")).alias("type"), F.col("p_size").alias("exclusiveMinimum")))
    older = F.from_json(schema_versions.schema_for(newer, "3.0"), "type string, minimum int, exclusiveMinimum boolean, nullable boolean")
    return table(spark, sf, "part").select("p_partkey", older.alias("s")).select("p_partkey", F.col("s.minimum").alias("low"), F.col("s.exclusiveMinimum").alias("above"), F.col("s.nullable").alias("may_be_null"), F.col("s.type").alias("kind"))


@_register("SELECT p_partkey, p_size AS above, 'integer,null' AS kinds FROM part")
def schema_upgrade(spark, sf):
    older = F.to_json(F.struct(F.lit("integer").alias("type"), F.lit(True).alias("nullable"), F.col("p_size").alias("minimum"), F.lit(True).alias("exclusiveMinimum")))
    newer = F.from_json(schema_versions.schema_for(older, "3.1"), "type array<string>, exclusiveMinimum int")
    return table(spark, sf, "part").select("p_partkey", newer["exclusiveMinimum"].alias("above"), F.array_join(newer["type"], ",").alias("kinds"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jp_filter_eq(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: oracle for name, (_, oracle) in QUERIES.items() if oracle}
