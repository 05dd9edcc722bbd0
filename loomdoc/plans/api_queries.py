"""Queries over annotations and operations that are made of the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomdoc.functions import annotations, http, registries
from loomdoc.functions import text as texts
from loomdoc.operators import operations
from loomdoc.operators.records import computed_once
from loomdoc.plans.named import register
from loomdoc.sources.tables import spread, table

_COMMENT = (
    "*\n * Order {k}\n * @openapi\n * @description Priority {p}\n * @operationId get-{k}\n * @method post\n * @tag Orders\n * @tagKind nav\n * @contentType text/{s}\n * @query Page<Order{s}>\n"
    " * @requestBody Body{s} required\n * @body Other optional\n * @itemSchema request: Item{s}\n * @responseItem Out{s} rest\n * @response 201:Order{s}:Made {k}: fine\n * @responseSummary 2XX Fine {k}\n * @responseSummary All {k}\n"
    " * @server https://{s}.example.com/{k} \"Server {k}\"\n * @externalDocs https://docs.example.com/{k}\n * @security Bearer:read, write|all;Basic\n * @security key\n * @responseHeader 201 X-Id integer Id of {k}\n"
    " * @responseHeader 201 X-Ref Ref{s}\n * @link 201 self get-{k} {\"id\": \"{k}\"}\n * @link 404 up #/paths/{k}\n * @callback done {$url} Done{s}\n * @querystring Find<{s}> as q{k}\n * @deprecated Since {k}"
)


def _comments(spark, sf):
    """A comment of every order: its key, priority and status in place of ``{k}``, ``{p}`` and ``{s}``."""
    filled = F.lit(_COMMENT)
    for mark, value in (("{k}", F.col("o_orderkey").cast("string")), ("{p}", F.col("o_orderpriority")), ("{s}", F.col("o_orderstatus"))):
        filled = F.replace(filled, F.lit(mark), value)
    return computed_once(spread(table(spark, sf, "orders")).select("o_orderkey", filled.alias("raw")), c=annotations.clean_comment(F.col("raw"))).select("o_orderkey", "c")


@register(
    "SELECT o_orderkey, 'Order ' || o_orderkey AS summary, 'Priority ' || o_orderpriority AS description, 'get-' || o_orderkey AS operation_id, 'POST' AS method, 'nav' AS tag_kind, 'Orders' AS tag, true AS is_openapi, false AS is_ignored, "
    "'text/' || o_orderstatus AS content_type, 'Page<Order' || o_orderstatus || '>' AS params_type, 'Since ' || o_orderkey AS reason FROM orders"
)
def annotation_lines(spark, sf):
    c = F.col("c")
    return _comments(spark, sf).select(
        "o_orderkey", annotations.summary(c).alias("summary"), annotations.line_tag(c, "@description").alias("description"), annotations.token_tag(c, "@operationId").alias("operation_id"), F.upper(annotations.token_tag(c, "@method")).alias("method"),
        annotations.line_tag(c, "@tagKind").alias("tag_kind"), annotations.parse_block(c)["tag"].alias("tag"), annotations.has_tag(c, "@openapi").alias("is_openapi"), annotations.has_tag(c, "@ignore").alias("is_ignored"),
        annotations.bounded_tag(c, "@requestContentType", "@contentType").alias("content_type"), annotations.type_tag(c, "@query", "@queryParams", "@params").alias("params_type"), annotations.deprecation_reason(c).alias("reason"),
    )


@register(
    "SELECT o_orderkey, 'Body' || o_orderstatus AS body_type, true AS body_required, 'Item' || o_orderstatus AS request_item, 'Out' || o_orderstatus AS response_item, '201' AS code, 'Order' || o_orderstatus AS response_type, "
    "'Made ' || o_orderkey || ':fine' AS response_text, 'All ' || o_orderkey AS summary, 'Fine ' || o_orderkey AS ok_summary, 'Find<' || o_orderstatus || '>' AS querystring, 'q' || o_orderkey AS querystring_name FROM orders"
)
def annotation_bodies(spark, sf):
    c = F.col("c")
    parts = {"body": annotations.request_body(c), "items": annotations.item_types(c), "response": annotations.response(c), "said": annotations.response_summaries(c), "query": annotations.querystring(c)}
    body, items, response, said, query = (F.col(name) for name in parts)
    return computed_once(_comments(spark, sf), **parts).select(
        "o_orderkey", body["type"].alias("body_type"), body["required"].alias("body_required"), items["request"].alias("request_item"), items["response"].alias("response_item"), response["code"].alias("code"), response["type"].alias("response_type"),
        response["description"].alias("response_text"), said["primary"].alias("summary"), said["by_status"]["2XX"].alias("ok_summary"), query["type"].alias("querystring"), query["name"].alias("querystring_name"),
    )


@register(
    "SELECT o_orderkey, 'https://' || o_orderstatus || '.example.com/' || o_orderkey AS url, 'Server ' || o_orderkey AS server, 'https://docs.example.com/' || o_orderkey AS docs, 'Bearer=read+write+all;Basic=|key=' AS security FROM orders"
)
def annotation_servers(spark, sf):
    c = F.col("c")
    shown = F.array_join(F.transform(annotations.security(c), lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "+"))), ";")), "|")
    found = computed_once(_comments(spark, sf), server=annotations.servers(c)[0], docs=annotations.external_docs(c)["url"], security=shown)
    return found.select("o_orderkey", F.col("server")["url"].alias("url"), F.col("server")["description"].alias("server"), "docs", "security")


@register(
    "SELECT o_orderkey, '201' AS status, 'X-Id' AS name, 'integer' AS type, NULL AS ref, 'Id of ' || o_orderkey AS description FROM orders UNION ALL "
    "SELECT o_orderkey, '201', 'X-Ref', NULL, '#/components/schemas/Ref' || o_orderstatus, NULL FROM orders"
)
def annotation_headers(spark, sf):
    return _comments(spark, sf).select("o_orderkey", F.explode(annotations.response_headers(F.col("c"))).alias("h")).select("o_orderkey", "h.*")


@register(
    "SELECT o_orderkey, '201' AS status, 'self' AS name, 'get-' || o_orderkey AS operation_id, NULL AS operation_ref, CAST(o_orderkey AS VARCHAR) AS id FROM orders UNION ALL "
    "SELECT o_orderkey, '404', 'up', NULL, '#/paths/' || o_orderkey, NULL FROM orders"
)
def annotation_links(spark, sf):
    rows = _comments(spark, sf).select("o_orderkey", F.explode(annotations.links(F.col("c"))).alias("l"))
    return rows.select("o_orderkey", "l.status", "l.name", "l.operation_id", "l.operation_ref", F.get_json_object("l.parameters", "$.id").alias("id"))


@register("SELECT o_orderkey, 'done' AS name, '{$url}' AS expression, '#/components/callbacks/Done' || o_orderstatus AS ref FROM orders")
def annotation_callbacks(spark, sf):
    return _comments(spark, sf).select("o_orderkey", F.explode(operations.callback_map(annotations.callbacks(F.col("c")))).alias("b")).select("o_orderkey", "b.*")


@register(
    "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'request' WHEN 1 THEN 'query' WHEN 2 THEN 'response' ELSE 'header' END AS target, CASE event_id % 4 WHEN 0 THEN 'example' WHEN 1 THEN event_type WHEN 2 THEN NULL ELSE event_type END AS name, "
    "CASE event_id % 4 WHEN 0 THEN 'json' WHEN 1 THEN 'text' WHEN 2 THEN 'ref' ELSE 'ref' END AS kind, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN CAST(user_id AS VARCHAR) WHEN 2 THEN event_type ELSE 'x' || user_id END AS payload FROM events"
)
def annotation_examples(spark, sf):
    key, kind, user = F.col("event_id") % 4, F.col("event_type"), F.col("user_id").cast("string")
    raw = F.when(key == 0, F.concat(F.lit("body: "), F.col("props"))).when(key == 1, F.concat(F.lit("query:"), kind, F.lit(":"), user)).when(key == 2, F.concat(F.lit("response: "), kind)).otherwise(F.concat(F.lit("header:"), kind, F.lit(": ref:x"), user))
    found = table(spark, sf, "events").select("event_id", F.explode(annotations.examples(F.concat(F.lit("@examples "), raw, F.lit("\n@examples nowhere:x")))).alias("e"))
    return found.select("event_id", "e.*")


@register(
    "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'json' WHEN 1 THEN 'sequential-json' WHEN 2 THEN 'sequential-multipart' WHEN 3 THEN 'text' ELSE 'unknown' END AS kind, p_size % 5 IN (1, 2) AS sequential, "
    "p_size % 3 = 0 AS registered, p_size % 2 = 0 AS reserved, CASE p_size % 2 WHEN 0 THEN 'x-oai-summary' END AS extension FROM part"
)
def registry_lookups(spark, sf):
    media = F.element_at(F.array(F.lit("application/a+json"), F.lit("application/JSONL"), F.lit("multipart/x"), F.lit("text/x"), F.lit("font/x")), F.col("p_size") % 5 + 1)
    format_ = F.element_at(F.array(F.lit("uuid"), F.lit("uuid4"), F.lit("")), F.col("p_size") % 3 + 1)
    name = F.element_at(F.array(F.lit("x-sap-a"), F.lit("x-a")), F.col("p_size") % 2 + 1)
    version = F.element_at(F.array(F.lit("3.1"), F.lit("3.2")), F.col("p_size") % 2 + 1)
    return table(spark, sf, "part").select(
        "p_partkey", registries.media_group(media).alias("kind"), registries.is_sequential(media).alias("sequential"), registries.is_registered_format(format_).alias("registered"), registries.is_reserved_namespace(name).alias("reserved"),
        registries.extension_of(F.lit("summary"), version).alias("extension"),
    )


@register(
    "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'x-oai-summary' ELSE 'summary' END AS moved, CASE WHEN p_size % 2 = 0 THEN 'x-oai-summary' ELSE 'summary' END AS promoted, p_name AS value FROM part"
)
def extension_fields(spark, sf):
    even = F.col("p_size") % 2 == 0
    map_ = F.create_map(F.lit("summary"), F.col("p_name"), F.lit("other"), F.lit("x"))
    moved = F.when(even, registries.move_fields(map_, "3.1")).otherwise(registries.move_fields(map_, "3.2"))
    back = F.when(even, registries.promote_fields(moved, "3.1")).otherwise(registries.promote_fields(registries.move_fields(map_, "3.0"), "3.2"))
    first = lambda m: F.filter(F.map_entries(m), lambda e: e["key"] != "other")[0]
    return table(spark, sf, "part").select("p_partkey", first(moved)["key"].alias("moved"), first(back)["key"].alias("promoted"), first(back)["value"].alias("value"))


@register(
    "SELECT page_id, './p' || page_id || '.json' AS near, '../../b/' || page_id AS far, CASE WHEN page_id % 2 = 0 THEN 'yaml' ELSE 'json' END AS format, page_id % 3 = 0 AS within, 'a/b~' || page_id AS token, "
    "CASE page_id % 4 WHEN 0 THEN '3.0' WHEN 1 THEN '3.1' WHEN 2 THEN '3.2' ELSE '3.3-preview' END AS version FROM pages"
)
def document_references(spark, sf):
    k = F.col("page_id").cast("string")
    path = F.concat(F.lit("/a/x."), F.when(F.col("page_id") % 2 == 0, "YML").otherwise("txt"))
    version = F.element_at(F.array(F.lit("2.0"), F.lit("3.1.9"), F.lit("4.1"), F.lit("3.3.0-preview")), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, sf, "pages").select(
        "page_id", http.relative_uri(F.lit("/d/a.json"), F.concat(F.lit("/d/p"), k, F.lit(".json"))).alias("near"), http.relative_uri(F.lit("/d/e/a/f.json"), F.concat(F.lit("/d/b/"), k)).alias("far"), http.document_format(path).alias("format"),
        http.inside(F.lit("/r/"), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/r/"), k)).otherwise("/rx")).alias("within"), http.pointer_token(F.concat(F.lit("a~1b~0"), k)).alias("token"), http.document_version(version).alias("version"),
    )


@register(
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'multipart/form-data' WHEN 'O' THEN 'text/x' ELSE 'application/json' END AS content_type, CASE WHEN o_orderstatus <> 'F' THEN '#/components/schemas/T' || o_orderkey END AS ref, "
    "o_orderstatus = 'F' AS default_file, CASE WHEN o_orderstatus = 'F' THEN 'Multipart form data containing a file upload.' END AS description FROM orders WHERE o_orderstatus IN ('F', 'O', 'P')"
)
def request_bodies(spark, sf):
    status = F.col("o_orderstatus")
    rows = table(spark, sf, "orders").where("o_orderstatus IN ('F', 'O', 'P')").select(
        "o_orderkey", F.when(status == "F", "").otherwise(F.concat(F.lit("T"), "o_orderkey")).alias("body_type"), F.when(status == "F", "multipart/form-data").when(status == "O", "text/x").alias("content_type"),
        F.lit("").alias("item_type"), F.lit("").alias("description"), F.lit(False).alias("required"),
    )
    return operations.request_bodies(rows).select("o_orderkey", "body.content_type", "body.ref", "body.default_file", "body.description")


@register(
    "SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN '204' WHEN 1 THEN '201' WHEN 2 THEN '302' ELSE '200' END AS code, CASE l_linenumber % 4 WHEN 0 THEN 'No Content' ELSE 'Successful response' END AS description, "
    "CASE l_linenumber % 4 WHEN 1 THEN 'application/json' WHEN 3 THEN 'text/event-stream' END AS content_type, CASE l_linenumber % 4 WHEN 1 THEN '#/components/schemas/L' || l_returnflag END AS ref, "
    "CASE l_linenumber % 4 WHEN 1 THEN 2 END AS depth, CASE l_linenumber % 4 WHEN 3 THEN 'string' END AS item, l_linenumber % 4 = 2 AS redirects FROM lineitem"
)
def typed_responses(spark, sf):
    k = F.col("l_linenumber") % 4
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(k == 2, "302").otherwise("").alias("code"), F.when(k == 0, "DELETE").when(k == 1, "POST").otherwise("GET").alias("method"), F.lit("").alias("description"), F.lit("").alias("item_type"),
        F.when(k == 1, F.concat(F.lit("L"), F.col("l_returnflag"), F.lit("[][]"))).when(k == 3, "string").otherwise("").alias("type"), F.when(k == 3, "text/event-stream").otherwise("").alias("content_type"),
    )
    r = F.col("response")
    made = operations.responses(rows)
    return made.select("l_orderkey", "l_linenumber", r["code"].alias("code"), r["description"].alias("description"), r["content_type"].alias("content_type"), r["schema"]["ref"].alias("ref"), r["schema"]["depth"].alias("depth"), r["item_schema"]["type"].alias("item"), r["location_header"].alias("redirects"))


def _schemas(spark, sf):
    part = spread(table(spark, sf, "part"))
    value = F.concat(
        F.lit('{"type":"object","required":["name"],"properties":{"id":{"type":"integer"},"name":{"type":"string","description":"'), F.col("p_name"), F.lit('"},"size":{"type":"integer","enum":['), F.col("p_size").cast("string"),
        F.lit(',1]},"filter":{"type":"object"},"photo":{"type":"object","description":"A File"},"blob":{"type":"array","items":{"type":"string","format":"binary"}},"free":{"in":"header"}}}'),
    )
    return part.select("p_partkey", F.parse_json(value).alias("schema"))


@register(
    "SELECT p_partkey, n.name, CASE n.name WHEN 'free' THEN 'header' ELSE 'query' END AS location, n.name = 'name' AS is_required, CASE n.name WHEN 'id' THEN 'integer' WHEN 'size' THEN 'integer' WHEN 'filter' THEN 'object' WHEN 'photo' THEN 'object' WHEN 'blob' THEN 'array' ELSE 'string' END AS type, "
    "CASE WHEN n.name IN ('filter', 'photo') THEN 'deepObject' END AS style, CASE n.name WHEN 'id' THEN '123' WHEN 'size' THEN CAST(p_size AS VARCHAR) WHEN 'name' THEN 'name' ELSE 'example' END AS example, "
    "CASE n.name WHEN 'name' THEN p_name WHEN 'photo' THEN 'A File' END AS description FROM part, (VALUES ('id'), ('name'), ('size'), ('filter'), ('photo'), ('blob'), ('free')) AS n(name)"
)
def request_parameters(spark, sf):
    rows = operations.properties(_schemas(spark, sf), "p_partkey").withColumnRenamed("owner", "p_partkey")
    return operations.parameters(rows).select("p_partkey", "name", "location", "is_required", "type", "style", "example", "description")


@register(
    "SELECT p_partkey, n.name, 'application/octet-stream' AS part_type, n.name = 'photo' AS rewritten FROM part, (VALUES ('photo'), ('blob')) AS n(name)"
)
def multipart_parts(spark, sf):
    rows = operations.properties(_schemas(spark, sf), "p_partkey").withColumnRenamed("owner", "p_partkey")
    return operations.multipart_encoding(operations.form_data(rows)).select("p_partkey", "name", "part_type", (F.coalesce("media_type", F.lit("")) == "application/octet-stream").alias("rewritten"))


@register(
    "SELECT page_id, i AS ord, 'n' || i AS name, 'example' AS example, 'Path parameter: n' || i AS description FROM pages, (VALUES (0), (1)) AS v(i) WHERE i <= page_id % 2"
)
def default_path_parameters(spark, sf):
    path = F.when(F.col("page_id") % 2 == 1, "/a/{n0}/{n1}").otherwise("/a/{n0}")
    rows = operations.default_path_parameters(table(spark, sf, "pages").select("page_id", texts.path_parameters(path).alias("names")))
    return rows.select("page_id", "ord", "name", "example", "description")


@register(
    "SELECT l_orderkey, '200' AS status, 'H' || l_returnflag AS name, max(l_linenumber) AS line FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY l_orderkey, l_returnflag"
)
def attached_headers(spark, sf):
    """Headers of even orders, whose response is no reference: of each name the last."""
    orders = table(spark, sf, "lineitem").select("l_orderkey").distinct()
    made = orders.select("l_orderkey", F.lit("200").alias("code"), F.when(F.col("l_orderkey") % 2 == 1, "#/r").alias("ref"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", F.lit("200").alias("status"), F.concat(F.lit("H"), "l_returnflag").alias("name"), F.col("l_linenumber").alias("line"))
    return operations.attach(made, lines, ["l_orderkey"], "name", "line")


@register(
    "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'k' ELSE event_type END AS param, event_type AS example_name, CASE WHEN event_id % 2 = 0 THEN CAST(json_extract(props, '$.k') AS VARCHAR) ELSE CAST(user_id AS VARCHAR) END AS value FROM events WHERE event_id % 2 = 1 OR json_extract(props, '$.k') IS NOT NULL"
)
def parameter_examples(spark, sf):
    events = table(spark, sf, "events")
    even = F.col("event_id") % 2 == 0
    params = events.select("event_id", F.lit("query").alias("location"), F.when(even, "k").otherwise(F.col("event_type")).alias("name"))
    given = events.select("event_id", F.lit("query").alias("location"), F.col("event_type").alias("name"), F.when(even, F.try_parse_json("props")).otherwise(F.try_parse_json(F.col("user_id").cast("string"))).alias("value"))
    found = operations.parameter_examples(params, given, "event_id")
    return found.select("event_id", "param", "example_name", F.try_variant_get("value", "$", "string").alias("value"))


@register(
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Given' ELSE 'Orders' END AS tag, o_orderstatus = 'O' AS missing_path_type FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 3 = 0"
)
def registered_routes(spark, sf):
    status = F.col("o_orderstatus")
    routes = table(spark, sf, "orders").select(
        "o_orderkey", F.when(status == "O", "/{v}/orders/{id}").otherwise("/orders").alias("path"), (status == "P").alias("is_ignored"), (F.col("o_orderkey") % 3 == 0).alias("is_openapi"), F.when(status == "F", " Given ").alias("tag"), F.lit("").alias("path_params_type")
    )
    return operations.register_routes(routes, opt_in=True).select("o_orderkey", "tag", "missing_path_type")


@register(
    "SELECT p_partkey, 'Base' || p_size AS base, 'A|B<C, D>|' || p_brand AS arguments, lower(left(p_brand, 1)) || substr(p_brand, 2) || 'Schema' AS variable, 'date' AS format, p_name AS example, 'Size ' || p_size AS description, "
    "CASE p_size % 4 WHEN 0 THEN 'string' WHEN 1 THEN 'integer' WHEN 2 THEN 'number' ELSE 'boolean' END AS type FROM part"
)
def type_texts(spark, sf):
    size = F.col("p_size").cast("string")
    generic = http.generic_arguments(F.concat(F.lit("Base"), size, F.lit("<A, B<C, D>,"), F.col("p_brand"), F.lit(">")))
    said = http.property_comment(F.concat(F.lit("*\n * Size "), size, F.lit("\n * @format date\n * @example "), F.col("p_name"), F.lit("\n * @other x\n ")))
    field = F.element_at(F.array(F.lit("userName"), F.lit("stockCount"), F.lit("unitPrice"), F.lit("isOpen")), F.col("p_size") % 4 + 1)
    found = computed_once(spread(table(spark, sf, "part")).select("p_partkey", "p_brand", "p_size", "p_name"), generic=generic, said=said, field=http.field_type(field))
    generic, said = F.col("generic"), F.col("said")
    return found.select(
        "p_partkey", generic["base"].alias("base"), F.array_join(generic["arguments"], "|").alias("arguments"), http.schema_variable(F.col("p_brand")).alias("variable"), said["format"].alias("format"), said["example"].alias("example"), said["description"].alias("description"), F.col("field")["type"].alias("type")
    )


@register(
    "SELECT event_id, CASE event_type WHEN 'error' THEN 'Bad Request' WHEN 'view' THEN 'Not Found' ELSE 'HTTP 418' END AS said, 'BearerAuth;x,BasicAuth' AS auth, "
    "CASE WHEN event_type = 'error' THEN 'Old' || event_id || chr(10) || chr(10) || 'Deprecated: r' || event_id ELSE 'Old' || event_id END AS description FROM events"
)
def error_and_auth_texts(spark, sf):
    kind, k = F.col("event_type"), F.col("event_id").cast("string")
    code = F.when(kind == "error", "400").when(kind == "view", "404").otherwise("418")
    auth = annotations.auth_preset_text(F.when(F.col("event_id") >= 0, " bearer ; x,BASIC"))
    said = annotations.deprecation_text(F.concat(F.lit("Old"), k), kind == "error", F.concat(F.lit("r"), k))
    return table(spark, sf, "events").select("event_id", http.error_text(code).alias("said"), auth.alias("auth"), said.alias("description"))
