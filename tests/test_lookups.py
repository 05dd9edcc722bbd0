import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdoc.functions import annotations, predicates, schema_algebra, schema_versions
from loomdoc.operators import diagnostics, lookups, workflows


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_predicates(spark):
    names = [("T",), ("TKey",), ("Task1",), ("a b",), ("Partial",), ("User",), (None,)]
    assert values(spark, names, "n string", predicates.component_name(F.col("n"))) == [False, False, True, False, False, True, None]
    paths = [("/admin/x",), ("/adminx",), ("/a.b",), ("/aXb",), (None,)]
    assert values(spark, paths, "p string", predicates.route_ignored(F.col("p"), ["/admin/*", "/a.b"])) == [True, False, True, True, None]
    assert values(spark, paths, "p string", predicates.name_excluded(F.col("p"), ["/admin/*", "/a.b"])) == [True, False, True, False, None]
    assert values(spark, paths, "p string", predicates.name_excluded(F.col("p"), []))[0] is False
    objects = [('{"$ref": "#/a", "summary": "s"}',), ('{"$ref": 1}',), ('{"$ref": "#/a", "in": "query"}',), ('{"in": "query", "name": "q"}',), ("[]",), ("{",), (None,)]
    assert values(spark, objects, "o string", predicates.reference_object(F.col("o"))) == [True, False, False, False, False, False, False]
    assert values(spark, objects, "o string", predicates.parameter_object(F.col("o"))) == [False, False, False, True, False, False, False]
    schemas = [('{"type": "object"}',), ('{"type": "object", "properties": {"a": {}}}',), ('{"type": "string"}',), ("{}",), (None,)]
    assert values(spark, schemas, "s string", predicates.concrete_schema(F.col("s"))) == [False, True, True, False, False]
    tokens = [("200",), ("4XX",), ("default",), ("9XX",), ("20",)]
    assert values(spark, tokens, "t string", predicates.status_token(F.col("t"))) == [True, True, True, False, False]


def test_lookups_keep_rows_and_priorities(spark):
    wanted = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (1, "a")], "id int, key string")
    first = spark.createDataFrame([("a", None), ("b", "x")], "key string, value string")
    second = spark.createDataFrame([("a", "y"), ("a", "z"), ("b", "q")], "key string, value string")
    got = lookups.by_priority(wanted, [first, second], "key", "value").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, "a", "y", 1), (1, "a", "y", 1), (2, "b", "x", 0), (3, None, None, None)], key=repr)
    assert lookups.by_priority(wanted.limit(0), [first, second], "key", "value").count() == 0


def test_imports(spark):
    files = spark.createDataFrame([("/a/b.ts",), ("/a/c/index.tsx",), ("/a/d.js",), ("/a/d.ts",)], "path string")
    imports = spark.createDataFrame([(f, s) for f, s in [("/a/x.ts", "./b"), ("/a/e/x.ts", "../c"), ("/a/x.ts", "./d"), ("/a/x.ts", "react"), ("/a/x.ts", "./none"), ("/a/x.ts", "./d.js")]], "current string, source string")
    got = {(r["current"], r["source"]): r["resolved"] for r in lookups.resolve_imports(imports, files).collect()}
    assert got == {("/a/x.ts", "./b"): "/a/b.ts", ("/a/e/x.ts", "../c"): "/a/c/index.tsx", ("/a/x.ts", "./d"): "/a/d.ts", ("/a/x.ts", "react"): None, ("/a/x.ts", "./none"): None, ("/a/x.ts", "./d.js"): "/a/d.js"}


def test_responses_and_headers(spark):
    got = values(spark, [("404:Err:not: here, 204:None, 500, :x",), (None,)], "t string", lookups.additional_responses(F.col("t"), {"404": "Missing"}))
    assert [tuple(r) for r in got[0]] == [("404", "#/components/schemas/Err", "not: here"), ("204", None, "No Content"), ("500", "#/components/responses/500", None)]
    assert got[1] is None
    responses = spark.createDataFrame([(1, "200"), (1, "404")], "id int, code string")
    headers = spark.createDataFrame([(1, "200", "B", "2"), (1, "200", "A", "1"), (2, "200", "C", "3")], "id int, code string, name string, value string")
    got = {r["code"]: r["headers"] for r in lookups.with_headers(responses, headers, "id", "code").collect()}
    assert got == {"200": {"A": "1", "B": "2"}, "404": None}


def test_stale_fragments_follow_folders(spark):
    fragments = spark.createDataFrame([("a.ts", ["lib"]), ("b.ts", ["lib/x.ts"]), ("c.ts", None), ("d.ts", [])], "file string, dependencies array<string>")
    changed = spark.createDataFrame([("lib/y.ts",), ("d.ts",)], "path string")
    assert sorted(r["file"] for r in lookups.stale_fragments(fragments, changed).collect()) == ["b.ts", "c.ts"]
    assert values(spark, [('{"a": {"$ref": "#/components/schemas/U"}, "b": [{"$ref":"#/components/schemas/V"}, {"$ref": "#/components/schemas/U"}]}',)], "d string", lookups.schema_references(F.col("d"))) == [["U", "V"]]


def test_diagnostics(spark):
    files = spark.createDataFrame([("/app/[[...s]]/@tab/(..)x/route.ts",), ("\\app\\@side\\route.ts",), ("/app/plain",), (None,)], "file string")
    found = diagnostics.route_features(files, "file")
    assert found.groupBy("subject").count().collect() and found.count() == 4
    assert diagnostics.together([found, found], ("code", "subject")).count() == 2
    assert [diagnostics.fails(found, on) for on in ("never", "error", "warning")] == [False, False, False]
    warned = found.withColumn("severity", F.lit("warning"))
    assert [diagnostics.fails(warned, on) for on in ("never", "error", "warning")] == [False, False, True]


def test_workflows(spark):
    one = {"$self": "u", "info": {"title": "one"}, "sourceDescriptions": [{"name": "s", "type": "asyncapi"}], "workflows": [{"workflowId": "w", "steps": [
        {"stepId": "a", "operationId": "known", "timeout": 5, "parameters": [{"name": "q", "in": "querystring", "value": "1"}]}, {"stepId": "b", "operationId": "gone"}, {"stepId": "c"}]}]}
    files = workflows.read_files(spark.createDataFrame([(1, json.dumps(one)), (2, '{"info": {"title": "two"}}'), (3, "{bad"), (4, None)], "id int, text string"))
    steps = workflows.steps_of(files, "id")
    operations = spark.createDataFrame([("known",)], "operationId string")
    assert [r["subject"] for r in workflows.unknown_operations(steps, operations).collect()] == ["w/b"]
    old = workflows.for_first_version(steps)
    assert "timeout" not in old.columns and old.where("stepId = 'a'").first()["parameters"][0]["in"] == "query"
    head = workflows.united(files, "id").first()
    assert head["info"]["title"] == "one" and len(head["sources"]) == 1 and head["workflows"] == 1
    assert sorted(r["code"] for r in workflows.version_warnings(files, "id").collect()) == ["ARAZZO_ASYNCAPI_SOURCE", "ARAZZO_SELF_UNSUPPORTED"]


def test_schema_versions(spark):
    down, up = (lambda s, m=None: schema_versions.rewrite(s, "3.0", m)), (lambda s, m=None: schema_versions.rewrite(s, "3.1", m))
    assert down({"const": 1}) == {"enum": [1]}
    assert down({"type": ["string", "null"]}) == {"type": "string", "nullable": True}
    assert down({"anyOf": [{"$ref": "#/x"}, {"type": "null"}], "title": "t"}) == {"$ref": "#/x", "title": "t", "nullable": True}
    assert down({"exclusiveMinimum": 2, "minimum": 3}) == {"minimum": 3}
    assert down({"exclusiveMaximum": 2, "maximum": 3}) == {"maximum": 2, "exclusiveMaximum": True}
    assert down({"prefixItems": [{"const": 1}], "items": {"type": "string"}}) == {"items": {"oneOf": [{"enum": [1]}, {"type": "string"}]}}
    assert down({"if": {}, "$defs": {}, "contentEncoding": "base64"}) == {"format": "base64", "x-jsonschema-if": {}, "x-jsonschema-contentEncoding": "base64"}
    assert up({"properties": {"a": {"type": "string", "nullable": True}}}) == {"properties": {"a": {"type": ["string", "null"]}}}
    assert up({"$ref": "#/x", "nullable": True}) == {"anyOf": [{"$ref": "#/x"}, {"type": "null"}]}
    assert up({"minimum": 1, "exclusiveMinimum": True, "maximum": 2, "exclusiveMaximum": False}) == {"exclusiveMinimum": 1, "maximum": 2}
    assert up({"format": "binary"}, "image/png") == {"contentMediaType": "image/png"}
    assert up({"example": None}) == {"examples": [None]}
    texts = [('{"const": "é"}',), ("{bad",), (None,), ("[1]",)]
    assert values(spark, texts, "s string", schema_versions.schema_for(F.col("s"), "3.0")) == ['{"enum":["é"]}', "{bad", None, "[1]"]


def test_schema_algebra():
    a = schema_algebra
    assert a.union([{"type": "string", "enum": ["x"]}, None, {"type": "string", "enum": ["y", "x"]}, {"type": "null"}]) == {"type": "string", "enum": ["x", "y"], "nullable": True}
    assert a.union([{"type": "string"}, {"type": "number"}]) == {"anyOf": [{"type": "string"}, {"type": "number"}]}
    assert a.union([]) == {} and a.union([{"type": "null"}]) == {"type": "null"}
    left, right = {"type": "object", "properties": {"a": {}}, "required": ["a"]}, {"type": "object", "properties": {"b": {}, "a": {"type": "string"}}, "required": ["b", "a"]}
    assert a.intersection([left, right]) == {"type": "object", "properties": {"a": {"type": "string"}, "b": {}}, "required": ["a", "b"]}
    assert a.intersection([{"type": "string"}, {"type": "object", "properties": {"__brand": {}}}]) == {"type": "string"}
    assert a.deep_partial({"required": ["a"], "properties": {"a": {"items": {"required": ["b"]}}}}) == {"properties": {"a": {"items": {}}}}
    assert a.template_enum([["a", "b"], ["-"], ["1", "2"]])["enum"] == ["a-1", "a-2", "b-1", "b-2"]
    assert a.discriminated("k", [{"$ref": "#/c"}, {"type": "object"}], {"#/c": "cat"})["discriminator"] == {"propertyName": "k", "mapping": {"cat": "#/c"}}
    table = T.StructType([T.StructField("id", T.IntegerType(), False, {"default": 1}), T.StructField("name", T.StringType(), False, {"maxLength": 9}), T.StructField("at", T.TimestampType()), T.StructField("tags", T.ArrayType(T.StringType()))])
    assert a.table_schema(table)["required"] == ["id", "name", "at"]
    assert a.table_schema(table, "insert") == {"type": "object", "properties": {"id": {"type": "integer"}, "name": {"type": "string", "maxLength": 9}, "at": {"type": "string", "format": "date-time", "nullable": True}}, "required": ["name"]}
    assert "required" not in a.table_schema(table, "update")


def test_lists_are_trimmed(spark):
    from loomdoc.functions import text

    got = values(spark, [("a: x | y ; b, c1 ",), ("",)], "s string", annotations.security_requirements(F.col("s")))
    assert got == [[{"a": ["x", "y"], "b": []}, {"c1": []}], []]
    sets = spark.createDataFrame([("one", ["400", "401"]), ("two", ["401", "500"])], "name string, codes array<string>")
    rows = spark.createDataFrame([(1, "one , two,zero"), (2, "one, none"), (3, None)], "id int, names string")
    assert sorted(r["code"] for r in lookups.expand_response_sets(rows, sets, "id", "names").collect()) == ["400", "401", "500"]
