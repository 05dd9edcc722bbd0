import json

from pyspark.sql import functions as F

from loomdoc.functions import annotations, http
from loomdoc.operators import chains, operations


def test_parameters_and_schemas(spark):
    schema = {"type": "object", "properties": {"a": {"in": "path", "example": 5, "type": "integer"}, "b": {"description": "d"}, "c": {"schema": {"type": "number", "in": 1}}, "d": {"content": {"x/y": {}}}}}
    rows = operations.properties(spark.createDataFrame([("o", json.dumps(schema)), ("p", "{}")], "name string, t string").select("name", F.parse_json("t").alias("schema")))
    got = {r["name"]: r for r in operations.cookie_parameters(rows).collect()}
    assert set(got) == {"a", "b", "c", "d"} and {r["location"] for r in got.values()} == {"cookie"}
    assert got["a"]["example"] == "5" and got["d"]["example"] is None and got["d"]["type"] is None
    assert {(r["name"], r["location"], r["is_required"]) for r in operations.parameters(rows, path=True).collect()} == {(n, "path", True) for n in "abcd"}
    members = {(r["name"], r["key"], r["v"]) for r in operations.parameter_schemas(rows).select("name", "key", F.to_json("value").alias("v")).collect()}
    assert members == {("a", "type", '"integer"'), ("b", "description", '"d"'), ("b", "type", '"string"'), ("c", "type", '"number"'), ("c", "in", "1"), ("d", "type", '"string"')}
    made = spark.range(1).select(operations.querystring_parameter(F.lit("T"), F.lit("")).alias("q"), operations.querystring_parameter(F.lit(""), F.lit("n")).alias("n")).first()
    assert (made["q"]["name"], made["q"]["ref"], made["n"]) == ("query", "#/components/schemas/T", None)


def test_responses_by_name_and_summaries(spark):
    rows = spark.createDataFrame([("404", '"NotFound"'), ("200", '{"schema": {"type": "string"}, "description": "ok"}'), ("201", '{"type": "object"}')], "code string, t string").select("code", F.parse_json("t").alias("response"))
    got = {r["code"]: r for r in operations.named_responses(rows).withColumn("s", F.to_json("schema")).collect()}
    assert got["404"]["ref"] == "#/components/responses/NotFound" and got["200"]["s"] == '{"type":"string"}' and got["201"]["description"] == "Response"
    comment = F.lit("@responseSummary 404 Gone\n@responseSummary Fine\n@responseSummary 404 Lost")
    said = annotations.response_summaries(comment)
    named = rows.withColumns({"primary": said["primary"], "by_status": said["by_status"], "is_primary": F.col("code") == "200"})
    assert {r["code"]: r["summary"] for r in operations.summaries(named, "code").collect()} == {"404": "Lost", "200": "Fine", "201": None}
    one = spark.range(1).select(operations.single_response(F.lit("x"), F.lit("")).alias("r")).first()["r"]
    assert (one["code"], one["description"]) == ("200", "Successful response")


def test_documents_without_configuration(spark):
    docs = spark.createDataFrame([(1, '{"openapi": "3.0.0", "apiDir": "x", "watch": true, "info": {}}')], "id int, t string").select("id", F.parse_json("t").alias("doc"))
    assert sorted(r["key"] for r in operations.strip_config(docs).collect()) == ["info", "openapi"]
    params = spark.createDataFrame([("/a/{id}", "id", "path", None), ("/a/{slug}", "slug", "path", ""), ("/a/{x}", "x", "path", "own"), ("/a", "id", "query", None)], "path string, name string, location string, example string")
    assert [r["example"] for r in operations.path_examples(params).collect()] == ["123", "example-slug", "own", None]


def test_odd_comments(spark):
    texts = [None, "", "* first line\n * @body T optional\n * @requestBody\n", "@security a b, c\n@security 1x, d;e: s|t", "@response [A:B]\n@response default\n@link 1 2", "@openapi-override {\"a\": {\"b\": 1}}\n@querystring Find"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string").select("i", annotations.parse_block(F.col("c")).alias("b"), annotations.responses(F.col("c")).alias("r"), annotations.is_internal(F.col("c")).alias("n")).orderBy("i").collect()
    assert df[2]["b"]["summary"] == "first line" and df[2]["b"]["body_type"] == "T" and df[2]["b"]["body_required"] is False
    assert df[3]["b"]["security"] == [{"a": []}, {"d": [], "e": ["s", "t"]}]
    assert [(r["code"], r["type"]) for r in df[4]["r"]] == [("", "[A:B]"), ("default", "")] and df[4]["b"]["links"] == []
    assert str(df[5]["b"]["override"]) == '{"a":{"b":1}}' and df[5]["b"]["querystring"]["name"] == "find"
    assert df[1]["b"]["servers"] == [] and df[1]["n"] is False


def test_frameworks_and_servers(spark):
    kinds = spark.createDataFrame([("reactrouter",), (None,), ("odd",)], "k string").select(http.framework(F.col("k")).alias("f")).collect()
    assert [r["f"] for r in kinds] == ["react-router", "nextjs", None]
    got = spark.createDataFrame([("./src/app/api/", "app"), ("src\\pages\\api", "pages"), ("src/api", "app")], "d string, r string").select(http.server_url(F.col("d"), F.lit("nextjs"), F.col("r")).alias("u"), http.file_method(F.lit("a/users.get.ts")).alias("m"), http.file_method(F.lit("get.ts")).alias("n")).collect()
    assert [r["u"] for r in got] == ["/api", "/api", ""] and (got[0]["m"], got[0]["n"]) == ("GET", None)


def test_template_patterns(spark):
    parts = F.array(*[F.struct(F.lit(fixed).alias("fixed"), F.lit(text).alias("text")) for fixed, text in ((True, "a."), (False, "number"), (False, "string"))])
    assert spark.range(1).select(chains.template_pattern(parts).alias("p")).first()["p"] == r"^a\.-?\d+(\.\d+)?.*$"


def test_requirements_and_bodies_are_cut_once(spark):
    """The plan holds the tokens' expression once, and long lists come out right."""
    from loomdoc.functions import annotations

    raw = ",".join(f"s{i}:a|b;t{i}" for i in range(40))
    df = spark.createDataFrame([(raw,)], "r string")
    row = df.select(F.size(annotations.security_requirements(F.col("r"))).alias("n")).first()
    assert row["n"] == 40
    for column, name in ((annotations.security_requirements(F.col("r")), "regexp_extract_all"), (annotations.response_summaries(F.col("r")), "regexp_extract_all"), (annotations.item_types(F.col("r")), "@itemSchema")):
        plan = df.select(column.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(name) == 1, plan


def test_arguments_and_comments_are_cut_once(spark):
    from loomdoc.functions import http

    df = spark.createDataFrame([("A<B, C<D, E>,F>", "*\n * Size 1\n * @format date\n * @example x\n ")], "t string, c string")
    row = df.select(http.generic_arguments(F.col("t")).alias("g"), http.property_comment(F.col("c")).alias("p")).first()
    assert row["g"]["arguments"] == ["B", "C<D, E>", "F"] and tuple(row["p"]) == ("date", "x", "Size 1")
    for column, name in ((http.split_arguments(F.col("t")), "split("), (http.property_comment(F.col("c")), "split(")):
        plan = df.select(column.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(name) == 1, plan
