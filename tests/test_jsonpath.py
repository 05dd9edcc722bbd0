import json

import pytest
from pyspark.sql import functions as F

from loomdoc.functions import jsonpath
from loomdoc.functions.jsonpath import JsonPathError, filter_literal, parse_json_path, query_json_path
from loomdoc.sources.shared import written

DOC = {"items": [True, None, 1, "a"], "nested": {"items": [{"active": True, "count": 0, "flag": False, "value": None}, {"active": False, "count": 2, "value": "x"}]}, "ite]ms": ["q"], "a b": {"x": 1}, "rows": [{"a b": 1, "a-b": 1}, {"a b": 2}], 'it"s': 7, "nil": None}


def found(spark, path, doc=DOC):
    docs = spark.createDataFrame([(json.dumps(doc),)], "t string").select(F.parse_json("t").alias("doc"))
    rows = query_json_path(docs, path).select("ord", F.to_json("value").alias("v")).collect()
    return [json.loads(r["v"]) for r in sorted(rows, key=lambda r: r["ord"])]


@pytest.mark.parametrize(
    "path, expected",
    [
        ("$.items[0]", [True]), ("$.items[-1]", ["a"]), ("$.items[9]", []), ("$.items[1:3]", [None, 1]), ("$.items[-2:]", [1, "a"]), ("$.items[-9:2]", [True, None]),
        ("$.items[?(@)]", [True, 1, "a"]), ("$['ite]ms'][0]", ["q"]), ("$.items.length", []), ("$.nested.items[?(@.active == true)].count", [0]),
        ("$.nested.items[?(@.flag != false)].count", [2]), ("$.nested.items[?(@.value == null)].count", [0]), ("$.nested.items[?(@.value == x)].count", [2]),
        ("$.nested.items[?(@.count == '2')].count", []), ("$.nested.items[?(@.count)]", []), ("$..count", [0, 2]), ("$.missing", []),
        (" $.items[0] ", [True]), ("$[ 'items' ][ 0 ]", [True]), ("$.nested.items[?@.count == 2].value", ["x"]), ("$.nested.items[?(@['count'] == 0)].flag", [False]), ("$.nested.items[?(@.count == 2e0)].count", []),
        ("$['a b'].x", [1]), ("$.rows[?(@['a b'] == 1)]['a b']", [1]), ("$.rows[?(@.a-b == 1)]", []), ('$["it\\"s"]', [7]), ("$.nil", [None]), ("$.nil.x", []),
    ],
)
def test_paths(spark, path, expected):
    assert found(spark, path) == expected


def test_root_and_null_documents(spark):
    assert found(spark, "$", 5) == [5]
    docs = spark.createDataFrame([(None,)], "t string").select(F.try_parse_json("t").alias("doc"))
    assert query_json_path(docs, "$..*").count() == 0


@pytest.mark.parametrize("path", ["items", "$.", "$..", "$x", "$['a", "$[1", "$[1:2:3]", "$[a]"])
def test_errors(path):
    with pytest.raises(JsonPathError):
        parse_json_path(path)


def test_literals():
    assert [filter_literal(x) for x in ("true", "null", "'a'", "-1.5", "internal")] == [True, None, "a", -1.5, "internal"]


def test_deep_documents(spark):
    deep = {"x": 1}
    for _ in range(120):
        deep = {"d": [deep]}
    assert found(spark, "$..x", deep) == [1]


def test_descendants_of_more_levels_than_a_pass(spark):
    """Members, items and nulls at, above and below the ends of passes, with their types; every node once for each node that it is below of."""
    doc = {"x": None}
    for i in range(20):
        doc = {"b": [doc, {"x": i}], "x": 1.5}
    wanted = []

    def walk(value):
        for key, v in value.items() if isinstance(value, dict) else [(None, v) for v in value] if isinstance(value, list) else []:
            if key == "x":
                wanted.append(v)
            walk(v)

    walk(doc)
    assert found(spark, "$..x", doc) == wanted
    assert len(found(spark, "$..*..x", {"a": {"a": {"x": 1}}})) == 2


def test_levels_are_cut_out_of_documents_in_few_passes(spark, monkeypatch):
    """242 levels take nine passes; no member is cast, which would build everything below it anew at each level. Members of wide values keep their types and take none of the other names along."""
    plans = []

    def noted(df, tag):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return written(df, tag)

    monkeypatch.setattr(jsonpath, "written", noted)
    deep = {"x": 1}
    for _ in range(120):
        deep = {"d": [deep]}
    assert found(spark, "$..x", deep) == [1]
    assert len(plans) <= 9 and not any("map<string,variant>" in p or "array<variant>" in p for p in plans)

    plans.clear()
    wide = spark.sql("SELECT to_variant_object(named_struct('a', map_from_entries(transform(sequence(0, 999), i -> struct('n' || i, named_struct('x', CAST(i AS DOUBLE), 'y', array(named_struct('x', DATE'2020-01-01')))))))) AS doc")
    for _ in range(17):
        wide = wide.select(F.to_variant_object(F.struct(F.lit(None).cast("int").alias("c"), F.col("doc").alias("d"))).alias("doc"))
    rows = query_json_path(wide, "$..x").groupBy(F.schema_of_variant("value").alias("t")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ord").alias("o")).collect()
    assert sorted((r["t"], r["n"], r["o"]) for r in rows) == [("DATE", 1000, 1000), ("DOUBLE", 1000, 1000)]
    inner = query_json_path(wide, "$..y").select(F.length(F.expr("CAST(value AS STRING)")).alias("n"), "value")
    assert {r["n"] for r in inner.collect()} == {len('[{"x":"2020-01-01"}]')} and max(len(bytes(r["value"].metadata)) for r in inner.collect()) < 20


def test_columns_beside_documents_stay(spark):
    docs = spark.createDataFrame([(1, "a", '{"x":[{"x":5}]}'), (2, None, "{}"), (3, "c", "7")], "id int, `b c` string, t string").select("id", "b c", F.parse_json("t").alias("doc"))
    rows = query_json_path(docs, "$..x").select("id", F.col("b c").alias("o"), "ord", "key", F.to_json("value").alias("v")).collect()
    assert sorted((r["id"], r["o"], tuple(r["ord"]), r["key"], r["v"]) for r in rows) == [(1, "a", (0,), "x", '[{"x":5}]'), (1, "a", (0, 0, 0), "x", "5")]
    assert sorted(tuple(r["ord"]) for r in query_json_path(docs, "$..*").collect()) == [(0,), (0, 0), (0, 0, 0)]
    assert [json.loads(r["v"]) for r in query_json_path(docs, "$..['x'][0]..['x']").select(F.to_json("value").alias("v")).collect()] == [5]


def test_a_run_of_names_and_places_is_read_at_once(spark):
    assert found(spark, "$.a[0]['b c'][1]", {"a": [{"b c": [1, None]}]}) == [None]
    assert found(spark, "$.a.b", {"a": [{"b": 1}]}) == found(spark, "$.a[0]", {"a": {"0": 1}}) == []
    docs = spark.createDataFrame([("{}",)], "t string").select(F.parse_json("t").alias("doc"))
    plan = query_json_path(docs, "$.a.b[0].c")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") + plan.count("parseJson") <= 1 and "schema_of_variant" not in plan.lower() and "schemaOfVariant" not in plan
