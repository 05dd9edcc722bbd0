import json

import pytest
from pyspark.sql import functions as F

from loomdoc.functions import merges
from loomdoc.operators import documents, overlay


def overlaid(spark, doc, *actions):
    docs = spark.createDataFrame([(json.dumps(doc),)], "doc string")
    return json.loads(overlay.apply_overlay(docs, overlay.resolve_actions(actions)).first()["doc"])


def test_merges_differ(spark):
    base, more = {"a": [1], "b": {"x": 1, "y": 2}, "c": 3}, {"a": [2], "b": {"y": None}, "d": {"e": None}}
    want = {
        "fragment": {"a": [1, 2], "b": {"x": 1, "y": None}, "c": 3, "d": {"e": None}},
        "override": {"a": [2], "b": {"x": 1, "y": None}, "c": 3, "d": {"e": None}},
        "patch": {"a": [2], "b": {"x": 1}, "c": 3, "d": {"e": None}},
        "shallow": {"a": [2], "b": {"y": None}, "c": 3, "d": {"e": None}},
    }
    rows = spark.createDataFrame([(json.dumps(base), json.dumps(more)), (None, "[1]"), ("{bad", None), ("{}", None)], "x string, y string")
    for kind, expected in want.items():
        got = [r["m"] for r in rows.select(merges.merged(F.col("x"), F.col("y"), kind).alias("m")).collect()]
        assert json.loads(got[0]) == expected
        assert got[1:] == ["[1]", None, "{}"]


def test_overlay_actions(spark):
    doc = {"info": {"t": "a"}, "tags": [{"n": 1, "k": "in"}, {"n": 2, "k": "out"}, {"n": 3, "k": "in"}]}
    assert overlaid(spark, doc, {"target": "$.info", "update": {"v": "1", "t": None}})["info"] == {"v": "1"}
    # all matched items go, not those that slide into their places
    assert overlaid(spark, doc, {"target": "$.tags[?(@.k == 'in')]", "remove": True})["tags"] == [{"n": 2, "k": "out"}]
    assert overlaid(spark, doc, {"target": "$.tags[*].k", "remove": True})["tags"] == [{"n": 1}, {"n": 2}, {"n": 3}]
    # later actions see earlier ones, and a path without a match changes nothing
    twice = overlaid(spark, doc, {"target": "$.info", "update": {"t": "b"}}, {"target": "$.info", "update": {"u": 1}}, {"target": "$.none", "update": 5})
    assert twice == doc | {"info": {"t": "b", "u": 1}}
    assert overlaid(spark, doc, {"target": "$.tags[0]", "copy": "$.info"})["tags"][0] == doc["info"]
    assert overlaid(spark, doc, {"target": "$", "update": {"info": None}}) == {"tags": doc["tags"]}


def test_overlay_copy_replaces(spark):
    doc = {"a": {"x": 1, "y": 2}, "b": {"z": 3}}
    assert overlaid(spark, doc, {"target": "$.a", "copy": "$.b"}) == {"a": {"z": 3}, "b": {"z": 3}}
    assert overlaid(spark, doc, {"target": "$.a", "copy": "$.b", "update": {"w": 4}})["a"] == {"x": 1, "y": 2, "w": 4}
    docs = spark.createDataFrame([(json.dumps(doc),), ('{"a": 1}',), (None,)], "doc string")
    action = overlay.resolve_actions([{"target": "$.none", "copy": "$.b"}])
    rows = overlay.apply_overlay(docs, action, error_col="why").collect()
    assert [r["why"] for r in rows] == [None, "nothing to copy at $.b", None] and rows[1]["doc"] == '{"a": 1}'
    with pytest.raises(Exception, match="nothing to copy"):
        overlay.apply_overlay(docs, action).collect()


def test_overlay_true_is_not_one(spark):
    assert overlaid(spark, [{"a": True}, {"a": 1}], {"target": "$[?(@.a == 1)]", "remove": True}) == [{"a": True}]


def test_overlay_errors_and_odd_documents(spark):
    with pytest.raises(overlay.OverlayError):
        overlay.resolve_actions([{"$ref": "#/components/actions/x"}])
    with pytest.raises(overlay.OverlayError):
        overlay.resolve_actions([{"update": 1}])
    shared = overlay.resolve_actions([{"$ref": "#/components/actions/x", "target": "$.b"}], {"x": {"fields": {"update": 1, "target": "$.a"}}})
    assert shared == [overlay.Action("$.b", 1)]
    docs = spark.createDataFrame([(1, None), (2, "{no"), (3, '{"b": 0}')], "id int, doc string")
    assert [r["doc"] for r in overlay.apply_overlay(docs, shared).orderBy("id").collect()] == [None, None, '{"b":1}']
    assert overlay.apply_overlay(docs.limit(0), shared).count() == 0


def test_operations(spark):
    doc = {"paths": {"/a": {"post": {"id": "x"}, "get": {"id": "y"}, "zap": {"id": "z"}}, "/b": {}}}
    docs = spark.createDataFrame([(1, json.dumps(doc)), (2, "{}")], "n int, j string").select("n", F.parse_json("j").alias("doc"))
    rows = documents.operations_of(docs).select("path", "method", "ord", F.try_variant_get("operation", "$.id", "string").alias("operation_id"))
    assert [tuple(r) for r in rows.orderBy("ord").collect()] == [("/a", "get", 0, "y"), ("/a", "post", 1, "x"), ("/a", "zap", 9, "z")]
    items = documents.path_items(rows, "path", "method", "operation_id", "ord").first()
    assert [tuple(m) for m in items["methods"]] == [("get", "y"), ("post", "x"), ("zap", "z")]


def test_last_and_first(spark):
    rows = spark.createDataFrame([("t", "a", None, 1), ("t", None, "k", 2), ("u", None, None, 3)], "tag string, summary string, kind string, ord int")
    assert sorted(tuple(r) for r in documents.tag_fields(rows, "tag", ["summary", "kind"], "ord").collect()) == [("t", "a", "k"), ("u", None, None)]
    ids = documents.operations_by_id(rows.withColumnRenamed("tag", "operation_id"), "ord")
    assert sorted((r["operation_id"], r["ord"]) for r in ids.collect()) == [("t", 2), ("u", 3)]
    firsts = documents.distinct_responses(rows.select("tag", "kind", "ord"), ["tag"], "ord")
    assert sorted((r["tag"], r["ord"]) for r in firsts.collect()) == [("t", 1), ("u", 3)]
