import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomdoc.functions import annotations, schema, text
from loomdoc.operators import records
from loomdoc.plans import registry
from loomdoc.streaming.incremental import latest_by_key

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("region nation customer supplier part orders lineitem events documents pages").split():
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    names = sorted(want.columns)
    rows = lambda found: sorted(repr([r[c] for c in names]) for r in found)
    got = registry.queries()[name](spark, SF)
    assert sorted(got.columns) == names
    assert rows([r.asDict() for r in got.collect()]) == rows([dict(zip(want.columns, r, strict=True)) for r in want.fetchall()])


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_text(spark):
    row = spark.range(1).select(
        text.camel_case(F.lit("get-user BY id")).alias("a"), text.camel_case(F.lit("--")).alias("b"), text.file_route(F.lit("/users/[id]/(x)/@s/route.ts")).alias("c"),
        text.call_path(F.lit("//a/:id?/")).alias("d"), text.guess_status(F.lit("404_gone"), {"gone": 410}).alias("e"), text.escape_regex(F.lit("a.b*")).alias("f"),
        annotations.security_requirements(F.lit("bearer:read|write;key, basic")).alias("g"),
    ).first()
    assert row[:6] == ("getUserById", "query", "/users/{id}", "/a/{id}", 404, r"a\.b\*")
    assert row["g"] == [{"bearer": ["read", "write"], "key": []}, {"basic": []}]


def test_path_order(spark):
    paths = ["/users/{id}", "/users", "/users/settings", "/users-paginated"]
    got = records.path_order(spark.createDataFrame([(p, "t") for p in paths], "path string, tag string"), "path", "tag").orderBy("ord")
    assert [r["path"] for r in got.collect()] == ["/users", "/users-paginated", "/users/{id}", "/users/settings"]


def test_closure_of_long_chains_and_cycles(spark):
    chain = [(i, i + 1) for i in range(40)]
    cycle = [(100 + i, 100 + (i + 1) % 5) for i in range(5)] + [(99, 100), (7000, 7000), (None, 1)]
    got = {(r["src"], r["dst"]): r["steps"] for r in records.closure(spark.createDataFrame(chain + cycle + chain[:3], "src int, dst int")).collect()}
    want = {(i, j): j - i for i in range(41) for j in range(i + 1, 41)}
    want |= {(100 + i, 100 + j): (j - i) % 5 for i in range(5) for j in range(5) if i != j} | {(100 + i, 100 + i): 5 for i in range(5)} | {(99, 100 + i): i + 1 for i in range(5)} | {(7000, 7000): 1, (None, 1): 1}
    assert got == want
    assert records.closure(spark.createDataFrame([], "src int, dst int")).count() == 0


def test_whole_closure_query(spark):
    assert registry.queries()["ref_closure_whole"](spark, SF).count() == 417


def test_schema():
    kind = {"type": "string", "nullable": True}
    assert schema.nullable_as_type_list({"properties": {"a": kind}})["properties"]["a"] == {"type": ["string", "null"]}
    assert schema.type_list_as_nullable(schema.nullable_as_type_list(kind)) == kind


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    args = (str(tmp_path / "in"), "k string, v int, t int", str(tmp_path / "log"), str(tmp_path / "cp"), ["k"], "t")
    (tmp_path / "in/1.json").write_text('{"k":"a","v":1,"t":1}\n{"k":"b","v":1,"t":1}\n')
    latest_by_key(spark, *args)
    (tmp_path / "in/2.json").write_text('{"k":"a","v":2,"t":2}\n')
    assert {r["k"]: r["v"] for r in latest_by_key(spark, *args).collect()} == {"a": 2, "b": 1}
