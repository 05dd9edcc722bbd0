"""Re-exports, components, accesses, paths and assembly against plain Python."""

import json
import random

from pyspark.sql import functions as F

from loomdoc.operators import assembly, exports, nodes, references
from loomdoc.sources import paths


def index(spark, definitions, named, stars):
    found = exports.schema_index(spark.createDataFrame(definitions, "file string, name string"), spark.createDataFrame(named, "file string, name string, source string, original string"), spark.createDataFrame(stars, "file string, source string"))
    return {(r["file"], r["name"]): (r["from_file"], r["from_name"], r["state"]) for r in found.collect()}


def test_reexports_long_chains_cycles_and_shadowing(spark):
    definitions = [("f0", "T"), ("own", "S"), ("far", "S"), ("far", "default"), (None, "x")]
    named = [(f"f{i}", "T", f"f{i - 1}", "T") for i in range(1, 1001)] + [("r", "New", "f1000", "T"), ("c1", "A", "c2", "A"), ("c2", "A", "c1", "A"), ("c3", "A", "c1", "A"), ("lost", "L", "nowhere", "L"), ("lost2", "M", "lost", "L"), ("lost3", "M", "f0", "absent")]
    stars = [("own", "far"), ("near", "own"), ("ring1", "ring2"), ("ring2", "ring1"), ("ring2", "far")] + [(f"s{i}", f"s{i - 1}") for i in range(1, 40)] + [("s0", "r")]
    got = index(spark, definitions, named, stars)
    assert all(got[(f"f{i}", "T")] == ("f0", "T", "found") for i in range(1001)) and got[("r", "New")] == ("f0", "T", "found")
    assert {got[(f"c{i}", "A")] for i in (1, 2, 3)} == {(None, None, "cycle")}
    assert got[("lost", "L")] == got[("lost2", "M")] == got[("lost3", "M")] == (None, None, "missing")
    assert got[("near", "S")] == ("own", "S", "found") == got[("own", "S")] and got[("ring1", "S")] == ("far", "S", "found")
    assert ("own", "default") not in got and got[("far", "default")][2] == "found"
    assert all(got[(f"s{i}", "New")] == ("f0", "T", "found") for i in range(40))
    asked = spark.createDataFrame([("near", "S[][]"), ("near", "Q"), ("near", "{ a: B }"), ("near", " "), ("c1", "A")], "file string, type string")
    made = exports.schema_index(spark.createDataFrame(definitions, "file string, name string"), spark.createDataFrame(named[-7:], "file string, name string, source string, original string"), spark.createDataFrame(stars[:3], "file string, source string"))
    assert sorted(tuple(r) for r in exports.unresolved(made, asked).collect()) == [("c1", "A"), ("near", "Q")]


def test_no_exports(spark):
    assert index(spark, [], [], []) == {} and index(spark, [("a", "b")], [], []) == {("a", "b"): ("a", "b", "found")}


def components(edges):
    """By reachability."""
    ahead = {}
    for a, b in edges:
        ahead.setdefault(a, set()).add(b)
        ahead.setdefault(b, set())

    def reach(n):
        seen, todo = set(), [n]
        while todo:
            for m in ahead[todo.pop()]:
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        return seen

    far = {n: reach(n) for n in ahead}
    return {n: min([n] + [m for m in far[n] if n in far[m]]) for n in ahead}


def test_strongly_connected(spark):
    ring = lambda base, n: [(base + i, base + (i + 1) % n) for i in range(n)]
    rnd = random.Random(4)
    cases = [
        ring(0, 2) + ring(10, 3) + ring(100, 100) + [(1, 10), (12, 100), (500, 0), (150, 501), (501, 502), (502, 503)],
        ring(100, 100) + [(100, 300), (300, 301), (301, 302), (302, 150), (302, 400), (400, 400)],  # a run that returns to its ring
        [(0, 1), (1, 2), (2, 0), (0, 5), (5, 6), (6, 0), (7, 7), (8, 9)],
        [(rnd.randrange(40), rnd.randrange(40)) for _ in range(55)], [(rnd.randrange(30), rnd.randrange(30)) for _ in range(35)], [(rnd.randrange(60), rnd.randrange(60)) for _ in range(60)],
    ]
    offset, edges = 0, []
    for case in cases:  # one graph of all
        edges += [(a + offset, b + offset) for a, b in case]
        offset += 1000
    df = spark.createDataFrame([*edges, (None, 1), (1, None)], "src long, dst long")
    got = {r["node"]: r["component"] for r in references.strongly_connected(df).collect()}
    assert got == components(edges)
    assert references.strongly_connected(df.limit(0)).count() == 0
    stays = {(r["src"], r["dst"]): r["stays"] for r in references.recursive_references(df).collect()}
    want = components(edges)
    assert stays == {(a, b): want[a] == want[b] for a, b in edges}


def test_accesses(spark):
    members = spark.createDataFrame([("A", "b", "B", None), ("B", "*", "C", None), ("C", "x", None, "number"), ("T", "0", None, "string"), ("T", "1", "A", None)], "type string, name string, target string, value string")
    links = spark.createDataFrame([("Alias", "A"), ("C", "D"), ("L1", "L2"), ("L2", "L3"), ("L3", "L1"), ("Self", "Self")], "type string, target string")
    rows = [(1, "Alias", ["b", "7", "x"]), (2, "A", ["b"]), (3, "T", ["0"]), (4, "T", ["0", "y"]), (5, "T", ["5"]), (6, "L2", ["x"]), (7, "Gone", ["x"]), (8, "Gone", []), (9, "A", None), (10, "Self", [])]
    found = references.access_paths(spark.createDataFrame(rows, "id long, type string, steps array<string>"), members, links)
    got = {r["id"]: (r["type"], r["value"], r["code"]) for r in found.collect()}
    # C refers to D, so its own members are never asked
    assert got == {1: ("D", None, "dangling"), 2: ("B", None, None), 3: ("T", "string", None), 4: ("T", None, "no-member"), 5: ("T", None, "no-member"), 6: ("L1", None, "cyclic"), 7: ("Gone", None, "dangling"), 8: ("Gone", None, None), 9: ("A", None, None), 10: ("Self", None, "cyclic")}


def test_nearest_of_many_paths(spark):
    n = 100_000
    places = spark.range(n).select(F.concat(F.lit("/r"), F.col("id") % 97, F.lit("/s"), F.col("id") % 1009, F.lit("/f"), "id", F.lit(".ts")).alias("path"))
    files = [("/tsconfig.json",), ("/r5/tsconfig.json",), ("/r5/s5/package.json",), ("/r5/s5/tsconfig.json",), ("/r5/s5/other.json",), ("tsconfig.json",)]
    got = paths.nearest_files(places, spark.createDataFrame(files, "path string"), ["tsconfig.json", "package.json"])
    count = {k: 0 for k in range(4)}
    count |= {r["ord"]: r["n"] for r in got.groupBy("ord").agg(F.count("*").alias("n")).collect()}
    r5 = [i for i in range(n) if i % 97 == 5]
    deep = sum(i % 1009 == 5 for i in r5)
    assert count == {0: n, 1: len(r5), 2: deep, 3: deep}
    one = {r["ord"]: r["found"] for r in got.where("path = '/r5/s5/f5.ts'").collect()}
    assert one == {0: "/r5/s5/tsconfig.json", 1: "/r5/s5/package.json", 2: "/r5/tsconfig.json", 3: "/tsconfig.json"}
    relative = paths.nearest_files(spark.createDataFrame([("a/b.ts",), ("x/",), (None,)], "path string"), spark.createDataFrame(files, "path string"), ["tsconfig.json"])
    assert sorted((r["path"], r["found"]) for r in relative.collect()) == [("a/b.ts", "tsconfig.json"), ("x/", "tsconfig.json")]


def test_alias_mappings(spark):
    rows = [("A", "z.infer<typeof Schema>"), ("B", " infer < typeof  other$ > ;"), ("C", "Other<typeof X>"), ("D", "z.infer<Y>"), ("E", None)]
    assert sorted(tuple(r) for r in paths.alias_mappings(spark.createDataFrame(rows, "name string, text string")).collect()) == [("A", "Schema"), ("B", "other$")]


def test_nodes_and_back(spark):
    docs = [{}, [], {"a/b": {"~x": [1, [2, []], {"0": "z", "1": {}}]}, "": None, 'q"\n': "é\\"}, [[[]], {"k": [None, True, 1.5]}], {"0": 1, "1": 2}, {"deep": {"er": {"and": {"so": {"on": [{"x": [{}]}]}}}}}, "text", 7, None, list(range(12))]
    df = spark.createDataFrame(list(enumerate(json.dumps(d) for d in docs)), "k long, t string").select("k", F.parse_json("t").alias("doc"))
    leaves, lists = nodes.nodes(df, "k"), nodes.lists(df, "k")
    got = {r["k"]: json.loads(r["t"]) for r in assembly.assemble(leaves, "k", lists).select("k", F.to_json("doc").alias("t")).collect()}
    assert got == dict(enumerate(docs))
    guessed = {r["k"]: json.loads(r["t"]) for r in assembly.assemble(leaves, "k").select("k", F.to_json("doc").alias("t")).collect()}
    assert guessed[4] == [1, 2] and guessed[3] == docs[3]
    assert assembly.assemble(leaves.limit(0), "k").count() == 0
    twice = spark.createDataFrame([(1, "/a", "2"), (1, "/a", "1"), (1, "/b", "5"), (1, "/b/c", "6")], "k long, pointer string, value string")
    assert assembly.assemble(twice, "k").select(F.to_json("doc").alias("t")).first()["t"] == '{"a":1,"b":{"c":6}}'


def test_walk_of_long_documents(spark):
    """Members of a long document are parsed anew: values, lists and whole numbers as doubles stay, and what is written doesn't hold all names for each member."""
    import glob
    import os

    wide = {f"name{i}": {"a/b": [i, [], {"x": None}]} for i in range(3000)}
    docs = spark.createDataFrame([(1, json.dumps(wide)), (2, '{"d":{"e":1}}'), (3, "7")], "k int, t string").select("k", F.parse_json("t").alias("doc"))
    doubles = spark.range(1).select(F.lit(4).alias("k"), F.to_variant_object(F.struct(F.array_repeat(F.struct(F.lit(1.0).alias("v")), 3000).alias("l"))).alias("doc"))
    leaves, lists = nodes.nodes_and_lists(docs.unionByName(doubles), "k")
    got = {(r["k"], r["pointer"]): r["value"] for r in leaves.collect()}
    assert got[2, "/d/e"] == "1" and got[3, ""] == "7" and got[4, "/l/2999/v"] == "1.0" and got[1, "/name2999/a~1b/0"] == "2999"
    assert len(got) == 9000 + 2 + 3000 and sum(r["k"] == 1 for r in lists.collect()) == 6000
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    last = max(glob.glob(f"{folder}/loomdoc-walk-*"), key=os.path.getmtime)
    assert sum(os.path.getsize(f) for f in glob.glob(f"{last}/*.parquet")) < 5_000_000
