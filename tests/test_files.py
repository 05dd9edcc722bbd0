import json

from pyspark.sql import functions as F

from loomdoc.operators import catalog, checks
from loomdoc.sources import files
from loomdoc.streaming import fragments


def test_scans_leave_ignored_folders_out(spark, tmp_path):
    for name in ("a/users.get.ts", "a/b/x.tsx", "a/node_modules/m/y.ts", "dist/z.ts", "a/readme.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("export async function GET() {}" if name.endswith("x.tsx") else "app.get('/x')")
    root = f"file://{tmp_path}"
    found = files.scan_files(spark, root, contents=True)
    assert sorted(r["file"].rsplit("/", 1)[1] for r in found.collect()) == ["users.get.ts", "x.tsx"]
    assert found.where(files.exports_handler(F.col("content"), ["GET"])).count() == 1
    assert found.where(files.calls_router(F.col("content"))).count() == 1
    assert sorted(r["folder"].rsplit("/", 1)[1] for r in files.ignored_folders(spark, root).collect()) == ["dist", "node_modules"]
    assert found.where(files.file_name_matches(F.col("file"), [".ts"], r"\.get\.")).count() == 1
    assert files.inputs([found, found], found.where("file LIKE '%tsx'")).count() == 1
    assert {len(r["hash"]) for r in files.file_hashes(spark, root).collect()} == {64}
    listed = spark.createDataFrame([("/r/dist",), ("/r/src",)], "folder string")
    wanted = spark.createDataFrame([("/r/src",), ("/r/none",)], "folder string")
    assert sorted(r["code"] for r in checks.folders(listed, wanted, "schema").collect()) == ["schema-dir-empty", "schema-directory-ignored"]


def test_documents_in_both_formats(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"components": {"schemas": {"A": {"type": "string"}, "B": 1}}}')
    (tmp_path / "b.yaml").write_text("schemas:\n  B: {type: integer}\n  C: &c [1, 2]\n  D: *c\n")
    (tmp_path / "c.yml").write_text("a: [")
    (tmp_path / "d.json").write_text("{")
    (tmp_path / "e.txt").write_text("{}")
    docs = files.documents(spark, f"file://{tmp_path}")
    assert {r["file"][-6:]: r["problem"] for r in docs.collect()} == {"a.json": None, "b.yaml": None, "/c.yml": "unreadable", "d.json": "unreadable", "/e.txt": "unsupported"}
    got = {r["name"]: json.loads(r["s"]) for r in files.schema_files(docs).select("name", F.to_json("schema").alias("s")).collect()}
    assert got == {"A": {"type": "string"}, "B": {"type": "integer"}, "C": [1, 2], "D": [1, 2]}
    good, bad = files.with_list(docs, "actions")
    assert good.count() == 0 and bad.count() == 5


def test_documents_are_written_whole(spark, tmp_path):
    rows = spark.createDataFrame([("x", '{"b":[1,2],"a":"é"}'), ("y", "{bad")], "name string, doc string")
    made = rows.withColumns({"text": files.serialized(F.col("doc")), "yaml": files.serialized(F.col("doc"), "yaml")}).collect()
    assert made[0]["text"] == '{\n  "b": [\n    1,\n    2\n  ],\n  "a": "é"\n}\n' and made[0]["yaml"] == "b:\n- 1\n- 2\na: é\n" and made[1]["text"] is None
    for _ in range(2):
        files.write_documents(rows.withColumn("text", F.col("doc")), f"file://{tmp_path}/out")
    assert sorted(r["value"] for r in spark.read.text(f"file://{tmp_path}/out").collect()) == sorted(r["doc"] for r in rows.collect())
    files.write_record(rows, f"file://{tmp_path}/state")
    files.write_manifest(spark.createDataFrame([("c", "info")], "code string, severity string"), spark.createDataFrame([("scan", 3)], "phase string, ms long"), f"file://{tmp_path}/manifest")
    assert {r["kind"] for r in spark.read.json(f"file://{tmp_path}/manifest").collect()} == {"diagnostic", "timing"}
    assert spark.read.parquet(f"file://{tmp_path}/state").count() == 2


def test_fragments_replace_each_other(spark, tmp_path):
    state = spark.createDataFrame([("a", 1, 10, "k", "x"), ("b", 1, 10, "k", "y")], "file string, size long, modified long, key string, result string")
    now = spark.createDataFrame([("a", 1, 10, "k"), ("b", 2, 11, "k"), ("c", 1, 1, "k")], "file string, size long, modified long, key string")
    held, new = fragments.reusable(now, state)
    assert [r["file"] for r in held.collect()] == ["a"] and sorted(r["file"] for r in new.collect()) == ["b", "c"]
    after = fragments.merged(state, new.withColumn("result", F.lit("z")), spark.createDataFrame([("a",)], "file string"))
    assert sorted((r["file"], r["result"]) for r in after.collect()) == [("b", "z"), ("c", "z")]
    source, folder = tmp_path / "in", f"file://{tmp_path}/state"
    source.mkdir()
    assert fragments.current(spark, folder) is None
    for n, rows in enumerate(([("a", 1), ("b", 1)], [("b", 2), ("c", 3)])):
        (source / f"{n}.json").write_text("\n".join(json.dumps({"file": f, "v": v}) for f, v in rows))
        fragments.watch(spark, f"file://{source}", "file string, v long", folder, lambda df: df.groupBy("file").agg(F.max("v").alias("v")))()
    assert sorted((r["file"], r["v"]) for r in fragments.current(spark, folder).collect()) == [("a", 1), ("b", 2), ("c", 3)]
    keys = spark.range(2).select(fragments.fragment_key({"a": F.col("id"), "b": F.lit(1)}).alias("k")).distinct()
    assert keys.count() == 2


def test_catalog_rest(spark):
    parts = spark.createDataFrame([("m", 0, None, True), ("m", 1, None, True), ("r", 0, None, True), ("r", 1, "#/R", True)], "key string, ord int, ref string, is_object boolean")
    assert {r["key"]: (r["form"], r["refs"]) for r in catalog.intersections(parts, "key", "ord").collect()} == {"m": ("merged", []), "r": ("all_of", ["#/R"])}
    stages = spark.createDataFrame([("p", 0, "type", "string"), ("p", 1, "type", "number"), ("p", 1, "minimum", None), ("p", 0, "format", "x")], "key string, ord int, attribute string, value string")
    assert sorted((r["attribute"], r["value"]) for r in catalog.piped(stages, ["key"], "ord").collect()) == [("format", "x"), ("type", "number")]
    columns = spark.createDataFrame([("c", "type", "string")], "col string, attribute string, value string")
    more = spark.createDataFrame([("c", "type", "email"), ("c", "minLength", "3")], "col string, attribute string, value string")
    assert sorted(r["value"] for r in catalog.refined_columns(columns, more, ["col"]).collect()) == ["3", "email"]


def test_named_files(spark, tmp_path):
    import pytest

    folder = str(tmp_path / "out")
    rows = [("a.json", '{"x":1}'), ("deep/er/b.yaml", "é: 1\n"), ("a.json", "{}~ later"), (None, "x"), ("c", None)]
    done = files.write_named(spark.createDataFrame(rows, "name string, text string"), folder)
    assert sorted((r["name"], r["bytes"]) for r in done.collect()) == [("a.json", 7), ("deep/er/b.yaml", 6)]
    found = sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*") if p.is_file())
    assert found == ["a.json", "deep/er/b.yaml"] and (tmp_path / "out/a.json").read_text() == '{"x":1}'
    files.write_named(spark.createDataFrame([("a.json", "new")], "name string, text string"), f"file://{folder}")
    assert (tmp_path / "out/a.json").read_text() == "new"
    with pytest.raises(Exception, match="no name of a file"):
        files.write_named(spark.createDataFrame([("../up", "x")], "name string, text string"), folder)
