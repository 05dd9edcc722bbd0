"""Keyed fragment state with resets, and a source whose roots change, over restarts."""

import json
import time

import pytest

from loomdoc.streaming import keyed, roots


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    if before:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    else:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def put(folder, name, rows):
    (folder / f"{name}.json").write_text("\n".join(json.dumps(dict(zip(("run", "ord", "file", "action", "fragment"), r, strict=True))) for r in rows))


def test_fragments_update_delete_reset_and_restart(rocks, tmp_path):
    source = tmp_path / "changes"
    source.mkdir()

    def step(name, rows):
        put(source, name, rows)
        changes = rocks.readStream.schema(keyed.CHANGE).json(str(source))
        query = keyed.fragment_log(changes).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint")).option("path", str(tmp_path / "log")).trigger(availableNow=True).start()
        query.awaitTermination()
        log = rocks.read.parquet(str(tmp_path / "log"))
        return {r["file"]: r["fragment"] for r in keyed.fragments(log).collect()}, log.count()

    # every step is a restart from the checkpoint
    assert step("a", [(0, 1, "x", "update", "x1"), (0, 2, "y", "update", "y1"), (0, 3, "z", "update", "z1")]) == ({"x": "x1", "y": "y1", "z": "z1"}, 3)
    assert step("b", [(0, 5, "x", "update", "x2"), (0, 4, "x", "update", "old"), (0, 6, "y", "delete", None)]) == ({"x": "x2", "z": "z1"}, 5)
    assert step("c", [(0, 2, "x", "update", "late"), (0, 7, "z", "update", "z1"), (0, 8, "q", "delete", None)]) == ({"x": "x2", "z": "z1"}, 5)  # late, the same, and nothing to delete
    assert step("d", [(1, 0, None, "reset", None)])[0] == {}
    assert step("e", [(1, 1, "x", "update", "x3"), (0, 9, "z", "update", "of the run before")])[0] == {"x": "x3"}
    assert step("f", [(1, 2, "y", "update", "y2")])[0] == {"x": "x3", "y": "y2"}


def test_roots_come_and_go(spark, tmp_path):
    spark.dataSource.register(roots.WatchedRoots)
    control = tmp_path / "roots.json"
    a, b, single = tmp_path / "a", tmp_path / "b", tmp_path / "one.ts"
    (a / "deep").mkdir(parents=True)
    b.mkdir()
    control.write_text(json.dumps([str(a), str(tmp_path / "missing")]))
    (a / "1.ts").write_text("a1")
    (a / "deep" / "2.ts").write_text("a2")
    (b / "1.ts").write_text("b1")
    out = str(tmp_path / "out")

    def start():
        stream = spark.readStream.format("watched_roots").option("control", str(control)).load()
        return stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint")).option("path", out).trigger(processingTime="200 milliseconds").start()

    def rows():
        try:
            return sorted(r["content"] for r in spark.read.parquet(out).collect())
        except Exception:  # nothing is written yet
            return []

    def until(want):
        end = time.time() + 60
        while rows() != want and time.time() < end:
            time.sleep(0.3)
        assert rows() == want

    query = start()
    until(["a1", "a2"])
    control.write_text(json.dumps([str(a), str(b), str(single)]))  # a root is added while the query runs
    until(["a1", "a2", "b1"])
    control.write_text(json.dumps([str(b), str(single)]))  # and one goes
    time.sleep(1)
    (a / "3.ts").write_text("a3")
    single.write_text("s1")
    until(["a1", "a2", "b1", "s1"])
    query.stop()
    query.awaitTermination()
    (b / "4.ts").write_text("b4")
    control.write_text(json.dumps([str(a), str(b), str(single)]))  # back again, after a restart: what came before doesn't come twice
    query = start()
    until(["a1", "a2", "a3", "b1", "b4", "s1"])
    query.stop()
    query.awaitTermination()
    assert query.exception() is None


def test_configured_roots():
    assert roots.watch_roots(["b", None, "a", ""], ["c", "b"]) == ["a", "b", "c"]
