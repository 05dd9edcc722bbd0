"""Keyed-record operators: last and first wins, layered lookup, differences, closures, ordering."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdoc.sources.shared import shared_dir, written


def last_wins(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """For each key the row with the greatest ``order``: one aggregation with map-side combining, no sort."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(*keys, "__r.*")


def first_wins(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """For each key the row with the least ``order``."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__r")).select(*keys, "__r.*")


def layered(layers: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union of layers in which the first layer that has a key wins."""
    every = None
    for i, layer in enumerate(layers):
        part = layer.withColumn("__layer", F.lit(i))
        every = part if every is None else every.unionByName(part)
    return first_wins(every, keys, "__layer").drop("__layer")


def first_success(rows: DataFrame, keys: Sequence[str], code: str, order: str) -> DataFrame:
    """The first code of each key that is missing, ``2XX`` or from 200 to 299."""
    good = F.col(code).isNull() | (F.upper(code) == "2XX") | F.col(code).try_cast("int").between(200, 299)
    return rows.where(good).groupBy(*keys).agg(F.min_by(code, order).alias(code))


def fingerprint(rows: DataFrame, keys: Sequence[str], parts: Sequence[str], order: str) -> DataFrame:
    """SHA-256 over each key's rows in order."""
    line = F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"))))
    return rows.groupBy(*keys).agg(F.sha2(F.array_join(listed["l"], "\n"), 256).alias("fingerprint"))


def input_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """``key`` and ``change`` (added, removed, changed) between two snapshots."""
    b, a = before.select(key, F.col(value).alias("b"), F.lit(True).alias("hb")), after.select(key, F.col(value).alias("a"), F.lit(True).alias("ha"))
    change = F.when(F.col("hb").isNull(), "added").when(F.col("ha").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return b.join(a, key, "full").select(key, change.alias("change")).where("change IS NOT NULL")


def path_order(rows: DataFrame, path: str, tag: str) -> DataFrame:
    """``ord``: by tag, then number of segments, then the segments ignoring case and accents, within each tag's rows."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    by = Window.partitionBy(tag).orderBy(F.size(parts), F.collate(F.col(path), "UNICODE_CI_AI"), F.col(path))
    return rows.withColumn("ord", F.row_number().over(by))


def closure(edges: DataFrame, depth: int | None = None) -> DataFrame:
    """All (src, dst) pairs that links lead to, each once with its least number of steps; a node on a cycle is paired with itself. A null is no node to go on from or to.

    Every round follows one more link from the pairs found last, leaves out those found before and writes the others to the shared folder, until none is new or,
    where ``depth`` is given, after so many steps.
    """
    links = written(edges.select("src", "dst").distinct(), "links")
    folder = f"{shared_dir(edges.sparkSession)}/loomdoc-closure-{uuid.uuid4().hex}"
    kind, steps = None, 1
    new = links.withColumn("steps", F.lit(1))
    while True:
        new.write.parquet(f"{folder}/{steps}")
        kind = kind or new.schema
        read = edges.sparkSession.read.schema(kind)
        found, last = read.parquet(f"{folder}/*"), read.parquet(f"{folder}/{steps}")
        if steps == depth or not last.take(1):
            return found
        steps += 1
        ahead = last.select("src", F.col("dst").alias("via")).join(links.select(F.col("src").alias("via"), "dst"), "via").where("src IS NOT NULL AND dst IS NOT NULL")
        new = ahead.select("src", "dst").distinct().join(found, ["src", "dst"], "left_anti").withColumn("steps", F.lit(steps))


def computed_once(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with more columns that are computed once a row, however many fields of theirs are used later.

    The optimiser writes a struct's whole expression out again for each field that is read from it; it doesn't do that across the generator that stands in between here.
    """
    held = F.explode(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))).alias("__held")
    kept = [c for c in rows.columns if c not in columns]
    return rows.select(*kept, held).select(*kept, *[F.col("__held")[name].alias(name) for name in columns])


def severity_counts(rows: DataFrame, severity: Column) -> DataFrame:
    return rows.groupBy(severity.alias("severity")).agg(F.count("*").alias("n"))
