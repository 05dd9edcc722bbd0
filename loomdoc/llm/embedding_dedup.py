"""Embedding near-dedup with a forest of random-projection trees.

The forest is fitted on a bounded sample and holds a random direction and a median for each node. A vector within the spill of a node's median goes to both
sides. Each label's vectors are compared inside the leaves of every tree, in blocks of a bounded size; a pair that shares several leaves counts in the
first of them only. Equal vectors are one class, compared once. Links are verified in double precision and united.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdoc.llm.common import connected_components, written

#: Trees, vectors in a leaf (about), vectors the forest is fitted on (about), sampled vectors that a node needs for a median of its own, vectors in a block.
TREES, LEAF, SAMPLE, OWN, BLOCK = 5, 400, 20_000, 64, 1500

#: Spill to either side of a median, times the square root of the dimensions, for the chord 0.2 of cosine 0.98: a pair at the threshold differs by more than twice this in 1 of 60 directions.
SPILL = 0.24


class Forest:
    """Directions (trees x levels x dimensions) and medians (trees x nodes, numbered as in a heap). Levels deeper than the sample can place medians for split at the sample's median."""

    def __init__(self, sample: np.ndarray, depth: int, threshold: float, seed: int = 11):
        rng = np.random.default_rng(seed)
        dims = sample.shape[1]
        self.depth = depth
        self.spill = SPILL / np.sqrt(dims) * np.sqrt(max(1e-6, 2 - 2 * threshold)) / 0.2
        self.directions = rng.normal(size=(TREES, depth, dims))
        self.directions /= np.linalg.norm(self.directions, axis=2, keepdims=True)
        self.own = min(depth, max(0, int(np.log2(max(1, len(sample) / OWN)))))
        self.medians = np.zeros((TREES, 1 << self.own))
        self.level = np.median(np.einsum("nd,tld->tln", sample, self.directions), axis=2) if depth else np.zeros((TREES, 0))
        for t in range(TREES):
            node = np.ones(len(sample), np.int64)
            for level in range(self.own):
                along = sample @ self.directions[t, level]
                order = np.lexsort((along, node))
                nodes, starts, counts = np.unique(node[order], return_index=True, return_counts=True)
                self.medians[t, nodes] = along[order][starts + counts // 2]
                node = node * 2 + (along >= self.medians[t, node])

    def leaves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and leaf codes (trees one after another): every leaf that a vector reaches."""
        rows, codes = [], []
        for t in range(TREES):
            row, node = np.arange(len(vectors)), np.ones(len(vectors), np.int64)
            for level in range(self.depth):
                middle = self.medians[t, node] if level < self.own else self.level[t, level]
                along = (vectors @ self.directions[t, level])[row] - middle
                left, right = along < self.spill, along >= -self.spill
                row, node = np.r_[row[left], row[right]], np.r_[node[left] * 2, node[right] * 2 + 1]
            rows.append(row)
            codes.append(node + (t << (self.depth + 1)))
        return np.concatenate(rows), np.concatenate(codes)


def _unpack(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # scaled by the largest component, so that squares neither vanish nor overflow
        packed = [(x / np.abs(x).max()).tobytes() for x in (np.asarray(v, np.float64) for v in batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(packed, pa.binary()), *batch.columns[3:]], ["node", "grp", "vec", "copies", "dims"])


def _place(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forests = shared.value
        for batch in batches:
            dims = np.array(batch.column("dims").to_pylist(), np.int64)
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                vectors = _unpack(part.column("vec"))
                rows, codes = forests[int(d)].leaves(vectors / np.linalg.norm(vectors, axis=1, keepdims=True))
                by = np.lexsort((codes, rows))
                rows, codes = rows[by], codes[by]
                ends = np.searchsorted(rows, np.arange(len(vectors) + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(codes, pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], ["node", "grp", "vec", "copies", "dims", "leaves"])

    return run


def _compare(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        code, i, j = (table.column(c)[0].as_py() for c in ("leaf", "i", "j"))
        node, side = table.column("node").to_numpy(), table.column("block").to_numpy()
        vectors = _unpack(table.column("vec").combine_chunks())
        vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        copies = table.column("copies").to_numpy()
        leaves = table.column("leaves").combine_chunks()
        flat, sizes = leaves.flatten().to_numpy(), leaves.value_lengths().to_numpy()
        owner = np.repeat(np.arange(len(node)), sizes)
        a = np.flatnonzero(side == i)
        b = a if i == j else np.flatnonzero(side == j)
        lower = flat < code
        names, column = np.unique(flat[lower], return_inverse=True)
        inside = np.zeros((len(node), len(names)), np.float32)
        inside[owner[lower], column] = 1
        linked = vectors[a] @ vectors[b].T >= threshold
        if i == j:
            np.fill_diagonal(linked, False)
        own = linked & (inside[a] @ inside[b].T == 0) if len(names) else linked
        links = np.zeros(len(node), np.int64)
        links[a] += own @ copies[b]
        if i != j:
            links[b] += own.T @ copies[a]
        # a forest of the block's links: every node's smallest reachable node inside the block
        root = np.arange(len(node))[np.argsort(np.argsort(node, kind="stable"), kind="stable")]
        while True:
            before = root.copy()
            here, there = root[a], root[b]
            least = np.where(linked, there[None, :], len(node)).min(1, initial=len(node))
            root[a] = np.minimum(root[a], least)
            here = root[a]
            root[b] = np.minimum(root[b], np.where(linked, here[:, None], len(node)).min(0, initial=len(node)))
            if (before == root).all():
                break
        by_rank = np.sort(node)
        keep = (links > 0) | (by_rank[root] != node)
        return pa.table({"node": node[keep], "links": links[keep], "root": by_rank[root[keep]]})

    return run


def near_vectors(table: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``id_col``, ``n_links``, ``component_id`` and ``kept`` of every row of ``table``; the id is a long.

    Rows are compared if labels and dimensions are equal and labels aren't null. Vectors that are null, empty, zero or hold null or non-finite components link with nothing: 0 links, a
    component of their own. Rows with equal vectors and labels link with each other, rows with an equal id too. An empty table gives an empty one.
    """
    spark = table.sparkSession
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.transform(F.col(vector_col), lambda x: x.cast("double") + F.lit(0.0)).alias("v"))
    largest = F.array_max(F.transform("v", F.abs))
    sound = F.col("label").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.withColumn("ok", F.coalesce(sound & (largest > 0), F.lit(False))).withColumn("key", F.when(F.col("ok"), F.sha2(F.concat_ws(",", F.length(F.col("label").cast("string")).cast("string"), F.col("label").cast("string"), F.transform("v", lambda x: x.cast("string"))), 256)))
    rows = written(rows, "vectors")
    classes = rows.where("ok").groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
    packed = classes.select(F.xxhash64("key").alias("node"), F.col("label").cast("string").alias("grp"), "v", "copies", F.size("v").alias("dims")).mapInArrow(
        _pack, "node long, grp string, vec binary, copies long, dims int"
    )
    packed = written(packed, "classes")
    forests = {}
    for row in packed.groupBy("grp", "dims").count().groupBy("dims").agg(F.max("count").alias("most"), F.sum("count").alias("all")).collect():
        take = min(1.0, SAMPLE / row["all"])
        sample = packed.where((F.col("dims") == row["dims"]) & (F.pmod(F.xxhash64(F.lit(5), "node"), F.lit(1_000_000)) <= int(take * 1e6))).select("vec").toArrow()
        vectors = _unpack(sample.column("vec").combine_chunks()) if sample.num_rows else np.eye(1, row["dims"])
        depth = int(np.ceil(np.log2(max(1, row["most"] / LEAF))))
        forests[row["dims"]] = Forest(vectors / np.linalg.norm(vectors, axis=1, keepdims=True), depth, threshold)
    placed = written(packed.mapInArrow(_place(spark.sparkContext.broadcast(forests)), "node long, grp string, vec binary, copies long, dims int, leaves array<long>"), "leaves")
    spots = placed.select("grp", "dims", F.explode("leaves").alias("leaf")).groupBy("grp", "dims", "leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    each = placed.withColumn("leaf", F.explode("leaves")).join(spots, ["grp", "dims", "leaf"])
    each = each.withColumn("block", F.pmod(F.xxhash64(F.lit(7), "node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = each.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    parts = each.select("grp", "dims", "leaf", "i", "j", "node", "vec", "copies", "block", "leaves").groupBy("grp", "dims", "leaf", "i", "j").applyInArrow(_compare(threshold), "node long, links long, root long")
    parts = written(parts, "links")
    links = parts.groupBy("node").agg(F.sum("links").alias("links"))
    found = connected_components(parts.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = classes.select("key", "least", "copies").withColumn("node", F.xxhash64("key")).join(links, "node", "left").join(found, "node", "left").withColumn("c", F.coalesce("component", "node"))
    named = written(named.select("key", "least", "c", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "named")
    least = named.groupBy("c").agg(F.min("least").alias("component_id"))
    named = named.join(least, "c").select("key", "n_links", "component_id")
    full = rows.where("ok").select("id", "key").join(named, "key").select("id", "n_links", "component_id")
    alone = rows.where("NOT ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return full.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def op6_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Every vector's links and component."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
