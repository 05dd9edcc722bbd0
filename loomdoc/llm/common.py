"""What the training-data operators share: tables in the shared folder, row keys, connected components."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.sources.shared import shared_dir, written  # noqa: F401


#: Bytes of an Arrow batch, about; a longer text is a batch of its own.
BATCH_BYTES = 4 << 20


def byte_batches(spark: SparkSession) -> None:
    """Let the session cut Arrow batches by bytes, so that a task's memory doesn't follow the length of its texts times thousands of rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def giving_back(run: Callable) -> Callable:
    """A mapInArrow function that returns freed memory to the system at the end of a task: workers live on, and what their allocators keep would count against the next stage."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def steady_heap() -> None:
    """Let the worker's allocator keep arrays up to 256 MB between uses instead of asking the system for fresh pages each time; ``giving_back`` returns them in the end."""
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 28)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 1 << 28)  # M_TRIM_THRESHOLD


def free_name(taken: list[str], name: str) -> str:
    """``name``, with as many underscores before it as it takes to be none of the names that are taken (case doesn't tell names apart)."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, every other character untouched."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Components of an undirected graph given as ``(a long, b long)`` rows, as ``(node, component)`` with the smallest node.

    Large-star and small-star rounds. Each is a map-side combined ``min`` per node and a join that
    AQE can split where a node is hot. Every round is written to the shared folder. Self links, nulls and repeats are ignored;
    an empty input gives an empty result.
    """
    spark = edges.sparkSession
    links = written(edges.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "links")

    def stamp(df: DataFrame) -> tuple:
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = stamp(links)
    if before[0] == 0:
        return spark.createDataFrame([], "node long, component long")
    for _ in range(max_rounds):
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        down = large.groupBy("v").agg(F.min("u").alias("m"))
        joined = large.join(down, "v")
        small = joined.select(F.col("m").alias("u"), F.col("u").alias("v")).union(joined.select(F.col("m").alias("u"), "v"))
        links = written(small.where("u <> v").distinct(), "links")
        after = stamp(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return links.select(F.col("v").alias("node"), F.col("u").alias("component")).union(
        links.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    )
