"""Results of single files kept as state: a changed file's fragment replaces the earlier one, micro-batch by micro-batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fragment_key(config: Mapping[str, Column]) -> Column:
    """A hash of what a fragment's result depends on besides its file."""
    return F.sha2(F.to_json(F.struct(*[c.alias(k) for k, c in sorted(config.items())])), 256)


def reusable(files: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files ``(file, size, modified, key)`` whose fragment in ``state`` (the same columns and more) still holds, and the others."""
    same = ["file", "size", "modified", "key"]
    return state.join(files.select(*same), same, "left_semi"), files.join(state.select(*same), same, "left_anti")


def merged(state: DataFrame, changed: DataFrame, removed: DataFrame, key: str = "file") -> DataFrame:
    """The state with changed fragments in place of earlier ones and without those of removed files."""
    gone = changed.select(key).unionByName(removed.select(key))
    return state.join(gone, key, "left_anti").unionByName(changed)


def watch(
    spark: SparkSession, source: str, schema: str, folder: str, build: Callable[[DataFrame], DataFrame], every: str | None = None, keys: Sequence[str] = ("file",),
) -> Callable[[], None]:
    """Keep the state of fragments under ``folder`` as JSON files arrive in ``source``; returns what stops it.

    Micro-batches run one at a time, which queues changes while one runs; ``every`` (a time such as ``120 milliseconds``) gathers a burst of changes into one, without it what is there is worked off once. A batch
    that fails is run again from the checkpoint. Each batch writes a new version of the state and then names it, so a reader sees whole versions. ``keyed`` keeps the same in the state store, touches a batch's files alone, and knows deletions and resets.
    """

    def one(batch: DataFrame, number: int) -> None:
        before = current(spark, folder)
        fresh = build(batch)
        made = fresh if before is None else before.join(fresh.select(*keys).distinct(), list(keys), "left_anti").unionByName(fresh)
        version = f"v{number}-{uuid.uuid4().hex}"
        made.write.parquet(f"{folder}/{version}")
        spark.createDataFrame([(number, version)], "number long, version string").write.mode("append").json(f"{folder}/versions")

    stream = spark.readStream.schema(schema).json(source).writeStream.foreachBatch(one).option("checkpointLocation", f"{folder}/checkpoint")
    query = (stream.trigger(processingTime=every) if every else stream.trigger(availableNow=True)).start()
    if not every:
        query.awaitTermination()
    return query.stop


def current(spark: SparkSession, folder: str) -> DataFrame | None:
    """The latest named version of the state; None before the first."""
    try:
        named = spark.read.schema("number long, version string").json(f"{folder}/versions")
        last = named.orderBy(F.desc("number"), F.desc("version")).first()
    except Exception as error:  # noqa: BLE001  nothing is written yet
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    return spark.read.parquet(f"{folder}/{last['version']}") if last else None
