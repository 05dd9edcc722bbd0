"""Incremental recomputation: new files are read once and merged by key, last wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomdoc.operators.records import last_wins


def latest_by_key(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, keys: list[str], order: str) -> DataFrame:
    """Append what is new under ``source`` (JSON lines) to the Parquet log ``target`` and return the latest row of each key."""
    stream = spark.readStream.schema(schema).json(source)
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", target).trigger(availableNow=True).start()
    query.awaitTermination()
    return last_wins(spark.read.schema(schema).parquet(target), keys, order)
