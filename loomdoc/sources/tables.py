"""Readers: tables of a folder, and JSON documents as VARIANT rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """Rows dealt out, by columns or as they come, over as many tasks as a shuffle has: a table's file may be a few MB in one piece, while each row of it is work for long or comes to many rows."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON files as ``(file, doc variant)``; broken files have a null document."""
    read = spark.read.text(path, wholetext=True)
    return read.select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("doc"))
