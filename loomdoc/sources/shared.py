"""Tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs in one local process (tests). A cluster without the setting is an error."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        set_dir = "file://" + tempfile.mkdtemp(prefix="loomdoc-")
        spark.sparkContext._jsc.sc().setCheckpointDir(set_dir)
        spark.conf.set("spark.checkpoint.dir", set_dir)
    return set_dir


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage, and outlives any executor."""
    path = f"{shared_dir(df.sparkSession)}/loomdoc-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
