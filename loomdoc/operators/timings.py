"""Phases of a run with their counts and times, taken while the phase runs: no row is read a second time to be counted."""

from __future__ import annotations

import time
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

ROWS = "run string, phase string, rows long, amounts map<string,double>, ms double"


class Timings:
    """``observed`` names a phase and what is summed up in it; after the phase's action has run, ``rows`` has a row for it.

    Counts are those of the rows that passed at that place. A phase whose action never ran, or runs again, has one row at most: of its first run. Times are from naming a phase, or the end of the phase before if that
    is later, to its first action's end, which ``done`` tells; without ``done`` a phase has no time.
    """

    def __init__(self, spark: SparkSession, run: str):
        self.spark, self.run = spark, run
        self.phases: list[list] = []

    def observed(self, df: DataFrame, phase: str, amounts: Mapping[str, Column] | None = None) -> DataFrame:
        watch = Observation()
        sums = [F.sum(c.cast("double")).alias(f"amount_{name}") for name, c in (amounts or {}).items()]
        self.phases.append([phase, watch, time.time(), None])
        return df.observe(watch, F.count(F.lit(1)).alias("rows"), *sums)

    def done(self, phase: str) -> None:
        """The phase's action has ended."""
        last = max((p[3] for p in self.phases if p[3]), default=0.0)
        for p in self.phases:
            if p[0] == phase and p[3] is None:
                p[2], p[3] = max(p[2], last), time.time()

    def rows(self) -> DataFrame:
        """``(run, phase, rows, amounts, ms)`` of the phases that ``done`` was told of."""
        made = []
        for phase, watch, began, ended in self.phases:
            if ended is not None:
                got = watch.get
                made.append((self.run, phase, got["rows"], {k.removeprefix("amount_"): float(v or 0) for k, v in got.items() if k.startswith("amount_")}, (ended - began) * 1000))
        return self.spark.createDataFrame(made, ROWS)


def averages(timings: DataFrame) -> DataFrame:
    """``(phase, runs, mean_ms, least_ms, most_ms, share)`` over runs; ``share`` of the mean time of all phases. A phase that stands several times in a run counts with its sum there."""
    each = timings.groupBy("run", "phase").agg(F.sum("ms").alias("ms"))
    made = each.groupBy("phase").agg(F.count("*").alias("runs"), F.avg("ms").alias("mean_ms"), F.min("ms").alias("least_ms"), F.max("ms").alias("most_ms"))
    total = made.agg(F.sum("mean_ms").alias("total"))
    return made.join(F.broadcast(total)).withColumn("share", F.when(F.col("total") > 0, F.col("mean_ms") / F.col("total"))).drop("total")
