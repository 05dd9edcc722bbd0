"""Fragments of files in the state store: updates, deletions and a reset of everything, one state entry a file."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CHANGE = "run long, ord long, file string, action string, fragment string"
LOG = "run long, ord long, file string, gone boolean, fragment string"


class Fragments(StatefulProcessor):
    """Holds each file's last fragment and the run it belongs to; changes of earlier runs, and those older than what is held, do nothing.

    A reset begins a new run: it can't visit every file's entry, so an entry of an earlier run counts as none from then on and goes when its file, or the state's time to live, comes up.
    """

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "run long, ord long, gone boolean, fragment string", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.held.get() if self.held.exists() else None
        run, at = (before[0], before[1]) if before else (-1, -1)
        last = before
        for batch in rows:
            for r in batch.sort_values(["run", "ord"]).itertuples(index=False):
                if (r.run, r.ord) > (run, at):
                    gone = r.action != "update"
                    run, at, last = int(r.run), int(r.ord), (int(r.run), int(r.ord), gone, None if gone else r.fragment)
        if last is before or last is None:
            return
        if before is not None and before[0] == last[0] and bool(before[2]) == last[2] and before[3] == last[3]:
            self.held.update(last)  # the same fragment again: nothing to tell
            return
        if last[2] and key[0] is not None and before is None:
            self.held.update(last)
            return
        self.held.update(last)
        yield pd.DataFrame({"run": [last[0]], "ord": [last[1]], "file": [key[0]], "gone": [last[2]], "fragment": [last[3]]})

    def close(self) -> None:
        pass


def fragment_log(changes: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """The stream of what really changes, from a stream of changes ``(run, ord, file, action, fragment)``: ``(run, ord, file, gone, fragment)``, to be appended to a table.

    ``action`` is update, delete or reset; a reset has no file and begins the run that it names. Needs the RocksDB state store. A micro-batch touches the entries of its own files alone.
    """
    return changes.groupBy("file").transformWithStateInPandas(Fragments(ttl_ms), LOG, "Append", "None" if ttl_ms is None else "ProcessingTime")


def fragments(log: DataFrame) -> DataFrame:
    """``(file, fragment)`` as the log's last run has them; resets count as runs even where nothing followed."""
    run = log.agg(F.max("run").alias("now"))
    last = log.join(F.broadcast(run), log["run"] == run["now"]).where("file IS NOT NULL").groupBy("file").agg(F.max_by(F.struct("gone", "fragment"), "ord").alias("l"))
    return last.where("NOT l.gone").select("file", "l.fragment")
