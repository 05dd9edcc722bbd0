"""Checks that produce rows: each is a filter or an anti join that gives (code, severity, subject, message), and checks are united."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: File patterns of unsupported route features and what is said of them.
ROUTE_FEATURES = (
    (r"/\[\[\.\.\.", "optional catch-all segment"),
    (r"/@[^/]+", "parallel route segment"),
    (r"/\(\.+[^)]*\)", "intercepting route segment"),
)

SCHEMA = ("code", "severity", "subject", "message")


def rows_where(rows: DataFrame, failing: Column, code: str, severity: str, subject: Column, message: Column) -> DataFrame:
    """A diagnostic for every row for which ``failing`` is true."""
    return rows.where(failing).select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), subject.cast("string").alias("subject"), message.alias("message"))


def unknown_references(rows: DataFrame, known: DataFrame, key: str, code: str, severity: str, subject: Column) -> DataFrame:
    """A diagnostic for every row whose key isn't null and isn't among ``known``."""
    missing = rows.where(F.col(key).isNotNull()).join(known.select(key), key, "left_anti")
    return rows_where(missing, F.lit(True), code, severity, subject, F.concat(F.lit("unknown "), F.lit(key), F.lit(": "), F.col(key).cast("string")))


def route_features(files: DataFrame, path: str) -> DataFrame:
    """Information on each unsupported feature that a file's path shows; a path may show several."""
    clean = F.translate(path, "\\", "/")
    found = [F.when(clean.rlike(pattern), F.lit(said)) for pattern, said in ROUTE_FEATURES]
    each = files.select(path, F.explode(F.array_compact(F.array(*found))).alias("__said"))
    return rows_where(each, F.lit(True), "unsupported-route-feature", "info", F.col(path), F.concat_ws(" ", F.lit("route uses an"), F.col("__said")))


def together(checks: Sequence[DataFrame], once: Sequence[str] = ()) -> DataFrame:
    """All checks' rows; with ``once`` one row for each combination of those columns."""
    every = reduce(DataFrame.unionByName, checks)
    if not once:
        return every
    rest = [c for c in every.columns if c not in once]
    return every.groupBy(*once).agg(F.min(F.struct(*rest)).alias("__r")).select(*once, "__r.*").select(*SCHEMA)


def fails(rows: DataFrame, on: str) -> bool:
    """Whether a run fails: ``on`` is never, error, or warning (which counts errors too). Reads no more than the first such row."""
    if on == "never":
        return False
    wanted = ["error"] if on == "error" else ["error", "warning"]
    return not rows.where(F.col("severity").isin(*wanted)).isEmpty()
