"""Workflow documents as rows: union of files, steps against known operations, and rewrites for older targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdoc.operators import diagnostics

#: The part of a workflow file that is read.
STEP = (
    "struct<stepId:string,operationId:string,dependsOn:array<string>,timeout:bigint,"
    "parameters:array<struct<name:string,`in`:string,value:string>>>"
)
FILE = f"struct<`$self`:string,info:struct<title:string,version:string>,sourceDescriptions:array<struct<name:string,url:string,type:string>>,workflows:array<struct<workflowId:string,steps:array<{STEP}>>>>"


def read_files(files: DataFrame, text: str = "text") -> DataFrame:
    """``files`` with ``flow``, the parsed workflow file; unreadable text gives a struct of nulls, null text null."""
    return files.withColumn("flow", F.from_json(text, FILE))


def steps_of(files: DataFrame, order: str) -> DataFrame:
    """One row for each step: ``order``, ``workflow``, ``step``, the step's columns, ``w`` and ``s`` (places, from 0)."""
    flows = files.select(order, F.posexplode("flow.workflows").alias("w", "__flow"))
    steps = flows.select(order, "w", F.col("__flow.workflowId").alias("workflow"), F.posexplode("__flow.steps").alias("s", "__step"))
    return steps.select(order, "workflow", "w", "s", "__step.*")


def unknown_operations(steps: DataFrame, operations: DataFrame) -> DataFrame:
    """An error for each step whose operation isn't known; ``operations`` has ``operationId``."""
    return diagnostics.unknown_references(steps, operations, "operationId", "ARAZZO_UNKNOWN_OPERATION_ID", "error", F.concat_ws("/", "workflow", "stepId"))


def united(files: DataFrame, order: str) -> DataFrame:
    """One row: ``info`` of the first file, all source descriptions and the number of workflows. Only these small heads are gathered, no steps."""
    heads = files.select(order, "flow.info", F.coalesce("flow.sourceDescriptions", F.array().cast("array<struct<name:string,url:string,type:string>>")).alias("sources"), F.greatest(F.size("flow.workflows"), F.lit(0)).alias("n"))
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "sources")))
    return heads.agg(F.min_by("info", order).alias("info"), F.flatten(listed["sources"]).alias("sources"), F.sum("n").alias("workflows"))


def for_first_version(steps: DataFrame) -> DataFrame:
    """Steps as the first version has them: no ``dependsOn`` and ``timeout``, ``querystring`` parameters in the query."""
    moved = F.transform("parameters", lambda p: p.withField("in", F.when(p["in"] == "querystring", "query").otherwise(p["in"])))
    return steps.drop("dependsOn", "timeout").withColumn("parameters", moved)


def version_warnings(files: DataFrame, subject: str) -> DataFrame:
    """A warning for each file with a ``$self``, and one for each source of a kind that can't be read."""
    own = diagnostics.rows_where(files, F.col("flow.`$self`").isNotNull(), "ARAZZO_SELF_UNSUPPORTED", "warning", F.col(subject), F.lit("$self is dropped for this target"))
    sources = files.select(subject, F.explode("flow.sourceDescriptions").alias("__s"))
    other = diagnostics.rows_where(sources, F.lower("__s.type") == "asyncapi", "ARAZZO_ASYNCAPI_SOURCE", "warning", F.col(subject), F.concat(F.lit("source is not read: "), F.col("__s.name")))
    return diagnostics.together([own, other])
