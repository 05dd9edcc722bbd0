"""Operations of documents as rows: flattening, grouping, method and path order, tag fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The native methods in their fixed order; others follow by name.
METHOD_ORDER = ("get", "post", "put", "patch", "delete", "options", "head", "trace", "query")


def method_rank(method: Column) -> Column:
    """Place of a method; unknown ones share the last place."""
    ranks = F.create_map(*[x for i, m in enumerate(METHOD_ORDER) for x in (F.lit(m), F.lit(i))])
    return F.coalesce(F.try_element_at(ranks, F.lower(method)), F.lit(len(METHOD_ORDER)))


def operations_of(docs: DataFrame, doc_col: str = "doc") -> DataFrame:
    """The other columns of ``docs``, ``path``, ``method``, ``ord`` and ``operation`` (VARIANT) of every operation under ``paths`` of the VARIANT column.

    Native methods by rank, then others by name. Documents without paths give no rows.
    """
    keep = [c for c in docs.columns if c != doc_col]
    docs.select(*keep, F.try_variant_get(doc_col, "$.paths", "variant").alias("__paths")).createOrReplaceTempView("__loomdoc_documents")
    columns = "".join(f"d.`{c}`, " for c in keep)
    found = docs.sparkSession.sql(
        f"SELECT {columns}p.key AS path, o.key AS method, o.value AS operation"
        " FROM __loomdoc_documents d, LATERAL variant_explode(d.__paths) p, LATERAL variant_explode(p.value) o WHERE p.key IS NOT NULL AND o.key IS NOT NULL"
    )
    return found.withColumn("ord", method_rank(F.col("method")))


def operations_by_id(operations: DataFrame, order: str, id_col: str = "operation_id") -> DataFrame:
    """The last operation of each id; rows without an id go."""
    rest = [c for c in operations.columns if c != id_col]
    return operations.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(id_col, "__r.*")


def path_items(operations: DataFrame, path: str, method: str, value: str, order: str) -> DataFrame:
    """One row for each path with its ``methods`` in method order as ``method=value`` entries; of a method's rows the last wins."""
    last = operations.groupBy(path, F.lower(method).alias("__m")).agg(F.max_by(F.col(value), order).alias("__v"))
    entry = F.struct(method_rank(F.col("__m")).alias("rank"), F.col("__m").alias("method"), F.col("__v").alias("value"))
    listed = last.groupBy(path).agg(F.array_sort(F.collect_list(entry)).alias("__items"))
    return listed.select(path, F.transform("__items", lambda e: F.struct(e["method"].alias("method"), e["value"].alias("value"))).alias("methods"))


def tag_fields(rows: DataFrame, tag: str, fields: list[str], order: str) -> DataFrame:
    """Field by field the last value that isn't null, for each tag."""
    return rows.groupBy(tag).agg(*[F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields])


def distinct_responses(rows: DataFrame, parts: list[str], order: str) -> DataFrame:
    """The first row of each combination of ``parts``; nulls are equal."""
    rest = [c for c in rows.columns if c not in parts]
    return rows.groupBy(*parts).agg(F.min_by(F.struct(*rest), order).alias("__r")).select(*parts, "__r.*")
