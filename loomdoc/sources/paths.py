"""Joins over paths: the nearest marker file above a place, and import aliases by their longest prefix. Prefixes are exploded and joined by equality, so no side is compared with all of the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ancestors(path: Column) -> Column:
    """The folders above a path, from the root down: ``/a/b/c`` has ``/``, ``/a`` and ``/a/b``; relative paths begin at ``.``. Repeated slashes count once."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    root = F.when(path.startswith("/"), "").otherwise(".")
    depths = F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0)))
    folder = F.transform(depths, lambda n: F.when(n == 0, F.when(root == "", "/").otherwise(root)).when(root == "", F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array_join(F.slice(parts, 1, n), "/")))
    return folder


def nearest_files(places: DataFrame, files: DataFrame, names: list[str], place: str = "path") -> DataFrame:
    """``(place, ord, found)``: the files of the given names in the folders above each place, the nearest folder first and in a folder in the order of ``names``; ``ord`` from 0.

    ``places`` are files or folders with their slash at the end (a folder holds itself), ``files`` has ``path``. Places without any file have no row.
    """
    p = F.col(place)
    asked = places.where(p.isNotNull()).select(place).distinct().select(place, F.posexplode(ancestors(F.when(p.endswith("/"), F.concat(p, F.lit("x"))).otherwise(p))).alias("depth", "folder"))
    f = F.col("marker")
    parent = F.when(~f.contains("/"), ".").otherwise(F.coalesce(F.nullif(F.regexp_replace(f, "/+[^/]*$", ""), F.lit("")), F.lit("/")))
    order = F.array_position(F.array(*[F.lit(n) for n in names]), F.substring_index(f, "/", -1))
    marks = files.select(F.col("path").alias("marker")).select("marker", parent.alias("folder"), order.alias("which")).where("which > 0").distinct()
    # only the folders that hold a marker meet; a place has as many rows as its path has folders
    hits = asked.join(marks, "folder").groupBy(place).agg(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "which", "marker"))).alias("hits"))
    return hits.select(place, F.posexplode(F.transform("hits", lambda h: h["marker"])).alias("ord", "found"))


def aliased(imports: DataFrame, aliases: DataFrame, source: str = "source") -> DataFrame:
    """``imports`` with ``target``: the source with the longest alias that fits put in place of it; null where none does.

    ``aliases`` are ``(alias, path)``: ``@/*`` with ``src/*`` fits everything below ``@/``, an alias without a star the source alone. Of two paths of an alias the first by name counts; the exact alias goes before any star.
    """
    table = aliases.groupBy("alias").agg(F.min("path").alias("path"))
    star = F.col("alias").endswith("*")
    keyed = table.select(star.alias("star"), F.when(star, F.expr("substring(alias, 1, length(alias) - 1)")).otherwise(F.col("alias")).alias("prefix"), "path")
    s = F.col(source)
    sources = imports.select(source).where(s.isNotNull()).distinct()
    # aliases end at a slash, a mark or anywhere: every prefix of a source that is as long as some alias is asked for, once for each source
    lengths = F.array_sort(F.collect_set(F.length("prefix")))
    sizes = keyed.where("star").agg(lengths.alias("sizes"))
    asked = sources.join(F.broadcast(sizes)).select(source, F.explode(F.filter("sizes", lambda n: n <= F.length(source))).alias("n")).select(source, F.expr(f"substring(`{source}`, 1, n)").alias("prefix"), F.lit(True).alias("star"))
    whole = sources.select(source, s.alias("prefix"), F.lit(False).alias("star"))
    hits = asked.unionByName(whole).join(keyed, ["prefix", "star"])
    rest = F.expr(f"substring(`{source}`, length(prefix) + 1)")
    best = hits.groupBy(source).agg(F.max_by(F.when(F.col("star"), F.concat(F.regexp_replace("path", r"\*$", ""), rest)).otherwise(F.col("path")), F.struct(~F.col("star"), F.length("prefix"))).alias("target"))
    return imports.join(best, source, "left")


def alias_mappings(types: DataFrame) -> DataFrame:
    """``(name, schema)`` of type aliases ``(name, text)`` that are inferred from a schema's value: ``z.infer<typeof X>`` or ``infer<typeof X>``."""
    found = F.regexp_extract("text", r"^\s*(?:z\s*\.\s*)?infer\s*<\s*typeof\s+([\p{L}_$][\p{L}\p{N}_$]*)\s*(?:,.*)?>\s*;?\s*$", 1)
    return types.select("name", found.alias("schema")).where("schema <> ''")
