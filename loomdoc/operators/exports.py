"""Where exported names come from: the schema index over files, re-exports followed to their definitions by pointer jumping.

A file holds a name if it defines it or re-exports it by name. ``export *`` lets a file show what another one shows, unless it holds the name itself; of several
holders the one that fewest stars lead to counts, then the least file. ``default`` passes no star. Files and names are given as rows; no source is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdoc.sources.shared import written


def _sorted(df: DataFrame) -> DataFrame:
    """A side of a join that is sorted and not sent through the driver: rows of one name and many files are small when written, and many times that when read."""
    return df.hint("merge")


def star_reach(stars: DataFrame) -> DataFrame:
    """``(file, source, hops)``: every file that stars lead to, with the least number of stars. Paths double each round, so a chain of n files takes log n joins."""
    reach = written(stars.where("file <> source").select("file", "source", F.lit(1).alias("hops")).distinct(), "stars")
    size = reach.count()
    while size:
        ahead = reach.alias("a").join(_sorted(reach).alias("b"), F.col("a.source") == F.col("b.file")).where("a.file <> b.source").select("a.file", "b.source", (F.col("a.hops") + F.col("b.hops")).alias("hops"))
        more = written(reach.unionByName(ahead).groupBy("file", "source").agg(F.min("hops").alias("hops")), "stars")
        stamp = more.agg(F.count("*"), F.sum("hops")).first()
        settled = stamp[0] == size and stamp[1] == reach.agg(F.sum("hops")).first()[0]
        reach, size = more, stamp[0]
        if settled:
            break
    return reach


def jumped(links: DataFrame) -> DataFrame:
    """``(node, end, state)`` of ``(node, next)`` rows, one a node: the node that following ``next`` leads to. ``end`` is null and ``state`` 'cycle' where it leads to none, as on a cycle.

    A node without a row is an end ('found'). Every round doubles the steps of the nodes that are not there yet: log n joins for a path of n.
    """
    ways = written(links.select("node", F.col("next").alias("end")), "jumps")
    steps, number = 1, ways.count()
    while True:
        ahead = ways.select(F.col("node").alias("end"), F.col("end").alias("later"))
        ways = written(ways.join(_sorted(ahead), "end", "left").select("node", F.coalesce("later", "end").alias("end"), F.col("later").isNull().alias("there")), "jumps")
        # a node whose end is no node itself has arrived; a way longer than there are nodes never does
        if steps > number or ways.where("NOT there").isEmpty():
            return ways.select("node", F.when(F.col("there"), F.col("end")).alias("end"), F.when(F.col("there"), "found").otherwise("cycle").alias("state"))
        steps *= 2


def schema_index(definitions: DataFrame, named: DataFrame, stars: DataFrame) -> DataFrame:
    """``(file, name, from_file, from_name, state)`` of every name that a file shows.

    ``definitions`` has ``(file, name)``, ``named`` ``(file, name, source, original)`` and ``stars`` ``(file, source)``. ``state`` is found, cycle, or missing where a named
    re-export leads to a file that shows no such name. A definition counts before a re-export of its file and name; of two re-exports the one with the least source does.
    """
    own = written(definitions.where("file IS NOT NULL AND name IS NOT NULL").select("file", "name").distinct(), "definitions")
    links = named.where("file IS NOT NULL AND name IS NOT NULL").groupBy("file", "name").agg(F.min(F.struct("source", "original")).alias("to")).select("file", "name", "to.*")
    links = written(links.join(_sorted(own), ["file", "name"], "left_anti"), "re-exports")
    holds = own.unionByName(links.select("file", "name"))
    reach = star_reach(stars)
    shown = reach.join(_sorted(holds.where("name <> 'default'").withColumnRenamed("file", "source")), "source").groupBy("file", "name").agg(F.min(F.struct("hops", "source"))["source"].alias("holder"))
    holders = written(holds.withColumn("holder", F.col("file")).unionByName(shown.join(_sorted(holds), ["file", "name"], "left_anti")), "holders")
    pair = lambda a, b: F.struct(F.col(a).alias("file"), F.col(b).alias("name"))
    goals = links.join(_sorted(holders.select(F.col("file").alias("source"), F.col("name").alias("original"), "holder")), ["source", "original"], "left")
    ends = written(jumped(goals.select(pair("file", "name").alias("node"), F.when(F.col("holder").isNotNull(), pair("holder", "original")).alias("next")).where("next IS NOT NULL")), "ends")
    lost = goals.where("holder IS NULL").select(pair("file", "name").alias("end"), F.lit(True).alias("lost"))
    resolved = ends.join(_sorted(lost), "end", "left").select("node", "end", F.when(F.col("lost"), "missing").otherwise(F.col("state")).alias("state")).unionByName(lost.select(F.col("end").alias("node"), "end", F.lit("missing").alias("state")))
    every = holders.select("file", "name", pair("holder", "name").alias("node")).join(_sorted(resolved), "node", "left")
    found = F.coalesce("state", F.lit("found"))
    goal = F.when(found == "found", F.coalesce("end", "node"))
    return every.select("file", "name", goal["file"].alias("from_file"), goal["name"].alias("from_name"), found.alias("state"))


def unresolved(index: DataFrame, types: DataFrame) -> DataFrame:
    """Type names ``(file, type)`` that no file's index row resolves, array brackets taken off; object and tuple literals name nothing."""
    bare = F.regexp_replace(F.trim("type"), r"(\[\])+$", "")
    asked = types.select("file", "type", bare.alias("name")).where((F.col("name") != "") & ~F.col("name").rlike(r"^[{\[]"))
    return asked.join(index.where("state = 'found'").select("file", "name"), ["file", "name"], "left_anti").select("file", "type").distinct()
