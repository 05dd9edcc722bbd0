"""References between schemas: strongly connected components, recursive references, and paths that follow references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdoc.operators.exports import jumped
from loomdoc.sources.shared import written


def _spread(links: DataFrame, start: DataFrame, most: bool) -> DataFrame:
    """``(node, colour)``: the greatest colour that leads to each node over ``(src, dst)`` rows; with ``most`` False only nodes of the same colour are entered, from those marked in ``start``."""
    seen = written(start, "colours")
    new = seen
    while new.take(1):
        ahead = new.join(links, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node"), *([] if most else ["colour"])).agg(F.max("colour").alias("reached"))
        ahead = ahead.select("node", F.col("reached").alias("colour")) if most else ahead.select("node", "colour")
        if most:
            new = written(ahead.join(seen.withColumnRenamed("colour", "held"), "node").where("colour > held").select("node", "colour"), "colours")
            seen = written(seen.join(new.withColumnRenamed("colour", "newer"), "node", "left").select("node", F.coalesce("newer", "colour").alias("colour")), "colours")
        else:
            new = written(ahead.join(seen, ["node", "colour"], "left_anti"), "colours")
            seen = written(seen.unionByName(new), "colours")
    return seen


def _components(links: DataFrame) -> DataFrame:
    """``(node, component)`` of nodes in components of several nodes: colours run forward, and a component is what runs back to its colour's node."""
    found, links = None, written(links, "links")
    while True:
        # what nothing leads to, or what leads nowhere, is in no cycle
        size = links.count()
        while size:
            links = written(links.join(links.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(links.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"), "links")
            before, size = size, links.count()
            if size == before:
                break
        if not size:
            break
        nodes = links.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        colours = _spread(links, nodes.select("node", F.col("node").alias("colour")), True)
        ends = links.join(colours.select(F.col("node").alias("src"), F.col("colour").alias("a")), "src").join(colours.select(F.col("node").alias("dst"), F.col("colour").alias("b")), "dst")
        inside = written(ends.where("a = b").select(F.col("dst").alias("src"), F.col("src").alias("dst")), "links")
        back = _spread(inside, colours.where("node = colour"), False)
        found = back if found is None else found.unionByName(back)
        gone = back.select("node")
        links = written(links.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"), "links")
    if found is None:
        return links.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    least = found.groupBy("colour").agg(F.min("node").alias("component"), F.count("*").alias("n"))
    return found.join(least.where("n > 1"), "colour").select("node", "component")


def strongly_connected(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of ``(src, dst)`` rows; the component is its least node. Nulls, repeats and links of a node to itself change nothing.

    A node with one link in and one out is no more than a step between two others: runs of these become one link (pointer jumping, log n rounds), circles of these alone are
    components as they are. What is left is coloured forward and back; each round there costs as many joins as the longest way has links.
    """
    links = written(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct(), "links")
    nodes = written(links.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "nodes")
    links = written(links.where("src <> dst"), "links")
    outs = links.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("outs"), F.max("dst").alias("next"))
    ins = links.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("ins"))
    steps = written(outs.join(ins, "node").where("outs = 1 AND ins = 1").select("node", "next"), "steps")
    ends = written(jumped(steps), "ends")
    # a run's first step comes from a node that is no step; runs that lead nowhere are circles
    first = links.join(steps.select(F.col("node").alias("src")), "src", "left_anti")
    short = first.join(ends.where("state = 'found'").select(F.col("node").alias("dst"), "end"), "dst", "left").select("src", F.coalesce("end", "dst").alias("dst")).where("src <> dst").distinct()
    several = _components(short)
    loops = first.join(ends.where("state = 'found'").select(F.col("node").alias("dst"), "end"), "dst").where("src = end").select(F.col("src").alias("node"), F.col("dst").alias("by"))
    # a step belongs to its run's ends if these are one component (or one node)
    starts = first.join(steps.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("head"), F.col("src").alias("start"))
    runs = _runs(steps, starts, ends)
    joined = runs.join(several.select(F.col("node").alias("start"), F.col("component").alias("a")), "start", "left").join(several.select(F.col("node").alias("end"), F.col("component").alias("b")), "end", "left")
    inner = joined.where("start = end OR a = b").select("node", F.coalesce("a", "start").alias("component"))
    circles = _circles(steps, ends)
    base = several.unionByName(inner).unionByName(loops.select("node", F.col("node").alias("component")).join(several.select("node"), "node", "left_anti").distinct()).unionByName(circles)
    renamed = base.groupBy("component").agg(F.min("node").alias("least"))
    named = base.join(renamed, "component").select("node", F.col("least").alias("component"))
    return nodes.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _runs(steps: DataFrame, starts: DataFrame, ends: DataFrame) -> DataFrame:
    """``(node, start, end)`` of steps between two other nodes: the way back of a step is the way ahead of the turned steps."""
    turned = steps.join(steps.select(F.col("node").alias("next")), "next", "left_semi").select(F.col("next").alias("node"), F.col("node").alias("next"))
    heads = jumped(turned)
    every = steps.join(heads, "node", "left").where("state IS NULL OR state = 'found'").select("node", F.coalesce("end", "node").alias("head"))
    return every.join(starts, "head").join(ends.where("state = 'found'").select("node", F.col("end").alias("end")), "node").select("node", "start", "end")


def _circles(steps: DataFrame, ends: DataFrame) -> DataFrame:
    """``(node, component)`` of circles of steps alone: the least node of each, found with doubling."""
    on = written(steps.join(ends.where("state = 'cycle'").select("node"), "node", "left_semi").select("node", F.col("next").alias("far"), F.least("node", "next").alias("least")), "circles")
    number, reach = on.count(), 1
    while reach < number:
        ahead = on.select(F.col("node").alias("far"), F.col("far").alias("later"), F.col("least").alias("lower"))
        on = written(on.join(ahead, "far").select("node", F.col("later").alias("far"), F.least("least", "lower").alias("least")), "circles")
        reach *= 2
    return on.select("node", F.col("least").alias("component"))


def recursive_references(edges: DataFrame) -> DataFrame:
    """``(src, dst, stays)``: whether a reference must stand, as its target leads back to its owner; all others can be written out in place."""
    parts = written(strongly_connected(edges), "components")
    both = edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct()
    of = lambda side, name: parts.select(F.col("node").alias(side), F.col("component").alias(name))
    return both.join(of("src", "a"), "src").join(of("dst", "b"), "dst").select("src", "dst", (F.col("a") == F.col("b")).alias("stays"))


def access_paths(accesses: DataFrame, members: DataFrame, references: DataFrame) -> DataFrame:
    """``(id, type, value, code)`` of indexed accesses ``(id, type, steps array<string>)``: where ``type["a"][0]...`` leads.

    ``members`` are ``(type, name, target, value)``: a property, or an item by its number (``*`` for the items of a list), is another type or a value. ``references`` are ``(type, target)``: a type that is
    another one. Before each step, and at the end, references are followed to the type that is none. ``code`` is null, or ``dangling`` (a type that has neither members nor a reference, before the last step),
    ``cyclic`` (references that lead back), ``no-member``. Rounds go on for the accesses that are not there yet alone.
    """
    known = written(members.select("type").unionByName(references.select("type")).distinct(), "types")
    members, references = written(members.select("type", "name", "target", "value").dropDuplicates(["type", "name"]), "members"), written(references.groupBy("type").agg(F.min("target").alias("to")), "references")
    none = F.lit(None).cast("string")
    open_ = written(accesses.select("id", "type", F.coalesce("steps", F.array().cast("array<string>")).alias("steps"), F.array("type").alias("seen"), none.alias("value")), "accesses")
    done = None
    while True:
        follow = written(open_.join(references, "type", "left"), "followed")
        cyclic = F.array_contains("seen", F.col("to"))
        referred = follow.where("to IS NOT NULL")
        here = follow.where("to IS NULL")
        stepped = here.where("size(steps) > 0").withColumn("name", F.col("steps")[0])
        lists = members.where("name = '*'").select("type", F.col("target").alias("t2"), F.col("value").alias("v2"), F.lit(True).alias("h2"))
        found = stepped.join(members.select("type", "name", F.col("target").alias("t1"), F.col("value").alias("v1"), F.lit(True).alias("h1")), ["type", "name"], "left").join(lists, "type", "left").join(known.withColumn("known", F.lit(True)), "type", "left")
        number = F.col("name").rlike(r"^\d+$")
        hit = F.when(F.col("h1"), F.struct(F.col("t1").alias("t"), F.col("v1").alias("v"))).when(number & F.col("h2"), F.struct(F.col("t2").alias("t"), F.col("v2").alias("v")))
        found = written(found.select("id", "type", "steps", F.coalesce("known", F.lit(False)).alias("known"), hit.alias("hit")), "accesses")
        rest = F.slice("steps", 2, F.greatest(F.size("steps"), F.lit(1)))
        on = found.where("hit.t IS NOT NULL").select("id", F.col("hit.t").alias("type"), rest.alias("steps"), F.array("hit.t").alias("seen"), none.alias("value"))
        ends = [
            referred.where(cyclic).select("id", "type", none.alias("value"), F.lit("cyclic").alias("code")), here.where("size(steps) = 0").select("id", "type", "value", none.alias("code")),
            found.where("hit IS NULL").select("id", "type", none.alias("value"), F.when(F.col("known"), "no-member").otherwise("dangling").alias("code")),
            found.where("hit IS NOT NULL AND hit.t IS NULL").select("id", "type", F.when(F.size("steps") == 1, F.col("hit.v")).alias("value"), F.when(F.size("steps") > 1, "no-member").alias("code")),
        ]
        # each round writes what ended in it, not what ended before once more
        more = written(ends[0].unionByName(ends[1]).unionByName(ends[2]).unionByName(ends[3]), "accessed")
        done = more if done is None else done.unionByName(more)
        open_ = written(on.unionByName(referred.where(~cyclic).select("id", F.col("to").alias("type"), "steps", F.concat("seen", F.array("to")).alias("seen"), none.alias("value"))), "accesses")
        if not open_.take(1):
            return done
