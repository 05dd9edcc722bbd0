"""Mixing sources to target weights as a min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). On that small graph, token capacity is routed from patterns
to source quotas; each further copy of a pattern's tokens costs more than the last, so repeats are spread before they
deepen. The flow says how many words each pattern gives. Within a pattern documents are selected by a seeded hash: all take the full copies,
and the rest goes to documents in hash order, found by bucket sums and one small window in the bucket where the rest ends.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomdoc.llm.common import written

WORDS = r"[^\x20\x09-\x0D]+"

#: The weights of the contract, repeated over the sources in order.
CONTRACT_WEIGHTS = (3, 1, 2)

#: Buckets of the seeded order in each pattern.
BUCKETS = 1 << 14


def targets(sizes: dict, weights: Sequence[float], share: float, most: float) -> dict:
    """Each source's target: ``share`` of all sizes by weight in code point order (None last), at most ``most`` times its size, excess reshared."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, active, found = share * sum(sizes.values()), list(order), {}
    while active:
        whole = sum(weight[s] for s in active)
        over = [s for s in active if left * weight[s] / whole > most * sizes[s]] if whole else active
        if not over:
            return found | {s: left * weight[s] / whole for s in active}
        for s in over:
            found[s] = float(most * sizes[s])
        left -= sum(found[s] for s in over)
        active = [s for s in active if s not in over]
    return found


def route(patterns: dict[tuple, int], quotas: dict, most: int) -> dict[tuple, dict]:
    """Min-cost flow from patterns (word capacity, ``most`` copies, the k-th at cost k * k) to source quotas: words by pattern and source.

    Successive shortest paths on the graph of patterns and sources, whose size is that of the source catalogue.
    """
    names, sinks = list(patterns), list(quotas)
    node = {("p", p): 1 + i for i, p in enumerate(names)} | {("s", s): 1 + len(names) + i for i, s in enumerate(sinks)}
    end = 1 + len(names) + len(sinks)
    to, cap, cost, out = [], [], [], [[] for _ in range(end + 1)]

    def edge(a: int, b: int, room: int, price: int) -> int:
        for x, y, r, c in ((a, b, room, price), (b, a, 0, -price)):
            out[x].append(len(to))
            to.append(y)
            cap.append(r)
            cost.append(c)
        return len(to) - 2

    arcs = {}
    for p in names:
        for k in range(most):
            edge(0, node["p", p], patterns[p], k * k)
        for s in p:
            arcs[p, s] = edge(node["p", p], node["s", s], 1 << 62, 0)
    for s in sinks:
        edge(node["s", s], end, quotas[s], 0)
    while True:
        dist, via, queue, queued = [1 << 60] * (end + 1), [-1] * (end + 1), [0], {0}
        dist[0] = 0
        while queue:
            x = queue.pop(0)
            queued.discard(x)
            for e in out[x]:
                if cap[e] > 0 and dist[x] + cost[e] < dist[to[e]]:
                    dist[to[e]], via[to[e]] = dist[x] + cost[e], e
                    if to[e] not in queued:
                        queue.append(to[e])
                        queued.add(to[e])
        if via[end] < 0:
            return {p: {s: cap[arcs[p, s] + 1] for s in p} for p in names}
        room, x = 1 << 62, end
        while x:
            room, x = min(room, cap[via[x]]), to[via[x] ^ 1]
        x = end
        while x:
            cap[via[x]] -= room
            cap[via[x] ^ 1] += room
            x = to[via[x] ^ 1]


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", sources_col: str = "sources", size_col: str = "size",
    weights: Sequence[float] = CONTRACT_WEIGHTS, share: float = 1.5, most: int = 2, seed: int = 17,
) -> DataFrame:
    """``docs`` with ``source_size``, ``target`` (of the first of its sources) and ``taken`` (words the mix takes, repeats counted).

    ``sources_col`` is ``array<string>`` (a null item is a source of its own; an empty or null array belongs to no source and takes 0),
    ``size_col`` the words of a document. ``taken`` is at most ``most`` times the size. Reruns agree; rows with equal ids and sizes may share their order
    in the bucket where a pattern's rest ends, which leaves the multiset of results as it is. An empty table gives an empty one. Columns besides stay as they are, whatever their names; those named as the three results give way to them.
    """
    spark = docs.sparkSession
    # a row's own columns are held in one, so that none of theirs meets a name that is used here
    given = docs.select(F.struct(*docs.columns).alias("__held"), F.col(id_col).alias("__id"), F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("__size"), F.coalesce(F.col(sources_col), F.array().cast("array<string>")).alias("__sources"))
    keyed = given.withColumn("__p", F.array_sort(F.array_distinct("__sources")))
    keyed = keyed.withColumn("__u", F.xxhash64(F.lit(seed), F.col("__id"))).withColumn("__b", F.shiftrightunsigned("__u", 50).cast("int"))
    buckets = written(keyed.groupBy("__p", "__b").agg(F.sum("__size").alias("words")), "buckets")
    capacity = {tuple(r["__p"]): int(r["words"] or 0) for r in buckets.groupBy("__p").agg(F.sum("words").alias("words")).collect()}
    sizes: dict = {}
    for pattern, words in capacity.items():
        for s in pattern:
            sizes[s] = sizes.get(s, 0) + words
    goal = targets(sizes, weights, share, most)
    flow = route(capacity, {s: round(t) for s, t in goal.items()}, most)
    rows = []
    for pattern, words in capacity.items():
        routed = sum(flow[pattern].values())
        copies = routed // words if words else 0
        first = pattern[0] if pattern else None
        rows.append((list(pattern), int(copies), int(routed - copies * words), int(sizes[first]) if pattern else 0, float(goal[first]) if pattern else 0.0))
    # tables of Arrow: rows of Python objects would start Python workers of their own in every executor
    kinds = {"__p": pa.list_(pa.string()), "__copies": pa.int64(), "__rest": pa.int64(), "source_size": pa.int64(), "target": pa.float64()}
    plan = spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values(), strict=True)] if rows else [pa.array([], t) for t in kinds.values()], list(kinds)))
    order = Window.partitionBy("__p").orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = buckets.withColumn("__upto", F.sum("words").over(order)).withColumn("__before", F.col("__upto") - F.col("words"))
    same = F.col("plan.__p").eqNullSafe(F.col("sums.__p"))
    ends = plan.alias("plan").join(sums.alias("sums"), same & (F.col("__before") < F.col("__rest")) & (F.col("__upto") >= F.col("__rest")), "left")
    found = ends.select("plan.*", F.coalesce("__b", F.lit(-1)).alias("__end"), (F.col("__rest") - F.coalesce("__before", F.lit(0))).alias("__left")).toArrow()
    bounds = spark.createDataFrame(found)
    # one row for each membership pattern: the size of the source catalogue
    placed = keyed.join(F.broadcast(bounds), "__p")
    size = F.col("__size")
    full = placed.where("__b <> __end").withColumn("taken", size * (F.col("__copies") + F.when(F.col("__b") < F.col("__end"), 1).otherwise(0)))
    line = Window.partitionBy("__p").orderBy("__u", "__id", "__size").rowsBetween(Window.unboundedPreceding, -1)
    last = placed.where("__b = __end").withColumn("__before", F.coalesce(F.sum(size).over(line), F.lit(0)))
    last = last.withColumn("taken", size * F.col("__copies") + F.greatest(F.lit(0), F.least(size, F.col("__left") - F.col("__before"))))
    results = ["source_size", "target", "taken"]
    columns = [*[F.col("__held")[c].alias(c) for c in docs.columns if c not in results], *results]
    return full.select(columns).union(last.select(columns))


def word_sizes(docs: DataFrame, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with ``size`` (words; null texts 0) and ``sources``, the array of its one source."""
    return docs.withColumns({"size": F.coalesce(F.regexp_count(text_col, F.lit(WORDS)), F.lit(0)).cast("long"), "sources": F.array(F.col(source_col))})


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    sized = written(word_sizes(docs).select("doc_id", "size", "sources"), "sizes")
    return mix_sources(sized).select("doc_id", "size", "source_size", "target", "taken")
