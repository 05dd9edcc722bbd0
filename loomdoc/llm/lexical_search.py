"""Ranked lexical search: best-first branch and bound over a tree of maxima per term.

1. One pass over the texts cuts documents into shards of at most ``SHARD_DOCS`` rows as they come, and keeps a shard as one row of flat arrays:
   ids, lengths and the postings of query terms. Shards are written to the shared folder; nothing of them is shuffled.
2. Corpus counts (documents, terms, documents of each query term) are sums over shards.
3. In a shard, every query term has a binary tree: its leaves are ranges of ``LEAF`` documents with the largest contribution that the term makes in them,
   every other node holds the larger of its two children. For an item, the sum of its terms' values at a node bounds the scores below it. Search opens the
   node of the highest bound, scores the documents of a leaf exactly, and ends when no open bound reaches the tenth score; nodes whose bound equals it are opened, as ties go by id.
4. Shards are the trees' upper level, over all tasks: the shard of the highest bound of each item is searched first, and gives the item a score that ten documents
   reach. Then all shards whose bound reaches it are searched from there. Each gives ten rows of an item at most, and the best ten of all are the result.

Items go in blocks of bounded size, each with passes of its own, so what is broadcast doesn't grow with the query set.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomdoc.llm.common import byte_batches, giving_back, written

#: Rows of a shard, documents of a leaf, and postings after which a shard ends early.
SHARD_DOCS, LEAF, SHARD_POSTINGS = 8192, 16, 1 << 19

#: Bytes of the items' terms in a block, of which each task holds a copy.
BLOCK_BYTES = 4 << 20

#: Every byte that is no part of a term becomes a space, A-Z their small letters. In UTF-8 the bytes of all other characters are 128 and more.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_SHARD = "shard long, ids array<long>, no_id array<boolean>, lengths array<int>, terms array<int>, docs array<int>, tfs array<int>"


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, in order."""
    return text.translate(_TERMS).split()


def _shards(known):
    """Rows of (id, text) to shards with the postings of known terms, sorted by term and document."""

    def pack(held: list) -> pa.RecordBatch:
        ids, lengths, postings = zip(*held, strict=True)
        docs = np.repeat(np.arange(len(held), dtype=np.int32), [len(p) for p in postings])
        pairs = np.array([x for p in postings for x in p.items()], np.int32).reshape(-1, 2)
        order = np.argsort(pairs[:, 0], kind="stable")
        columns = (pa.array([0 if i is None else i for i in ids], pa.int64()), pa.array([i is None for i in ids]), pa.array(lengths, pa.int32()), *(pa.array(x[order]) for x in (pairs[:, 0], docs, pairs[:, 1])))
        lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
        return pa.RecordBatch.from_arrays(lists, ["ids", "no_id", "lengths", "terms", "docs", "tfs"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value
        held, size = [], 0
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                words = terms_of(texts[i].as_py() or b"")
                postings = Counter([number[w] for w in words if w in number])
                held.append((keys[i].as_py(), len(words), postings))
                size += len(postings)
                if len(held) >= SHARD_DOCS or size >= SHARD_POSTINGS:
                    yield pack(held)
                    held, size = [], 0
        if held:
            yield pack(held)

    return giving_back(task)


class Trees:
    """The maxima of one shard's terms, and the search over them."""

    def __init__(self, shard: dict, weights: dict[int, int], documents: int, length: int):
        n = shard["lengths"].astype(np.int64)
        terms, self.docs, tf = shard["terms"], shard["docs"], shard["tfs"].astype(np.int64)
        m = 100 - 90 + (90 * n * documents) // max(1, length)
        self.names, first = np.unique(terms, return_index=True)
        self.first = np.append(first, len(terms))
        weight = np.array([weights[t] for t in self.names.tolist()], np.int64).repeat(np.diff(self.first))
        self.scores = weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[self.docs]))
        self.leaves = 1 << max(0, math.ceil(math.log2(max(1, -(-len(n) // LEAF)))))
        self.where = {t: i for i, t in enumerate(self.names.tolist())}
        self.nodes = np.zeros((len(self.names), 2 * self.leaves), np.int64)  # node i has the children 2i and 2i+1
        place = np.arange(len(self.names)).repeat(np.diff(self.first)) * self.leaves + self.docs // LEAF
        np.maximum.at(self.nodes[:, self.leaves :], np.divmod(place, self.leaves), self.scores)
        self.postings = np.searchsorted(place, np.arange(len(self.names) * self.leaves + 1))  # where a term's postings of a leaf begin
        at = self.leaves
        while at > 1:
            self.nodes[:, at // 2 : at] = np.maximum(self.nodes[:, at : 2 * at : 2], self.nodes[:, at + 1 : 2 * at : 2])
            at //= 2

    def rows(self, item: list[int]) -> list[int]:
        return [self.where[t] for t in item if t in self.where]

    def bound(self, item: list[int]) -> int:
        return int(self.nodes[self.rows(item), 1].sum())

    def _leaf(self, lists: np.ndarray, low: int) -> list[int]:
        """The exact scores of a leaf's documents."""
        a, sizes = self.postings[lists], self.postings[lists + 1] - self.postings[lists]
        at = np.arange(sizes.sum()) + (a - np.cumsum(sizes) + sizes).repeat(sizes)
        total = np.zeros(LEAF, np.int64)
        np.add.at(total, self.docs[at] - low, self.scores[at])
        return total.tolist()

    def search(self, item: list[int], ids: list[tuple], k: int, least: int) -> list[tuple]:
        """The ``k`` best (score, place) of an item with a score of at least ``least``, ordered by score and then id; 0 is never in."""
        rows = self.rows(item)
        if not rows:
            return []
        bounds = self.nodes[rows].sum(axis=0).tolist()
        begins = np.array(rows) * self.leaves - self.leaves
        best: list[tuple] = []  # the worst one first: (score, id turned around, place)
        least, opened = max(1, least), [(-bounds[1], 1)]
        while opened and -opened[0][0] >= least:
            _, node = heapq.heappop(opened)
            if node < self.leaves:
                for child in (2 * node, 2 * node + 1):
                    if bounds[child] >= least:
                        heapq.heappush(opened, (-bounds[child], child))
                continue
            low = (node - self.leaves) * LEAF
            total = self._leaf(begins + node, low)
            for d, score in enumerate(total):
                if score >= least:
                    entry = (score, _Turned(ids[low + d]), low + d)
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry[:2] > best[0][:2]:
                        heapq.heapreplace(best, entry)
                    if len(best) == k:
                        least = max(least, best[0][0])
        return [(score, place) for score, _, place in sorted(best, key=lambda e: (-e[0], ids[e[2]]))]


class _Turned:
    """An id that is the greater, the later it stands."""

    __slots__ = ("key",)

    def __init__(self, key: tuple):
        self.key = key

    def __lt__(self, other: _Turned) -> bool:
        return self.key > other.key

    def __eq__(self, other: object) -> bool:
        return self.key == other.key


def _each_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i].as_py() if name == "shard" else batch.column(name)[i].values.to_numpy(zero_copy_only=False) for name in batch.schema.names}


def _bounds(given):
    """The highest bound of each item in a task's shards, and whose it is."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, documents, length = given.value
        most: dict[int, tuple] = {}
        for shard in _each_shard(batches):
            trees = Trees(shard, weights, documents, length)
            for key, item in items.items():
                if (bound := trees.bound(item)) > most.get(key, (0,))[0]:
                    most[key] = (bound, shard["shard"])
        yield pa.RecordBatch.from_arrays([pa.array(list(most), pa.int64()), pa.array([b for b, _ in most.values()], pa.int64()), pa.array([s for _, s in most.values()], pa.int64())], ["item", "bound", "shard"])

    return giving_back(task)


def _found(given, chosen, k: int):
    """The rows of a task's shards that can be among an item's best: of the shard that ``chosen`` names alone, or with the score that it names."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, documents, length = given.value
        only, least = chosen.value
        for shard in _each_shard(batches):
            wanted = [key for key in items if only is None or only.get(key) == shard["shard"]]
            if not wanted:
                continue
            trees, rows = Trees(shard, weights, documents, length), []
            ids = list(zip(shard["no_id"].tolist(), shard["ids"].tolist(), strict=True))
            for key in wanted:
                for score, place in trees.search(items[key], ids, k, least.get(key, 1)):
                    rows.append((key, None if ids[place][0] else ids[place][1], score))
            names, kinds = ("item", "doc_id", "score"), (pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kinds[j]) for j in range(3)], list(names))

    return giving_back(task)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of each item; Spark drops the others of a task before the shuffle."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(items: DataFrame, most: int) -> Iterator[dict[int, set[bytes]]]:
    """The items' terms in blocks of about ``most`` bytes."""
    block: dict[int, set[bytes]] = {}
    size = 0
    for row in items.toLocalIterator():
        terms = set(terms_of(bytes(row["text"] or b"")))
        block[row["item"]] = terms
        size += 100 + sum(64 + len(t) for t in terms)
        if size >= most:
            yield block
            block, size = {}, 0
    if block:
        yield block


def _search(docs: DataFrame, block: dict[int, set[bytes]], k: int) -> DataFrame:
    spark = docs.sparkSession
    context = spark.sparkContext
    number = {t: i for i, t in enumerate(sorted(set().union(*block.values())))}
    packed = docs.mapInArrow(_shards(context.broadcast(number)), _SHARD.removeprefix("shard long, "))
    shards = written(packed.select(F.monotonically_increasing_id().alias("shard"), "*"), "shards")
    sizes = shards.select(F.explode("lengths").alias("n")).agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("length")).first()
    documents, length = sizes["documents"], sizes["length"] or 0
    df = {r["t"]: r["df"] for r in shards.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()}
    weights = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for t, n in df.items()}
    items = {key: sorted(number[t] for t in terms if number[t] in df) for key, terms in block.items()}
    given = context.broadcast((items, weights, documents, length))
    bounds = shards.mapInArrow(_bounds(given), "item long, bound long, shard long").groupBy("item").agg(F.max(F.struct("bound", "shard"))["shard"].alias("shard"))
    only = {r["item"]: r["shard"] for r in bounds.collect()}
    first = _best(shards.mapInArrow(_found(given, context.broadcast((only, {})), k), "item long, doc_id long, score long"), k)
    least = {r["item"]: r["least"] for r in first.groupBy("item").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k).collect()}
    return _best(shards.mapInArrow(_found(given, context.broadcast((None, least)), k), "item long, doc_id long, score long"), k)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_col``, ``rank``, ``id_col`` and ``score`` of the ``k`` best rows of ``docs`` for each row of ``items``; fewer where fewer have a score above 0.

    Equal scores go by ascending id, nulls last. Null and empty texts have no term: such documents are in no count and no result, such items get no row.
    Repeated documents are rows of their own, in all counts too; a repeated item gets its rows once for each time. Texts may be of any length. An empty
    table on either side gives an empty result. Other columns of both tables, whatever their names, are left out.
    """
    spark = docs.sparkSession
    byte_batches(spark)
    queries = written(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("binary").alias("text")), "items")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    parts = [written(_search(rows, block, k), "ranked") for block in _blocks(queries.select("item", "text"), block_bytes)]
    found = parts[0] if parts else spark.createDataFrame([], "item long, doc_id long, score long, rank int")
    for part in parts[1:]:
        found = found.union(part)
    named = found.join(queries.select("item", "item_id"), "item")
    return named.select(F.col("item_id").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("doc_id").alias(id_col), "score")


def op12_ranked_search(spark, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return rank_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def oracle_sql() -> str:
    """The same rows in DuckDB: every document scored for every item with which it shares a term."""
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    terms = "regexp_extract_all(" + low + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {terms.format("coalesce(text, '')")} AS words FROM documents),
    s AS (SELECT count(*) AS big_n, sum(len(words)) AS big_l FROM d WHERE len(words) > 0),
    w AS (SELECT r, unnest(words) AS term FROM d),
    tf AS (SELECT r, term, count(*) AS tf FROM w GROUP BY r, term),
    f AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    q AS (SELECT DISTINCT i, item_id, term FROM (SELECT row_number() OVER () AS i, item_id, unnest({terms.format("coalesce(text, '')")}) AS term FROM benchmark)),
    c AS (SELECT i, item_id, r, floor(1000 * ln((2 * big_n + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(words) * big_n) // big_l::BIGINT))) AS x
        FROM q JOIN f USING (term) JOIN tf USING (term) JOIN d USING (r), s),
    t AS (SELECT i, item_id, r, sum(x)::BIGINT AS score FROM c GROUP BY i, item_id, r HAVING sum(x) > 0),
    k AS (SELECT i, item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM t JOIN d USING (r))
    SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 10
    """
