"""N-gram Jaccard join by T-occurrence search, as connected components.

Every document is the set of its distinct word shingles. Two sets reach the similarity only if they share at least T shingles, where T follows from the larger set.
DivideSkip leaves the T - c longest inverted lists of a document for probing and merges the short ones: a partner must stand in at
least c of the short lists. Lists are ordered by the length of a shingle's text (longer ones are rarer), with shingles that many documents share last.

1. One pass gives each document its set's size and signature; equal sets are one class, and shingles that many classes share are found.
2. A second pass writes the short lists' entries; merging is a count by shingle and a join, which AQE can split.
   Classes that stand in fewer than c shared lists drop out; a class that could link with one of fewer than FEW shingles needs only one.
3. In each list every member meets a leader of that list, and what links is united. Then, in lists that span several components, members outside a list's main component meet a few drawn
   members of other components, and what links is united again, so that most of a group of near copies is one component by pairs in proportion to its members. Pairs whose places
   in the list or whose sketches (parities of hash buckets) bound the overlap below T drop out; for the others the rest of T is binary-probed in the partner's sorted set.
4. In lists that still span several components, members outside the main one meet all members of other components, under the same bounds. No pair of different sets that could link in
   different components is left out; pairs inside a component aren't listed. Bounds of a list's members that never link are still checked against all others of the list.

Shingles and set signatures are 64-bit hashes (equal sets: 128 bits).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdoc.llm.common import byte_batches, connected_components, giving_back, written

#: A shingle is ordered last if at least LOCAL_SHARED sets of a task hold it, SHARED of all such; they are broadcast, the most shared first, at most MOST_SHARED
#: (8 bytes each). Which these are changes the work alone, not the result. A task counts so many codes at once.
LOCAL_SHARED, SHARED, MOST_SHARED, COUNTED_CODES = 2, 6, 1 << 20, 1_500_000

#: Short lists that a set of at least FEW shingles must share with a partner of at least FEW; 1 if either is smaller.
SHORT_HITS, FEW = 4, 8

#: Orders from which lists take their leaders, members of a list that are drawn next (about).
LEADERS, DRAWN = 16, 48

#: Bytes of text taken at once, bits of the filters that are broadcast (8 MB each; a full one only lets more through to the joins), bits of a set's sketch, longs of a folded one.
CHUNK_BYTES, FILTER_BITS, SKETCH_BITS, FOLDED = 500_000, 1 << 26, 2048, 8


#: Fixed values of the polynomial word hash: a random number for each byte (A-Z as a-z) and an odd base.
_BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, np.uint64)
_BYTES[65:91] = _BYTES[97:123]
_BASE, _INVERSE = 0x9E3779B97F4A7C15 | 5, pow(0x9E3779B97F4A7C15 | 5, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, 1 << 19), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def _mixed(code: np.ndarray) -> np.ndarray:
    code = (code ^ (code >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return code ^ (code >> np.uint64(29))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle codes of the texts ``data[offsets[i]:offsets[i + 1]]`` (UTF-8 bytes).

    A code has 8 bits that fall with the shingle's length and 56 bits of hash. Fewer words than ``n`` are one shingle. All words of the texts are hashed at once, by differences of
    one running polynomial.
    """
    count = len(offsets) - 1
    if not len(data):
        return [np.zeros(0, np.uint64) for _ in range(count)]
    inside = ~_SPACE[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    begin[cuts] = inside[cuts]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    stop[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    up, down = _power_tables(len(data) + 1)
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=running[1:])
    lengths = ends - starts
    hashes = _mixed((running[ends] - running[starts]) * down[starts] + lengths.astype(np.uint64))
    first = np.searchsorted(starts, offsets)
    sizes = np.diff(first)

    def codes_of(at: np.ndarray, width: int) -> np.ndarray:
        code, length = np.full(len(at), width, np.uint64), np.zeros(len(at), np.int64)
        for k in range(width):
            code = _mixed(code * np.uint64(_BASE) + hashes[at + k])
            length += lengths[at + k]
        rank = (255 - np.minimum(length, 255)).astype(np.uint64)
        return (rank << np.uint64(56)) | (code >> np.uint64(8))

    full = sizes >= n
    keep = np.zeros(len(starts), bool)
    windows = np.where(full, sizes - n + 1, 0)
    edges = np.zeros(len(starts) + 1, np.int64)
    np.add.at(edges, first[:-1][full], 1)
    np.add.at(edges, (first[:-1] + windows)[full], -1)
    keep = np.cumsum(edges[:-1]) > 0
    codes = codes_of(np.flatnonzero(keep), n)
    ends_of = np.cumsum(windows)
    out = [np.unique(codes[e - w : e]) if w else codes[:0] for e, w in zip(ends_of.tolist(), windows.tolist(), strict=True)]
    for i in np.flatnonzero((sizes > 0) & ~full):
        out[i] = codes_of(first[i : i + 1], int(sizes[i]))
    return out


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Chunks of (id, set)."""
    for batch in batches:
        keys, texts = batch.column(0).to_pylist(), batch.column(1).fill_null("").cast(pa.large_binary())
        spots = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        whole = texts.buffers()[2]
        data = np.frombuffer(whole, np.uint8) if whole is not None and whole.size else np.zeros(0, np.uint8)
        at = 0
        while at < len(keys):
            end = max(at + 1, int(np.searchsorted(spots, spots[at] + CHUNK_BYTES, "right")) - 1)
            yield list(zip(keys[at:end], shingle_sets(data[spots[at] : spots[end]], spots[at : end + 1] - spots[at], n), strict=True))
            at = end


def _signature(codes: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(codes.tobytes())
    return tuple(np.frombuffer(digest, np.int64).tolist())


def parities(codes: np.ndarray) -> np.ndarray:
    """For each of SKETCH_BITS buckets whether it holds an odd number of codes, as longs. Two sets differ in at least as many codes as their sketches in bits."""
    odd = np.bincount((codes >> np.uint64(20)).astype(np.int64) & (SKETCH_BITS - 1), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def apart(left: str, right: str) -> Column:
    """A lower bound of the codes in which two sets differ, from their sketches."""
    return F.aggregate(F.zip_with(left, right, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def folded(sketch: str) -> list[Column]:
    """A sketch of FOLDED longs with the same property: parities of whole runs of buckets. Its distance is compiled, so it goes before ``apart``."""
    longs = SKETCH_BITS // 64
    return [reduce(lambda x, y: x.bitwiseXOR(y), [F.get(sketch, F.lit(i)) for i in range(k, longs, FOLDED)]).alias(f"{sketch}{k}") for k in range(FOLDED)]


def _first_pass(n: int):
    kinds = [("doc", pa.int64()), ("n", pa.int64()), ("sid", pa.int64()), ("more", pa.int64()), ("code", pa.int64()), ("sets", pa.int64()), ("sketch", pa.list_(pa.int64()))]

    def often(different: dict) -> pa.RecordBatch:
        codes, counts = np.unique(np.concatenate(list(different.values())), return_counts=True)
        many = counts >= LOCAL_SHARED
        codes, counts = codes[many].view(np.int64), counts[many]
        none = [None] * len(codes)
        return pa.RecordBatch.from_arrays([*[pa.array(none, k) for _, k in kinds[:4]], pa.array(codes), pa.array(counts.astype(np.int64)), pa.array(none, kinds[-1][1])], [k for k, _ in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        different, held = {}, 0
        for chunk in _sets(batches, n):
            signs = [_signature(s) for _, s in chunk]
            for sign, (_, codes) in zip(signs, chunk, strict=True):
                if sign not in different:
                    different[sign] = codes
                    held += len(codes)
            sketches = [parities(s) for _, s in chunk]
            columns = [
                [k for k, _ in chunk], [len(s) for _, s in chunk], [a for a, _ in signs], [b for _, b in signs], [None] * len(chunk), [None] * len(chunk), sketches,
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], [k for k, _ in kinds])
            if held >= COUNTED_CODES:
                yield often(different)
                different, held = {}, 0
        if different:
            yield often(different)

    return run


def overlap_needed(n: int, percent: int) -> int:
    """The least overlap with any partner of a set of ``n`` that reaches the similarity."""
    return -(-percent * n // 100)


def hits_needed(n, percent: int):
    """Whether a set of ``n`` shares SHORT_HITS lists with any partner: the smallest has ``overlap_needed`` shingles, which must be FEW and SHORT_HITS at least. ``n`` is an int or a Column."""
    return percent * n > 100 * (max(FEW, SHORT_HITS) - 1)


def _short_lists(n: int, percent: int, shared, wanted=None):
    """Entries (key, sid, n, pos) of the short lists, ``pos`` being the key's place in the set's order; with ``wanted``, a bitmap over the keys' low bits, only those that it may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, bits = shared.value, None if wanted is None else np.frombuffer(wanted.value, np.uint8)
        for chunk in _sets(batches, n):
            seen, keys, sids, sizes, spots = set(), [], [], [], []
            for _, codes in chunk:
                sid = _signature(codes)[0]
                if not len(codes) or sid in seen:
                    continue
                seen.add(sid)
                if len(last):
                    late = last[np.minimum(np.searchsorted(last, codes), len(last) - 1)] == codes
                    codes = np.r_[codes[~late], codes[late]]
                hits = SHORT_HITS if len(codes) >= FEW else 1
                short = codes[: len(codes) - overlap_needed(len(codes), percent) + hits]
                spot = np.arange(len(short), dtype=np.int32)
                if bits is not None:
                    low = short & np.uint64(FILTER_BITS - 1)
                    held = bits[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8) & 1 > 0
                    short, spot = short[held], spot[held]
                spots.append(spot)
                keys.append(short)
                sids += [sid] * len(short)
                sizes += [len(codes)] * len(short)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(sids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(np.concatenate(spots))], ["key", "sid", "n", "pos"])

    return run


def _wanted_sets(n: int, bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = bits.value
        for chunk in _sets(batches, n):
            found = {}
            for _, codes in chunk:
                sid = _signature(codes)[0]
                at = sid % FILTER_BITS
                if wanted[at >> 3] >> (at & 7) & 1:
                    found[sid] = codes.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], ["sid", "codes"])

    return run


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Shared codes of two sorted sets: those of the shorter are binary-probed in the longer."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shared, sizes = [], []
        last, left = None, None
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            raw = x.as_py()
            if raw != last:
                last, left = raw, np.frombuffer(raw, np.uint64)
            right = np.frombuffer(y.as_py(), np.uint64)
            both = _overlap(left, right)
            shared.append(both)
            sizes.append(len(left) + len(right) - both)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int64()), pa.array(sizes, pa.int64())], ["a", "b", "shared", "whole"])


def _filter_bits(values: DataFrame, name: str) -> bytes:
    """A bitmap of a fixed size over a column's low bits, built in blocks of 4 KB on the executors."""
    at = F.pmod(name, F.lit(FILTER_BITS))
    blocks = values.groupBy(F.bitmap_bucket_number(at + 1).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at + 1)).alias("bits"))
    held = bytearray(FILTER_BITS // 8)
    for row in blocks.toLocalIterator():
        start = (row["block"] - 1) * 4096
        held[start : start + len(row["bits"])] = row["bits"]
    return bytes(held)


def jaccard_components(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_shingles`` and ``component_id`` (smallest id reachable by links) of every row of ``docs``; the id is a long.

    Sets link when 100 * shared >= ``percent`` * united. Null texts and texts without a word have empty sets and link with nothing. Rows with an equal id are rows of their own
    in the result; null ids give null components. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    byte_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    first = written(texts.mapInArrow(giving_back(_first_pass(n)), "doc long, n long, sid long, more long, code long, sets long, sketch array<long>"), "first")
    rows = first.where("code IS NULL").select("doc", "n", "sid", "more")
    often = first.where("code IS NOT NULL").groupBy("code").agg(F.sum("sets").alias("sets")).where(F.col("sets") >= SHARED)
    often = written(often, "shared")
    held, least = 0, 1 << 60
    for row in often.groupBy(F.floor(F.log2("sets") * 4).alias("c")).count().orderBy(F.desc("c")).collect():
        held += row["count"]
        if held > MOST_SHARED:
            break
        least = row["c"]
    codes = often.where(F.floor(F.log2("sets") * 4) >= least).select("code").toArrow().column(0).to_numpy()
    shared = spark.sparkContext.broadcast(np.sort(codes.view(np.uint64)))

    # merge the short lists: a key is shared if two sets hold it
    kind = "key long, sid long, n int, pos int"
    lists = texts.mapInArrow(giving_back(_short_lists(n, percent, shared)), kind).groupBy("key").agg(F.min("sid").alias("x"), F.max("sid").alias("y")).where("x <> y").select("key")
    lists = written(lists, "keys")
    wanted = spark.sparkContext.broadcast(_filter_bits(lists, "key"))
    entries = texts.mapInArrow(giving_back(_short_lists(n, percent, shared, wanted)), kind)
    members = written(entries.join(lists, "key").groupBy("key", "sid").agg(F.max("n").alias("n"), F.min("pos").alias("pos")), "members")
    enough = members.groupBy("sid").agg(F.count("*").alias("hits"), F.max("n").alias("n")).where((F.col("hits") >= SHORT_HITS) | ~hits_needed(F.col("n"), percent)).select("sid")
    enough = written(enough, "enough")
    lists = members.join(enough, "sid", "left_semi")

    # equal sets have equal sketches
    sketches = written(first.where("code IS NULL").join(enough, "sid", "left_semi").select("sid", "n", "sketch").dropDuplicates(["sid"]), "sketches")
    bits = spark.sparkContext.broadcast(_filter_bits(enough, "sid"))
    # equal sets come from several tasks: their bytes are equal too
    sets = written(texts.mapInArrow(giving_back(_wanted_sets(n, bits)), "sid long, codes binary").dropDuplicates(["sid"]), "sets")

    def with_both(pairs: DataFrame, table: DataFrame, a: str, b: str, column: str) -> DataFrame:
        left = pairs.join(table.withColumnsRenamed({"sid": a, column: "left"}), a)
        return left.join(table.withColumnsRenamed({"sid": b, column: "right"}), b).select(a, b, "left", "right")

    near_enough = (100 + percent) * apart("left", "right") <= (100 - percent) * (F.col("n") + F.col("ln"))

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs ``a``, ``b`` that link."""
        both = pairs.join(sketches.select(F.col("sid").alias("a"), "n", F.col("sketch").alias("left")), "a").join(sketches.select(F.col("sid").alias("b"), F.col("n").alias("ln"), F.col("sketch").alias("right")), "b")
        checked = with_both(both.where(near_enough).select("a", "b"), sets, "a", "b", "codes").mapInArrow(_verify, "a long, b long, shared long, whole long")
        return written(checked.where(100 * F.col("shared") >= percent * F.col("whole")).select("a", "b"), "linked")

    fits = 100 * F.least("n", "ln") >= percent * F.greatest("n", "ln")
    # from the first key that two sets share on, enough of both must be left
    room = (100 + percent) * F.least(F.col("n") - F.col("pos"), F.col("ln") - F.col("lpos")) >= percent * (F.col("n") + F.col("ln"))
    found, links = spark.createDataFrame([], "node long, component long"), None

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(found.withColumnsRenamed({"node": "sid", "component": "c"}), "sid", "left").withColumn("c", F.coalesce("c", "sid"))

    def meet(pairs: DataFrame) -> None:
        """Verify pairs and unite those that link."""
        nonlocal found, links
        new = linked(pairs)
        links = new if links is None else links.union(new)
        if new.take(1):
            found = written(connected_components(links), "components")

    def placed_lists(rows: DataFrame) -> DataFrame:
        return placed(rows.select("key", "sid", "n", "pos"))

    # the leader of a list is its first member by one of a few orders drawn by the key; it meets all others here, so open lists go on without it
    drawn = F.col("sid").bitwiseXOR(F.xxhash64(F.pmod(F.xxhash64("key"), F.lit(LEADERS))))
    leads = lists.groupBy("key").agg(F.min("sid").alias("least"), F.max("sid").alias("most"), F.min(F.struct(drawn.alias("by"), "sid", "n", "pos")).alias("l")).where("least <> most").select("key", "l")
    lists = written(lists.join(leads, "key").where("sid <> l.sid"), "lists")
    led = lists.select("sid", "n", "pos", F.col("l.sid").alias("leader"), F.col("l.n").alias("ln"), F.col("l.pos").alias("lpos"))
    meet(led.where(fits & room).select(F.least("sid", "leader").alias("a"), F.greatest("sid", "leader").alias("b")).distinct())
    for most in (DRAWN, None):
        counts = placed_lists(lists).groupBy("key", "c").count()
        main = counts.groupBy("key").agg(F.max_by("c", F.struct("count", "c")).alias("main"), F.count("*").alias("several"), F.sum("count").alias("size")).where("several > 1").select("key", "main", "size")
        rest = placed_lists(lists).join(main, "key").join(sketches.select("sid", F.col("sketch").alias("left"), *folded("sketch")), "sid")
        lists = written(rest, "open")
        other = lists.select("key", F.col("sid").alias("leader"), F.col("n").alias("ln"), F.col("pos").alias("lpos"), F.col("c").alias("lc"), F.col("left").alias("right"), "size", *[F.col(f"sketch{k}").alias(f"other{k}") for k in range(FOLDED)])
        far = reduce(add, [F.bit_count(F.col(f"sketch{k}").bitwiseXOR(F.col(f"other{k}"))) for k in range(FOLDED)])
        close = (F.col("c") != F.col("lc")) & fits & room & ((100 + percent) * far <= (100 - percent) * (F.col("n") + F.col("ln"))) & near_enough
        if most:
            other = other.where(F.pmod(F.xxhash64("leader"), F.lit(1 << 20)) * F.col("size") < most * (1 << 20))
        else:
            close = ((F.col("lc") == F.col("main")) | (F.col("sid") < F.col("leader"))) & close
        meet(lists.where("c <> main").drop("size").join(other.drop("size"), "key").where(close).select(F.least("sid", "leader").alias("a"), F.greatest("sid", "leader").alias("b")).distinct())

    classes = rows.where("n > 0").groupBy("sid", "more").agg(F.min("doc").alias("least"))
    classes = classes.join(found.withColumnsRenamed({"node": "sid", "component": "c"}), "sid", "left").withColumn("c", F.coalesce("c", "sid"))
    least = classes.groupBy("c").agg(F.min("least").alias("component_id"))
    named = classes.join(least, "c").select("sid", "more", "component_id")
    full = rows.where("n > 0").join(named, ["sid", "more"]).select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("doc").isNotNull(), F.col("component_id")).alias("component_id"))
    return full.union(rows.where("n = 0").select("doc", "n", "doc"))


def op5_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """Every document's shingle count and component."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
