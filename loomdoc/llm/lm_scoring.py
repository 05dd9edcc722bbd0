"""Language-model scores of texts: a causal self-attention model over subword ids, learned from a part of the corpus.

A text is its words, A-Z lower-cased, and an end; the subword ids of a word are those of the word with a space before it. So a word's ids are made once however often it stands there.

1. One pass over all texts counts words and subword ids, and writes each text with its ids; all these counts are exact and over all documents.
2. Counts of ids give the model's units and its output biases. Its weights begin with a task that learns from a few documents (about ``TRAIN_BYTES`` of text, ``BEGIN_PASSES`` times);
   from there every task learns from all the learned texts of its partition, once, and the tasks' weights are averaged by how much each learned from, in a tree of bounded groups.
3. One pass scores whole texts: overlapping windows in batches, each id predicted once. The same pass adds up the unigram score of the most frequent words
   (``HEAD_WORDS``, of ``HEAD_BYTES`` together, broadcast); a document's other words leave it as counts, are joined with the corpus counts and added.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdoc.llm import attention_model as network
from loomdoc.llm.common import byte_batches, giving_back, steady_heap, written

#: What the weights begin with: bytes of text, and passes over it. Windows of a step, rates and the steps after which these slow down: there, and over all the text.
TRAIN_BYTES, BEGIN_PASSES, BEGIN, WHOLE = 2 << 20, 4, (48, 1.5e-2, 400), (256, 3e-3, 200)

#: The broadcast part of the words: number, bytes of all, bytes of one.
HEAD_WORDS, HEAD_BYTES, LONGEST_WORD = 1 << 18, 8 << 20, 1 << 10

#: Bytes that are read or scored together; words a task remembers (and combines before rows leave it), and encodes together; characters of a word that are encoded together.
SCORE_BYTES, REMEMBERED, TOGETHER, LONGEST = 1 << 20, 500_000, 4096, 256

_REST = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))
_loaded: dict = {}


def _encoding(path: str):
    """The vocabulary, loaded once in each worker."""
    if path not in _loaded:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        lengths = np.zeros(1 + max(ranks.values()), np.int64)
        lengths[list(ranks.values())] = [len(token) for token in ranks]
        _loaded[path, "bytes"] = lengths
        _loaded[path] = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def encode_word(encoding, word: bytes) -> list[int]:
    """The ids of one word with a space before it."""
    text = " " + word.decode("utf-8", "replace")
    if len(text) <= LONGEST:
        return encoding.encode_ordinary(text)
    return [i for at in range(0, len(text), LONGEST) for i in encoding.encode_ordinary(text[at : at + LONGEST])]


def vocabulary_size(path: str) -> int:
    with open(path, "rb") as file:
        return 1 + max(int(line.split()[1]) for line in file if line.strip())


class Words:
    """The words that a task has met: their numbers in order, and their ids side by side in one array."""

    def __init__(self, path: str):
        self.encoding = _encoding(path)
        self.bytes_of = _loaded[path, "bytes"]
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode_new(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, and each word's number of ids: many words are encoded as one text, whose ids are dealt out by their bytes."""
        parts, sizes = [], []
        texts = [" " + w.decode("utf-8", "replace") for w in words]
        for at in range(0, len(texts), TOGETHER):
            some = texts[at : at + TOGETHER]
            if max(map(len, some)) <= LONGEST:
                found = np.array(self.encoding.encode_ordinary("".join(some)), np.int32)
                ends = np.cumsum(self.bytes_of[found])
                wanted = np.cumsum([len(t.encode()) for t in some])
                last = np.searchsorted(ends, wanted)
                if np.array_equal(ends[np.minimum(last, len(ends) - 1)], wanted):
                    parts.append(found)
                    sizes.append(np.diff(last, prepend=-1))
                    continue
            each = [encode_word(self.encoding, w) for w in words[at : at + TOGETHER]]
            parts.append(np.array([i for own in each for i in own], np.int32))
            sizes.append(np.array([len(own) for own in each]))
        return np.concatenate(parts), np.concatenate(sizes)

    def encode(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The numbers of all words of the texts, all their ids, and each text's number of ids."""
        if len(self.place) > REMEMBERED:
            self.clear()
        place = self.place
        new = [w for w in dict.fromkeys(chain.from_iterable(texts)) if w not in place]
        if new:
            place.update(zip(new, range(len(place), len(place) + len(new)), strict=True))
            ids, sizes = self.encode_new(new)
            self.ids, self.ends = np.concatenate([self.ids, ids]), np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        at = np.array(list(map(place.__getitem__, chain.from_iterable(texts))), np.int64)
        sizes = self.ends[at + 1] - self.ends[at]
        flat = self.ids[np.arange(sizes.sum()) + (self.ends[at] - np.cumsum(sizes) + sizes).repeat(sizes)]
        whole = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum([len(own) for own in texts]))]
        return at, flat, np.diff(whole)


def _chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[list, list[bytes]]]:
    """Rows whose texts are about ``limit`` bytes: what stands before the text in a row, and the texts."""
    keys, texts, held = [], [], 0
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns - 1)]
        own = batch.column(batch.num_columns - 1)
        for i in range(batch.num_rows):
            keys.append(tuple(c[i] for c in columns))
            texts.append(own[i].as_py() or b"")
            held += len(texts[-1])
            if held >= limit:
                yield keys, texts
                keys, texts, held = [], [], 0
    if keys:
        yield keys, texts


def _id_type(ids: int) -> type:
    """What ids are stored as."""
    return np.uint16 if ids <= 1 << 16 else np.int32


_READ = "key long, held_out boolean, text binary, ids binary, word string, id int, n long, n_all long"


def _read(path: str):
    """Rows of texts with their ids; rows of words and of ids with their counts in texts that are learned from, those of words in all texts, too."""

    def rows(size: int, **columns: pa.Array) -> pa.RecordBatch:
        types = {"key": pa.int64(), "held_out": pa.bool_(), "text": pa.binary(), "ids": pa.binary(), "word": pa.string(), "id": pa.int32(), "n": pa.int64(), "n_all": pa.int64()}
        return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(size, t)) for c, t in types.items()], list(types))

    def counted(words: Words, learned: np.ndarray, everywhere: np.ndarray) -> Iterator[pa.RecordBatch]:
        names = list(words.place)
        for at in range(0, len(names), 1 << 16):
            some = slice(at, at + (1 << 16))
            yield rows(len(names[some]), word=pa.array(names[some], pa.string()), n=pa.array(learned[some]), n_all=pa.array(everywhere[some]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady_heap()
        words = Words(path)
        kind, of_ids = _id_type(len(words.bytes_of)), np.zeros(len(words.bytes_of), np.int64)
        learned = everywhere = np.zeros(0, np.int64)
        for keys, texts in _chunks(batches, SCORE_BYTES):
            if len(words.place) > REMEMBERED:
                yield from counted(words, learned, everywhere)
                words.clear()
                learned = everywhere = np.zeros(0, np.int64)
            split = [t.lower().split() for t in texts]
            at, ids, sizes = words.encode(split)
            held = np.array([k[1] for k in keys], bool)
            own = at[~held.repeat([len(s) for s in split])]
            learned, everywhere = (np.pad(c, (0, len(words.place) - len(c))) + np.bincount(a, minlength=len(words.place)) for c, a in ((learned, own), (everywhere, at)))
            of_ids += np.bincount(ids[~held.repeat(sizes)], minlength=len(of_ids))
            ends = np.append(0, np.cumsum(sizes)) * np.dtype(kind).itemsize
            stored = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids.astype(kind))])
            yield rows(len(texts), key=pa.array([k[0] for k in keys], pa.int64()), held_out=pa.array(held), text=pa.array(texts, pa.binary()), ids=stored)
        yield from counted(words, learned, everywhere)
        some = np.flatnonzero(of_ids)
        yield rows(len(some), id=pa.array(some, pa.int32()), n=pa.array(of_ids[some]))

    return giving_back(task)


def _units(stored: list[bytes], units: network.Units) -> tuple[np.ndarray, np.ndarray]:
    """All ids of texts, each with an end mark behind its last, and each text's number of ids."""
    kind = np.dtype(_id_type(len(units.unit) - 1))
    sizes = np.array([len(own) // kind.itemsize for own in stored])
    return np.insert(np.frombuffer(b"".join(stored), kind).astype(np.int32), np.cumsum(sizes), len(units.unit) - 1), sizes + 1


def _trained(units, start, form: tuple[int, float, int], passes: int = 1, most: int | None = None):
    """The weights after learning from all texts of a partition (from no further ones once ``most`` targets are reached), times the number of targets."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady_heap()
        own, (batch, rate, slowing) = units.value, form
        training = network.Training(network.unpack(start.value, network.begin(own)), rate, batch, slowing)
        for _, stored in _chunks(batches, SCORE_BYTES):
            if most is not None and training.seen >= most:
                continue
            ids, sizes = _units(stored, own)
            taken, valid, _ = network.windows(own.unit[ids], sizes)
            for _ in range(passes):
                training.learn(taken, valid)
        if training.seen:
            weights = network.pack(training.p).astype(np.float64) * training.seen
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([training.seen], pa.int64()), pa.array([weights.tobytes()], pa.binary())], ["shard", "n", "weights"])

    return giving_back(task)


def _added(key: tuple, table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(w, np.float64) for w in table.column("weights").to_pylist())
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "weights": pa.array([total.tobytes()], pa.binary())})


_WEIGHTS = "shard long, n long, weights binary"


def _averaged(shards: DataFrame, most: int = 16) -> np.ndarray | None:
    """The mean of the shards' weights: groups of about ``most`` are added until so few are left."""
    rows = written(shards, "weights")
    count = rows.count()
    while count > most:
        count = -(-count // most)
        rows = written(rows.withColumn("shard", F.pmod("shard", F.lit(count))).groupBy("shard").applyInArrow(_added, _WEIGHTS), "weights")
    parts = rows.collect()
    return (sum(np.frombuffer(r["weights"], np.float64) for r in parts) / sum(r["n"] for r in parts)).astype(np.float32) if parts else None


def fit(docs: DataFrame, counts: np.ndarray, train_bytes: int = TRAIN_BYTES) -> tuple:
    """Units and weights of the model, learned from every row of ``docs (ids)``; ``counts`` has the corpus count of every id, the end mark's last."""
    context = docs.sparkSession.sparkContext
    units = network.units_of(counts)
    sent, start = context.broadcast(units), network.pack(network.begin(units))
    whole = docs.select("ids").withColumn("row_key", F.monotonically_increasing_id())
    # about three bytes of text to an id
    parts = max(1, round(int(counts.sum()) * 3 / max(1, train_bytes)))
    first = whole.where(F.pmod(F.xxhash64("row_key"), F.lit(parts)) == 0).select("ids").repartition(1)
    most = BEGIN_PASSES * max(1, train_bytes)
    for rows, made in ((first, (BEGIN, BEGIN_PASSES, most)), (whole.select("ids"), (WHOLE,))):
        found = _averaged(rows.mapInArrow(_trained(sent, context.broadcast(start), *made), _WEIGHTS))
        start = start if found is None else found
    return units, start


def _scored(model, head):
    """Each row's model score and its words' unigram score; words outside the head leave as counts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady_heap()
        (units, weights), (names, logs, seen) = model.value, head.value
        place, others = {w: i for i, w in enumerate(names)}, len(names)
        params = network.unpack(weights, network.begin(units))
        for keys, texts in _chunks(batches, SCORE_BYTES):
            split = [t.lower().split() for t in texts]
            at = np.array([place.get(w, others) for w in chain.from_iterable(split)], np.int64)
            ids, sizes = _units([k[1] for k in keys], units)
            unit = units.unit[ids]
            taken, valid, _ = network.windows(unit, sizes)
            found = network.log_probabilities(params, taken, valid)
            rare = unit == network.RARE
            found[rare] += units.rare[ids[rare]]
            score = np.add.reduceat(found, np.cumsum(sizes) - sizes) / np.log(10)
            number = np.array([len(own) for own in split])
            spans = list(zip((np.cumsum(number) - number).tolist(), np.cumsum(number).tolist(), strict=True))
            outside = at == others
            sums = [[c[at[a:b]].sum() for a, b in spans] for c in (logs, seen)]
            rest = [Counter([own[i] for i in np.flatnonzero(outside[a:b]).tolist()]) for own, (a, b) in zip(split, spans, strict=True)]
            flat = pa.StructArray.from_arrays([pa.array([w for r in rest for w in r], pa.string()), pa.array([n for r in rest for n in r.values()], pa.int64())], ["word", "n"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(r) for r in rest])), pa.int32()), flat)
            columns = [pa.array([k[0] for k in keys], pa.int64()), pa.array(number + 1, pa.int64()), pa.array(score, pa.float64()), pa.array(sums[0], pa.float64()), pa.array(sums[1], pa.int64()), lists.cast(_REST)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n_tokens", "score", "head_score", "head_known", "rest"])

    return giving_back(task)


def _head(words: DataFrame) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The words that stand most often anywhere, whole classes of frequency at a time, with log10(count + 0.5) and whether they are known; then an entry for all others."""
    short = words.where(F.octet_length("word") <= LONGEST_WORD).withColumn("class", F.floor(F.log2("n_all") * 8).cast("int"))
    held, size, least = 0, 0, None
    for row in short.groupBy("class").agg(F.count("*").alias("words"), F.sum(F.octet_length("word")).alias("bytes")).orderBy(F.desc("class")).collect():
        held, size = held + row["words"], size + row["bytes"]
        if held > HEAD_WORDS or size > HEAD_BYTES:
            break
        least = row["class"]
    if least is None:
        return [], np.zeros(1), np.zeros(1, np.int64)
    head = short.where(F.col("class") >= least).select("word", "n").toArrow()
    counts = head.column("n").to_numpy()
    return [w.encode() for w in head.column("word").to_pylist()], np.append(np.log10(counts + 0.5), 0), np.append(counts > 0, 0).astype(np.int64)


def score_texts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", fold: int = 5, held: int = 1, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """``id_col``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of every row of ``docs``; other columns, whatever their names, are left out.

    Rows whose crc32 of the id modulo ``fold`` is ``held`` are held out; a null id isn't. Null texts count as empty: they have the end as their only token. Repeated rows, and rows
    with one or no id, keep a row each and count each. With nothing to learn from, counts are 0 and the model is uniform. An empty table gives an empty one.
    Texts may be of any length: a text is held whole once, its windows in batches.
    """
    spark = docs.sparkSession
    byte_batches(spark)
    held_out = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(fold)) == held, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("key"), held_out.alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    read = written(rows.mapInArrow(_read(tokenizer_path), _READ), "lm-texts")
    texts = read.where("ids IS NOT NULL")
    words = written(read.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all")), "lm-words")
    totals = words.agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    ends = texts.where("NOT held_out").count()
    train_tokens, known = (totals["n"] or 0) + ends, totals["v"] + (ends > 0)
    counts = np.zeros(vocabulary_size(tokenizer_path) + 1, np.int64)
    counts[-1] = ends
    for r in read.where("id IS NOT NULL").groupBy("id").agg(F.sum("n").alias("n")).collect():  # as many as the vocabulary has at most
        counts[r["id"]] = r["n"]
    model = spark.sparkContext.broadcast(fit(texts.where("NOT held_out"), counts, train_bytes))
    head = spark.sparkContext.broadcast(_head(words))
    scored = texts.select("key", "ids", "text").mapInArrow(_scored(model, head), "key long, n_tokens long, score double, head_score double, head_known long, rest array<struct<word:string,n:long>>")
    scored = written(scored.withColumn("row_key", F.monotonically_increasing_id()), "lm-scores")
    rest = scored.select("row_key", F.explode("rest").alias("x")).select("row_key", "x.word", F.col("x.n").alias("times"))
    joined = rest.join(words.select("word", "n"), "word", "left").select("row_key", "times", F.coalesce("n", F.lit(0)).alias("n"))
    summed = joined.groupBy("row_key").agg(F.sum(F.col("times") * F.log10(F.col("n") + 0.5)).alias("head_score"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("head_known"))
    parts = scored.select("row_key", "key", "n_tokens", "score", "head_score", "head_known").unionByName(summed, allowMissingColumns=True)
    whole = parts.groupBy("row_key").agg(F.max("key").alias(id_col), F.max("n_tokens").alias("n_tokens"), F.sum("head_known").alias("n_known"), F.sum("head_score").alias("logs"), F.max("score").alias("score"))
    divisor = float(np.log10(train_tokens + 0.5 * (known + 1)))
    end = float(np.log10(ends + 0.5))
    return whole.select(
        id_col, held_out.alias("held_out"), "n_tokens", (F.col("n_known") + F.lit(1 if ends else 0)).alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.lit(end) - F.col("n_tokens") * F.lit(divisor)).alias("base_score"), "score",
    )


def op13_lm_scores(spark, sf_dir: str) -> DataFrame:
    """Every document's log10 probability under the attention model, and under the unigram base."""
    import public_tokenizers

    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
