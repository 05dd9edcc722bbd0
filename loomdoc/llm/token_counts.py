"""Token counts without ids: pieces are counted once per distinct pre-token and summed over each document's pre-token frequencies.

1. One pass over the texts cuts pre-tokens and sums their frequencies; the vocabulary of distinct pre-tokens is counted with map-side combining.
2. Each distinct pre-token's pieces are counted once, and the vocabulary is written to the shared folder.
3. A second pass joins each document's frequencies with the vocabulary. The most frequent pre-tokens (``HEAD_WORDS`` at most, of ``HEAD_BYTES`` bytes
   together, so a broadcast of a fixed bound) are joined inside the pass; all others go through a shuffled join on the pre-token. Hot
   pre-tokens are in the head, so no join key is hot.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdoc.llm.common import byte_batches, written

#: The broadcast part of the vocabulary: words, bytes of all together, and bytes of a word at most (a longer one is too much text itself to stand in many documents).
HEAD_WORDS, HEAD_BYTES, LONGEST = 1 << 18, 12 << 20, 1 << 16

#: Texts whose pre-tokens are combined before rows leave a task, in characters.
CHUNK_CHARS = 16_000_000

#: The vocabulary's special strings (one id each, wherever they stand) and its pre-token expression.
SPECIAL = regex.compile(r"<\|startoftext\|>|<\|endoftext\|>")
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")

_SPACES = regex.compile(r"\s+")
_loaded: dict = {}


def _tokenizer(path: str):
    """The library's tokenizer, loaded once in each worker."""
    if path not in _loaded:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _loaded[path] = tokenizer
    return _loaded[path]


def pre_tokens(text: str) -> tuple[list[str], int]:
    """The pre-tokens of a text as the vocabulary's normaliser and splitter give them, and its number of special strings."""
    pieces = SPECIAL.split(text) if "<|" in text else [text]
    found: list[str] = []
    for piece in pieces:
        if not piece.isascii():
            # lower-casing is by character, so a final capital sigma isn't special
            piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ")
        found += PRE_TOKEN.findall(_SPACES.sub(" ", piece).lower())
    return found, len(pieces) - 1


def _columns(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[tuple[int, str]]]:
    """Chunks of (key, text) of about ``limit`` characters."""
    chunk, held = [], 0
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1)
        for i in range(batch.num_rows):
            text = texts[i].as_py() or ""
            chunk.append((keys[i].as_py(), text))
            held += len(text)
            if held >= limit:
                yield chunk
                chunk, held = [], 0
    if chunk:
        yield chunk


def _local_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in _columns(batches, CHUNK_CHARS):
        total: Counter = Counter()
        for _, text in chunk:
            total.update(pre_tokens(text)[0])
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])


def _piece_counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for batch in batches:
            words = batch.column(0).to_pylist()
            pieces: list[int] = []
            for at in range(0, len(words), 4096):
                pieces += [len(x.ids) for x in tokenizer.encode_batch(words[at : at + 4096], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pieces, pa.int32())], ["word", "n", "pieces"])

    return count


def vocabulary(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """Every distinct pre-token of the corpus: ``word``, ``n`` (how often it stands there) and ``pieces`` (ids it becomes)."""
    local = docs.select(F.lit(0).alias("key"), F.col(text_col).alias("text")).mapInArrow(_local_words, "word string, n long")
    totals = local.groupBy("word").agg(F.sum("n").alias("n"))
    return totals.mapInArrow(_piece_counter(tokenizer_path), "word string, n long, pieces int")


def _head(words: DataFrame, most: int) -> dict[str, int]:
    """The most frequent words that fit the bound, whole frequency classes at a time."""
    short = words.where(F.octet_length("word") <= LONGEST)
    classes = short.groupBy(F.floor(F.log2("n") * 8).cast("int").alias("c")).agg(F.count("*").alias("words"), F.sum(F.octet_length("word")).alias("bytes")).orderBy(F.desc("c")).collect()
    held, size, least = 0, 0, None
    for row in classes:
        held, size = held + row["words"], size + row["bytes"]
        if held > most or size > HEAD_BYTES:
            break
        least = row["c"]
    if least is None:
        return {}
    head = short.where(F.floor(F.log2("n") * 8) >= least).select("word", "pieces").toArrow()
    return dict(zip(head.column(0).to_pylist(), head.column(1).to_pylist(), strict=True))


def _frequencies(head):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = head.value
        kind = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))
        for chunk in _columns(batches, CHUNK_CHARS // 16):
            keys, sums, sizes, rest = [], [], [], []
            for key, text in chunk:
                words, total = pre_tokens(text)
                other = []
                for word, n in Counter(words).items():
                    pieces = known.get(word)
                    if pieces is None:
                        other.append({"word": word, "n": n})
                    else:
                        total += pieces * n
                keys.append(key)
                sums.append(total)
                sizes.append(len(text.encode("utf-8", "surrogatepass")))
                rest.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(rest, kind)], ["doc_key", "n_bytes", "n_head", "rest"])

    return count


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", head_words: int = HEAD_WORDS) -> DataFrame:
    """``id_col``, ``n_bytes`` and ``n_tokens`` of every row of ``docs``; other columns are left out.

    Null texts count as empty: 0 bytes, 0 tokens. Repeated rows and repeated or null ids keep a row each. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    byte_batches(spark)
    words = written(vocabulary(docs, tokenizer_path, text_col), "words")
    head = spark.sparkContext.broadcast(_head(words, head_words))
    ids = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counted = written(
        ids.select("doc_id", "text").mapInArrow(_frequencies(head), "doc_key long, n_bytes long, n_head long, rest array<struct<word:string,n:long>>")
        .withColumn("row_key", F.monotonically_increasing_id()),
        "frequencies",
    )
    rest = counted.select("row_key", F.explode("rest").alias("x")).select("row_key", "x.word", "x.n")
    summed = rest.join(words.select("word", "pieces"), "word").groupBy("row_key").agg(F.sum(F.col("n") * F.col("pieces")).alias("n_tokens"))
    rows = counted.select("row_key", "doc_key", "n_bytes", F.col("n_head").alias("n_tokens"))
    parts = rows.unionByName(summed, allowMissingColumns=True)
    whole = parts.groupBy("row_key").agg(F.max("doc_key").alias(id_col), F.max("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"))
    return whole.drop("row_key")


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    """Every document's tokens in the word_bpe_49k vocabulary."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    return found.withColumn("over_limit", F.col("n_tokens") > 2048)
