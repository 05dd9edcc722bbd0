"""A training corpus from ``documents``: quality, language, near duplicates, mixture, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.llm import language_id, mixing, ngram_jaccard, piece_codec, quality
from loomdoc.llm.common import free_name, written


def _small_reads(docs: DataFrame) -> None:
    """Let the session read few rows of long texts at a time: the arrays that hold thousands of them make an executor's heap grow."""
    docs.sparkSession.conf.set("spark.sql.parquet.columnarReaderBatchSize", "512")


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs``, written with a key for each row, and the key's name: one that no column has. So rows with null or repeated ids, and repeated rows, are told apart."""
    key = free_name(docs.columns, "row_key")
    return written(docs.withColumn(key, F.monotonically_increasing_id()), "rows"), key


def _of_verdict(docs: DataFrame, judged: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The rows of ``docs`` whose columns ``by`` are some row's of ``judged (h1, h2)``, which has their hashes of 128 bits: a verdict that follows from a text alone needs no key for each row, so the input isn't written once more."""
    h1, h2 = (free_name(docs.columns, name) for name in ("h1", "h2"))
    kept = judged.select(F.col("h1").alias(h1), F.col("h2").alias(h2)).distinct()
    first, second = _hashes(by)
    return docs.withColumns({h1: first, h2: second}).join(kept, [h1, h2], "left_semi").select(docs.columns)


def _hashes(by: tuple[str, ...]) -> tuple:
    """Two hashes of the columns, of which nulls are told apart from empty texts."""
    parts = [c for name in by for c in (F.col(name).isNull(), F.col(name))]
    return F.xxhash64(*parts), F.xxhash64(F.lit(1), *reversed(parts))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within their language's perplexity bar stay; the model is trained on the trusted ones among ``docs``.

    Null and empty texts go; without a trusted text all others stay. A verdict follows from text and language, so repeated rows and rows with null or repeated ids stay or go with their texts. Columns that ``docs`` has besides stay as they
    are, whatever their names. An empty table gives an empty one. Texts may be of any length. Only hashes and texts go through the scoring pass; its verdicts are joined to the rows.
    """
    _small_reads(docs)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    h1, h2 = _hashes(("text", "lang"))
    texts = docs.select("text", "lang", h1.alias("h1"), h2.alias("h2"))
    return _of_verdict(docs, quality.classify(texts, model, ("h1", "h2")).where("kept"), ("text", "lang"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose predicted language holds at least half of the code's weight stay.

    Null texts and texts without a letter go. With no labelled text nothing can be predicted, and all go. Extra columns stay as they are, whatever their names. A verdict follows from the text alone, repeated rows stay or go together; an
    empty table gives an empty one. Texts may be of any length.
    """
    _small_reads(docs)
    h1, h2 = _hashes(("text",))
    found = language_id.identify(docs.select("text", h1.alias("h1"), h2.alias("h2")), language_id.fit(docs), keep=("h1", "h2"))
    return _of_verdict(docs, found.where("lang_pred <> 'und' AND score >= 0.5"), ("text",))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of rows whose five-word shingles reach a Jaccard similarity of 0.8 one row of the smallest id stays; nulls come last.

    Texts without a word, empty and null ones are like no other and all stay. Extra columns stay as they are, whatever their names; an empty table gives an empty one. Texts may be of any length.
    """
    _small_reads(docs)
    rows, key = _keyed(docs)
    texts = rows.select(F.col(key).alias("row_key"), "doc_id", "text")
    found = written(ngram_jaccard.jaccard_components(texts.select("row_key", "text"), n=5, percent=80, id_col="row_key").select("row_key", "component_id"), "row-components")
    # a component of one row has that row's key; the others hold at least one row with another key
    several = found.where("component_id <> row_key").select("component_id").distinct()
    members = found.join(several, "component_id", "left_semi").join(texts.select("row_key", "doc_id"), "row_key")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key"))["row_key"].alias("first"))
    gone = written(members.join(first, "component_id").where("row_key <> first").select(F.col("row_key").alias(key)), "copies")
    return rows.join(gone, key, "left_anti").select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once for every time the mix takes words of it; documents of which it takes none, texts without a word among them, go.

    A null source is a source. Rows with null or repeated ids are taken row by row. Extra columns stay as they are, whatever their names; an empty table gives an empty one. Texts may be of any length.
    """
    _small_reads(docs)
    given = docs.select(F.struct(*docs.columns).alias("held"), "doc_id", "text", "source")
    sized = mixing.word_sizes(given).select("held", "doc_id", "size", "sources")
    mixed = mixing.mix_sources(sized).where("taken > 0")
    times = F.ceil(F.col("taken") / F.greatest("size", F.lit(1))).cast("int")
    return mixed.select("held", F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).select(*[F.col("held")[c].alias(c) for c in docs.columns])


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``ids`` (tokens of the whole text), ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of every row; other columns are left out.

    Null and empty texts have no ids. Repeated rows, and rows with null or repeated ids, have a row each; an empty table gives an empty one. Texts may be of any length.
    """
    import public_tokenizers

    _small_reads(docs)
    found = piece_codec.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), want_texts=False)
    return found.select("doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", encoding_stage),
]

#: The models' decisions can't be written in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs, f"stage{number}")
    return docs
