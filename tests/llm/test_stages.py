"""The pipeline's stages, each against its rule on its own input, with columns whose names the operators use themselves."""

import hashlib
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import functions as F

from loomdoc.llm import language_id, license_scan, mixing, piece_codec, quality

SF = "/root/testdata/sf0.001"
CLASHES = ("row_key", "_row_key", "__row", "__copy", "held", "copy", "__held", "model", "kept", "size", "sources", "taken", "lang_pred", "score", "component_id", "__p", "__u", "__b", "__id", "first", "plan")


def table(spark, extra=True):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    if not extra:
        return docs
    docs = docs.unionByName(docs.where("doc_id < 3").withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs.where("doc_id < 2"))  # no id, and repeats
    return docs.withColumns({name: F.concat(F.lit(f"{name}:"), F.coalesce(F.col("doc_id"), F.lit(-1)).cast("string")) for name in CLASHES})


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_filters_keep_rows_whole(spark):
    docs = table(spark)
    every = rows(docs)
    plain = table(spark, False)
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    verdicts = {r["text"]: r["kept"] for r in quality.classify(plain, model, ("text",)).collect()}
    kept = rows(corpus_pipeline.quality_stage(spark, docs, SF))
    assert kept == Counter({r: n for r, n in every.items() if verdicts[r[1]]}) and 0 < len(kept) < len(every)
    found = {r["text"]: r["lang_pred"] != "und" and r["score"] >= 0.5 for r in language_id.identify(plain, language_id.fit(docs), keep=("text",)).collect()}
    kept = rows(corpus_pipeline.language_stage(spark, docs, SF))
    assert kept == Counter({r: n for r, n in every.items() if found[r[1]]}) and kept


def test_near_duplicates_and_mixing_keep_columns(spark):
    docs = table(spark)
    left = corpus_pipeline.near_duplicate_stage(spark, docs, SF)
    assert left.columns == docs.columns and not rows(left) - rows(docs)
    mixed = rows(corpus_pipeline.mixing_stage(spark, docs, SF))
    sized = mixing.mix_sources(mixing.word_sizes(table(spark, False).unionByName(table(spark, False).where("doc_id < 3").withColumn("doc_id", F.lit(None).cast("long"))).unionByName(table(spark, False).where("doc_id < 2"))).drop("text"))
    times = Counter()
    for r in sized.where("taken > 0").collect():
        times[r["doc_id"]] += -(-r["taken"] // max(1, r["size"]))
    got = Counter()
    for r, n in mixed.items():
        got[r[0]] += n
    assert set(mixed) <= set(rows(docs)) and {k: n for k, n in got.items() if k is not None and k > 1} == {k: n for k, n in times.items() if k is not None and k > 1}


def test_encoding(spark):
    docs = table(spark)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter()
    for r in docs.collect():
        ids = library.encode(r["text"] or "")
        want[r["doc_id"], tuple(ids), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], tuple(r["ids"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.encoding_stage(spark, docs, SF).collect()) == want


def test_empty_tables(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table(spark).limit(0), SF).count() == 0


def test_operators_keep_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "MIT license here", "a", "b", "c", "d", "s")], "doc_id long, text string, __low string, __words string, __held string, __p string, source string")
    row = license_scan.scan_licenses(docs).first()
    assert (row["__low"], row["__words"], row["__held"], row["n_words"]) == ("a", "b", "c", 3)
    row = mixing.mix_sources(mixing.word_sizes(docs)).first()
    assert (row["__low"], row["__held"], row["__p"], row["size"], row["source_size"]) == ("a", "c", "d", 3, 3)


def test_encoding_makes_no_texts_and_holds_little(spark, monkeypatch):
    """The decoded texts stay in the task, and what a worker holds at once goes with parts of a batch, not with it all."""
    docs = table(spark, False)
    assert "decoded#" not in corpus_pipeline.encoding_stage(spark, docs, SF)._jdf.queryExecution().optimizedPlan().toString()
    met = []
    units_of = piece_codec.units_of
    monkeypatch.setattr(piece_codec, "units_of", lambda text: met.append(len(text)) or units_of(text))
    texts = pa.array([f"w{i} " * 1000 for i in range(500)])
    run = piece_codec._encoder(public_tokenizers.path("piece_bpe_32k.model"), True)
    held, total = [], 0
    for found in run(iter([pa.RecordBatch.from_arrays([pa.array(range(500)), texts], ["a", "b"])])):
        total += found.num_rows
        held.append(sum(met))
        met.clear()
    assert total == 500 and max(held) <= 600_000


def test_mixing_starts_no_python_workers(spark):
    """The plan's small tables come as Arrow: rows of Python objects would be dealt out by Python workers."""
    sized = mixing.word_sizes(table(spark, False))
    assert "ExistingRDD" not in mixing.mix_sources(sized)._jdf.queryExecution().optimizedPlan().toString() + mixing.mix_sources(sized)._jdf.queryExecution().executedPlan().toString()
