import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from loomdoc.llm import embedding_dedup, language_id, license_scan, media_columns, mixing, ngram_jaccard, piece_codec, quality, queries, token_counts, url_filters
from loomdoc.llm.common import connected_components

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a", "  Hello  wörld\n\tok  ", "日本語🎉🎉", "▁▁x▁", "<s>hi</s><|endoftext|>", "a\x00b", "=" * 500, "ΑΣ ΣΑΣ", "bcbcabcbc" * 30]


def docs(spark, texts, **more):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def texts(spark):
    return [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


def test_pieces_match_the_library(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    random.seed(3)
    every = ODD + ["".join(random.choices("abcdeinorst =#-", k=random.randint(1, 90))) for _ in range(300)] + texts(spark)
    got = {r["doc_id"]: r for r in piece_codec.encode_pieces(docs(spark, every), path).collect()}
    for i, t in enumerate(every):
        ids = sp.encode(t or "")
        assert got[i]["ids"] == ids and got[i]["decoded"] == sp.decode(ids), t
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_token_counts_match_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    every = ODD + texts(spark)
    for head in (0, 50, 1 << 18):
        got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(docs(spark, every), path, head_words=head).collect()}
        assert got == {i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(every)}


def test_media_round_trip(spark):
    every = ODD + texts(spark)[:40] + ["ab" * 5000 + "\xff" * 5000]
    stored = media_columns.store_texts(docs(spark, every))
    for r in stored.collect():
        found = media_columns.read_media(bytes(r["media"]))
        assert found["payload"] == media_columns.padded(every[r["doc_id"]])
        assert found["clips"][-1]["last_frame"] == found["frames"] - 1
    assert media_columns.media_clips(stored).count() >= len(every)
    frame = media_columns.write_jpeg(np.arange(64, dtype=np.uint8))
    flat, is_flat = media_columns.read_jpeg(frame)
    assert is_flat and (flat == np.arange(64)).all()
    general = media_columns._general(frame[frame.index(b"\xff\xda") + 10 : -2], 8, 512, [(1, 1, 1, 0)], {1: 0}, {0: np.full(64, 8)}, {0: media_columns._codes(media_columns._DC_TABLE), 16: media_columns._codes(media_columns._AC_TABLE)}, 0)
    assert (general[::8, ::8].ravel() == flat).all()
    assert media_columns.find_shots(np.array([[9, 0], [9, 0], [0, 9], [0, 9]])) == [0, 2]
    assert zlib.crc32(b"") == 0


def test_language_held_out(spark):
    got = queries.QUERIES["op3_language_id"](spark, "/root/testdata/sf0.01")
    both = got.join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL")
    assert both.where("lang = lang_pred").count() >= 0.97 * both.count()
    odd = {r["doc_id"]: r for r in language_id.identify(docs(spark, ["123 !!", None, "", "the"]), language_id.fit(docs(spark, ["the and of"] * 3))).collect()}
    assert [odd[i]["lang_pred"] for i in range(4)] == ["und", "und", "und", "en"]
    assert language_id.identify(docs(spark, ["a"]), language_id.fit(docs(spark, []))).first()["lang_pred"] == "und"


def test_code_lengths_are_probabilities():
    rng = np.random.default_rng(1)
    grams = np.unique(rng.integers(0, language_id.SYMBOLS**4, 500))
    tables = language_id.freeze({"x": (grams, rng.integers(1, 9, len(grams)))})
    assert np.allclose(np.exp2(-tables.model(0)[1].astype(float)).sum(1), 1, atol=1e-3)


def test_quality(spark):
    got = queries.QUERIES["op4_quality"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    rate = {r["quality"]: r["kept"] for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()}
    assert rate[1] > 0.95 and rate[0] < 0.3
    none = quality.fit(docs(spark, ["a"]), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert [r["kept"] for r in quality.classify(docs(spark, ["a", None, ""]), none).orderBy("doc_id").collect()] == [True, False, False]


def brute_components(ids, every, n, percent):
    sets = []
    for t in every:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    label = list(ids)
    for _ in ids:
        for i in range(len(ids)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    label[i] = label[j] = min(label[i], label[j])
    return {k: (len(s), c) for k, s, c in zip(ids, sets, label, strict=True)}


def test_jaccard_components(spark):
    random.seed(5)
    words = [f"w{i}" for i in range(40)]
    base = [" ".join(random.choices(words, k=k)) for k in (3, 8, 30, 60)]
    every = [None, "", " \t", "a", "A", "a b", *base, *base]
    for b in base:
        for _ in range(8):
            w = b.split()
            for _ in range(random.randint(1, 3)):
                w[random.randrange(len(w))] = random.choice(words)
            every.append(" ".join(w))
    every += [base[3] + " " + " ".join(random.choices(words, k=k)) for k in (1, 2, 3, 6, 8)]
    for n, percent in ((4, 85), (5, 80), (2, 60)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.jaccard_components(docs(spark, every), n, percent).collect()}
        want = brute_components(range(len(every)), every, n, percent)
        assert got == want
    assert ngram_jaccard.jaccard_components(docs(spark, [])).count() == 0


@pytest.mark.parametrize(("n", "percent", "low", "high"), [(4, 85, 10, 11), (5, 80, 11, 12), (4, 60, 8, 11), (4, 60, 10, 14)])
def test_jaccard_links_of_small_and_larger_sets(spark, n, percent, low, high):
    every = []
    for k in range(30):
        words = [f"{'x' * ((i * 7 + k) % 5)}{k}w{i}" for i in range(high)]
        every += [" ".join(words[:low]), " ".join(words)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.jaccard_components(docs(spark, every), n, percent).collect()}
    assert got == brute_components(range(len(every)), every, n, percent)
    assert all(got[2 * k + 1][1] == 2 * k for k in range(30))


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 16))
    vectors = [*(centres[i % 60] + rng.normal(size=16) * 0.05 * (i % 5) for i in range(300))]
    rows = [(i, [float(x) for x in v], i % 3) for i, v in enumerate(vectors)]
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, [None] * 16, 1), (304, rows[0][1], None), (305, rows[0][1], 0), (306, [], 0)]
    got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert len(got) == len(rows)
    ok = [r for r in rows if r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    x = np.array([r[1] for r in ok])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = (x @ x.T >= 0.98) & (np.array([r[2] for r in ok])[:, None] == np.array([r[2] for r in ok])[None, :])
    np.fill_diagonal(linked, False)
    label = np.array([r[0] for r in ok])
    for _ in ok:
        label = np.minimum(label, np.where(linked, label[None, :], 999).min(1))
    for r, n, c in zip(ok, linked.sum(1), label, strict=True):
        assert (got[r[0]]["n_links"], got[r[0]]["component_id"]) == (n, c)
    assert all((got[i]["n_links"], got[i]["kept"]) == (0, True) for i in (300, 301, 302, 303, 304, 306))


def test_urls(spark):
    pages = spark.createDataFrame([(0, None), (1, "x"), (2, "http://A.Spam-Farm.example.net/en/1?q"), (3, "http://www.example.com/en/1#a"), (4, "http://b.example.com/en/"), (5, "s://x.net/es/1"), (6, "s://x.com")], "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.filter_urls(pages).collect()}
    assert got[0] == got[1] == ("", "", None, "allow")
    assert got[2] == ("a.spam-farm.example.net", "/en/1", None, "block")
    assert got[3][2:] == ("www.example.com/en/", "allow") and got[4][2:] == ("example.com/en/", "block") and got[5][2:] == ("net/es/", "block") and got[6][2:] == (None, "allow")
    universe = spark.range(4000).select(F.concat(F.lit("h"), "id").alias("host"), (F.col("id") % 7 == 0).alias("listed"))
    cascade = url_filters.build_cascade(universe)
    assert universe.where(cascade.holds(F.col("host")) != F.col("listed")).count() == 0
    assert url_filters.filter_urls(pages.limit(0), listed=()).count() == 0


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, ["b", None, "a", "c"][min(3, i % 7)], rng.randint(0, 50)) for i in range(800)] + [(9, "a", 7), (9, "a", 7)]
    table = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("sources", F.array("source"))
    got = mixing.mix_sources(table).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(table).collect()))
    taken, goal = Counter(), {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        goal[r["source"]] = r["target"]
    assert all(abs(taken[s] - goal[s]) <= 1 for s in goal)
    flow = mixing.route({("a",): 10, ("a", "b"): 10}, {"a": 15, "b": 10}, 2)
    assert sum(flow["a",].values()) + flow["a", "b"]["a"] == 15 and flow["a", "b"]["b"] == 10
    assert mixing.targets({"a": 10, None: 10}, (3, 1), 1.5, 2) == {"a": 20.0, None: 10.0}
    assert mixing.mix_sources(table.limit(0)).count() == 0


def test_licenses(spark):
    every = [None, "", "MIT License and the Apache license, Version 2.0. mit-license", "licensed under the GNU General Public License, version 3.", "mit licenses", "SPDX-License-Identifier: MIT", "MIT\nLICENSE MIT license", "licensed under the MIT License"]
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(docs(spark, every)).collect()}
    assert [[tuple(b) for b in got[i]["base"]] for i in range(5)] == [[], [], [(0, "mit"), (4, "apache"), (9, "mit")], [(4, "gpl")], []]
    assert [tuple(b) for b in got[6]["base"]] == [(0, "mit"), (2, "mit")]
    assert got[5]["detections"][0]["label"] == "mit" and got[0]["n_words"] == 0 and got[2]["n_words"] == 11
    assert len(got[7]["detections"]) == 1  # the mention inside the notice is suppressed


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 50), (50, 70), (3, 3), (None, 4)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(21)} | {50: 50, 70: 50, 100: 50}


def test_pipeline(spark):
    read = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.near_duplicate_stage(spark, read, SF)
    rows = [(r["doc_id"], r["text"]) for r in read.collect()]
    want = brute_components([k for k, _ in rows], [t for _, t in rows], 5, 80)
    assert {r["doc_id"] for r in kept.collect()} == {k for k, (_, c) in want.items() if c == k}
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and "ids" in out.columns


def test_near_duplicates_with_null_and_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(20)) for x in "abc")
    every = [(None, a), (None, a), (5, b), (5, b), (None, b), (7, b + " more"), (3, c), (3, "other words than those of the row before"), (None, None), (None, "")]
    table = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(every)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicate_stage(spark, table, SF)
    assert kept.columns == table.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([every[k] for k in (0, 2, 6, 7, 8, 9)], key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, tmp_path, name):
    for table in ("documents", "pages", "embeddings", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0
