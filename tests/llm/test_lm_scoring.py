"""Language-model scores: the base against plain Python, the model's sums against its own single steps, held-out texts against the base."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from loomdoc.llm import attention_model as network
from loomdoc.llm import lm_scoring

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id long, text string"
LOW = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def base(docs):
    counts, ends = Counter(), 0
    for key, text in docs:
        if key is None or zlib.crc32(str(key).encode()) % 5 != 1:
            counts.update(words(text))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    rows = []
    for key, text in docs:
        own = words(text)
        each = [counts[w] for w in own] + [ends]
        score = sum(math.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in each)
        rows.append((key, key is not None and zlib.crc32(str(key).encode()) % 5 == 1, len(own) + 1, sum(c > 0 for c in each), n, round(score, 6)))
    return sorted(rows, key=repr)


def got(df):
    rows = df.collect()
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    return sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows), key=repr)


ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "A a B é É\x0bx"), (5, "漢字 😀"), (6, "\x1c\x85 z"), (7, "rep eat"), (7, "rep eat"), (None, "no id"), (None, None), (8, " " * 30_000), (9, "y" * 50_000), (10, "a b " * 60_000)]


def test_base_equals_plain_python(spark, monkeypatch):
    docs = ODD + [(100 + i, " ".join(f"w{(i * j) % 37}" for j in range(i % 30))) for i in range(200)]
    frame = spark.createDataFrame(docs, DOCS).repartition(5)
    assert got(lm_scoring.score_texts(frame, PATH, train_bytes=1)) == base(docs)
    monkeypatch.setattr(lm_scoring, "HEAD_WORDS", 0)  # every word leaves the pass
    assert got(lm_scoring.score_texts(frame, PATH, train_bytes=1)) == base(docs)


def test_empty_and_unlearned_tables(spark):
    assert lm_scoring.score_texts(spark.createDataFrame([], DOCS), PATH).count() == 0
    held = [(k, "some words here") for k in range(60) if zlib.crc32(str(k).encode()) % 5 == 1]
    found = lm_scoring.score_texts(spark.createDataFrame(held, DOCS), PATH)
    assert got(found) == base(held)
    assert {r["train_tokens"] for r in found.collect()} == {0}
    other = spark.createDataFrame([(1, "a", 3.0)], "doc_id long, text string, score double")
    assert lm_scoring.score_texts(other, PATH, train_bytes=100).columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


@pytest.fixture(scope="module")
def small():
    counts = np.zeros(3001, np.int64)
    counts[:2500] = 5000 // (1 + np.arange(2500))
    counts[-1] = 40
    units = network.units_of(counts)
    params = network.begin(units)
    rng = np.random.default_rng(5)
    return units, {k: v + 0.05 * rng.standard_normal(v.shape).astype(np.float32) for k, v in params.items()}


def test_probabilities_of_all_ids_sum_to_one(small):
    units, params = small
    before = np.array([3, 700, 9])
    total = 0.0
    for i in range(len(units.unit)):
        ids = np.append(before, i)
        taken, valid, _ = network.windows(units.unit[ids], np.array([4]))
        found = network.log_probabilities(params, taken, valid)[3]
        total += math.exp(found + (units.rare[i] if units.unit[i] == network.RARE else 0))
    assert abs(total - 1) < 1e-3


def test_each_unit_is_scored_once_and_sees_no_later_one(small):
    units, params = small
    rng = np.random.default_rng(1)
    sizes = np.array([1, network.STEP, network.STEP + 1, 200, 3])
    ids = rng.integers(0, 3001, sizes.sum())
    taken, valid, text = network.windows(units.unit[ids], sizes)
    assert valid.sum() == sizes.sum() and list(np.bincount(text)) == [-(-n // network.STEP) for n in sizes]
    assert np.array_equal(taken[:, network.LEAD + 1 :][valid], units.unit[ids])
    whole = network.log_probabilities(params, taken, valid)
    changed = ids.copy()
    changed[150] = (changed[150] + 1) % 3001  # of the fourth text
    other = network.log_probabilities(params, network.windows(units.unit[changed], sizes)[0], valid)
    assert np.allclose(whole[:150], other[:150], atol=1e-5)


def test_gradients(small):
    units, params = small
    rng = np.random.default_rng(2)
    taken, valid, _ = network.windows(units.unit[rng.integers(0, 3001, 90)], np.array([50, 40]))
    _, g = network.gradients(params, taken, valid)
    for name, p in params.items():
        way = rng.standard_normal(p.shape).astype(np.float32)
        way *= np.float32(0.02 / np.sqrt(way.size))
        up, down = (network.gradients(params | {name: p + s * way}, taken, valid)[0] for s in (1, -1))
        assert abs((up - down) / 2 - float((g[name] * way).sum())) < 2e-4


def test_model_beats_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in lm_scoring.score_texts(docs, PATH).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_words_encoded_together_are_words_encoded_alone():
    rows = ["don't", "a ", " b", " ", "x\x1cy", "\x85", "漢字", "😀é", "12ab", "...", "'s", "z" * 5000, "q" * 4100, "­", "ﬁ"] + [f"w{i}é" for i in range(600)]
    words = [r.encode() for r in rows] + [b"\xff\xfe", b"ok"]
    found = lm_scoring.Words(PATH)
    ids, sizes = found.encode_new(words)
    ends = np.cumsum(sizes)
    for word, a, b in zip(words, ends - sizes, ends, strict=True):
        assert ids[a:b].tolist() == lm_scoring.encode_word(found.encoding, word)
    _, flat, each = found.encode([words, [], [b"ok", b"ok"]])
    assert flat[: each[0]].tolist() == ids.tolist() and each[1] == 0 and each[2] == 2 * sizes[-1]


def test_weights_are_learned_from_every_text(spark):
    """The targets that the tasks learned from are all ids and ends of the learned texts, beyond what the weights begin with, and a text outside that beginning changes them."""
    rng = np.random.default_rng(3)
    kind = lm_scoring._id_type(3000)
    rows = [(rng.integers(0, 200, int(rng.integers(0, 400))).astype(kind).tobytes(),) for _ in range(60)]
    counts = np.bincount(np.concatenate([np.frombuffer(r[0], kind) for r in rows]), minlength=3001)
    counts[-1] = 60
    seen, averaged = [], lm_scoring._averaged

    def watched(shards):
        held = shards.collect()
        seen.append(sum(r["n"] for r in held))
        return averaged(spark.createDataFrame(held, lm_scoring._WEIGHTS))

    lm_scoring._averaged = watched
    try:
        frame = spark.createDataFrame(rows, "ids binary").repartition(3)
        units, one = lm_scoring.fit(frame, counts, train_bytes=3000)
        odd = np.full(2000, 7, kind).tobytes()
        _, other = lm_scoring.fit(frame.unionByName(spark.createDataFrame([(odd,)], "ids binary")), counts, train_bytes=3000)
    finally:
        lm_scoring._averaged = averaged
    assert seen[1] == counts.sum() > seen[0] / lm_scoring.BEGIN_PASSES
    assert seen[3] == counts.sum() + 2001 and not np.array_equal(one, other)


def test_weights_of_many_tasks_are_averaged_by_what_each_learned_from(spark):
    rows = [(i, i + 1, np.array([i, 2.0 * i]) * (i + 1)) for i in range(40)]
    frame = spark.createDataFrame([(i, n, w.tobytes()) for i, n, w in rows], lm_scoring._WEIGHTS)
    assert np.allclose(lm_scoring._averaged(frame), sum(w for _, _, w in rows) / sum(n for _, n, _ in rows))
