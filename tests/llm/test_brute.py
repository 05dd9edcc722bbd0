"""Queries without SQL against plain Python over whole tables."""

import hashlib
import re
import zlib
from collections import defaultdict

from loomdoc.llm import queries
from loomdoc.llm.media_columns import media_clips, store_texts

SF = "/root/testdata/sf0.001"


def rows_of(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


def test_media_digests(spark):
    got = {r["doc_id"]: r for r in queries.QUERIES["op2_media_columns"](spark, SF).collect()}
    docs = rows_of(spark)
    assert len(got) == len(docs)
    for d in docs:
        raw = (d["text"] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got[d["doc_id"]]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["media_bytes"] > r["payload_bytes"] // 64 and len(r["media_sha256"]) == 64 and r["feature"]


def test_media_of_long_texts_and_broken_files(spark):
    long = spark.createDataFrame([(1, "ab c" * 400_000), (2, None), (3, "x")], "doc_id long, text string")
    stored = store_texts(long)
    assert {r["doc_id"]: r["n_bytes"] for r in stored.collect()} == {1: 1_600_000, 2: 0, 3: 1}
    broken = spark.createDataFrame([(1, bytearray(b"RIFF....AVI ")), (2, bytearray(b"")), (3, None)], "doc_id long, media binary")
    assert sorted((r["doc_id"], r["clip"]) for r in media_clips(broken).collect()) == [(1, None), (2, None)]


def test_mixing_targets(spark):
    got = {r["doc_id"]: r for r in queries.QUERIES["op9_mixing"](spark, SF).collect()}
    docs = rows_of(spark)
    size = {d["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")) for d in docs}
    words = defaultdict(int)
    for d in docs:
        words[d["source"]] += size[d["doc_id"]]
    sources = sorted(words, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    target, left, free = {}, 1.5 * sum(words.values()), set(sources)
    while free:
        total = sum(weight[s] for s in free)
        share = {s: left * weight[s] / total for s in free}
        over = {s for s in free if share[s] > 2 * words[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * words[s]
            left -= target[s]
        free -= over
    taken = defaultdict(int)
    for d in docs:
        r = got[d["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[d["doc_id"]], words[d["source"]])
        assert abs(r["target"] - target[d["source"]]) < 1e-6 * max(1, target[d["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[d["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in sources)


def test_license_base_phrases(spark):
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    got = {r["doc_id"]: r for r in queries.QUERIES["op10_license_scan"](spark, SF).collect()}
    hits = 0
    for d in rows_of(spark):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in d["text"] or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        found = [(i, label) for i in range(len(words)) for phrase, label in phrases.items() if tuple(words[i : i + len(phrase)]) == phrase]
        r = got[d["doc_id"]]
        want = (len(words), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found})))
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == want
        assert {x for _, x in found} <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
        hits += len(found)
    assert hits
