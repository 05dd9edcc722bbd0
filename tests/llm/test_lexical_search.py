"""Ranked search against a plain-Python ranking of all documents."""

import math
import random
import re
from collections import Counter

from loomdoc.llm import lexical_search
from loomdoc.llm.lexical_search import rank_documents

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = {i: i + 32 for i in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def expected(docs, items, k=10):
    words = [(key, terms(text)) for key, text in docs]
    words = [(key, len(w), Counter(w)) for key, w in words if w]
    big_n, big_l = len(words), sum(n for _, n, _ in words)
    df = Counter(t for _, _, c in words for t in c)
    rows = []
    for key, text in items:
        found = []
        for doc, n, c in words:
            m = 10 + (90 * n * big_n) // big_l
            score = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        rows += [(key, rank, None if none else doc, -score) for rank, (score, none, doc) in enumerate(sorted(found)[:k], 1)]
    return sorted(rows, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def made(seed, n):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choices("abcé漢Z9", k=rnd.randint(1, 4))) for _ in range(60)]
    docs = [(rnd.randint(0, 10**9), " ".join(rnd.choices(vocab, weights=range(1, 61), k=rnd.choice([1, 3, 20, 120])))) for _ in range(n)]
    docs += [(10**9 + i, docs[0][1]) for i in range(40)] + [docs[1]] * 15 + [(None, docs[0][1]), (5, None), (6, ""), (7, "?!"), (None, None)]
    items = [(i, rnd.choice([", ", "-", "\n"]).join(rnd.choices(vocab, k=rnd.randint(1, 12)))) for i in range(12)] + [(12, docs[0][1]), (13, None), (14, ""), (15, "unknownterm"), (3, "a"), (3, "a"), (None, "a b")]
    return docs, items


def test_equals_brute_force_with_ties_and_repeats(spark, monkeypatch):
    docs, items = made(1, 700)
    want = expected(docs, items)
    for parts in (1, 9):
        found = rank_documents(spark.createDataFrame(docs, DOCS).repartition(parts), spark.createDataFrame(items, ITEMS))
        assert got(found) == want
    # blocks of one item each give the same rows
    assert got(rank_documents(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items[:4], ITEMS), block_bytes=1)) == expected(docs, items[:4])
    assert got(rank_documents(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), k=3)) == expected(docs, items, 3)


def test_search_skips_nodes_and_opens_ties():
    import numpy as np

    rng = np.random.default_rng(0)
    n = 4096
    shard = {"lengths": rng.integers(1, 50, n).astype(np.int32)}
    held = [np.sort(rng.choice(n, size, replace=False)) for size in (3000, 40, 7)]
    shard |= {"terms": np.repeat([0, 1, 2], [len(h) for h in held]).astype(np.int32), "docs": np.concatenate(held).astype(np.int32), "tfs": rng.integers(1, 4, sum(map(len, held))).astype(np.int32)}
    trees = lexical_search.Trees(shard, {0: 3, 1: 4000, 2: 6000}, n, int(shard["lengths"].sum()))
    total = np.zeros(n, np.int64)
    np.add.at(total, trees.docs, trees.scores)
    ids = [(False, int(x)) for x in rng.permutation(n)]
    want = sorted(range(n), key=lambda d: (-total[d], ids[d]))[:10]
    assert trees.search([0, 1, 2], ids, 10, 1) == [(int(total[d]), d) for d in want]
    assert trees.bound([0, 1, 2]) >= total.max()
    assert trees.search([0, 1, 2], ids, 10, int(total.max()) + 1) == [] == trees.search([], ids, 10, 1)


def test_empty_tables_other_columns_and_long_texts(spark):
    docs, items = spark.createDataFrame([(1, "a b", 0)], "doc_id long, text string, score int"), spark.createDataFrame([(4, "B", 1)], "item_id long, text string, rank int")
    assert got(rank_documents(docs, items)) == expected([(1, "a b")], [(4, "B")])
    assert rank_documents(spark.createDataFrame([], DOCS), items).count() == 0
    assert rank_documents(docs, spark.createDataFrame([], ITEMS)).count() == 0
    long = [(1, "alpha beta " * 300_000), (2, "beta"), (3, "gamma"), (4, "x" * 2_000_000)]
    assert got(rank_documents(spark.createDataFrame(long, DOCS), spark.createDataFrame([(1, "alpha beta gamma " + "x" * 2_000_000)], ITEMS))) == expected(long, [(1, "alpha beta gamma " + "x" * 2_000_000)])
