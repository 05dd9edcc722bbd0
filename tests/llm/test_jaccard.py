import random

import pytest

from loomdoc.llm import ngram_jaccard


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def brute_components(texts, n, percent):
    """Shingle counts and components by comparing all pairs."""
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i] = root[root[i]]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (3, 60)])
def test_every_size_at_the_threshold(spark, n, percent):
    """Sets of 1 to 40 shingles against the largest and smallest partners that link, and one beyond: prefixes of one run of words, and runs shifted against each other."""
    texts = []
    for size in range(1, 41):
        words = [f"s{size}w{k}" for k in range(size + n + 40)]
        texts.append(" ".join(words[: size + n - 1]))
        least = -(-percent * size // 100)
        for other in {least, least - 1} - {0, size}:
            texts.append(" ".join(words[: other + n - 1]))
        words = [f"t{size}w{k}" for k in range(size + n + 40)]
        shift = size - -(-2 * percent * size // (100 + percent))
        for k in (0, shift, shift + 1):
            texts.append(" ".join(words[k : k + size + n - 1]))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.jaccard_components(docs(spark, texts), n=n, percent=percent).collect()}
    assert got == brute_components(texts, n, percent)


def near_copies(k, seed):
    rnd = random.Random(seed)
    base = [f"b{rnd.randrange(5000)}" for _ in range(60)]
    texts = []
    for _ in range(k):
        words = list(base)
        for _ in range(rnd.choice([1, 2, 2, 3])):
            words[rnd.randrange(60)] = f"n{rnd.randrange(10**9)}"
        texts.append(" ".join(words))
    return texts


def test_a_group_of_near_copies_grows_in_proportion(spark, monkeypatch):
    """Pairs that are verified grow with the members of one group of copies, many of which don't link with each other; the result is that of brute force."""
    made = {}
    for k in (150, 600):
        counts = []
        monkeypatch.setattr(ngram_jaccard.DataFrame, "mapInArrow", lambda df, f, schema, counts=counts: counted(df, f, schema, counts))
        texts = near_copies(k, 4)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.jaccard_components(docs(spark, texts)).collect()}
        assert got == brute_components(texts, 4, 85)
        made[k] = sum(counts)
    assert made[600] <= 8 * made[150]


MAP = ngram_jaccard.DataFrame.mapInArrow


def counted(df, f, schema, counts):
    if f is ngram_jaccard._verify:
        counts.append(df.count())
    return MAP(df, f, schema)
