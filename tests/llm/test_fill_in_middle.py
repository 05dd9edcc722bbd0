"""Fill-in-middle rows against plain Python over code points."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from loomdoc.llm import fill_in_middle as fim

SCHEMA = "doc_id long, text string"


def expected(key, text, seed="1"):
    text = text or ""
    x = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(x[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return key, n, "plain", None, None, text
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return key, n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return key, n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


def check(spark, rows, parts=2):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    found = fim.fill_in_middle(df)
    got = found.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted((expected(*r) for r in rows), key=repr)
    assert sorted((r["doc_id"], r["back"]) for r in got if r["doc_id"] is not None) == sorted((k, t or "") for k, t in rows if k is not None)


def test_forms_marks_widths_and_nulls(spark):
    odd = ["", None, "a", "é", "漢字", "😀", "aé漢😀" * 7, "<P>x", "x<S", "<<S>>", "<M>", "a<", "P>b", "\x00\n\t", "ab" * 50 + "é" * 50 + "漢" * 50]
    rows = [(i, odd[i % len(odd)]) for i in range(400)] + [(None, "no id é"), (None, None), (7, "repeat"), (7, "repeat")]
    check(spark, rows)
    check(spark, rows, 7)


def test_long_texts(spark):
    check(spark, [(1, "xé漢😀 " * 300_000), (2, "a" * 5_000_000), (3, ""), (4, "é" * 3_000_000), (5, "z")], 1)


def test_runs_do_not_depend_on_blocks(monkeypatch):
    texts = ["", "aé漢😀b", "", "ccc", "éé", "", "😀", "a漢" * 9, ""]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    starts = np.cumsum([0] + [len(t.encode()) for t in texts[:-1]])
    whole = fim.class_runs(data, starts)
    for block in (1, 2, 3, 5, 64):
        monkeypatch.setattr(fim, "BLOCK", block)
        assert all(np.array_equal(x, y) for x, y in zip(whole, fim.class_runs(data, starts), strict=True))
    for k, t in enumerate(texts):
        for cut in range(len(t) + 1):
            assert fim.cut_bytes(whole, whole[3][k] + cut) - starts[k] == len(t[:cut].encode())


def test_empty_table_and_other_columns(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], SCHEMA)).count() == 0
    extra = spark.createDataFrame([(1, "abc", "x", 5)], "doc_id long, text string, output string, n int")
    assert fim.fill_in_middle(extra).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert fim.fill_in_middle(extra, seed="2").first()["n"] == 3
