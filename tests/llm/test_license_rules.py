"""The license scan's own labels and spans against Python's re: gates, all matches of every rule, suppression by containment, labels and scores."""

import re

from loomdoc.llm import license_scan

SF = "/root/testdata/sf0.001"
LOW = {i: i + 32 for i in range(65, 91)}


def spans(text):
    """All matches of gated rules; one goes if another one that sorts before it reaches as far with at least its priority."""
    low = (text or "").translate(LOW)
    found = []
    for r in license_scan.RULES:
        if any(k in low for k in r["keys"]):
            found += [(m.start(), -m.end(), r["priority"], r["label"], r["weight"]) for m in re.finditer(r["pattern"], low, re.ASCII)]
    found.sort()
    return [(a, -b, p, label, w) for i, (a, b, p, label, w) in enumerate(found) if not any(y <= b and q <= p for _, y, q, _, _ in found[:i])]


MADE = [
    "SPDX-License-Identifier: Apache-2.0 OR MIT", "Licensed under the Apache License, Version 2.0 (the License)", "distributed under the terms of the GNU General Public License v3. See https://www.gnu.org/licenses/gpl-3.0.html",
    "license: bsd-3-clause\nlicense = 'mit'\nThis is MIT-licensed and also ISC licensed.", "All rights reserved. Copyright (c) 2020 Someone", "The BSD License, the 3-clause BSD license and Mozilla Public License 2.0", "CC BY-SA 4.0 and cc-by 3.0, Creative Commons Attribution-ShareAlike 4.0 International License",
    "licensed under the MIT License licensed under the MIT License", "mit license, version 1.0 mit license", "é漢 MIT License é SPDX-License-Identifier: (GPL-3.0-or-later)", "lgpl license; LGPL-2.1+ license is lgpl-2.1", "", None, "no such words at all",
]


def test_spans_labels_and_suppression(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(MADE * 2)], "doc_id long, text string")  # repeated texts too
    got = {r["doc_id"]: [tuple(d) for d in r["detections"]] for r in license_scan.scan_licenses(docs).collect()}
    for i, text in enumerate(MADE * 2):
        assert [d[:4] for d in got[i]] == [d[:4] for d in spans(text)], text
    assert got[0] and got[2] and len(got[7]) == 2


def test_whole_table_labels_and_scores(spark):
    got = {r["doc_id"]: r for r in license_scan.op10_license_scan(spark, SF).collect()}
    base = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        found = spans(d["text"])
        words = base.findall((d["text"] or "").translate(LOW))
        fixed = {label for phrase, label in license_scan.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()}
        r = got[d["doc_id"]]
        assert set(filter(None, r["labels"].split(","))) == fixed | {f[3] for f in found}
        assert abs(r["score"] - max([f[4] for f in found] + [0.9 if fixed else 0.0])) < 1e-9


def test_long_texts(spark):
    text = "words and more " * 70_000 + "Licensed under the MIT License. " + "tail " * 200_000
    row = license_scan.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(d)[:4] for d in row["detections"]] == [d[:4] for d in spans(text)] and len(row["detections"]) == 1
