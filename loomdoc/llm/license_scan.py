"""License scans: ordered signature rules over whole texts, in DataFrame expressions alone.

Every rule is a regular expression over the text with A-Z lower-cased, gated by a keyword. A text without any of the few ``TRIGGERS`` is
never scanned further; in the others a rule's expression runs only where its own keyword occurs. A detection inside the span of
another of the same or a better priority is suppressed, so a mention inside a notice counts once.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdoc.llm.common import ascii_lower

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Label; names in running text; short identifier; place of the text.
FAMILIES = (
    ("mit", r"mit|expat", r"mit(?:-0)?", r"opensource\.org/licenses?/mit"),
    ("apache", r"apache(?: software)?", r"apache-[12]\.[01]", r"apache\.org/licenses"),
    ("gpl", r"(?:gnu )?general public|gnu gpl", r"gpl-[123]\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl"),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public", r"lgpl-[23]\.[01](?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?lgpl"),
    ("agpl", r"(?:gnu )?affero general public", r"agpl-[13]\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/agpl"),
    ("gfdl", r"(?:gnu )?free documentation", r"gfdl-1\.[123](?:-only|-or-later)?", r"gnu\.org/licenses/fdl"),
    ("bsd", r"(?:[234]-clause |new |simplified |modified )?bsd(?: [234]-clause)?", r"(?:0bsd|bsd-[1234]-clause)", r"opensource\.org/licenses?/bsd"),
    ("isc", r"isc", r"isc", r"opensource\.org/licenses?/isc"),
    ("mpl", r"mozilla public", r"mpl-[12]\.[01]", r"mozilla\.org/(?:en-us/)?mpl"),
    ("epl", r"eclipse public", r"epl-[12]\.0", r"eclipse\.org/legal/epl"),
    ("edl", r"eclipse distribution", r"edl-1\.0", r"eclipse\.org/org/documents/edl"),
    ("cddl", r"common development and distribution", r"cddl-1\.[01]", r"opensource\.org/licenses?/cddl"),
    ("cpl", r"common public", r"cpl-1\.0", r"opensource\.org/licenses?/cpl"),
    ("cpal", r"common public attribution", r"cpal-1\.0", r"opensource\.org/licenses?/cpal"),
    ("ms-pl", r"microsoft public", r"ms-pl", r"opensource\.org/licenses?/ms-pl"),
    ("ms-rl", r"microsoft reciprocal", r"ms-rl", r"opensource\.org/licenses?/ms-rl"),
    ("artistic", r"artistic", r"artistic-[12]\.0", r"opensource\.org/licenses?/artistic"),
    ("zlib", r"zlib(?:/libpng)?", r"zlib", r"opensource\.org/licenses?/zlib"),
    ("libpng", r"libpng", r"libpng(?:-2\.0)?", r"libpng\.org/pub/png/src/libpng-license"),
    ("boost", r"boost software", r"bsl-1\.0", r"boost\.org/license_1_0"),
    ("unlicense", r"(?:the )?unlicense", r"unlicense", r"unlicense\.org"),
    ("wtfpl", r"do what the f\S+ you want to public", r"wtfpl", r"wtfpl\.net"),
    ("eupl", r"european union public", r"eupl-1\.[012]", r"joinup\.ec\.europa\.eu/\S*eupl"),
    ("osl", r"open software", r"osl-[123]\.[01]", r"opensource\.org/licenses?/osl"),
    ("afl", r"academic free", r"afl-[123]\.[012]", r"opensource\.org/licenses?/afl"),
    ("ecl", r"educational community", r"ecl-[12]\.0", r"opensource\.org/licenses?/ecl"),
    ("upl", r"universal permissive", r"upl-1\.0", r"opensource\.org/licenses?/upl"),
    ("psf", r"python software foundation|psf", r"(?:psf-2\.0|python-2\.0)", r"docs\.python\.org/\S*license"),
    ("php", r"php", r"php-3\.0[1]?", r"php\.net/license"),
    ("ruby", r"ruby", r"ruby", r"ruby-lang\.org/\S*license"),
    ("openssl", r"openssl", r"openssl", r"openssl\.org/source/license"),
    ("ncsa", r"university of illinois(?:/ncsa)?(?: open source)?", r"ncsa", r"opensource\.org/licenses?/ncsa"),
    ("postgresql", r"postgresql", r"postgresql", r"postgresql\.org/about/licen[cs]e"),
    ("ofl", r"(?:sil )?open font", r"ofl-1\.[01]", r"scripts\.sil\.org/ofl"),
    ("odbl", r"open (?:data commons open )?database", r"odbl-1\.0", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by", r"open data commons attribution", r"odc-by-1\.0", r"opendatacommons\.org/licenses/by"),
    ("pddl", r"public domain dedication and", r"pddl-1\.0", r"opendatacommons\.org/licenses/pddl"),
    ("cecill", r"cecill(?:-[abc])?", r"cecill-(?:1\.[01]|2\.[01]|b|c)", r"cecill\.info"),
    ("mulan", r"mulan p(?:ermissive|ublic) software", r"mulanp(?:sl|ubl)-[12]\.0", r"license\.coscl\.org\.cn/mulan"),
    ("elastic", r"elastic", r"elastic-2\.0", r"elastic\.co/licensing"),
    ("sspl", r"server side public", r"sspl-1\.0", r"mongodb\.com/licensing/server-side"),
    ("bsl", r"business source", r"busl-1\.1", r"mariadb\.com/bsl"),
    ("bigscience", r"bigscience (?:openrail-m|rail)|(?:open)?rail(?:\+\+)?-m", r"bigscience-\S+", r"huggingface\.co/spaces/bigscience/license"),
    ("llama", r"llama [23](?:\.\d)? community", r"llama[23](?:\.\d)?", r"llama\.com/\S*license"),
    ("cc0", r"(?:creative commons )?cc0|creative commons zero", r"cc0-1\.0", r"creativecommons\.org/publicdomain/zero"),
    ("cc-by", r"creative commons attribution|cc by", r"cc-by-[1234]\.[05]", r"creativecommons\.org/licenses/by/"),
    ("cc-by-sa", r"creative commons attribution-share ?alike|cc by-sa", r"cc-by-sa-[1234]\.[05]", r"creativecommons\.org/licenses/by-sa/"),
    ("cc-by-nc", r"creative commons attribution-non ?commercial|cc by-nc", r"cc-by-nc-[1234]\.[05]", r"creativecommons\.org/licenses/by-nc/"),
    ("cc-by-nd", r"creative commons attribution-no ?derivatives|cc by-nd", r"cc-by-nd-[1234]\.[05]", r"creativecommons\.org/licenses/by-nd/"),
    ("cc-by-nc-sa", r"creative commons attribution-non ?commercial-share ?alike|cc by-nc-sa", r"cc-by-nc-sa-[1234]\.[05]", r"creativecommons\.org/licenses/by-nc-sa/"),
    ("cc-by-nc-nd", r"creative commons attribution-non ?commercial-no ?derivatives|cc by-nc-nd", r"cc-by-nc-nd-[1234]\.[05]", r"creativecommons\.org/licenses/by-nc-nd/"),
)

#: Single sentences of known texts: label, keyword, expression.
SENTENCES = (
    ("mit", "hereby granted, free of charge", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("isc", "with or without fee", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee"),
    ("bsd", "redistributions of source code", r"redistributions of source code must retain the above copyright"),
    ("bsd", "redistributions in binary form", r"redistributions in binary form must reproduce the above copyright"),
    ("zlib", "altered source versions", r"altered source versions must be plainly marked as such"),
    ("unlicense", "released into the public domain", r"this is free and unencumbered software released into the public domain"),
    ("public-domain", "public domain", r"(?:placed|dedicated|released) (?:in|to|into) the public domain"),
    ("all-rights-reserved", "all rights reserved", r"all rights reserved"),
    ("copyright", "copyright", r"copyright (?:\(c\) |© )?(?:19|20)\d\d"),
)

#: A text with none of these has no detection: each rule's expression implies one of them.
TRIGGERS = ("licen", "copyright", "rights reserved", "public domain", "permission", "redistributions", "source versions", "cecill.info", "wtfpl", "creativecommons.org", "scripts.sil.org", "opensource.org", "gnu.org", "mozilla.org", "eclipse.org", "eupl", "mariadb.com", "cc by", "cc-by", "cc0")

_LICENSED = r"licen[cs]ed under (?:the )?(?:terms of )?(?:the )?"
_GIVEN = r"(?:released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?"


#: What a family's names hold, where that isn't the names themselves.
NAME_KEYS = {
    "mit": "mit|expat", "apache": "apache", "gpl": "general public|gnu gpl", "lgpl": "general public", "agpl": "affero general", "gfdl": "free documentation", "bsd": "bsd",
    "zlib": "zlib", "unlicense": "unlicense", "wtfpl": "do what the f", "psf": "python software|psf", "ncsa": "university of illinois", "ofl": "open font", "odbl": "open",
    "cecill": "cecill", "mulan": "mulan p", "bigscience": "bigscience|rail", "llama": "llama", "cc0": "cc0|creative commons zero", "cc-by": "creative commons attribution|cc by",
    "cc-by-sa": "attribution-share|cc by-sa", "cc-by-nc": "attribution-non|cc by-nc", "cc-by-nd": "attribution-no|cc by-nd", "cc-by-nc-sa": "attribution-non|cc by-nc-sa", "cc-by-nc-nd": "attribution-non|cc by-nc-nd",
}

#: What a family's short identifiers hold, where they don't begin with plain text.
SHORT_KEYS = {"bsd": "bsd", "psf": "psf|python"}


def _rules() -> list[dict]:
    """Rules as label, priority, weight, keys (a text that the expression matches holds one of them) and pattern; the best priority first."""
    rules = []

    def add(label: str, priority: int, weight: float, keys: str, pattern: str) -> None:
        rules.append({"label": label, "priority": priority, "weight": weight, "keys": keys.split("|"), "pattern": pattern})

    for label, names, short, place in FAMILIES:
        name_keys = NAME_KEYS.get(label, names)
        short_keys = SHORT_KEYS.get(label) or re.match(r"[a-z0-9-]+", short)[0].rstrip("-")
        add(label, 1, 1.0, "license-identifier", rf"spdx-license-identifier:\s*\(?{short}\b")
        add(label, 2, 0.95, name_keys, rf"(?:{_LICENSED}(?:{names})(?: licen[cs]e)?|{_GIVEN}(?:{names}) licen[cs]e)\b(?:,? (?:version |v)?\d(?:\.\d)?)?")
        add(label, 3, 0.9, name_keys, rf"\b(?:{names})(?:[ -]| public | international )licen[cs]e\b(?:,? (?:version |v)\d(?:\.\d)?)?")
        add(label, 3, 0.85, short_keys, rf"\blicen[cs]e(?:[:=] ?| is )[\"']?{short}\b")
        add(label, 4, 0.8, re.match(r"(?:[a-z0-9-]|\\\.)+", place)[0].replace("\\", ""), rf"https?://(?:www\.)?{place}")
        add(label, 5, 0.6, short_keys, rf"\b{short}[ -]licen[cs]ed?\b")
        if label.startswith("cc"):
            add(label, 3, 0.85, "cc by|cc-by|cc0|cc 0", rf"\b{label.replace('-', '[ -]', 1)}(?: [1-4]\.[05])?\b(?!-)")
    for label, key, pattern in SENTENCES:
        add(label, 6 if label in ("copyright", "all-rights-reserved") else 2, 0.7, key, pattern)
    return sorted(rules, key=lambda r: r["priority"])


RULES = _rules()


def _places(text: Column, pattern: Column) -> Column:
    """All matches of a rule as ``array<struct<start, stop>>``, counted in characters from 0."""
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, pattern, -1)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("found"))
    return F.aggregate(
        F.sequence(F.lit(1), F.size(matches)),
        empty,
        lambda acc, i: F.struct(
            (acc["at"] + F.length(F.get(between, i - 1)) + F.length(F.get(matches, i - 1))).alias("at"),
            F.concat(
                acc["found"],
                F.array(
                    F.struct(
                        (acc["at"] + F.length(F.get(between, i - 1))).alias("start"),
                        (acc["at"] + F.length(F.get(between, i - 1)) + F.length(F.get(matches, i - 1))).alias("stop"),
                    )
                ),
            ).alias("found"),
        ),
        lambda acc: acc["found"],
    )


def detections(text: Column) -> Column:
    """Unsuppressed detections in a lower-cased text: ``array<struct<start, stop, priority, label, weight>>`` in order of place.

    Null and empty texts give an empty array; equal spans keep the better priority, then the first label.
    """
    kind = "array<struct<start:int,stop:int,priority:int,label:string,weight:double>>"
    rules = F.from_json(F.lit(json.dumps(RULES)), "array<struct<label:string,priority:int,weight:double,keys:array<string>,pattern:string>>")
    gated = F.filter(rules, lambda r: F.exists(r["keys"], lambda k: text.contains(k)) & F.regexp_like(text, r["pattern"]))
    all_found = F.flatten(
        F.transform(
            gated,
            lambda r: F.transform(
                _places(text, r["pattern"]),
                lambda p: F.struct(p["start"], (-p["stop"]).alias("neg_stop"), r["priority"].alias("priority"), r["label"].alias("label"), r["weight"].alias("weight")),
            ),
        )
    )
    start = F.struct(*[F.lit(-1).alias(f"p{p}") for p in range(1, 7)], F.array().cast(kind).alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        stop = -x["neg_stop"]
        covered = F.lit(False)
        for p in range(1, 7):
            covered = covered | ((x["priority"] >= p) & (acc[f"p{p}"] >= stop))
        item = F.struct(x["start"].alias("start"), stop.alias("stop"), x["priority"].alias("priority"), x["label"].alias("label"), x["weight"].alias("weight"))
        return F.struct(
            *[F.when(x["priority"] == p, F.greatest(acc[f"p{p}"], stop)).otherwise(acc[f"p{p}"]).alias(f"p{p}") for p in range(1, 7)],
            F.when(covered, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(item))).alias("kept"),
        )

    return F.aggregate(F.array_sort(all_found), start, step, lambda acc: acc["kept"])


def phrase_starts(words: Column, phrase: str) -> Column:
    """Indexes in ``words`` at which the phrase's words stand one after another."""
    parts = phrase.split()
    last = F.size(words) - len(parts)

    def here(i: Column) -> Column:
        same = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            same = same & (F.get(words, i + k) == part)
        return same

    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), here)).otherwise(F.array().cast("array<int>"))


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with what a scan of each whole text finds (columns of these names are replaced; repeated rows stay).

    ``n_words`` counts words; ``base`` is the array of ``struct<start, label>`` places of the base phrases; ``detections`` the array of
    unsuppressed spans. Null texts count as empty: no words, empty arrays. Other columns stay as they are, whatever their names; an empty table gives an empty one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    gate = F.lit(False)
    low = F.col("__low")
    for word in TRIGGERS:
        gate = gate | low.contains(word)
    base_kind = "array<struct<start:int,label:string>>"
    kind = "array<struct<start:int,stop:int,priority:int,label:string,weight:double>>"
    # a row's own columns are held in one, so that none of theirs meets a name that is used here
    held = docs.select(F.struct(*docs.columns).alias("__held"), text.alias("__text")).withColumn("__low", F.lower("__text")).withColumn("__gate", gate)
    held = held.withColumn("__exact", F.when(F.col("__gate"), ascii_lower(F.col("__text"))))
    held = held.withColumn("__words", F.when(low.contains("license"), F.regexp_extract_all("__exact", F.lit(WORD), F.lit(0))))
    words = F.col("__words")

    def places(phrase: str, label: str) -> Column:
        return F.transform(phrase_starts(words, phrase), lambda i: F.struct(i.alias("start"), F.lit(label).alias("label")))

    base = F.array_sort(F.flatten(F.array(*[places(phrase, label) for phrase, label in BASE])))
    results = held.withColumns(
        {
            "n_words": F.regexp_count("__text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long"),
            "base": F.when(low.contains("license"), base).otherwise(F.array().cast(base_kind)),
            "detections": F.when(F.col("__gate"), detections(F.col("__exact"))).otherwise(F.array().cast(kind)),
        }
    )
    made = ["n_words", "base", "detections"]
    return results.select(*[F.col("__held")[c].alias(c) for c in docs.columns if c not in made], *made)


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    """Every document's base phrases and license labels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_licenses(docs).select("doc_id", "n_words", "base", "detections")
    starts, base_labels = F.col("base.start"), F.array_sort(F.array_distinct(F.col("base.label")))
    labels = F.array_sort(F.array_union(F.col("base.label"), F.col("detections.label")))
    score = F.greatest(F.coalesce(F.array_max("detections.weight"), F.lit(0.0)), F.when(F.size("base") > 0, 0.9).otherwise(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        score.alias("score"),
    )
