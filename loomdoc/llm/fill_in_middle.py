"""Fill-in-middle rows: a text is cut at two code points and its three parts are put into a training order.

Cuts are given in code points, texts are held in UTF-8. Instead of a table of all code points, a text is held as the maximal runs
of code points of one class (how many bytes each takes), with the units and bytes before each run. A cut's run is found by binary
search, and its byte by arithmetic: ``run's byte + (cut - run's unit) * class``. A batch of texts is one such table; an ASCII text is one run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdoc.llm.common import byte_batches, giving_back

#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Bytes that are classified at a time, so that memory beside the text stays the same for any length.
BLOCK = 1 << 21


def class_runs(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of code points of one UTF-8 width in ``data`` (bytes of texts, one after the other, each from its place in ``starts``).

    Returns the units before each run, its first byte and its width, each closed by an entry for the end, and the units before each text.
    No run crosses from a text into the next.
    """
    units, firsts, widths = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    before, text_units = 0, np.zeros(len(starts), np.int64)
    last = 0
    for at in range(0, len(data), BLOCK):
        block = data[at : at + BLOCK]
        lead = np.flatnonzero((block & 0xC0) != 0x80)
        head = block[lead]
        width = 1 + (head >= 0xC0) + (head >= 0xE0).astype(np.int64) + (head >= 0xF0)
        a, b = np.searchsorted(starts, (at, at + len(block)))
        own = np.searchsorted(lead, starts[a:b] - at)
        text_units[a:b] = before + own
        opens = np.empty(len(lead), bool)
        opens[1:] = width[1:] != width[:-1]
        if len(lead):
            opens[0] = width[0] != last
            opens[own[own < len(lead)]] = True
            last = width[-1]
        found = np.flatnonzero(opens)
        units.append(before + found)
        firsts.append(at + lead[found])
        widths.append(width[found])
        before += len(lead)
    text_units[np.searchsorted(starts, len(data)) :] = before
    end = (np.array([before]), np.array([len(data)]), np.array([1]))
    return tuple(np.concatenate([*parts, x]) for parts, x in zip((units, firsts, widths), end, strict=True)) + (text_units,)


def cut_bytes(runs: tuple, at: np.ndarray) -> np.ndarray:
    """The bytes before each of the given units, counted through all texts of the table."""
    units, firsts, widths, _ = runs
    run = np.searchsorted(units, at, side="right") - 1
    return firsts[run] + (at - units[run]) * widths[run]


def _draws(seed: str, key: int | None) -> tuple[int, ...]:
    """The first four 32-bit numbers of a document's hash; a null id has no digits."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def _transform(seed: str, fim_percent: int, spm_percent: int):
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            texts = [x.as_buffer() if x.is_valid else b"" for x in batch.column(1)]
            data = np.frombuffer(b"".join(texts), np.uint8)
            ends = np.cumsum([len(x) for x in texts])
            starts = ends - [len(x) for x in texts]
            runs = class_runs(data, starts)
            first = runs[3]
            n = np.append(first[1:], runs[0][-1]) - first
            draws = [_draws(seed, k) for k in keys]
            cuts = np.array([sorted((h[0] % (int(k) + 1), h[1] % (int(k) + 1))) for h, k in zip(draws, n, strict=True)]).reshape(-1, 2)
            a, b = cut_bytes(runs, first + cuts[:, 0]), cut_bytes(runs, first + cuts[:, 1])
            forms, outputs, prefixes, middles = [], [], [], []
            for i, h in enumerate(draws):
                text = bytes(texts[i])
                x, y = int(a[i] - starts[i]), int(b[i] - starts[i])
                if not text or p in text or s in text or m in text or h[2] % 100 >= fim_percent:
                    form, out = "plain", text
                elif h[3] % 100 < spm_percent:
                    form, out = "spm", b"".join((s, text[y:], p, text[:x], m, text[x:y]))
                else:
                    form, out = "psm", b"".join((p, text[:x], s, text[y:], m, text[x:y]))
                forms.append(form)
                outputs.append(out)
                plain = form == "plain"
                prefixes.append(None if plain else int(cuts[i, 0]))
                middles.append(None if plain else int(cuts[i, 1] - cuts[i, 0]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(forms), pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()), pa.array(outputs, pa.string())],
                ["key", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return giving_back(task)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", fim_percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """``id_col``, ``n`` (code points), ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` and ``output`` of every row of ``docs``; other columns, whatever their names, are left out.

    The draws of a document follow from ``seed`` and its id alone, so a row's result is the same in any run and partition, and rows with
    one id and one text (repeats) give equal rows. Null texts count as empty, empty texts and texts that hold a mark stay plain. A null id draws as an id
    without digits. Cuts may fall on the same place or on the text's ends; the parts are then empty. An empty table gives an empty one. Texts may be of any length.
    """
    byte_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("binary").alias("text"))
    found = rows.mapInArrow(_transform(seed, fim_percent, spm_percent), "key long, n long, form string, prefix_chars long, middle_chars long, output string")
    return found.withColumnRenamed("key", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text again, from the output and its form alone: the marks of an output that isn't plain are the only ones in it."""
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """Every document's fill-in-middle row, as digests of the output and of the text rebuilt from it."""
    found = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def oracle_sql() -> str:
    """The same rows in DuckDB."""
    return """
    WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
    d AS (SELECT *, ('0x' || substr(x, 1, 8))::BIGINT % (n + 1) AS c1, ('0x' || substr(x, 9, 8))::BIGINT % (n + 1) AS c2, ('0x' || substr(x, 17, 8))::BIGINT % 100 AS r3, ('0x' || substr(x, 25, 8))::BIGINT % 100 AS r4 FROM h),
    c AS (SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r3 >= 90 THEN 'plain' WHEN r4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
    p AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM c)
    SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
        sha256(CASE form WHEN 'plain' THEN t ELSE pre || mid || suf END) AS restored_sha256
    FROM p
    """
