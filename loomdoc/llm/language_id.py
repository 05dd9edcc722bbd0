"""Language identification by prediction by partial matching.

For each language a byte context tree of up to three bytes of its own is counted on a bounded sample of its documents; it holds every context that these have. Frozen, it gives every next byte an exact
code length: seen symbols of the longest context by their counts, unseen ones by the escape probability (distinct symbols over counts and
distinct symbols) times the next shorter context without the symbols already excluded. A text's language has the shortest code.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdoc.llm.byte_contexts import CHUNK_BYTES, Tables, count_grams
from loomdoc.llm.common import byte_batches, giving_back

#: Documents of each language that its tree is fitted on, about (taken by hash of the id). Every language is learned.
SAMPLE_DOCS = 400

_NO_LETTERS = re.compile(rb"[^a-z\x80-\xff]+")

#: Symbols: space, a-z, and each byte from 128 up.
SYMBOLS = 155
CLASSES = np.zeros(256, np.uint8)
CLASSES[97:123] = np.arange(1, 27)
CLASSES[128:] = np.arange(27, 155)


def prepare(text: str) -> bytes:
    """Lower-cased UTF-8 in which every run of ASCII that isn't letters is one space."""
    return _NO_LETTERS.sub(b" ", text.lower().encode("utf-8", "surrogatepass"))


def prepared(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Prepared bytes of a string column and the texts' offsets in them; null is empty."""
    ready = [prepare(t) if t else b"" for t in column.to_pylist()]
    return np.frombuffer(b"".join(ready), np.uint8), np.r_[0, np.cumsum([len(r) for r in ready], dtype=np.int64)]


def _tree(grams: np.ndarray, counts: np.ndarray, contexts: list[np.ndarray]) -> list[np.ndarray]:
    """Probabilities in the given contexts of 0 to 3 symbols: for each length an array (contexts x symbols), unseen contexts as their suffix."""
    parent = np.full((1, SYMBOLS), 1 / SYMBOLS)
    out = []
    for k, wanted in enumerate(contexts):
        part = grams % SYMBOLS ** (k + 1)
        table = np.zeros((len(wanted), SYMBOLS))
        at = np.searchsorted(wanted, part // SYMBOLS)
        inside = (at < len(wanted)) & (wanted[np.minimum(at, len(wanted) - 1)] == part // SYMBOLS)
        np.add.at(table, (at[inside], (part % SYMBOLS)[inside]), counts[inside])
        below = parent if k == 0 else parent[np.searchsorted(contexts[k - 1], wanted % SYMBOLS ** (k - 1))]
        seen = table > 0
        total, distinct = table.sum(1, keepdims=True), seen.sum(1, keepdims=True)
        left = np.where(seen, 0, below)
        rest = left.sum(1, keepdims=True)
        escape = np.where(rest > 0, distinct / np.maximum(total + distinct, 1), 0)
        own = np.where(rest > 0, table / np.maximum(total + distinct, 1), table / np.maximum(total, 1))
        parent = np.where(total > 0, own + escape * left / np.maximum(rest, 1e-300), below)
        out.append(parent)
    return out


def freeze(grams: dict[str, tuple[np.ndarray, np.ndarray]]) -> Tables:
    """Each language's tree over its own contexts; languages in order of their names."""
    models = {}
    for lang in sorted(grams):
        codes, counts = grams[lang]
        three = np.unique(codes // SYMBOLS)
        two = np.unique(np.r_[three % SYMBOLS**2, codes % SYMBOLS**3 // SYMBOLS])
        tree = _tree(codes, counts, [np.zeros(1, np.int64), np.arange(SYMBOLS), two, three])
        models[lang] = two, three, -np.log2(np.maximum(np.concatenate(tree[1:]), 1e-12)).astype(np.float32)
    return Tables(CLASSES, SYMBOLS, models)


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Tables | None:
    """Trees of all languages in ``docs (doc_id, text, lang)``; None where nothing is labelled.

    The sample is by hash of ``doc_id``, about ``sample_docs`` documents of each language: whole texts, and all that a language has if it has no more. Rows with an equal
    or null id are drawn together. A language whose texts are all empty is not learned.
    """
    byte_batches(docs.sparkSession)
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = labelled.groupBy("lang").count().collect()  # one row for each language
    if not sizes:
        return None
    most = F.create_map(*[F.lit(x) for row in sizes for x in (row["lang"], int(1e6 * min(1, sample_docs / row["count"])) + 1)])
    draw = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1_000_000))
    counted = labelled.where(draw < most[F.col("lang")]).select("lang", "text").mapInArrow(giving_back(count_grams(CLASSES, SYMBOLS, prepared)), "lang string, gram long, n long")
    table = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = table.column(0).combine_chunks().dictionary_encode()
    own, gram, n = langs.indices.to_numpy(), table.column(1).to_numpy(), table.column(2).to_numpy()
    by = np.lexsort((gram, own))
    cuts = np.searchsorted(own[by], np.arange(len(langs.dictionary) + 1))
    grams = {lang: (gram[by[lo:hi]], n[by[lo:hi]]) for lang, lo, hi in zip(langs.dictionary.to_pylist(), cuts, cuts[1:], strict=False)}
    return freeze(grams) if grams else None


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column(batch.num_columns - 1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends, at = np.cumsum(sizes), 0
            while at < max(1, batch.num_rows):
                end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK_BYTES, "right")))
                part = batch.slice(at, end - at)
                at = end
                texts = part.column(part.num_columns - 1)
                data, offsets = prepared(texts)
                letters = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts.to_pylist()], bool)
                bits = model.bits(data, offsets)
                best, low = bits.argmin(1), bits.min(1)
                share = 1 / np.exp2(-np.minimum(bits - low[:, None], 1000)).sum(1)
                found = [model.names[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(found, pa.string()), pa.array(np.where(letters, share, 0.0)), pa.array(low / np.maximum(np.diff(offsets), 1))],
                    [*[f"c{i}" for i in range(part.num_columns - 1)], "lang_pred", "score", "bits_per_byte"],
                )

    return run


def identify(docs: DataFrame, model: Tables | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``lang_pred``, ``score`` (share of the best code among all, 0 to 1), ``bits_per_byte``.

    One pass over whole texts without a shuffle. Null texts and texts without a letter are ``und`` with score 0, as all texts are without a model; of equal codes the first language by name wins.
    ``keep`` may name the text. A kept column that has the name of one of the three results gives way to it. Repeated rows give repeated results, an empty table an empty one.
    """
    keep = tuple(c for c in keep if c not in ("lang_pred", "score", "bits_per_byte"))
    if model is None:
        return docs.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits_per_byte"))
    byte_batches(docs.sparkSession)
    kinds = dict(docs.dtypes)
    schema = ", ".join([*[f"c{i} {kinds[c]}" for i, c in enumerate(keep)], "lang_pred string, score double, bits_per_byte double"])
    found = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col(text_col).alias("__text")).mapInArrow(giving_back(_predict(model.shared(docs.sparkSession))), schema)
    return found.withColumnsRenamed({f"c{i}": c for i, c in enumerate(keep)})


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    """Every document's predicted language; a third of the ids is held out from learning."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = fit(docs.where(~held))
    return identify(docs, model).withColumn("held_out", held)
