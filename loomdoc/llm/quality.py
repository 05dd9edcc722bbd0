"""Quality classifier: an interpolated modified Kneser-Ney model of byte 4-grams, trained on trusted text.

Counts of all trusted text are combined in the tasks and sharded by language and context; the discounts, context masses and lower-order continuation
counts are joined shard by shard to interpolated probabilities, one set for each language and a pooled one. Every place of every text is scored exactly, in one way at every size: places leave the task as counts of
grams for each document and are joined with the sharded probabilities, back off by back off, and summed. Contexts as frequent as spaces would be hot keys there, so the rows of those that make up ``HEAD_SHARE`` of a language's trusted text
are a head that tasks hold, and whose places are summed before rows leave; its size has a bound, beyond which it covers less. The head changes the work alone, not a result. A document is kept if its perplexity is within its
language's bar, which is set by quantiles over the trusted documents of that language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomdoc.llm.byte_contexts import Tables, count_grams, places, raw_texts, text_sums
from loomdoc.llm.common import byte_batches, give_back, giving_back, written

#: The part of each language's trusted places whose contexts, the most frequent ones, are in the head, and the head's numbers at most (32 MB before compression).
HEAD_SHARE, HEAD_CELLS = 0.99, 4_000_000

#: Symbols: letters by case, one for digits, space, newline, each punctuation, one for other control bytes, each byte from 128 up.
CLASSES = np.zeros(256, np.uint8)
for _i, _byte in enumerate([32, 10, *[b for b in range(33, 127) if not 48 <= b <= 57], *range(128, 256)]):
    CLASSES[_byte] = _i + 2
CLASSES[48:58] = 1
SYMBOLS = int(CLASSES.max()) + 1

#: Trusted documents that a language needs for a model and a bar of its own; documents of other languages, or of none, use those of all trusted text.
LEAST_DOCS, POOLED = 20, ""

#: The bar: the upper quantile of a language's log perplexity plus so many times its distance from the median.
UPPER, SPREAD = 0.9, 2.0

#: Trusted ids that are broadcast at most (16 bytes each); more go through a shuffled join.
BROADCAST_IDS = 2_000_000


def _sorted(df: DataFrame) -> DataFrame:
    """A side of a join that is sorted, however small it is: each of a model's many joins would otherwise be built up in the driver on small tables, which takes more of its memory than large ones do."""
    return df.hint("merge")


def trusted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id some label calls of quality 1 and none calls toxic or of quality 0."""
    good = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).where("q = 1 AND t = 0")
    ids = written(good.select("doc_id"), "trusted")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def kneser_ney(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Interpolated probabilities and context weights from 4-gram counts ``(lang, gram, n)``.

    Returns ``(lang, k, gram, p, gamma)`` for all seen grams of k symbols and ``(lang, k, context, gamma, mass)`` for their contexts. Orders below four use continuation
    counts; each order has three discounts for each language, from its counts of counts. All orders go through one pass, as each exchange of a plan costs the driver memory; a context has at most ``SYMBOLS`` rows.
    """
    n_of, levels = {4: counts}, {}
    for k in (3, 2, 1):
        n_of[k] = n_of[k + 1].groupBy("lang", (F.col("gram") % SYMBOLS**k).alias("gram")).agg(F.count("*").alias("n"))
    own = reduce(DataFrame.union, [n.select("lang", F.lit(k).alias("k"), "gram", F.floor(F.col("gram") / SYMBOLS).alias("context"), "n") for k, n in n_of.items()])
    own = written(own, "kn-counts")
    many = own.groupBy("lang", "k").agg(*[F.sum((F.col("n") == i).cast("double")).alias(f"n{i}") for i in (1, 2, 3, 4)])
    y = F.coalesce(F.col("n1") / F.nullif(F.col("n1") + 2 * F.col("n2"), F.lit(0.0)), F.lit(0.5))
    d = [F.least(F.lit(i - 0.05), F.greatest(F.lit(0.05), F.coalesce(i - (i + 1) * y * F.col(f"n{i + 1}") / F.nullif(F.col(f"n{i}"), F.lit(0.0)), F.lit(0.5 * i)))) for i in (1, 2, 3)]
    discounts = F.broadcast(many.select("lang", "k", *[x.alias(f"d{i + 1}") for i, x in enumerate(d)]))  # four rows for each language
    discount = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    alike = Window.partitionBy("lang", "k", "context")
    cut = own.join(discounts, ["lang", "k"]).withColumn("cut", discount).withColumns({"mass": F.sum("n").over(alike), "freed": F.sum("cut").over(alike)})
    cut = written(cut.select("lang", "k", "gram", "context", ((F.col("n") - F.col("cut")) / F.col("mass")).alias("kept"), (F.col("freed") / F.col("mass")).alias("gamma"), "mass"), "kn-cut")
    for k in (1, 2, 3, 4):
        order = cut.where(F.col("k") == k)
        if k == 1:
            joined = order.withColumn("p0", F.lit(1 / SYMBOLS))
        else:
            suffix = levels[k - 1].select("lang", F.col("gram").alias("suffix"), F.col("p").alias("p0"))
            joined = order.withColumn("suffix", F.col("gram") % SYMBOLS ** (k - 1)).join(_sorted(suffix), ["lang", "suffix"])
        levels[k] = joined.select("lang", "k", "gram", (F.col("kept") + F.col("gamma") * F.col("p0")).alias("p"), "gamma")
        if k > 1:
            levels[k] = written(levels[k], f"kn{k}")
    every = levels[1].union(levels[2]).union(levels[3]).union(levels[4])
    return every, written(cut.groupBy("lang", "k", "context").agg(F.first("gamma").alias("gamma"), F.max("mass").alias("mass")), "kn-contexts")


def freeze(grams: DataFrame, contexts: DataFrame, langs: list[str], cells: int = HEAD_CELLS, share: float = HEAD_SHARE) -> Tables:
    """The head: of each model the rows of the contexts of three symbols that stand most often, whole frequency classes at a time until they make up ``share`` of its places; the rarest classes of all models go while there is no room.

    A row has a column for each symbol that the model has seen and one for all others.
    """
    seen: dict[str, list[int]] = {}
    for row in grams.where("k = 1").select("lang", "gram").collect():  # at most SYMBOLS for each language
        seen.setdefault(row["lang"], []).append(row["gram"])
    columns = {lang: np.full(SYMBOLS, len(own)) for lang, own in seen.items()}
    for lang, own in seen.items():
        columns[lang][sorted(own)] = np.arange(len(own))
    ranked = contexts.where("k = 4").select("lang", "context", F.col("mass").alias("n"), F.floor(F.log2("mass") * 4).cast("int").alias("f"))
    classes = ranked.groupBy("f", "lang").agg(F.count("*").alias("contexts"), F.sum("n").alias("places")).collect()  # at most four rows for each power of two and language
    total: dict[str, int] = {}
    for row in classes:
        total[row["lang"]] = total.get(row["lang"], 0) + row["places"]
    inside, reached = [], dict.fromkeys(total, 0)
    for row in sorted(classes, key=lambda r: (-r["f"], r["lang"])):
        if reached[row["lang"]] < share * total[row["lang"]]:
            reached[row["lang"]] += row["places"]
            inside.append((row["f"], row["lang"], row["contexts"] * (int(columns[row["lang"]].max()) + 1)))
    while sum(size for _, _, size in inside) > cells:
        rarest = inside[-1][0]
        inside = [x for x in inside if x[0] > rarest]
    least: dict[str, int] = {}
    for f, lang, _ in inside:
        least[lang] = min(f, least.get(lang, f))
    enough = reduce(lambda rest, m: F.when(F.col("lang") == m[0], F.lit(m[1])).otherwise(rest), least.items(), F.lit(1 << 30))
    held = [F.struct(F.lit(k).alias("k"), (F.col("context") % SYMBOLS ** (k - 1)).alias("context")) for k in (4, 3, 2, 1)]
    kept = written(ranked.where(F.col("f") >= enough).select("lang", F.explode(F.array(*held)).alias("x")).select("lang", "x.k", "x.context").distinct(), "head")
    rows = grams.withColumn("context", F.floor(F.col("gram") / SYMBOLS)).join(_sorted(kept), ["lang", "k", "context"], "left_semi").select("lang", "k", "gram", "p", "gamma").toArrow()
    models = {}
    for lang in langs:
        r = rows.filter(pa.compute.equal(rows.column("lang"), lang))
        r_k, r_gram, r_p, r_gamma = (r.column(c).to_numpy() for c in ("k", "gram", "p", "gamma"))
        place = columns[lang]
        width = int(place.max()) + 1
        parent, before = np.full((1, width), 1 / SYMBOLS), np.zeros(1, np.int64)
        for k in (1, 2, 3, 4):
            gram = r_gram[r_k == k]
            wanted, of = np.unique(gram // SYMBOLS, return_index=True)  # every context of the head has been seen before some symbol
            below = parent if k == 1 else parent[np.searchsorted(before, wanted % SYMBOLS ** (k - 2))]
            parent = (below if len(wanted) else np.zeros((0, width))) * r_gamma[r_k == k][of][:, None]
            parent[np.searchsorted(wanted, gram // SYMBOLS), place[gram % SYMBOLS]] = r_p[r_k == k]
            before = wanted
        models[lang] = np.zeros(0, np.int64), before, -np.log2(np.concatenate([np.ones((SYMBOLS, width)), parent]))
    del rows, r
    give_back()
    return Tables(CLASSES, SYMBOLS, models, columns)


def _scorer(shared, n_keep: int, text: int):
    """Rows (kept columns, row, model, n_symbols, bits in the head, n: grams outside it), and rows (row, model, gram, n) for these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = shared.value
        number = {lang: i for i, lang in enumerate(head.names)}
        names = [*[f"c{i}" for i in range(n_keep)], "row", "model", "n_symbols", "bits", "gram", "n"]
        for batch in batches:
            row, lang = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            named = lang.fill_null(POOLED).dictionary_encode()
            which = np.array([number.get(x, number[POOLED]) for x in named.dictionary.to_pylist()], np.int64)
            which = which[named.indices.to_numpy(zero_copy_only=False)] if len(named) else which[:0]
            data, offsets = raw_texts(batch.column(text))
            bits, sizes, outside = np.zeros(len(which)), np.diff(offsets), np.zeros(len(which), np.int64)
            away = []
            for at, end, context, symbol, part in places(CLASSES, SYMBOLS, data, offsets):
                owner = np.repeat(np.arange(at, end), part)
                value = np.zeros(len(context))
                for k in np.unique(which[at:end]):
                    own = which[owner] == k
                    if not own.any():
                        continue
                    found = head.model(int(k))[0].of(context[own])
                    inside = found >= 0
                    value[np.flatnonzero(own)[inside]] = head.lengths(int(k), found[inside], symbol[own][inside])
                    if not inside.all():
                        out = np.flatnonzero(own)[~inside]
                        codes, counts = np.unique((owner[out] - at).astype(np.int64) * SYMBOLS**4 + context[out].astype(np.int64) * SYMBOLS + symbol[out], return_counts=True)
                        away.append((codes // SYMBOLS**4 + at, codes % SYMBOLS**4, counts))
                        np.add.at(outside, away[-1][0], 1)
                bits[at:end] += text_sums(value, part)
            models = pa.DictionaryArray.from_arrays(pa.array(which, pa.int32()), pa.array(head.names, pa.string())).cast(pa.string())
            nulls = pa.nulls(len(which), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], row, models, pa.array(sizes.astype(np.int64)), pa.array(bits), nulls, pa.array(outside)], names)
            for at in range(0, len(away), 8):
                owner, gram, count = (np.concatenate(x) for x in zip(*away[at : at + 8], strict=True))
                empty = [pa.nulls(len(owner), batch.column(i).type) for i in range(n_keep)]
                take = pa.array(owner)
                yield pa.RecordBatch.from_arrays([*empty, row.take(take), models.take(take), pa.nulls(len(owner), pa.int64()), pa.nulls(len(owner), pa.float64()), pa.array(gram), pa.array(count.astype(np.int64))], names)

    return run


class QualityModel:
    """The sharded probabilities ``grams (lang, k, gram, p)`` and ``contexts (lang, k, context, gamma)``, the head, each model's bar of log2 perplexity."""

    def __init__(self, grams: DataFrame, contexts: DataFrame, head: Tables, bars: dict[str, float]):
        self.grams, self.contexts, self.head, self.bars = grams, contexts, head, bars


def gram_bits(wanted: DataFrame, grams: DataFrame, contexts: DataFrame) -> DataFrame:
    """``(model, gram, each)`` of distinct ``wanted (model, gram)``: the code length, interpolated or backed off through the orders; all orders are looked up in one join. Bounded by the grams that a model can tell apart."""
    keys = [(k, F.col("gram") % SYMBOLS**k) for k in (1, 2, 3, 4)] + [(-k, F.floor(F.col("gram") / SYMBOLS) % SYMBOLS ** (k - 1)) for k in (1, 2, 3, 4)]
    parts = wanted.select("model", "gram", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), code.alias("code")) for k, code in keys])).alias("x")).select("model", "gram", "x.kind", "x.code")
    known = grams.select(F.col("lang").alias("model"), F.col("k").alias("kind"), F.col("gram").alias("code"), F.col("p").alias("value"))
    known = known.union(contexts.select("lang", -F.col("k"), "context", "gamma"))
    found = parts.join(_sorted(known), ["model", "kind", "code"], "left").groupBy("model", "gram").agg(*[F.max(F.when(F.col("kind") == k, F.col("value"))).alias(f"{'p' if k > 0 else 'g'}{abs(k)}") for k, _ in keys])
    p = F.lit(1 / SYMBOLS)
    for k in (1, 2, 3, 4):
        p = F.coalesce(F.col(f"p{k}"), F.coalesce(F.col(f"g{k}"), F.lit(1.0)) * p)
    return found.select("model", "gram", (-F.log2(p)).alias("each"))


def score(docs: DataFrame, grams: DataFrame, contexts: DataFrame, head: Tables, keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep``, ``model``, ``n_symbols`` and ``bits`` (a symbol) of every row of ``docs``."""
    byte_batches(docs.sparkSession)
    kinds = dict(docs.dtypes)
    columns = [*keep, *(["text"] if "text" not in keep else [])]
    schema = ", ".join([*[f"c{i} {kinds[c]}" for i, c in enumerate(keep)], "row long, model string, n_symbols long, bits double, gram long, n long"])
    chosen = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)], F.monotonically_increasing_id().alias("__row"), F.col("lang").alias("__lang"))
    passed = chosen.mapInArrow(giving_back(_scorer(head.shared(docs.sparkSession), len(keep), columns.index("text"))), schema)
    mean = lambda total: F.when(F.col("n_symbols") > 0, total / F.col("n_symbols")).otherwise(0.0).alias("bits")
    kept = [F.col(f"c{i}").alias(c) for i, c in enumerate(keep)]
    passed = written(passed, "scored")
    away = passed.where("gram IS NOT NULL").select("row", "model", "gram", "n")
    each = written(gram_bits(away.select("model", "gram").distinct(), grams, contexts), "gram-bits")
    more = written(away.join(_sorted(each), ["model", "gram"]).groupBy("row").agg(F.sum(F.col("n") * F.col("each")).alias("more")), "more")
    rows = passed.where("gram IS NULL")
    # rows with nothing outside the head aren't shuffled
    joined = rows.where("n > 0").join(_sorted(more), "row").select(*kept, "model", "n_symbols", mean(F.col("bits") + F.col("more")))
    return rows.where("n = 0").select(*kept, "model", "n_symbols", mean(F.col("bits"))).union(joined)


def fit(docs: DataFrame, labels: DataFrame, cells: int = HEAD_CELLS, share: float = HEAD_SHARE) -> QualityModel | None:
    """A model of the trusted part of ``docs (doc_id, text, lang)``; None where no text is trusted.

    Each language of at least LEAST_DOCS trusted documents has a model and a bar; one of all trusted text serves the others. A repeated document counts as often as it stands.
    """
    byte_batches(docs.sparkSession)
    good = trusted(docs.select("doc_id", "text", "lang").where("text IS NOT NULL AND text <> ''"), labels)
    sizes = good.where("lang IS NOT NULL AND lang <> ''").groupBy("lang").count().where(F.col("count") >= LEAST_DOCS).collect()  # one row for each language
    langs = sorted(row["lang"] for row in sizes) + [POOLED]
    counted = good.select(F.coalesce("lang", F.lit(POOLED)).alias("lang"), "text").mapInArrow(giving_back(count_grams(CLASSES, SYMBOLS, raw_texts)), "lang string, gram long, n long")
    by_lang = written(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    if not by_lang.take(1):
        return None
    pooled = by_lang.groupBy("gram").agg(F.sum("n").alias("n")).select(F.lit(POOLED).alias("lang"), "gram", "n")
    counts = written(by_lang.where(F.col("lang").isin(langs[:-1])).union(pooled), "counts")
    grams, contexts = kneser_ney(counts)
    head = freeze(grams, contexts, langs, cells, share)
    scored = written(score(good, grams, contexts, head, ()), "trusted-scores")
    quantiles = F.percentile_approx("bits", F.array(F.lit(0.5), F.lit(UPPER)), 10_000)
    bars = {row["model"]: row["q"] for row in scored.select("model", "bits").rollup("model").agg(quantiles.alias("q")).collect()}
    bars[POOLED] = bars.pop(None)  # of all
    return QualityModel(grams, contexts, head, {m: q[1] + SPREAD * max(q[1] - q[0], 0.05) for m, q in bars.items()})


def classify(docs: DataFrame, model: QualityModel | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``model`` (the language scored by, empty for the pooled one), ``n_symbols``, ``perplexity``, ``bar``, ``kept``.

    Null and empty texts have perplexity 1 and aren't kept. Without a model (nothing trusted) all texts that aren't empty are kept, with null perplexities. A kept column that has the name of
    one of the five results gives way to it. A text at its bar is kept. Repeated rows and equal ids are scored row by row; an empty table gives an empty one. What lies outside the
    head is written to the shared folder and joined by row.
    """
    keep = tuple(c for c in keep if c not in ("model", "n_symbols", "perplexity", "bar", "kept"))
    if model is None:
        null = F.lit(None).cast("double")
        return docs.select(*keep, F.lit(POOLED).alias("model"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_symbols"), null.alias("perplexity"), null.alias("bar"), F.coalesce(F.col("text") != "", F.lit(False)).alias("kept"))
    scored = score(docs, model.grams, model.contexts, model.head, keep)
    bar = reduce(lambda rest, m: F.when(F.col("model") == m[0], F.lit(m[1])).otherwise(rest), model.bars.items(), F.lit(model.bars[POOLED]))
    # a short text's mean wavers, so its bar is higher by the square root of its length
    slack = bar + F.lit(3.0) / F.sqrt(F.greatest(F.col("n_symbols"), F.lit(1)))
    return scored.select(*keep, "model", "n_symbols", F.pow(F.lit(2.0), "bits").alias("perplexity"), F.pow(F.lit(2.0), slack).alias("bar"), ((F.col("n_symbols") > 0) & (F.col("bits") <= slack)).alias("kept"))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    """Every document's perplexity under its language's model and whether it is kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return classify(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), ("doc_id", "lang"))
