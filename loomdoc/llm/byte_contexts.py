"""What the byte-context models share: symbol classes, counts of 4-grams in tasks, places of whole texts, tables of contexts."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Symbols looked at together: a context of three and the next.
ORDER = 4

#: Bytes of text taken at once.
CHUNK_BYTES = 500_000

#: Indexes of languages that a worker keeps at a time; others are built again.
INDEXES = 4

Texts = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def raw_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the texts' offsets in them; null is empty."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    whole = column.fill_null("").cast(pa.large_binary())
    spots = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = whole.buffers()[2]
    data = np.frombuffer(data, np.uint8)[spots[0] : spots[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, spots - spots[0]


def places(classes: np.ndarray, size: int, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks (first text, end, code of the three symbols before, symbol, places of each text): every byte of every text is a place. Texts begin after three spaces; a long text comes in several chunks."""
    at, count = 0, len(offsets) - 1
    while at < count:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        lo, hi = int(offsets[at]), int(offsets[end])
        if hi - lo > 2 * CHUNK_BYTES:
            for start in range(lo, hi, CHUNK_BYTES):
                before = data[max(lo, start - 3) : start]
                bytes_ = np.r_[np.full(3 - len(before), 32, np.uint8), before, data[start : min(hi, start + CHUNK_BYTES)]]
                symbols = classes[bytes_].astype(np.int32)
                yield at, end, (symbols[:-3] * size + symbols[1:-2]) * size + symbols[2:-1], symbols[3:], np.array([len(symbols) - 3])
        elif hi > lo:
            sizes = np.diff(offsets[at : end + 1])
            inside = np.ones(hi - lo + 3 * len(sizes), bool)
            starts = np.cumsum(sizes + 3) - (sizes + 3)
            for k in range(3):
                inside[starts + k] = False
            padded = np.full(len(inside), 32, np.uint8)
            padded[inside] = data[lo:hi]
            symbols = classes[padded].astype(np.int32)
            keep = inside[3:]
            yield at, end, ((symbols[:-3] * size + symbols[1:-2]) * size + symbols[2:-1])[keep], symbols[3:][keep], sizes
        at = end


def text_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of the values of each text, in double precision."""
    out = np.zeros(len(sizes))
    full = sizes > 0
    if len(values):
        out[full] = np.add.reduceat(values.astype(np.float64), (np.cumsum(sizes) - sizes)[full])
    return out


def count_grams(classes: np.ndarray, size: int, texts: Texts) -> Callable:
    """A mapInArrow function from (lang, text) to (lang, gram, n), combined for each batch. Grams never reach over two texts, so counts don't depend on the batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = batch.column(0).dictionary_encode()
            names, own = named.dictionary.to_pylist(), named.indices.to_numpy(zero_copy_only=False)
            data, offsets = texts(batch.column(1))
            held_codes, held_counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for at, end, context, symbol, sizes in places(classes, size, data, offsets):
                codes, counts = np.unique((np.repeat(own[at:end].astype(np.int64), sizes) * size**3 + context) * size + symbol, return_counts=True)
                held_codes, back = np.unique(np.r_[held_codes, codes], return_inverse=True)
                held_counts = np.bincount(back, np.r_[held_counts, counts], len(held_codes)).astype(np.int64)
            if len(held_codes):
                lang = pa.DictionaryArray.from_arrays(pa.array(held_codes // size**ORDER, pa.int32()), pa.array(names, pa.string())).cast(pa.string())
                yield pa.RecordBatch.from_arrays([lang, pa.array(held_codes % size**ORDER), pa.array(held_counts)], ["lang", "gram", "n"])

    return run


class Rows:
    """Rows of codes of three symbols in a table of single symbols, then the contexts ``two``, then ``three``: -1 less the row of its longest listed suffix where a code isn't among ``three``.

    The index is over the symbols that the listed contexts have, which is small for a language with its own script.
    """

    def __init__(self, size: int, two: np.ndarray, three: np.ndarray):
        self.size = size
        used = np.unique(np.concatenate([three // size**2, three // size % size, three % size, two // size, two % size]))
        self.place = np.full(size, len(used), np.int32)
        self.place[used] = np.arange(len(used), dtype=np.int32)
        self.wide = len(used) + 1
        self.index = np.zeros((self.wide,) * 3, np.int32)  # 0: no suffix but the last symbol
        self.index[:, self.place[two // size], self.place[two % size]] = -1 - (size + np.arange(len(two), dtype=np.int32))
        self.index[self.place[three // size**2], self.place[three // size % size], self.place[three % size]] = size + len(two) + np.arange(len(three), dtype=np.int32)

    def of(self, context: np.ndarray) -> np.ndarray:
        first, rest = np.divmod(context, self.size**2)
        middle, last = np.divmod(rest, self.size)
        row = self.index.ravel()[(self.place[first] * self.wide + self.place[middle]) * self.wide + self.place[last]]
        return np.where(row == 0, -1 - last, row)


class Tables:
    """For each model, code lengths in bits of every symbol in its contexts: rows of one symbol, then of the listed contexts of two and of three, both sorted. Broadcast compressed.

    ``columns`` may give each model the column of every symbol (symbols that a model never saw share one).
    """

    def __init__(self, classes: np.ndarray, size: int, models: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]], columns: dict[str, np.ndarray] | None = None):
        self.classes, self.size, self.names = classes, size, list(models)
        self.columns = [np.arange(size, dtype=np.int64) if columns is None else columns[m].astype(np.int64) for m in models]
        self._packed = [(two, three, table.dtype, table.shape, zlib.compress(np.ascontiguousarray(table).tobytes(), 1)) for two, three, table in models.values()]
        self._shared, self._held = None, {}

    def __getstate__(self) -> tuple:
        return self.classes, self.size, self.names, self.columns, self._packed

    def __setstate__(self, state: tuple) -> None:
        self.classes, self.size, self.names, self.columns, self._packed = state
        self._shared, self._held = None, {}

    def shared(self, spark):
        """One broadcast of the tables, however often they score."""
        if self._shared is None:
            self._shared = spark.sparkContext.broadcast(self)
        return self._shared

    def model(self, k: int) -> tuple[Rows, np.ndarray]:
        """The rows of codes of three symbols, and the table."""
        if k not in self._held:
            if len(self._held) >= INDEXES:
                self._held.pop(next(iter(self._held)))
            two, three, kind, shape, packed = self._packed[k]
            self._held[k] = Rows(self.size, two, three), np.frombuffer(zlib.decompress(packed), kind).reshape(shape)
        return self._held[k]

    def lengths(self, k: int, row: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The code lengths of symbols in rows of a model's table."""
        table = self.model(k)[1]
        return table.ravel()[row.astype(np.int64) * table.shape[1] + self.columns[k][symbol]]

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Total bits of each text under every model, backing off to suffixes."""
        out = np.zeros((len(offsets) - 1, len(self.names)))
        for at, end, context, symbol, sizes in places(self.classes, self.size, data, offsets):
            for k in range(len(self.names)):
                row = self.model(k)[0].of(context)
                out[at:end, k] += text_sums(self.lengths(k, np.where(row < 0, -1 - row, row), symbol), sizes)
        return out
