"""SentencePiece BPE encoding and decoding with vectorised merge rounds.

A text becomes units (a run of word marks and the characters up to the next mark; no piece holds a mark after another
character, so no merge crosses a unit's end). The distinct units of a batch lie as symbols in one flat numpy array. In every round
each unit finds its best pair with a segmented minimum, all its leftmost places with that rank merge at once, and the array is compacted, until no pair is left.
Where merging all places at once could differ from merging them one by one, only the unit's first place merges in that round.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdoc.llm.common import byte_batches, giving_back

MARK = "▁"

#: Characters of new units that one run of merge rounds takes, units that a task remembers, at most, and characters of texts that are encoded together. A worker's memory goes with these.
ROUND_CHARS, KEPT_UNITS, TEXT_CHARS = 400_000, 100_000, 500_000

_UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_NONE = np.iinfo(np.int32).max
_loaded: dict = {}


class PieceModel:
    """The pieces of a BPE model file and tables for merging: ``rank`` orders merges, the lower the sooner."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        self.is_byte = np.array([sp.is_byte(i) for i in range(size)])
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.unknown = sp.unk_id()
        self.silent = {i for i in range(size) if sp.is_control(i)}
        self.byte_ids = {int(self.pieces[i][1:-1], 16): i for i in range(size) if self.is_byte[i]}
        for i in plain:
            if MARK in self.pieces[i].lstrip(MARK):
                raise ValueError(f"piece {self.pieces[i]!r} holds a mark after another character")
        # symbols: pieces first, then single characters that aren't pieces
        self.symbols = {self.pieces[i]: i for i in plain}
        score = {self.pieces[i]: sp.get_score(i) for i in plain}
        order = {x: r for r, x in enumerate(sorted(set(score.values()), reverse=True))}
        for piece in list(self.symbols):
            for char in piece:
                self.symbols.setdefault(char, len(self.symbols) + size)
        keys, merged, ranks = [], [], []
        for piece in score:
            for cut in range(1, len(piece)):
                left, right = self.symbols.get(piece[:cut]), self.symbols.get(piece[cut:])
                if left is not None and right is not None:
                    keys.append((left << 32) | right)
                    merged.append(self.symbols[piece])
                    ranks.append(order[score[piece]])
        by = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.merged, self.ranks = np.array(keys, np.int64)[by], np.array(merged, np.int32)[by], np.array(ranks, np.int32)[by]
        self.size, self.kept = size, {}
        top = max([ord(c) for c in self.symbols if len(c) == 1])
        self.char_symbol = np.full(top + 1, -1, np.int32)
        for text, symbol in self.symbols.items():
            if len(text) == 1:
                self.char_symbol[ord(text)] = symbol

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (``_NONE`` without a merge) and merged symbol of each pair."""
        key = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], _NONE), np.where(hit, self.merged[at], -1)


def load_model(path: str) -> PieceModel:
    """The model, loaded once in each worker."""
    if path not in _loaded:
        _loaded[path] = PieceModel(path)
    return _loaded[path]


def merge_units(model: PieceModel, units: list[str]) -> list[list[int]]:
    """The ids of each unit (non-empty strings), all merged together in rounds."""
    sizes = np.array([len(u) for u in units], np.int64)
    codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    inside = codes < len(model.char_symbol)
    known = np.where(inside, model.char_symbol[np.where(inside, codes, 0)], -1)
    symbols = np.where(known >= 0, known, -2 - codes).astype(np.int64)  # below -1: a character that no piece holds
    unit = np.repeat(np.arange(len(units)), sizes)
    done_symbols, done_units = [], []
    n = len(symbols)
    rank, merged = np.full(n, _NONE, np.int32), np.full(n, -1, np.int32)
    if n > 1:
        same = unit[:-1] == unit[1:]
        r, m = model.pairs(symbols[:-1], symbols[1:])
        rank[:-1], merged[:-1] = np.where(same, r, _NONE), m
    while len(symbols):
        starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
        lengths = np.diff(np.r_[starts, len(unit)])
        best = np.minimum.reduceat(rank, starts)
        active = best != _NONE
        if not active.all():  # units without a pair are done
            row = np.repeat(active, lengths)
            done_symbols.append(symbols[~row])
            done_units.append(unit[~row])
            symbols, unit, rank, merged = symbols[row], unit[row], rank[row], merged[row]
            lengths, best = lengths[active], best[active]
            if not len(symbols):
                break
            starts = np.r_[0, np.cumsum(lengths)[:-1]]
        hit = rank == np.repeat(best, lengths)
        # leftmost: within a run of overlapping places every second one merges
        at = np.flatnonzero(hit)
        run = np.r_[True, (np.diff(at) != 1)]
        first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - first) % 2 == 0]
        at = _one_by_one(model, symbols, unit, merged, rank, at)
        symbols[at] = merged[at]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        changed = np.zeros(len(symbols), bool)
        changed[at] = True
        before = at - 1
        while True:  # a left neighbour that was merged away isn't one
            gone = (before >= 0) & ~keep[np.maximum(before, 0)]
            if not gone.any():
                break
            before = np.where(gone, before - 1, before)
        changed[before[before >= 0]] = True
        symbols, unit, rank, merged, changed = symbols[keep], unit[keep], rank[keep], merged[keep], changed[keep]
        spots = np.flatnonzero(changed)
        right = np.minimum(spots + 1, len(symbols) - 1)
        r, m = model.pairs(symbols[spots], symbols[right])
        ok = (right > spots) & (unit[spots] == unit[right])
        rank[spots], merged[spots] = np.where(ok, r, _NONE), np.where(ok, m, -1)
    if done_symbols:
        symbols, unit = np.concatenate(done_symbols), np.concatenate(done_units)
        by = np.argsort(unit, kind="stable")
        symbols, unit = symbols[by], unit[by]
    ids: list[list[int]] = [[] for _ in units]
    ends = np.searchsorted(unit, np.arange(len(units) + 1))
    flat = symbols.tolist()
    for k in range(len(units)):
        for symbol in flat[ends[k] : ends[k + 1]]:
            if 0 <= symbol < model.size:
                ids[k].append(symbol)
            else:
                ids[k] += spelled(model, symbol)
    return ids


def _one_by_one(model: PieceModel, symbols, unit, merged, rank, at: np.ndarray) -> np.ndarray:
    """Of the places of a round those that may merge at once; only the first of a unit where a merge could make a better pair."""
    n = len(symbols)
    new = merged[at].astype(np.int64)
    several = np.zeros(len(at), bool)
    several[:-1] |= unit[at[:-1]] == unit[at[1:]]
    several[1:] |= unit[at[:-1]] == unit[at[1:]]
    if not several.any():
        return at
    left, right = np.maximum(at - 1, 0), np.minimum(at + 2, n - 1)
    has_left, has_right = (at > 0) & (unit[left] == unit[at]), (at + 2 < n) & (unit[right] == unit[at])
    better = np.zeros(len(at), bool)
    merges = np.full(n, -1, np.int64)
    merges[at] = new
    before = np.r_[-1, at[:-1]]
    joined_left = before == at - 2
    for mask, a, b in (
        (has_left, symbols[left], new),
        (has_left & joined_left, np.where(joined_left, np.r_[-1, new[:-1]], -1), new),
        (has_right, new, symbols[right]),
    ):
        r, _ = model.pairs(a, b)
        better |= mask & (r <= rank[at])
    bad = np.unique(unit[at[better & several]])
    if not len(bad):
        return at
    first = np.r_[True, unit[at[1:]] != unit[at[:-1]]]
    return at[first | ~np.isin(unit[at], bad)]


def spelled(model: PieceModel, symbol: int) -> list[int]:
    """Ids of a symbol that is no piece: its UTF-8 bytes' pieces, or the unknown id without such pieces."""
    if symbol >= model.size:
        text = next(t for t, s in model.symbols.items() if s == symbol)
    else:
        text = chr(-2 - symbol)
    return [model.byte_ids.get(b, model.unknown) for b in text.encode("utf-8", "surrogatepass")] if model.byte_ids else [model.unknown]


def units_of(text: str) -> list[str]:
    """A text's units: spaces become marks, one is put in front; an empty text has none."""
    return _UNIT.findall(MARK + text.replace(" ", MARK)) if text else []


def remembered(model: PieceModel, texts: list[list[str]]) -> dict:
    """For each unit its ids as text, their number and their decoded form; new units are merged, ``ROUND_CHARS`` at a time."""
    if len(model.kept) > KEPT_UNITS:
        model.kept.clear()
    kept = model.kept
    new = list({u for units in texts for u in units if u not in kept})
    at = 0
    while at < len(new):
        end, chars = at, 0
        while end < len(new) and (end == at or chars + len(new[end]) <= ROUND_CHARS):
            chars += len(new[end])
            end += 1
        for unit, ids in zip(new[at:end], merge_units(model, new[at:end]), strict=True):
            kept[unit] = (",".join(map(str, ids)), len(ids), decode_ids(model, ids, begin=False))
        at = end
    return kept


def encode_text(model: PieceModel, text: str | None) -> list[int]:
    """The ids of one text; null and empty texts have none."""
    units = units_of(text or "")
    return [i for ids in merge_units(model, units) for i in ids] if units else []


def decode_ids(model: PieceModel, ids: list[int], begin: bool = True) -> str:
    """The text of ids: marks become spaces, byte pieces UTF-8 (broken bytes U+FFFD); at the text's begin one mark is dropped."""
    out, raw, started = [], bytearray(), not begin
    for i in ids:
        if model.is_byte[i]:
            raw.append(int(model.pieces[i][1:-1], 16))
            started = True
            continue
        if raw:
            out.append(_utf8(raw))
            raw = bytearray()
        if i in model.silent:
            continue
        piece = " ⁇ " if i == model.unknown else model.pieces[i].replace(MARK, " ")
        if not started:
            piece, started = piece.removeprefix(" "), True
        out.append(piece)
    if raw:
        out.append(_utf8(raw))
    return "".join(out)


def _utf8(raw: bytearray) -> str:
    """Valid characters, and U+FFFD for every byte that is part of none."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(bytes(raw[at : at + n]).decode("utf-8"))
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


def _slices(texts: pa.Array, limit: int) -> Iterator[tuple[int, list[str]]]:
    start, chunk, held = 0, [], 0
    for i, value in enumerate(texts):
        chunk.append(value.as_py() or "")
        held += len(chunk[-1])
        if held >= limit:
            yield start, chunk
            start, chunk, held = i + 1, [], 0
    if chunk:
        yield start, chunk


def _encoder(path: str, want_ids: bool, want_texts: bool = True):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(path)
        for batch in batches:
            for start, texts in _slices(batch.column(1), TEXT_CHARS):
                cut = [units_of(t) for t in texts]
                kept = remembered(model, cut)
                counts, id_sums, text_sums, id_lists, decoded_texts = [], [], [], [], []
                for units in cut:
                    found = [kept[u] for u in units]
                    id_text = ",".join([x[0] for x in found])
                    decoded = "".join([x[2] for x in found])
                    decoded = decoded.removeprefix(" ")
                    counts.append(sum(x[1] for x in found))
                    id_sums.append(hashlib.sha256(id_text.encode()).hexdigest())
                    text_sums.append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
                    if want_ids:
                        id_lists.append(np.fromstring(id_text, np.int32, sep=",") if id_text else np.zeros(0, np.int32))
                        decoded_texts.append(decoded if want_texts else None)
                columns = [batch.column(0).slice(start, len(texts)), pa.array(counts, pa.int64()), pa.array(id_sums), pa.array(text_sums)]
                names = ["row", "n_tokens", "ids_sha256", "decoded_sha256"]
                if want_ids:
                    columns += [pa.array(id_lists, pa.list_(pa.int32())), *[pa.array(decoded_texts, pa.string())] * want_texts]
                    names += ["ids", *["decoded"] * want_texts]
                yield pa.RecordBatch.from_arrays(columns, names)
        model.kept.clear()  # the worker lives on

    return run


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", want_ids: bool = True, want_texts: bool = True) -> DataFrame:
    """Ids of every whole text and what they decode to, one row per row of ``docs``, in one pass without a shuffle.

    Columns: ``id_col``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if ``want_ids``, ``ids array<int>`` and, if ``want_texts`` too, ``decoded``. Null texts count as empty:
    no ids, an empty decoded text. Other columns of ``docs`` are left out.
    """
    byte_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    schema = f"row {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * want_ids + ", decoded string" * (want_ids and want_texts)
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(giving_back(_encoder(model_path, want_ids, want_texts)), schema).withColumnRenamed("row", id_col)


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Every document's ids in the piece_bpe_32k model, and their decoded text, as digests."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), want_ids=False)
