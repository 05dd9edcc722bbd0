"""Media columns: motion-JPEG in AVI files, their frames, shots and timed clips.

The writer stores a payload losslessly: each byte is one flat 8 x 8 block of an 8-bit baseline JPEG, so any decoder gives it back. The
DC table gives a difference of category c a code of 9 - c bits, so with its c bits and a one-bit end of block each block takes
ten bits and a frame packs and unpacks as arrays. The reader takes any grey or colour baseline frames through RIFF lists and the ``idx1`` index.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdoc.llm.common import byte_batches

#: Blocks across a written frame, block rows in it at most, and frames a second.
ACROSS, ROWS, FPS = 64, 16, 25

#: Shots: histogram bins, differences looked back on, deviations above their mean, and the least difference of a cut.
BINS, WINDOW, DEVIATIONS, LEAST = 32, 12, 3.0, 0.35

_ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


def _words() -> np.ndarray:
    """Ten-bit words of the differences -255..255."""
    out = np.zeros(511, np.uint64)
    for diff in range(-255, 256):
        c = abs(diff).bit_length()
        bits = diff if diff > 0 else diff + (1 << c) - 1
        out[diff + 255] = ((((1 << (9 - c)) - 2) << c | bits) << 1) if c else 0b1111111100
    return out


_TO_WORD = _words()
_TO_DIFF = np.full(1024, 9999, np.int64)
_TO_DIFF[_TO_WORD.astype(np.int64)] = np.arange(-255, 256)
_DC_TABLE = bytes([1] * 9 + [0] * 7) + bytes([8, 7, 6, 5, 4, 3, 2, 1, 0])
_AC_TABLE = bytes([1] + [0] * 15) + bytes([0])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_HEADS: dict[int, bytes] = {}


def write_jpeg(values: np.ndarray) -> bytes:
    """A grey baseline JPEG of flat blocks, ``values`` uint8 in rows of ``ACROSS``."""
    rows = len(values) // ACROSS
    head = _HEADS.get(rows)
    if head is None:
        head = _HEADS[rows] = (
            b"\xff\xd8" + _segment(0xDB, b"\x00" + bytes([8] * 64)) + _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, ACROSS * 8, 1) + b"\x01\x11\x00")
            + _segment(0xC4, b"\x00" + _DC_TABLE) + _segment(0xC4, b"\x10" + _AC_TABLE) + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
        )
    level = values.astype(np.int16)
    diff = np.empty_like(level)
    diff[0], diff[1:] = level[0] - 128, level[1:] - level[:-1]
    w = _TO_WORD[diff.astype(np.int64) + 255].reshape(-1, 4)
    packed = (w[:, 0] << np.uint64(30)) | (w[:, 1] << np.uint64(20)) | (w[:, 2] << np.uint64(10)) | w[:, 3]
    data = packed.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()
    return head + data.replace(b"\xff", b"\xff\x00") + b"\xff\xd9"


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) % 2)


def write_avi(payload: bytes) -> bytes:
    """An AVI file whose frames hold ``payload`` (a positive multiple of 64 bytes); its length is kept in an INFO comment."""
    rows = min(ROWS, len(payload) // ACROSS)
    size = rows * ACROSS
    padded = np.frombuffer(payload + bytes(-len(payload) % size), np.uint8)
    frames = [write_jpeg(padded[i : i + size]) for i in range(0, len(padded), size)]
    most = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, ACROSS * 8, rows * 8, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, FPS, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, ACROSS * 8, rows * 8)
    strf = struct.pack("<IiiHH4sIiiII", 40, ACROSS * 8, rows * 8, 1, 8, b"MJPG", ACROSS * 8 * rows * 8, 0, 0, 0, 0)
    hdrl = b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    info = b"INFO" + _chunk(b"ICMT", f"payload={len(payload)}\0".encode())
    movi, index, at = [b"movi"], [], 4
    for frame in frames:
        movi.append(_chunk(b"00dc", frame))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        at += len(movi[-1])
    body = b"AVI " + _chunk(b"LIST", hdrl) + _chunk(b"LIST", info) + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def read_avi(media: bytes) -> dict:
    """Frame spans through the index (or by walking ``movi`` without one), frame rate and the comment of an AVI file."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    found: dict = {"rate": float(FPS), "comment": "", "spans": []}
    movi, index = None, None
    stack = [(12, min(len(media), 8 + struct.unpack_from("<I", media, 4)[0]))]
    while stack:
        at, end = stack.pop()
        while at + 8 <= end:
            name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
            start = at + 8
            if name == b"LIST":
                kind = media[start : start + 4]
                if kind == b"movi":
                    movi = (start, start + size)
                else:
                    stack.append((start + 4, start + size))
            elif name == b"strh" and media[start : start + 4] == b"vids":
                scale, rate = struct.unpack_from("<II", media, start + 20)
                found["rate"] = rate / scale if scale and rate else found["rate"]
            elif name == b"ICMT":
                found["comment"] = media[start : start + size].rstrip(b"\0").decode("latin-1")
            elif name == b"idx1":
                index = (start, size // 16)
            at = start + size + size % 2
    if movi and index:
        base = None
        for i in range(index[1]):
            name, _, offset, size = struct.unpack_from("<4sIII", media, index[0] + 16 * i)
            if name[2:] in (b"dc", b"db"):
                if base is None:  # offsets count from the list's name, or from the file's start
                    base = movi[0] if media[movi[0] + offset : movi[0] + offset + 4] == name else 0
                found["spans"].append((base + offset + 8, size))
    elif movi:
        at = movi[0] + 4
        while at + 8 <= movi[1]:
            name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
            if name[2:] in (b"dc", b"db"):
                found["spans"].append((at + 8, size))
            at += 8 + (4 if name == b"LIST" else size + size % 2)
    return found


def _codes(table: bytes) -> dict[tuple[int, int], int]:
    """(length, code) to symbol of a table in a DHT segment."""
    out, code, k = {}, 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            out[length, code] = table[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def read_jpeg(data: bytes) -> tuple[np.ndarray, bool]:
    """Luma of a baseline frame, uint8: ``(block values, True)`` if every block is flat and packed as here, else ``(pixels, False)``."""
    at, quant, huff, comps, restart = 2, {}, {}, [], 0
    height = width = 0
    while True:
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide, name = body[k] >> 4, body[k] & 15
                n = 128 if wide else 64
                quant[name] = np.frombuffer(body[k + 1 : k + 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                k += 1 + n
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                n = 17 + sum(body[k + 1 : k + 17])
                huff[body[k]] = body[k + 1 : k + n]
                k += n
        elif marker in (0xC0, 0xC1):
            _, height, width, n = struct.unpack_from(">BHHB", body)
            comps = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("only baseline frames are read")
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            scan = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            break
    end = data.rfind(b"\xff\xd9")
    stream = data[at : end if end >= at else len(data)]
    if len(comps) == 1 and huff.get(0) == _DC_TABLE and huff.get(16) == _AC_TABLE and not restart and quant[comps[0][3]][0] == 8:
        raw = np.frombuffer(stream.replace(b"\xff\x00", b"\xff"), np.uint8)
        n = -(-height // 8) * -(-width // 8)
        if len(raw) * 8 == n * 10 and n % 4 == 0:
            wide = np.zeros((n // 4, 8), np.uint8)
            wide[:, 3:] = raw.reshape(-1, 5)
            four = wide.view(">u8").astype(np.uint64).ravel()
            words = np.stack([(four >> np.uint64(s)) & np.uint64(1023) for s in (30, 20, 10, 0)], 1).ravel()
            return (np.cumsum(_TO_DIFF[words.astype(np.int64)]) + 128).astype(np.uint8), True
    return _general(stream, height, width, comps, scan, quant, {k: _codes(v) for k, v in huff.items()}, restart), False


def _general(stream, height, width, comps, scan, quant, huff, restart) -> np.ndarray:
    """Pixels of the first component of any baseline scan."""
    parts, start = [], 0
    for i in range(len(stream) - 1):
        if stream[i] == 0xFF and 0xD0 <= stream[i + 1] <= 0xD7:
            parts.append(stream[start:i])
            start = i + 2
    parts.append(stream[start:])
    most_h, most_v = max(c[1] for c in comps), max(c[2] for c in comps)
    if len(comps) == 1:
        comps = [(comps[0][0], 1, 1, comps[0][3])]
        most_h = most_v = 1
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    own_h, own_v = comps[0][1], comps[0][2]
    image = np.zeros((down * own_v * 8, across * own_h * 8), np.float64)
    basis = np.array([[(0.5 if u else 0.5 / np.sqrt(2)) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
    mcu = 0
    for part in parts:
        bits = np.unpackbits(np.frombuffer(part.replace(b"\xff\x00", b"\xff"), np.uint8)).tolist()
        at, last = 0, [0] * len(comps)

        def symbol(table):
            nonlocal at
            code = 0
            for length in range(1, 17):
                code = code << 1 | bits[at]
                at += 1
                if (length, code) in table:
                    return table[length, code]
            raise ValueError("a code is broken")

        def number(n):
            nonlocal at
            value = 0
            for b in bits[at : at + n]:
                value = value << 1 | b
            at += n
            return value if not n or value >> (n - 1) else value - (1 << n) + 1

        for _ in range(restart or across * down):
            if mcu >= across * down:
                break
            for c, (name, h, v, q) in enumerate(comps):
                dc, ac = huff[scan[name] >> 4], huff[16 + (scan[name] & 15)]
                for b in range(h * v):
                    coef = np.zeros(64)
                    last[c] += number(symbol(dc))
                    coef[0] = last[c] * quant[q][0]
                    k = 1
                    while k < 64:
                        s = symbol(ac)
                        if s == 0:
                            break
                        k += s >> 4
                        if s & 15:
                            coef[_ZIGZAG[k]] = number(s & 15) * quant[q][k]
                        k += 1
                    if c == 0:
                        y, x = (mcu // across * v + b // h) * 8, (mcu % across * h + b % h) * 8
                        image[y : y + 8, x : x + 8] = basis.T @ coef.reshape(8, 8) @ basis
            mcu += 1
    return np.clip(np.rint(image + 128), 0, 255).astype(np.uint8)[:height, :width]


def find_shots(histograms: np.ndarray) -> list[int]:
    """First frames of the shots: a cut is a histogram difference well above those before it in the same shot."""
    if not len(histograms):
        return []
    share = histograms / np.maximum(histograms.sum(1, keepdims=True), 1)
    steps = np.abs(np.diff(share, axis=0)).sum(1) / 2
    cuts, since = [0], 0
    for i, step in enumerate(steps):
        past = steps[max(since, i - WINDOW) : i]
        bar = max(LEAST, past.mean() + DEVIATIONS * past.std()) if len(past) else LEAST
        if step > bar:
            cuts.append(i + 1)
            since = i + 1
    return cuts


def read_media(media: bytes) -> dict:
    """Frames, shots and clips of an AVI file, and the payload where its comment tells of one."""
    found = read_avi(media)
    values, histograms, means = [], [], []
    for at, size in found["spans"]:
        luma, flat = read_jpeg(media[at : at + size])
        values.append(luma)
        counts = np.bincount(luma.ravel() >> 3, minlength=BINS)
        histograms.append(counts * 64 if flat else counts)
        means.append(float(luma.mean()))
    cuts = find_shots(np.array(histograms))
    stops = cuts[1:] + [len(values)]
    clips = [
        {"clip": i, "first_frame": a, "last_frame": b - 1, "start_s": a / found["rate"], "end_s": b / found["rate"], "luma": float(np.mean(means[a:b]))}
        for i, (a, b) in enumerate(zip(cuts, stops, strict=True))
    ]
    comment = found["comment"]
    payload = np.concatenate(values).tobytes()[: int(comment[8:])] if comment.startswith("payload=") and values else None
    return {"frames": len(values), "clips": clips, "payload": payload}


def padded(text: str | None) -> bytes:
    """UTF-8 of a text (null: empty) with zeros up to a positive multiple of 64 bytes."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64))


#: Bytes of text that are stored before a batch is given out; a longer text is a batch of its own.
STORE_BYTES = 1 << 20


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, texts, at = batch.column(0), batch.column(1), 0
        while at < batch.num_rows:
            sizes, media, held = [], [], 0
            begin = at
            while at < batch.num_rows and (at == begin or held < STORE_BYTES):
                text = texts[at].as_py()
                sizes.append(len((text or "").encode("utf-8", "surrogatepass")))
                media.append(write_avi(padded(text)))
                held += sizes[-1]
                at += 1
            yield pa.RecordBatch.from_arrays([keys.slice(begin, at - begin), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["row", "n_bytes", "media"])


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_bytes`` and ``media binary``: every whole text as an AVI file. Null texts count as empty (one frame of zeros); rows stay as they are."""
    byte_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(_store, f"row {kind}, n_bytes long, media binary").withColumnRenamed("row", id_col)


def _clip_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([("clip", pa.int32()), ("first_frame", pa.int32()), ("last_frame", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("luma", pa.float64())])
    for batch in batches:
        keys, rows = [], []
        for key, media in zip(batch.column(0), batch.column(1), strict=True):
            try:
                clips = read_media(media.as_py())["clips"] if media.is_valid else []
            except (ValueError, IndexError, KeyError, TypeError, OverflowError, struct.error):
                clips = [{}]
            for clip in clips:
                keys.append(key.as_py())
                rows.append(clip)
        clips = pa.array(rows, kind)
        yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), *clips.flatten()], ["row", *[f.name for f in kind]])


def media_clips(table: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row for each shot of each AVI file: ``clip``, ``first_frame``, ``last_frame``, ``start_s``, ``end_s``, ``luma``. Null media give no row, files that can't be read one row of nulls."""
    kind = dict(table.dtypes)[id_col]
    schema = f"row {kind}, clip int, first_frame int, last_frame int, start_s double, end_s double, luma double"
    return table.select(F.col(id_col), F.col(media_col)).mapInArrow(_clip_rows, schema).withColumnRenamed("row", id_col)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for media in batch.column(2):
            stored = media.as_py()
            found = read_media(stored)
            payload = found["payload"]
            luma = sum(c["luma"] * (c["last_frame"] - c["first_frame"] + 1) for c in found["clips"]) / found["frames"]
            feature = f"frames={found['frames']};shots={len(found['clips'])};luma={luma:.3f};cuts={','.join(str(c['first_frame']) for c in found['clips'])}"
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = ["row", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)


def op2_media_columns(spark, sf_dir: str) -> DataFrame:
    """Every document's text stored as motion-JPEG, read back, as digests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    schema = "row long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return store_texts(docs).mapInArrow(_digests, schema).withColumnRenamed("row", "doc_id")
