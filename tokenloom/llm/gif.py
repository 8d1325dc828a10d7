"""GIF media columns: bytes stored losslessly as palette indices, read back through LZW, palettes, disposal and transparency."""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm._common import utf8

#: Samples a row, rows a frame at most, hundredths of a second a frame.
WIDTH, ROWS, DELAY = 64, 64, 10
GREY = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)
WARM, COOL = (np.stack([np.arange(256) * k // 4 for k in x], axis=1).astype(np.uint8) for x in ((4, 2, 1), (1, 2, 4)))
#: What frames get by turns: their own palette (None: the common one), disposal, whether their rows are interlaced.
TURNS = ((None, 1, False), (WARM, 2, True), (None, 3, False), (COOL, 2, True))
#: The index that is not painted: the byte that pads a text.
CLEAR = 0
#: A frame with more samples is refused.
MOST = 1 << 28


class GifError(ValueError):
    """The stream isn't a complete GIF."""


@dataclass
class Frame:
    """indices as stored (rows in order), the box on the canvas, the RGB canvas as shown (as far as any frame has reached), when
    and how long it shows."""

    indices: np.ndarray
    left: int
    top: int
    rgb: np.ndarray
    delay: int
    start: int
    disposal: int
    transparent: int | None


# ---- LZW -----------------------------------------------------------------------------------------------------------


@functools.cache
def _widths(least: int) -> np.ndarray:
    """The bits of each code after a clear code, as long as the table grows: a reader adds an entry with every code but the first."""
    entries = (1 << least) + 2 + np.maximum(0, np.arange(4098 - (1 << least)) - 1)
    return np.clip(np.floor(np.log2(entries)).astype(np.int64) + 1, least + 1, 12)


@functools.cache
def _ends(least: int) -> np.ndarray:
    """How many bits there are up to the end of each code after a clear code."""
    return np.cumsum(_widths(least))


@functools.cache
def _table() -> list[int]:
    """By a code and the sample after it, the entry for both, times 256; 0 where there is none.  Callers leave it as they found it."""
    return [0] * (4096 << 8)


def lzw_encode(samples: bytes, least: int = 8) -> bytes:
    """Samples of ``least`` bits as an LZW stream; where the table is full a clear code begins a new one."""
    clear, end = 1 << least, (1 << least) + 1
    table, prefix, new, full = _table(), samples[0] << 8, (end + 1) << 8, 4096 << 8
    tables: list[list[int]] = [[]]
    put = tables[0].append
    for sample in samples[1:]:
        key = prefix | sample
        if code := table[key]:
            prefix = code
            continue
        put(key)  # the code before the sample goes out, and both are a new entry
        table[key] = new
        prefix = sample << 8
        new += 256
        if new == full:
            for key in tables[-1]:
                table[key] = 0
            tables.append([])
            put, new = tables[-1].append, (end + 1) << 8
    for key in tables[-1]:
        table[key] = 0
    tables[-1].append(prefix)
    codes = np.concatenate([np.array([clear << 8, *t], dtype=np.int32) for t in tables] + [np.array([end << 8], dtype=np.int32)]) >> 8
    since = np.concatenate([np.maximum(0, np.arange(len(t) + 1) - 1) for t in tables] + [[len(tables[-1])]])
    since[np.cumsum([0, *(len(t) + 1 for t in tables[:-1])])] = [0, *(len(t) for t in tables[:-1])]  # a clear code is as long as the codes before it
    width, bit = _widths(least)[since], np.arange(12, dtype=np.int32)
    return np.packbits((codes[:, None] >> bit & 1).astype(np.uint8)[bit < width[:, None]], bitorder="little").tobytes()


def _unrolled(codes: np.ndarray, least: int, known: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """The samples of codes that follow a clear code, or follow a full table, and that table: its samples and where entries begin.

    Entry k of the table is what code k of the stream stood for and one sample more, which is how the next code begins.  So a
    code of an entry repeats samples that begin where code k began; chains of such references are followed by doubling.
    """
    of = codes - (1 << least) - 2  # the entry; below 0 a sample
    if known is not None:
        before, starts = known
        if (of >= len(starts) - 1).any():
            raise GifError("LZW code beyond the table")
        entry = np.maximum(of, 0)
        length = np.where(of < 0, 1, starts[entry + 1] - starts[entry] + 1)
        source = np.repeat(starts[entry], length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        return np.where(np.repeat(of < 0, length), np.repeat(codes, length), before[np.minimum(source, len(before) - 1)]).astype(np.uint8), known
    index = np.arange(len(codes))
    if (of >= index).any():
        raise GifError("LZW code beyond the table")
    parent, length = np.where(of < 0, index, of), (of >= 0).astype(np.int64)
    while (length[parent] > 0).any():
        length, parent = length + length[parent], parent[parent]
    length += 1
    starts = np.concatenate(([0], np.cumsum(length)))
    is_sample = np.repeat(of < 0, length)
    place = np.arange(starts[-1])
    source = np.where(is_sample, place, np.repeat(starts[np.maximum(of, 0)] - starts[:-1], length) + place)
    while True:
        further = source[source]
        if (further == source).all():
            break
        source = further
    out = np.repeat(codes, length)[source].astype(np.uint8)
    return out, (out, starts[: 4096 - (1 << least) - 2 + 1])


def lzw_decode(data: bytes, least: int, size: int) -> np.ndarray:
    """At most ``size`` samples of an LZW code stream with ``least`` bits a sample.

    Codes are taken from the bits as if no clear code came until a table is full; those after one are taken anew.
    """
    if not 1 <= least <= 8:
        raise GifError(f"LZW code size {least}")
    clear, end = 1 << least, (1 << least) + 1
    raw = np.frombuffer(data + b"\0\0\0", dtype=np.uint8)
    wide = raw[:-2].astype(np.int32) | raw[1:-1].astype(np.int32) << 8 | raw[2:].astype(np.int32) << 16
    growing = _widths(least)
    known, at, made, out = None, 0, 0, []
    while made < size:
        width, lasts = (growing, _ends(least)) if known is None else (np.full(4096, 12), 12 * np.arange(1, 4097))
        n = int(np.searchsorted(lasts, len(data) * 8 - at, side="right"))
        if not n:
            break
        ends = at + lasts[:n]
        starts = ends - width[:n]
        codes = wide[starts >> 3] >> (starts & 7) & ((1 << width[:n]) - 1)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        taken = int(stops[0]) if len(stops) else n
        if taken:
            part, table = _unrolled(codes[:taken], least, known)
            out.append(part)
            made += len(part)
            known = table if taken == len(growing) or known is not None else None
        if len(stops):
            if codes[taken] == end:
                break
            known = None
        elif n < len(width) or taken < len(growing) and known is None:
            break
        at = int(ends[min(taken, n - 1)])
    return np.concatenate(out)[:size] if out else np.zeros(0, dtype=np.uint8)


# ---- writing and reading -------------------------------------------------------------------------------------------


def _blocks(data: bytes) -> bytes:
    parts = []
    for i in range(0, len(data), 255):
        parts += [bytes([len(x := data[i : i + 255])]), x]
    parts.append(b"\0")
    return b"".join(parts)


def _interlaced(rows: int) -> np.ndarray:
    """The order in which the rows of an interlaced image are stored."""
    return np.array([*range(0, rows, 8), *range(4, rows, 8), *range(2, rows, 4), *range(1, rows, 2)])


def encode(payload: bytes) -> bytes:
    """A looping GIF of frames 64 samples wide and at most 64 rows high, whose indices are the payload's bytes.

    The payload's length must be a positive multiple of 64.  Frames take palettes, disposals and interlacing by turns; index 0,
    which pads texts, is transparent everywhere: what is shown depends on all that, the indices don't.
    """
    if not payload or len(payload) % WIDTH:
        raise ValueError("the payload's length must be a positive multiple of 64")
    step = WIDTH * ROWS
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(ROWS, len(payload) // WIDTH), 0xF7, 0, 0), GREY.tobytes(), b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"]
    for k, at in enumerate(range(0, len(payload), step)):
        palette, disposal, interlaced = TURNS[k % len(TURNS)]
        part = payload[at : at + step]
        rows = len(part) // WIDTH
        if interlaced:
            part = np.frombuffer(part, dtype=np.uint8).reshape(rows, WIDTH)[_interlaced(rows)].tobytes()
        flags = (0 if palette is None else 0x87) | (0x40 if interlaced else 0)
        out += [b"\x21\xf9\x04", struct.pack("<BHBB", disposal << 2 | 1, DELAY, CLEAR, 0), b"\x2c", struct.pack("<HHHHB", 0, 0, WIDTH, rows, flags)]
        out += [b"" if palette is None else palette.tobytes(), b"\x08", _blocks(lzw_encode(part))]
    out.append(b"\x3b")
    return b"".join(out)


def _joined(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    try:
        while n := data[at]:
            parts.append(data[at + 1 : at + 1 + n])
            at += n + 1
    except IndexError:
        raise GifError("a GIF ends within its blocks") from None
    return b"".join(parts), at + 1


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    if not flags & 0x80:
        return None, at
    n = 2 << (flags & 7)
    if len(data) < at + 3 * n:
        raise GifError("a GIF ends within its palette")
    return np.frombuffer(data, dtype=np.uint8, count=3 * n, offset=at).reshape(n, 3), at + 3 * n


def decode(data: bytes) -> Iterator[Frame]:
    """The frames of a GIF, each with its stored indices and the canvas as shown: palettes, interlace, transparency, disposal.

    Only one canvas and one saved canvas are held, as large as frames that have arrived reach, whatever size the header names.
    Raises GifError where the stream is cut short or malformed, or a frame has more than MOST samples.
    """
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise GifError("no GIF header")
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    common, at = _palette(data, 13, flags)
    ground = common[background] if common is not None and background < len(common) else np.zeros(3, dtype=np.uint8)
    canvas = np.zeros((0, 0, 3), dtype=np.uint8)
    disposal, transparent, delay, clock = 0, None, 0, 0
    while True:
        if at >= len(data):
            raise GifError("a GIF has no trailer")
        kind, at = data[at], at + 1
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at] if at < len(data) else 0
            body, at = _joined(data, at + 1)
            if label == 0xF9 and len(body) >= 4:
                packed, delay, clear = struct.unpack_from("<BHB", body)
                disposal, transparent = packed >> 2 & 7, clear if packed & 1 else None
            continue
        if kind != 0x2C:
            raise GifError(f"unknown GIF block {kind}")
        if len(data) < at + 10:
            raise GifError("a GIF ends within an image descriptor")
        left, top, w, h, packed = struct.unpack_from("<HHHHB", data, at)
        own, at = _palette(data, at + 9, packed)
        palette = own if own is not None else common
        if palette is None:
            raise GifError("a GIF image has no palette")
        least = data[at]
        stream, at = _joined(data, at + 1)
        if w * h > MOST:
            raise GifError(f"a frame of {w} x {h} samples")
        got = lzw_decode(stream, least, w * h)
        if len(got) != w * h:
            raise GifError(f"{len(got)} of {w * h} samples")
        indices = got.reshape(h, w)
        if packed & 0x40:
            rows = np.empty_like(indices)
            rows[_interlaced(h)] = indices
            indices = rows
        seen = indices[: max(0, height - top), : max(0, width - left)]
        tall, wide = max(canvas.shape[0], top + seen.shape[0] if seen.size else 0), max(canvas.shape[1], left + seen.shape[1] if seen.size else 0)
        if (tall, wide) != canvas.shape[:2]:
            if tall * wide > MOST:
                raise GifError(f"frames reach {wide} x {tall} samples")
            larger = np.broadcast_to(ground, (tall, wide, 3)).copy()
            larger[: canvas.shape[0], : canvas.shape[1]] = canvas
            canvas = larger
        saved = canvas.copy() if disposal == 3 else None
        box = canvas[top : top + seen.shape[0], left : left + seen.shape[1]]
        if seen.size and int(seen.max()) >= len(palette):
            raise GifError("a sample beyond the palette")
        if transparent is None:
            box[:] = palette[seen]
        else:
            np.copyto(box, palette[seen], where=(seen != transparent)[:, :, None])
        yield Frame(indices, left, top, canvas.copy(), delay, clock, disposal, transparent)
        clock += delay
        if disposal == 2:
            box = canvas[top : top + seen.shape[0], left : left + seen.shape[1]]
            box[:] = ground
        elif saved is not None:
            canvas = saved
        disposal, transparent, delay = 0, None, 0


def histogram(rgb: np.ndarray) -> np.ndarray:
    """Pixels in each of 64 colours: two bits of red, green and blue."""
    c = rgb.reshape(-1, 3)
    return np.bincount((c[:, 0] >> 6) << 4 | (c[:, 1] >> 6) << 2 | c[:, 2] >> 6, minlength=64)


# ---- DataFrames ----------------------------------------------------------------------------------------------------


def _mapped(df: DataFrame, columns: list, make: Callable, schema: pa.Schema, spark_schema: str) -> DataFrame:
    return df.select(*columns).mapInArrow(functools.partial(_each, make, schema), spark_schema)


def _each(make: Callable, schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Applies make(id, value) -> rows; batches are cut so that about 8 MB of results are held at once."""
    for batch in batches:
        held, size = [], 0
        for key, value in zip(batch.column(0), batch.column(1), strict=True):
            for row in make(key.as_py(), value.as_py()):
                held.append(row)
                size += 64 + sum(len(x) for x in row if isinstance(x, bytes | str))
                if size > 8 << 20:
                    yield _rows(held, schema)
                    held, size = [], 0
        yield _rows(held, schema)


def _rows(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*held, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _padded(text: str | None) -> tuple[bytes, int]:
    raw = utf8(text)
    return raw.ljust(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH), b"\0"), len(raw)


def _stored(key: int, text: str | None) -> Iterator[tuple]:
    payload, n = _padded(text)
    yield key, n, encode(payload)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8 bytes (null: none), zero-padded to a positive multiple of 64, as a GIF."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
    return _mapped(docs, [F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")], _stored, schema, "doc_id long, n_bytes long, media binary")


def _framed(key: int, media: bytes | None) -> Iterator[tuple]:
    try:
        for i, f in enumerate(decode(media or b"")):
            yield key, i, f.start * 10, f.delay * 10, f.indices.shape[1], f.indices.shape[0], f.disposal, f.transparent, f.indices.tobytes(), histogram(f.rgb).tolist(), None
    except GifError as e:
        yield key, None, None, None, None, None, None, None, None, None, str(e)


def frames(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per frame of each GIF with its time, box, stored indices and the shown canvas's colour histogram.

    A null, empty or malformed GIF gives its frames up to the fault and then a row whose ``error`` says what is wrong.
    """
    ints = ["frame", "start_ms", "delay_ms", "width", "height", "disposal", "transparent"]
    schema = pa.schema([("doc_id", pa.int64()), *[(x, pa.int32()) for x in ints], ("indices", pa.binary()), ("colours", pa.list_(pa.int32())), ("error", pa.string())])
    return _mapped(media, [F.col(id_col).alias("doc_id"), F.col(media_col).alias("media")], _framed, schema, "doc_id long, " + "".join(f"{x} int, " for x in ints) + "indices binary, colours array<int>, error string")


def _digested(key: int, text: str | None) -> Iterator[tuple]:
    for key, n, media in _stored(key, text):
        whole, tail, size, colours, shown, until = hashlib.sha256(), b"", 0, np.zeros(64, dtype=np.int64), 0, 0
        for f in decode(media):
            part = f.indices.tobytes()
            whole.update(part)
            tail, size, shown, until = (tail + part)[-64:], size + len(part), shown + 1, f.start + f.delay
            colours += histogram(f.rgb)
        feature = f"{shown}f:" + ",".join(map(str, colours[[0, 21, 42, 63]].tolist()))
        yield key, n, size, whole.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature, shown, until * 10, colours.tolist()


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text as a GIF, decodes the stored bytes again, and returns digests of both, and of the frames as shown their
    number, their time and the pixels in each of 64 colours.

    A null text counts as empty: 64 zero bytes.  Repeated rows give repeated rows; an empty table an empty result.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("frames", pa.int32()), ("duration_ms", pa.int64()), ("colours", pa.list_(pa.int64()))])
    spark_schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames int, duration_ms long, colours array<long>"
    return _mapped(docs, [F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")], _digested, schema, spark_schema)
