"""Media columns: GIF.

An encoder stores bytes losslessly as palette indexes of frames, and a decoder reads any GIF: it
decodes the LZW code stream of each frame, applies its palette, transparency and disposal to the
canvas, and gives timed frames with colour-histogram columns.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Pixels of a row and rows of a frame of stored payloads, and their delay in hundredths of a second.
WIDTH, ROWS, DELAY = 192, 64, 10
#: Levels of each of red, green and blue in a colour histogram.
LEVELS = 4
GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()
#: Pixels of a frame or of all that is drawn on, at most; a GIF that wants more ends before that frame.
MOST_PIXELS = 1 << 26
_ONE = [bytes([i]) for i in range(256)]


@dataclass
class Frame:
    """One frame: its place, time in hundredths of a second, disposal, palette indexes, and the canvas (RGBA) that shows until the next frame is read."""

    left: int
    top: int
    width: int
    height: int
    delay: int
    disposal: int
    transparent: int | None
    indexes: bytes
    canvas: np.ndarray | None


def _widths(n: int, bits: int) -> np.ndarray:
    """Bits of the codes since a clear code."""
    free = (1 << bits) + 1 + np.arange(n)
    return np.minimum(np.maximum(np.floor(np.log2(free)).astype(np.int64) + 1, bits + 1), 12)


_WIDTHS = {bits: _widths(8192, bits) for bits in range(1, 9)}


def _since_clear(codes: np.ndarray, clear: int) -> np.ndarray:
    at = np.flatnonzero(codes == clear)
    begin = np.zeros(len(codes), np.int64)
    begin[at[at + 1 < len(codes)] + 1] = at[at + 1 < len(codes)] + 1
    return np.arange(len(codes)) - np.maximum.accumulate(begin)


def lzw_encode(data: bytes) -> bytes:
    """The code stream of 8-bit indexes."""
    codes, table, free = [256], {}, 258
    add, find = codes.append, table.get
    w = data[0]
    for c in data[1:]:
        key = w << 8 | c
        x = find(key)
        if x is not None:
            w = x
            continue
        add(w)
        table[key] = free
        free += 1
        w = c
        if free == 4096:
            add(256)
            table.clear()
            free = 258
    codes += [w, 257]
    code = np.array(codes, np.int64)
    width = np.minimum(_WIDTHS[8][np.minimum(_since_clear(code, 256), 8191)], 12)
    bits = (code[:, None] >> np.arange(12)) & 1
    return np.packbits(bits[np.arange(12) < width[:, None]].astype(np.uint8), bitorder="little").tobytes()


def lzw_decode(stream: bytes, bits: int, pixels: int) -> bytes:
    """At most `pixels` indexes of a code stream; a broken or short stream gives those before the break."""
    clear, end = 1 << bits, (1 << bits) + 1
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    total, at, out, done = 8 * len(stream), 0, [], 0
    while at < total and done < pixels:
        n = (total - at) // (bits + 1) + 1
        width = _WIDTHS[bits][:n] if n <= 4096 else np.concatenate((_WIDTHS[bits][:4096], np.full(n - 4096, 12)))
        width = width[:5000]  # a longer run without a clear code goes on below
        offset = at + np.concatenate(([0], np.cumsum(width)))
        n = int(np.searchsorted(offset[1:], total, "right"))
        if not n:
            break
        spot = offset[:n]
        codes = ((raw[spot >> 3] | raw[(spot >> 3) + 1] << 8 | raw[(spot >> 3) + 2] << 16) >> (spot & 7)) & ((1 << width[:n]) - 1)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        if len(stops) == 0 and n == 5000:  # a full table: all further codes have 12 bits
            more = (total - int(offset[n])) // 12
            spot = int(offset[n]) + 12 * np.arange(more)
            far = ((raw[spot >> 3] | raw[(spot >> 3) + 1] << 8 | raw[(spot >> 3) + 2] << 16) >> (spot & 7)) & 4095
            codes, offset = np.concatenate((codes, far)), np.concatenate((offset[:n], spot, [total]))
            stops = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(stops[0]) if len(stops) else len(codes)
        table = [*_ONE[:clear], b"", b""]
        prev, size, grow, add = b"", len(table), table.append, out.append
        for c in codes[:stop].tolist():
            if c < size:
                entry = table[c]
            elif c == size and prev:
                entry = prev + prev[:1]
            else:
                return b"".join(out)[:pixels]
            add(entry)
            done += len(entry)
            if prev and size < 4096:
                grow(prev + entry[:1])
                size += 1
            prev = entry
        if not len(stops) or codes[stop] == end:
            break
        at = int(offset[stop + 1])
    return b"".join(out)[:pixels]


def encode_gif(payload: bytes) -> bytes:
    """A GIF of 256 greys whose frames' indexes are the payload; its length is a positive multiple of WIDTH."""
    step = WIDTH * ROWS
    rows = min(len(payload), step) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, rows, 0xF7, 0, 0), GREY]
    for a in range(0, len(payload), step):
        part = payload[a : a + step]
        out += [b"\x21\xf9\x04", struct.pack("<BHB", 1 << 2, DELAY, 0), b"\0\x2c", struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0), b"\x08"]
        stream = lzw_encode(part)
        for k in range(0, len(stream), 255):
            block = stream[k : k + 255]
            out += [bytes([len(block)]), block]
        out.append(b"\0")
    return b"".join([*out, b"\x3b"])


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while at < len(data) and data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def _interlaced(height: int) -> np.ndarray:
    return np.concatenate([np.arange(first, height, step) for first, step in ((0, 8), (4, 8), (2, 4), (1, 2))])


def _reach(data: bytes, at: int) -> tuple[int, int]:
    """Right and lower end of what the frames from `at` on cover, as far as they can be read and are not too large."""
    right = low = 0
    try:
        while data[at] in (0x21, 0x2C):
            if data[at] == 0x21:
                at = _end(data, at + 2)
                continue
            left, top, w, h, flags = struct.unpack("<HHHHB", data[at + 1 : at + 10])
            if w * h > MOST_PIXELS or max(right, left + w) * max(low, top + h) > MOST_PIXELS:
                break
            right, low = max(right, left + w), max(low, top + h)
            at = _end(data, at + 11 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0))
    except (IndexError, struct.error):
        pass
    return right, low


def _end(data: bytes, at: int) -> int:
    """The place after the data blocks that begin at `at`."""
    while data[at]:
        at += 1 + data[at]
    return at + 1


def decode_gif(data: bytes | None, render: bool = True) -> Iterator[Frame]:
    """The frames of a GIF, one after the other. What is no GIF gives none; a GIF that breaks off, or that wants more than MOST_PIXELS, gives the frames before.

    Only the part of the canvas that frames cover is kept; the rest stays transparent.
    """
    if not data or data[:4] != b"GIF8" or len(data) < 13:
        return
    width, height, packed, _, _ = struct.unpack("<HHBBB", data[6:13])
    at, palette = 13, None
    if packed & 0x80:
        size = 3 << ((packed & 7) + 1)
        palette, at = data[at : at + size], at + size
    right, low = _reach(data, at)
    canvas = np.zeros((min(height, low), min(width, right), 4), np.uint8) if render else None
    delay, disposal, transparent = 0, 0, None
    try:
        while at < len(data):
            kind, at = data[at], at + 1
            if kind == 0x21:
                if data[at] == 0xF9:
                    flags, delay, clear = struct.unpack("<BHB", data[at + 2 : at + 6])
                    disposal, transparent = (flags >> 2) & 7, clear if flags & 1 else None
                _, at = _blocks(data, at + 1)
            elif kind == 0x2C:
                left, top, w, h, flags = struct.unpack("<HHHHB", data[at : at + 9])
                at, colours = at + 9, palette
                if flags & 0x80:
                    size = 3 << ((flags & 7) + 1)
                    colours, at = data[at : at + size], at + size
                bits = data[at]
                stream, at = _blocks(data, at + 1)
                if not 1 <= bits <= 8 or w * h > MOST_PIXELS or left + w > right or top + h > low:
                    return
                indexes = lzw_decode(stream, bits, w * h)
                if len(indexes) < w * h:
                    return
                if flags & 0x40:
                    grid = np.empty((h, w), np.uint8)
                    grid[_interlaced(h)] = np.frombuffer(indexes, np.uint8).reshape(h, w)
                    indexes = grid.tobytes()
                if render:
                    grid = np.frombuffer(indexes, np.uint8).reshape(h, w)
                    table = np.zeros((256, 3), np.uint8)
                    given = np.frombuffer((colours or b"")[:768], np.uint8)
                    table[: len(given) // 3] = given[: len(given) // 3 * 3].reshape(-1, 3)
                    area = canvas[top : top + h, left : left + w]
                    before = area.copy() if disposal == 3 else None
                    grid = grid[: area.shape[0], : area.shape[1]]
                    table = np.concatenate((table, np.full((256, 1), 255, np.uint8)), axis=1)
                    if transparent is None:
                        area[:] = table[grid]
                    else:
                        drawn = grid != transparent
                        area[drawn] = table[grid[drawn]]
                yield Frame(left, top, w, h, delay, disposal, transparent, indexes, canvas)
                if render and disposal == 2:
                    area[:] = 0
                elif render and disposal == 3:
                    area[:] = before
                delay, disposal, transparent = 0, 0, None
            else:
                return
    except (IndexError, struct.error):
        return


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Counts of the opaque pixels by LEVELS levels of red, green and blue."""
    level = canvas[..., :3] // np.uint8(256 // LEVELS)
    cell = (level[..., 0] * np.uint8(LEVELS) + level[..., 1]) * np.uint8(LEVELS) + level[..., 2]
    opaque = canvas[..., 3] > 0
    return np.bincount(cell.ravel() if opaque.all() else cell[opaque], minlength=LEVELS**3)


def gif_media(docs: DataFrame, multiple: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, media: the UTF-8 text, padded with bytes 32 to a positive multiple of `multiple`, as a GIF.

    Null and empty texts are one row of padding. Every row of docs gives a row. Columns other than
    doc_id and text are not read.
    """
    common.bounded_batches(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                raw = [(x.as_py() or "").encode() for x in part.column(1)]
                media = [encode_gif(r.ljust(max(1, -(-len(r) // multiple)) * multiple)) for r in raw]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(of, "doc_id long, n_bytes long, media binary")


def gif_frames(media: DataFrame) -> DataFrame:
    """One row for each frame of a (doc_id, media) table (null, broken or foreign media: those that decode_gif gives): frame, start_cs, delay_cs, left, top, width, height, disposal, transparent, indexes, histogram."""
    common.bounded_batches(media.sparkSession)
    form = "doc_id long, frame int, start_cs long, delay_cs int, left int, top int, width int, height int, disposal int, transparent int, indexes binary, histogram array<long>"

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in form.split(", ")]
        kinds = {"doc_id": pa.int64(), "start_cs": pa.int64(), "indexes": pa.binary(), "histogram": pa.list_(pa.int64())}
        form_of = pa.schema([(n, kinds.get(n, pa.int32())) for n in names])
        batch = lambda rows: pa.RecordBatch.from_pydict({n: [r[k] for r in rows] for k, n in enumerate(names)}, schema=form_of)
        rows, held = [], 0
        for b in batches:
            for key, data in zip(b.column(0).to_pylist(), b.column(1)):
                start = 0
                for k, f in enumerate(decode_gif(data.as_py())):
                    row = (key, k, start, f.delay, f.left, f.top, f.width, f.height, f.disposal, f.transparent, f.indexes, histogram(f.canvas).tolist())
                    rows.append(row)
                    start, held = start + f.delay, held + len(f.indexes)
                    if held > common.SLICE_BYTES or len(rows) == 256:
                        yield batch(rows)
                        rows, held = [], 0
        if rows:
            yield batch(rows)

    return media.select(F.col("doc_id").cast("long").alias("doc_id"), "media").mapInArrow(of, form)


def gif_digests(media: DataFrame) -> DataFrame:
    """What a (doc_id, n_bytes, media) table holds, read back: payload and media sizes and digests, the CRC-32 of the last 16 payload bytes, and a feature string of frames, time and summed histogram."""
    common.bounded_batches(media.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {"payload_bytes": [], "payload_sha256": [], "tail_crc32": [], "media_bytes": [], "media_sha256": [], "feature": []}
            for x in b.column(2):
                data = x.as_py() or b""
                sha, size, tail, frames, time, bins = hashlib.sha256(), 0, b"", 0, 0, np.zeros(LEVELS**3, np.int64)
                for f in decode_gif(data):
                    sha.update(f.indexes)
                    size, tail = size + len(f.indexes), (tail + f.indexes)[-16:]
                    frames, time, bins = frames + 1, time + f.delay, bins + histogram(f.canvas)
                some = ",".join(f"{k}:{v}" for k, v in enumerate(bins.tolist()) if v)
                out["payload_bytes"].append(size)
                out["payload_sha256"].append(sha.hexdigest())
                out["tail_crc32"].append(zlib.crc32(tail))
                out["media_bytes"].append(len(data))
                out["media_sha256"].append(hashlib.sha256(data).hexdigest())
                out["feature"].append(f"frames={frames};cs={time};rgb{LEVELS}={some}")
            kinds = {"payload_bytes": pa.int64(), "tail_crc32": pa.int64(), "media_bytes": pa.int64()}
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(v, kinds.get(k, pa.string())) for k, v in out.items())], ["doc_id", "n_bytes", *out])

    rows = media.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_bytes").cast("long").alias("n_bytes"), "media")
    return rows.mapInArrow(of, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
