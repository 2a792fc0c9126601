"""GIF media columns: LZW code streams, palettes, disposal, transparency, timed frames, histograms.

`decode` follows the GIF89a format: global and local colour tables, interlaced
rows, graphic control (delay, disposal 0-3, transparent index), and frames that
cover part of the canvas.  Codes between two clear codes have widths that
depend only on their number, so that a whole run is cut out of the bit stream
by numpy at once.  `encode` writes payloads as frames of palette indices under
a palette of 256 distinct colours, so that pixels map back to bytes.
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

from ._store import keyed

BLOCK, FRAME_ROWS, DELAY_CS = 192, 256, 10
BINS = 64
#: Three bits of red and green, two of blue: all 256 colours differ, and differ in their high bits.
PALETTE = np.array([((i >> 5) * 36, ((i >> 2) & 7) * 36, (i & 3) * 85) for i in range(256)], np.uint8)
_INDEX = np.zeros((8, 8, 4), np.uint8)
_INDEX[PALETTE[:, 0] // 36, PALETTE[:, 1] // 36, PALETTE[:, 2] // 85] = np.arange(256)


def _widths(size: int, n: int) -> np.ndarray:
    """Bits of the n first codes after a clear code."""
    return np.minimum(12, np.maximum(size + 1, np.ceil(np.log2((1 << size) + 2 + np.arange(n)))).astype(np.int64))


_SPAN = 4096
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _table(size: int) -> tuple[np.ndarray, np.ndarray]:
    if size not in _TABLES:
        w = _widths(size, _SPAN)
        _TABLES[size] = w, np.concatenate([[0], np.cumsum(w)])
    return _TABLES[size]


def _expanded(codes: np.ndarray, clear: int) -> np.ndarray:
    """Colour indices that the codes behind a clear code stand for, without a loop over them.

    The entry that code i adds is code i and the first letter of the next one,
    and so it lies in the result already, where code i begins.  Each code copies
    an earlier stretch, down to literals; both lengths and letters are found by
    following these references in doubled steps.
    """
    n = len(codes)
    literal = codes < clear
    room = np.minimum(4096, clear + 1 + np.arange(n))
    if not literal[0]:
        raise ValueError("LZW code without a prefix")
    if (~literal & ((codes > room) | (codes == 4096))).any() or (codes[literal] > 255).any():
        raise ValueError("LZW code out of range")
    entry = np.where(literal, np.arange(n), codes - clear - 2)
    size, hop = (~literal).astype(np.int64), entry
    while (more := size.take(hop)).any():
        size, hop = size + more, hop.take(hop)
    size += 1
    ends = np.cumsum(size)
    starts = ends - size
    at = np.arange(ends[-1]) - np.repeat(starts - starts[entry], size)
    for _ in range(int(2 * size.max()).bit_length()):  # no letter is copied more often than twice the longest code
        at = at.take(at)
    letters = np.zeros(ends[-1], np.uint8)
    letters[starts[literal]] = codes[literal]
    return letters[at]


def lzw_decode(stream: bytes, size: int, pixels: int) -> bytes:
    """Colour indices of one image; `size` is the stream's minimum code size."""
    if not 1 <= size <= 11:
        raise ValueError("LZW code size out of range")
    clear, end = 1 << size, (1 << size) + 1
    data = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.uint32)
    bits, at = len(stream) * 8, 0
    out, done, run, read = [], 0, [], 0  # the run: codes since the last clear code, and how many
    while done < pixels:
        if read < _SPAN:
            widths, offs = _table(size)
            w, pos = widths[read:], at + offs[read:-1] - offs[read]
        else:
            w = np.full(_SPAN, 12)
            pos = at + 12 * np.arange(_SPAN)
        fit = int(np.searchsorted(pos + w, bits, "right"))
        w, pos = w[:fit], pos[:fit]
        b = pos >> 3
        codes = ((data[b] | data[b + 1] << 8 | data[b + 2] << 16) >> (pos & 7).astype(np.uint32)) & ((1 << w) - 1).astype(np.uint32)
        stop = np.flatnonzero((codes == clear) | (codes == end))
        n = int(stop[0]) if len(stop) else fit
        run.append(codes[:n])
        read += n
        if len(stop) or not fit:
            if read:
                out.append(_expanded(np.concatenate(run).astype(np.int64), clear))
                done += len(out[-1])
            if not fit or int(codes[n]) == end:
                break
            at, run, read = int(pos[n] + w[n]), [], 0
        else:
            at = int(pos[-1] + w[-1])
    if done < pixels:
        raise ValueError("LZW stream ends early")
    return np.concatenate([*out, np.zeros(0, np.uint8)])[:pixels].tobytes()


def lzw_encode(data: bytes) -> bytes:
    """The code stream of 8-bit indices."""
    codes, table, free = [256], {}, 258
    get, put, rest = table.get, codes.append, iter(data)
    word = next(rest, None)
    for b in rest:
        key = word << 8 | b
        found = get(key)
        if found is None:
            put(word)
            table[key] = free
            free += 1
            word = b
            if free == 4096:
                put(256)
                table.clear()
                free = 258
        else:
            word = found
    if word is not None:
        put(word)
    put(257)
    c = np.array(codes)
    at = np.arange(len(c))
    cleared = np.maximum.accumulate(np.where(c == 256, at, -1))
    before = np.concatenate([[-1], cleared[:-1]])
    w = _table(8)[0][at - before - 1]
    ends = np.cumsum(w)
    starts = ends - w
    place, value, size = starts >> 3, c << (starts & 7), -(-int(ends[-1]) // 8)
    return sum(np.bincount(place + k, value >> 8 * k & 255, size + 2) for k in range(3))[:size].astype(np.uint8).tobytes()  # codes share bytes, but no bits


def _blocks(raw: bytes) -> bytes:
    return b"".join(bytes([len(raw[i : i + 255])]) + raw[i : i + 255] for i in range(0, len(raw), 255)) + b"\0"


def encode(payload: bytes, width: int = BLOCK, rows: int = FRAME_ROWS, delay_cs: int = DELAY_CS) -> bytes:
    """A GIF of frames of `width` x at most `rows` pixels, one byte a pixel; the payload fills whole rows."""
    if not payload or len(payload) % width:
        raise ValueError("the payload has to fill whole rows")
    lines = len(payload) // width
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(lines, rows), 0xF7, 0, 0), PALETTE.tobytes()]
    for top in range(0, lines, rows):
        part = payload[top * width : (top + rows) * width]
        out += [struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, delay_cs, 0, 0), struct.pack("<BHHHHB", 0x2C, 0, 0, width, len(part) // width, 0), b"\x08", _blocks(lzw_encode(part))]
    return b"".join([*out, b";"])


@dataclass
class Frame:
    number: int
    start_ms: int
    delay_ms: int
    left: int
    top: int
    width: int
    height: int
    canvas: np.ndarray  # rows x columns x RGBA after this frame is drawn

    def region(self) -> np.ndarray:
        return self.canvas[self.top : self.top + self.height, self.left : self.left + self.width]

    def histogram(self) -> np.ndarray:
        """Opaque canvas pixels by two high bits of red, green and blue."""
        px = self.canvas[self.canvas[:, :, 3] > 0].astype(np.int64)
        return np.bincount((px[:, 0] >> 6) << 4 | (px[:, 1] >> 6) << 2 | px[:, 2] >> 6, minlength=BINS)


def decode(raw: bytes) -> list[Frame]:
    """All frames as the canvas shows them."""
    if raw[:6] not in (b"GIF87a", b"GIF89a") or len(raw) < 13:
        raise ValueError("not a GIF")
    width, height, packed, _, _ = struct.unpack_from("<HHBBB", raw, 6)
    at, colours = 13, None

    def palette(flags: int) -> np.ndarray | None:
        nonlocal at
        if not flags & 0x80:
            return None
        n = 2 << (flags & 7)
        table = np.zeros((256, 3), np.uint8)
        table[:n] = np.frombuffer(raw, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
        return table

    def blocks() -> bytes:
        nonlocal at
        out = []
        while raw[at]:
            out.append(raw[at + 1 : at + 1 + raw[at]])
            at += 1 + raw[at]
        at += 1
        return b"".join(out)

    try:
        colours = palette(packed)
        canvas = np.zeros((height, width, 4), np.uint8)
        frames: list[Frame] = []
        clock, control = 0, (0, 0, None)
        while raw[at] != 0x3B:
            kind = raw[at]
            at += 1
            if kind == 0x21:
                label = raw[at]
                at += 1
                body = blocks()
                if label == 0xF9 and len(body) >= 4:
                    flags, delay, index = struct.unpack_from("<BHB", body)
                    control = (flags >> 2 & 7, delay * 10, index if flags & 1 else None)
            elif kind == 0x2C:
                left, top, w, h, flags = struct.unpack_from("<HHHHB", raw, at)
                at += 9
                own = palette(flags)
                table = own if own is not None else colours
                if table is None:
                    raise ValueError("no colour table")
                size = raw[at]
                at += 1
                stream = blocks()
                index = np.frombuffer(lzw_decode(stream, size, w * h), np.uint8).reshape(h, w) if w and h else np.zeros((h, w), np.uint8)
                if flags & 0x40:
                    order = [r for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(first, h, step)]
                    plain = np.empty_like(index)
                    plain[order] = index
                    index = plain
                disposal, delay, clear = control
                before = canvas.copy() if disposal == 3 else None
                spot = canvas[top : top + h, left : left + w]
                index = index[: spot.shape[0], : spot.shape[1]]
                drawn = np.ones(index.shape, bool) if clear is None else index != clear
                spot[drawn, :3] = table[index[drawn]]
                spot[drawn, 3] = 255
                frames.append(Frame(len(frames), clock, delay, left, top, index.shape[1], index.shape[0], canvas.copy()))
                clock += delay
                if disposal == 2:
                    spot[:] = 0
                elif disposal == 3:
                    canvas = before
                control = (0, 0, None)
            else:
                raise ValueError("unknown block")
    except (IndexError, struct.error) as e:
        raise ValueError("the GIF ends early") from e
    return frames


def payload_of(frames: list[Frame]) -> bytes:
    """The bytes that `encode` took, from the drawn pixels."""
    out = []
    for f in frames:
        px = f.region()
        out.append(_INDEX[px[:, :, 0] // 36, px[:, :, 1] // 36, px[:, :, 2] // 85].tobytes())
    return b"".join(out)


def padded(raw: bytes, block: int = BLOCK) -> bytes:
    return raw + b" " * ((-len(raw)) % block if raw else block)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, media (GIF); null texts count as empty.

    A long text is one image, made whole in memory; repeated rows are stored
    each; an empty table gives no rows.  Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                raws = [(t.as_py() or "").encode() for t in batch.column(1).slice(lo, 256)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 256), pa.array([len(r) for r in raws], pa.int64()), pa.array([encode(padded(r)) for r in raws], pa.binary())], ["doc_id", "n_bytes", "media"])

    rows, kind = keyed(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def frames_of(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", pixels: bool = False) -> DataFrame:
    """One row per frame: id, frame, start_ms, delay_ms, its place, histogram, pixels (RGBA, if asked), error.

    Null media give no row.  Bytes that aren't a whole GIF give one row with an
    error and nothing else.  Repeated rows give their frames each.  Ids keep
    their type; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "frame", "start_ms", "delay_ms", "x", "y", "width", "height", "histogram", "pixels", "error"]
        for batch in batches:
            kinds = [batch.schema.field(0).type, *[pa.int32()] * 7, pa.list_(pa.int64()), pa.binary(), pa.string()]
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not raw.is_valid:
                    continue
                try:
                    rows = [(key, f.number, f.start_ms, f.delay_ms, f.left, f.top, f.width, f.height, f.histogram().tolist(), f.canvas.tobytes() if pixels else None, None) for f in decode(raw.as_py())]
                except ValueError as e:
                    rows = [(key, *[None] * 9, str(e))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    rows = media.select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, frame int, start_ms int, delay_ms int, x int, y int, width int, height int, histogram array<long>, pixels binary, error string")


def feature(frames: list[Frame]) -> str:
    """Number of frames, their time, and the histogram of all of them."""
    total = sum((f.histogram() for f in frames), np.zeros(BINS, np.int64))
    return f"frames={len(frames)};ms={sum(f.delay_ms for f in frames)};hist=" + ",".join(f"{i}:{n}" for i, n in enumerate(total.tolist()) if n)


def digest(media: DataFrame) -> DataFrame:
    """One row per input row: the payload read back from stored media, features of its frames, and error.

    A null medium has nulls but for doc_id and n_bytes; one that isn't a whole
    GIF has its size and digest, an error, and nulls.  Repeated rows are read
    each; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
        for batch in batches:
            out: list[tuple] = []
            for raw in batch.column(2):
                gif = raw.as_py()
                if gif is None:
                    out.append((None,) * 7)
                    continue
                stored = len(gif), hashlib.sha256(gif).hexdigest()
                try:
                    frames = decode(gif)
                    payload = payload_of(frames)
                    out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), *stored, feature(frames), None))
                except ValueError as e:
                    out.append((None, None, None, *stored, None, str(e)))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], ["doc_id", "n_bytes", *names])

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")
