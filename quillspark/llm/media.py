"""Media columns: GIF images with timed frames and colour-histogram columns.

decode() reads any GIF87a or GIF89a: LZW code streams (deferred clears too), global and
local palettes, interlacing, the disposal methods and transparency; each frame comes with
its raw samples, its composed canvas and its time. encode() stores bytes losslessly as
8-bit samples of a grey palette, 192 a row, in frames of at most FRAME_ROWS rows.

frames() opens a column of GIFs: a row for each frame as it shows, with its time and the
colours of the samples that it draws.

A null text counts as empty and gives one row of spaces. Equal texts give equal values. An
empty table gives no rows. Rows with null or repeated ids are rows like others. Only the
named columns of the input are read, whatever others there are. A column's value that is
null has no frames; one that is no GIF, is damaged, or asks for more than PIXELS pixels gives
a row with the error after the frames before it. Frames are decoded one at a time, so a very
long text or GIF costs its own bytes and a few frames.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.common import arrow_schema, arrow_settings, as_batch, entered, give_back, map_batches, table

WIDTH = 192
FRAME_ROWS = 16_384
#: Pixels of a canvas or of a frame, at most: 256 MB as RGBA.
PIXELS = 1 << 26
#: Hundredths of a second that each frame stays.
DELAY = 10
_CLEAR, _STOP, _FULL = 256, 257, 4096


def _pack(codes: np.ndarray, widths: np.ndarray) -> bytes:
    at = np.cumsum(widths) - widths
    bits = np.zeros(int(widths.sum()), np.uint8)
    for b in range(12):
        on = widths > b
        bits[at[on] + b] = codes[on] >> b & 1
    return np.packbits(bits, bitorder="little").tobytes()


#: By the number of codes since a clear code: how wide the next one is, and where it starts, for 8-bit samples.
def _schedule(least: int) -> tuple[np.ndarray, np.ndarray]:
    first = (1 << least) + 2
    entries = np.minimum(np.maximum(np.arange(_FULL) - 1, 0) + first, _FULL - 1)
    widths = np.maximum(least + 1, np.floor(np.log2(entries)).astype(np.int64) + 1)
    return widths, np.cumsum(widths) - widths


_WIDTHS, _STARTS = _schedule(8)


def lzw(data: bytes) -> bytes:
    """The LZW code stream of 8-bit samples; the table is cleared when it is full."""
    codes: list[int] = [_CLEAR]
    sizes = [1]
    known: dict[int, int] = {}
    get, put = known.get, codes.append
    new, w, since = _STOP + 1, data[0], len(codes)
    for c in data[1:]:
        k = w << 8 | c
        x = get(k)
        if x is not None:
            w = x
            continue
        put(w)
        known[k] = new
        new += 1
        w = c
        if new == _FULL:
            put(_CLEAR)
            sizes.append(len(codes) - since)
            since = len(codes)
            known.clear()
            new = _STOP + 1
    codes += [w, _STOP]
    sizes.append(len(codes) - since)
    widths = np.concatenate([[9], *(_WIDTHS[:n] for n in sizes[1:])])
    return _pack(np.array(codes, np.int64), widths)


def unlzw(stream: bytes, least: int, most: int) -> bytes:
    """The samples of a code stream, up to one table's worth beyond `most`. A stream that ends early gives what it holds; a code beyond the table is an error."""
    clear, stop = 1 << least, (1 << least) + 1
    widths, starts = (_WIDTHS, _STARTS) if least == 8 else _schedule(least)
    b = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    triple = b[:-2] | b[1:-1] << 8 | b[2:] << 16
    total, at = 8 * len(stream), 0
    alphabet = [bytes([i]) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    known, prev = alphabet.copy(), b""
    since = made = 0  # codes since the last clear, and samples so far
    while at < total and made < most:
        if since < _FULL:
            place, width = at + starts[since:] - starts[since], widths[since:]
        else:
            place, width = at + 12 * np.arange(_FULL), np.full(_FULL, 12)
        n = int(np.searchsorted(place + width, total, "right"))
        if not n:
            break
        codes = triple[place[:n] >> 3] >> (place[:n] & 7) & ((1 << width[:n]) - 1)
        marks = np.flatnonzero((codes == clear) | (codes == stop))
        m = int(marks[0]) if len(marks) else n
        for c in codes[:m].tolist():
            if c < len(known):
                e = known[c]
            elif prev and c == len(known):
                e = prev + prev[:1]
            else:
                raise ValueError("a code beyond the table")
            if prev and len(known) < _FULL:
                known.append(prev + e[:1])
            out.append(e)
            prev = e
        made += sum(map(len, out[len(out) - m :]))
        if m < n and codes[m] == stop:
            break
        if m < n:
            at = int(place[m] + width[m])
            known, prev, since = alphabet.copy(), b"", 0
        else:
            at, since = int(place[n - 1] + width[n - 1]), since + n
    return b"".join(out)


def _blocks(data: bytes) -> bytes:
    return b"".join([bytes([len(x := data[i : i + 255])]) + x for i in range(0, len(data), 255)]) + b"\0"


def encode(payload: bytes) -> bytes:
    """A GIF of WIDTH samples a row, whose frames' samples are the payload."""
    rows = len(payload) // WIDTH
    grey = bytes(np.repeat(np.arange(256, dtype=np.uint8), 3))
    out = [b"GIF89a" + struct.pack("<HHBBB", WIDTH, min(rows, FRAME_ROWS), 0xF7, 0, 0) + grey]
    for top in range(0, rows, FRAME_ROWS):
        part = payload[top * WIDTH : (top + FRAME_ROWS) * WIDTH]
        out.append(b"!\xf9\x04" + struct.pack("<BHB", 1 << 2, DELAY, 0) + b"\0")
        out.append(b"," + struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0) + b"\x08" + _blocks(lzw(part)))
    return b"".join(out) + b";"


def _unblocked(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    if not flags & 0x80:
        return None, at
    n = 2 << (flags & 7)
    return np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n


def decode(data: bytes) -> Iterator[dict]:
    """The frames one by one: samples (indices, rows by columns), palette, drawn (the samples that show), canvas (RGBA after drawing, the same array for all frames), at_ms and ms.

    A canvas or frame of more than PIXELS pixels is an error, so a few bytes can't ask for more memory than that.
    """
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    shared, at = _palette(data, 13, flags)
    if width * height > PIXELS:
        raise ValueError("a canvas beyond the bound")
    canvas = np.zeros((height, width, 4), np.uint8)
    disposal, delay, clear_index, clock = 0, 0, None, 0
    while at < len(data) and (kind := data[at]) != 0x3B:
        at += 1
        if kind == 0x21:
            label = data[at]
            body, at = _unblocked(data, at + 1)
            if label == 0xF9:
                f, delay, index = struct.unpack("<BHB", body[:4])
                disposal, clear_index = f >> 2 & 7, index if f & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError("an unknown block")
        x, y, w, h, f = struct.unpack_from("<HHHHB", data, at)
        if w * h > PIXELS:
            raise ValueError("a frame beyond the bound")
        own, at = _palette(data, at + 9, f)
        palette = shared if own is None else own
        if palette is None:
            raise ValueError("no palette")
        stream, at = _unblocked(data, at + 1) if (least := data[at]) < 12 else (b"", len(data))
        flat = np.frombuffer(unlzw(stream, least, w * h), np.uint8)[: w * h]
        samples = np.concatenate([flat, np.zeros(w * h - len(flat), np.uint8)]).reshape(h, w)
        if f & 0x40:
            rows = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
            samples = samples[np.argsort(rows)]
        before = canvas.copy() if disposal == 3 else None
        area = canvas[y : y + h, x : x + w]
        shown = samples[: area.shape[0], : area.shape[1]]
        paint = np.concatenate([palette, np.full((len(palette), 1), 255, np.uint8)], axis=1)
        paint = np.concatenate([paint, np.repeat(paint[-1:], 256 - len(paint), axis=0)])
        if clear_index is None:
            drawn = shown
            area[:] = paint[shown]
        else:
            seen = shown != clear_index
            drawn = shown[seen]
            area[seen] = paint[drawn]
        yield {"samples": samples, "palette": palette, "drawn": drawn, "canvas": canvas, "at_ms": clock, "ms": 10 * delay, "disposal": disposal}
        if disposal == 2:
            area[:] = 0
        elif before is not None:
            canvas = before
        clock += 10 * delay
        disposal, delay, clear_index = 0, 0, None


def histogram(frame: dict, bins: int = 4) -> np.ndarray:
    """Counts of the samples that the frame draws, transparent ones left out, by colour, bins a channel."""
    n = np.bincount(frame["drawn"].ravel(), minlength=256)
    p = frame["palette"].astype(np.int64) * bins // 256
    cell = (p[:, 0] * bins + p[:, 1]) * bins + p[:, 2]
    return np.bincount(cell, weights=n[: len(cell)], minlength=bins**3).astype(np.int64)


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b" " * (-len(raw) % WIDTH if raw else WIDTH)


class Features:
    """What a GIF's frames show, summed up frame by frame."""

    def __init__(self) -> None:
        self.frames = self.ms = 0
        self.grey, self.red, self.colour = np.zeros(16, np.int64), np.zeros(16, np.int64), np.zeros(64, np.int64)

    def add(self, frame: dict) -> None:
        canvas = frame["canvas"]
        self.frames += 1
        self.ms = frame["at_ms"] + frame["ms"]
        self.grey += np.bincount(frame["drawn"].ravel() >> 4, minlength=16)
        self.red += np.bincount(canvas[..., 0].ravel()[canvas[..., 3].ravel() == 255] >> 4, minlength=16)
        self.colour += histogram(frame)

    def __str__(self) -> str:
        """Frames, their time, the drawn samples by sixteenth, the composed canvases' visible pixels by red, and the drawn samples by colour cell."""
        cells = ",".join(f"{i}:{self.colour[i]}" for i in np.flatnonzero(self.colour).tolist())
        return f"frames={self.frames};ms={self.ms};grey={','.join(map(str, self.grey))};shown={','.join(map(str, self.red))};colour={cells}"


def stored_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the GIF of each row, with its frames' times and colour histograms."""

    def run(b: pa.RecordBatch) -> dict:
        media = [encode(padded(x)[1]) for x in b.column(1).to_pylist()]
        told = [[(f["at_ms"], histogram(f)) for f in decode(x)] for x in media]
        return {"doc_id": b.column(0), "media": media, "frame_ms": [[at for at, _ in x] for x in told], "colours": [np.concatenate([h for _, h in x]).tolist() for x in told]}

    return map_batches(docs.select(doc_id, text), run, "doc_id long, media binary, frame_ms array<long>, colours array<long>")


_FRAME = "id long, frame int, at_ms long, ms long, width int, height int, canvas binary, colours array<long>, error string"


def frames(df: DataFrame, media_id: str, media: str) -> DataFrame:
    """A row for each frame of a column of GIFs: its canvas (RGBA) after drawing, its time, and the drawn samples by colour. What can't be decoded, or asks for more than PIXELS, gives an error row after the frames before it."""
    schema = arrow_schema(_FRAME)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entered()
        for b in batches:
            for own, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                k = 0
                try:
                    for k, f in enumerate(decode(data) if data is not None else (), 1):
                        h, w, _ = f["canvas"].shape
                        yield as_batch(dict(zip(schema.names, [[x] for x in (own, k - 1, f["at_ms"], f["ms"], w, h, f["canvas"].tobytes(), histogram(f).tolist(), None)], strict=True)), schema)
                except (ValueError, IndexError, struct.error) as e:
                    yield as_batch(dict(zip(schema.names, [[x] for x in (own, *[None] * 7, str(e)[:200])], strict=True)), schema)
        give_back()

    return df.select(media_id, media).mapInArrow(run, _FRAME)


_ROW = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digested(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The digests of each row's GIF and of the payload that its decoded frames give back."""

    def run(b: pa.RecordBatch) -> dict:
        out: list[tuple] = []
        for x in b.column(1).to_pylist():
            n, payload = padded(x)
            media = encode(payload)
            told, back, size, tail = Features(), hashlib.sha256(), 0, b""
            for f in decode(media):
                part = f["samples"].tobytes()
                told.add(f)
                back.update(part)
                size, tail = size + len(part), (tail + part[-16:])[-16:]
            out.append((n, size, back.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), str(told)))
        return {"doc_id": b.column(0)} | dict(zip([c.split()[0] for c in _ROW.split(", ")][1:], map(list, zip(*out, strict=True)), strict=True))

    return map_batches(docs.select(doc_id, text), run, _ROW)


def op9_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract of op9: every text of documents through a GIF and back."""
    arrow_settings(spark)
    return digested(table(spark, sf_dir, "documents"))
