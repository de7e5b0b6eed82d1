"""Media columns: Netpbm and BMP images as numpy arrays, area-resized by integral images, kept as NPY tiles.

`text_media` stores a text's bytes losslessly as an image, reads the stored bytes back and computes a difference
hash; `tiles` decodes a column of images and writes their resized tiles.

Defined results: a null text counts as empty and is stored as one block of padding; equal texts, so repeated rows, give
equal values; a text of any length is stored whole; samples that are equally bright give a 0 bit; an image that cannot be
read gives a row with its error and null tile; an empty table gives an empty table; only the id and text (or image)
columns are read, so extra columns of any name do not clash.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes to a block of payload: 24 x 24 grey samples or 24 x 8 colours.
BLOCK, WIDTH = 576, 24
TILE = 16


def encode_pgm(a: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (a.shape[1], a.shape[0]) + a.tobytes()


def encode_ppm(a: np.ndarray) -> bytes:
    return b"P6\n%d %d\n255\n" % (a.shape[1], a.shape[0]) + a.tobytes()


def encode_bmp(a: np.ndarray) -> bytes:
    """24-bit, bottom row first, blue first, rows padded to four bytes."""
    h, w = a.shape[:2]
    rows = np.zeros((h, -(-w * 3 // 4) * 4), np.uint8)
    rows[:, : w * 3] = a[::-1, :, ::-1].reshape(h, w * 3)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + rows.size, 0, 0, 54, 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def _numbers(data: bytes, at: int, count: int) -> tuple[list[int], int]:
    """Header numbers of a Netpbm file; comments run from # to the end of the line."""
    out = []
    while len(out) < count:
        m = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)").match(data, at)
        if not m:
            raise ValueError("a Netpbm header lacks a number")
        out.append(int(m[1]))
        at = m.end()
    return out, at


def decode(data: bytes) -> np.ndarray:
    """P1 to P6 and BMP of 8 (palette), 24 or 32 bits as height x width (x 3) samples of 8 bits."""
    if data[:2] == b"BM":
        start, size, w, h, _, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
        if packing or bits not in (8, 24, 32) or w <= 0 or h == 0:
            raise ValueError("this kind of BMP is not read")
        step = -(-w * bits // 32) * 4
        rows = np.frombuffer(data, np.uint8, step * abs(h), start).reshape(abs(h), step)[:, : w * bits // 8]
        rows = rows if h < 0 else rows[::-1]
        if bits == 8:
            palette = np.frombuffer(data, np.uint8, start - 14 - size, 14 + size).reshape(-1, 4)[:, 2::-1]
            return palette[rows]
        return rows.reshape(abs(h), w, bits // 8)[:, :, 2::-1]
    if data[:1] != b"P" or data[1:2] not in b"123456" or len(data) < 3:
        raise ValueError("neither Netpbm nor BMP")
    kind = data[1] - 48
    (w, h, *top), at = _numbers(data, 2, 2 if kind in (1, 4) else 3)
    top = top[0] if top else 1
    if not (w and h and 0 < top < 65536):
        raise ValueError("a Netpbm header has a bad number")
    shape = (h, w, 3) if kind in (3, 6) else (h, w)
    n = w * h * (3 if kind in (3, 6) else 1)
    if kind == 4:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, -(-w // 8) * h, at + 1).reshape(h, -1), axis=1)[:, :w]
        return (1 - bits) * np.uint8(255)
    if kind > 4:
        flat = np.frombuffer(data, ">u2" if top > 255 else np.uint8, n, at + 1)
    elif kind == 1:
        flat = 1 - np.frombuffer(re.sub(rb"#[^\n]*|\s", b"", data[at:])[:n], np.uint8).astype(np.int64) + 48
    else:
        flat = np.array(re.sub(rb"#[^\n]*", b"", data[at:]).split()[:n], np.int64)
    if len(flat) < n:
        raise ValueError("a Netpbm image ends early")
    return (flat if top == 255 else flat.astype(np.int64) * 255 // top).astype(np.uint8).reshape(shape)


def grey(a: np.ndarray) -> np.ndarray:
    if a.ndim == 2:
        return a
    return ((a[:, :, 0].astype(np.uint32) * 299 + a[:, :, 1].astype(np.uint32) * 587 + a[:, :, 2].astype(np.uint32) * 114) // 1000).astype(np.uint8)


def integral_lines(a: np.ndarray, height: int) -> np.ndarray:
    """The integral image of a at the height + 1 borders between target rows: sums of all samples above and to the left.

    Only these lines of it are made, from the sums of the bands of rows between them, so its memory does not grow with
    the height of the image.
    """
    h, w = a.shape
    ys = np.arange(height + 1) * (h / height)
    whole = np.minimum(ys.astype(np.int64), h - 1)
    cuts, at = np.unique(whole, return_inverse=True)
    above = np.zeros((len(cuts), w), np.int64)
    np.cumsum(np.add.reduceat(a, cuts, axis=0, dtype=np.int64)[:-1], 0, out=above[1:])
    out = np.zeros((height + 1, w + 1))
    np.cumsum(above[at] + a[whole] * (ys - whole)[:, None], 1, out=out[:, 1:])
    return out


def area_means(lines: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over the source area of each target sample, from integral lines of an image of that height."""
    w = lines.shape[1] - 1
    xs = np.arange(width + 1) * (w / width)
    left = np.minimum(xs.astype(np.int64), w - 1)
    corners = lines[:, left] + (lines[:, left + 1] - lines[:, left]) * (xs - left)
    return np.diff(np.diff(corners, axis=0), axis=1) * ((len(lines) - 1) * width / (height * w))


def area_resize(a: np.ndarray, height: int, width: int) -> np.ndarray:
    return area_means(integral_lines(a, height), len(a), width)


def difference_bits(means: np.ndarray) -> str:
    """64 bits: whether a sample of the 8 x 9 means is brighter than its left neighbour."""
    s = np.round(means, 6)
    return np.packbits(s[:, 1:] > s[:, :-1]).tobytes().hex()


def difference_hash(a: np.ndarray) -> str:
    return difference_bits(area_resize(grey(a), 8, 9))


def tile_and_hash(a: np.ndarray) -> tuple[bytes, str]:
    """The TILE x TILE tile as an NPY file, and the difference hash, from one integral image: every second of the tile's
    lines is one of the hash's."""
    lines = integral_lines(grey(a), TILE)
    return tile_file(area_means(lines, len(a), TILE)), difference_bits(area_means(lines[:: TILE // 8], len(a), 9))


def npy(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, a, allow_pickle=False)
    return out.getvalue()


def tile_file(means: np.ndarray) -> bytes:
    """Means as 8-bit samples in an NPY file."""
    return npy(np.clip(np.floor(means + 0.5), 0, 255).astype(np.uint8))


def tile_of(a: np.ndarray, size: int = TILE) -> bytes:
    """The image resized to size x size grey samples, as an NPY file."""
    return tile_file(area_resize(grey(a), size, size))


def store(payload: bytes) -> bytes:
    """A payload of whole blocks as an image: grey, colour or BMP in turn, by its number of blocks."""
    flat, turn = np.frombuffer(payload, np.uint8), len(payload) // BLOCK % 3
    if turn == 1:
        return encode_pgm(flat.reshape(-1, WIDTH))
    return (encode_bmp if turn else encode_ppm)(flat.reshape(-1, WIDTH, 3))


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature; with keep also the
    stored image (media) and its tile (npy). The feature holds format, size, difference hash and the tile's digest."""
    source = docs.select(id_col, text_col)
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def row(text: str | None) -> tuple:
        raw = (text or "").encode()
        blocks = max(1, -(-len(raw) // BLOCK))
        media = store(raw + b"\xff" * (blocks * BLOCK - len(raw)))
        image = decode(media)
        back = np.ascontiguousarray(image).tobytes()
        tile, bits = tile_and_hash(image)
        feature = f"{media[:2].decode()}:{image.shape[1]}x{image.shape[0]}:{bits}:{hashlib.sha256(tile).hexdigest()[:16]}"
        out = (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature)
        return (*out, media, tile) if keep else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, heads = kinds + [pa.binary()] * (2 * keep), names + ["media", "npy"] * keep
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = [row(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True))], [id_col, *heads])

    extra = ", media binary, npy binary" if keep else ""
    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string{extra}")


def tiles(images: DataFrame, id_col: str, image_col: str, size: int = TILE) -> DataFrame:
    """id, width, height, npy (the tile), dhash, error of a column of Netpbm or BMP images."""
    source = images.select(id_col, image_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                try:
                    a = decode(b.column(1)[k].as_py() or b"")
                    got = (a.shape[1], a.shape[0], tile_of(a, size), difference_hash(a), None)
                except (ValueError, struct.error) as e:
                    got = (None, None, None, None, str(e))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), *(pa.array([v], t) for v, t in zip(got, (pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()), strict=True))], [id_col, "width", "height", "npy", "dhash", "error"])

    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, width int, height int, npy binary, dhash string, error string")
