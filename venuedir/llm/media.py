"""Netpbm and BMP media columns: decoding, integral-image resizing, NPY tiles, difference hashes.

Images are bytes in a column. Decoding gives numpy arrays of 8-bit samples; a resized tile
is the mean over exact pixel areas, read from an integral image in one pass whatever the
scale; tiles are stored as NPY bytes, and hashes compare neighbouring cells of a 9 x 8 tile.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from venuedir.llm.common import scratch, slices, table, utf8

#: Width of payload images; payloads are padded to a multiple of it.
WIDTH = 64
TILE = 16

_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([0-9]+)")


class BadImage(ValueError):
    """Bytes that are no complete image of a known format."""


# --- formats ------------------------------------------------------------------


def encode_pgm(samples: np.ndarray) -> bytes:
    """Binary greymap (P5) or pixmap (P6) of an ``(h, w)`` or ``(h, w, 3)`` array of 8-bit samples."""
    kind = b"P5" if samples.ndim == 2 else b"P6"
    return b"%s\n%d %d\n255\n" % (kind, samples.shape[1], samples.shape[0]) + samples.astype(np.uint8).tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """Uncompressed BMP: 8 bits with a grey palette, or 24 bits; rows bottom-up, padded to four bytes."""
    h, w = samples.shape[:2]
    grey = samples.ndim == 2
    rows = samples[::-1].astype(np.uint8) if grey else samples[::-1, :, ::-1].astype(np.uint8).reshape(h, 3 * w)
    stride = (rows.shape[1] + 3) // 4 * 4
    body = np.zeros((h, stride), np.uint8)
    body[:, : rows.shape[1]] = rows
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4).copy() if grey else np.zeros((0, 4), np.uint8)
    palette[:, 3:] = 0
    start = 54 + palette.size
    head = b"BM" + np.array([start + body.size, 0, start, 40], "<u4").tobytes()
    head += np.array([w, h], "<i4").tobytes() + np.array([1, 8 if grey else 24], "<u2").tobytes()
    head += np.array([0, body.size, 2835, 2835, 256 if grey else 0, 0], "<u4").tobytes()
    return head + palette.tobytes() + body.tobytes()


def _netpbm(raw: bytes) -> np.ndarray:
    kind = raw[1] - 48
    at, numbers = 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        m = _TOKEN.match(raw, at)
        if not m:
            raise BadImage("header")
        numbers.append(int(m[1]))
        at = m.end()
    w, h = numbers[:2]
    top = numbers[2] if len(numbers) == 3 else 1
    if w < 1 or h < 1 or not 1 <= top <= 65535:
        raise BadImage("size")
    depth = 3 if kind in (3, 6) else 1
    need = w * h * depth
    if kind == 1:
        digits = re.sub(rb"#[^\n]*\n|\s", b"", raw[at:])[:need]
        values = np.frombuffer(digits, np.uint8).astype(np.int64) - 48
    elif kind in (2, 3):
        values = np.array(re.sub(rb"#[^\n]*\n", b" ", raw[at:]).split()[:need], dtype="S").astype(np.int64)
    elif kind == 4:
        stride = (w + 7) // 8
        body = np.frombuffer(raw, np.uint8, min(stride * h, len(raw) - at - 1), at + 1)
        if len(body) < stride * h:
            raise BadImage("short")
        values = np.unpackbits(body.reshape(h, stride), axis=1)[:, :w].ravel().astype(np.int64)
    else:
        unit = np.dtype(">u2" if top > 255 else np.uint8)
        if len(raw) < at + 1 + need * unit.itemsize:
            raise BadImage("short")
        values = np.frombuffer(raw, unit, need, at + 1)
    if len(values) < need or values.size and (int(values.min()) < 0 or int(values.max()) > top):
        raise BadImage("samples")
    if kind in (1, 4):
        values = (1 - values) * 255
    elif top != 255:
        values = (values.astype(np.int64) * 255 + top // 2) // top
    out = values.astype(np.uint8)
    return out.reshape(h, w, 3) if depth == 3 else out.reshape(h, w)


def _bmp(raw: bytes) -> np.ndarray:
    if len(raw) < 54:
        raise BadImage("header")
    u32 = lambda at: int.from_bytes(raw[at:at + 4], "little")
    i32 = lambda at: int.from_bytes(raw[at:at + 4], "little", signed=True)
    start, head, w, h = u32(10), u32(14), i32(18), i32(22)
    bits, packing, colours = int.from_bytes(raw[28:30], "little"), u32(30), u32(46)
    if w < 1 or h == 0 or packing or bits not in (1, 4, 8, 24, 32):
        raise BadImage("kind")
    stride = (w * bits + 31) // 32 * 4
    if len(raw) < start + stride * abs(h):
        raise BadImage("short")
    body = np.frombuffer(raw, np.uint8, stride * abs(h), start).reshape(abs(h), stride)
    body = body[::-1] if h > 0 else body
    if bits >= 24:
        return body[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1].copy()
    per = 8 // bits
    index = np.stack([body >> (8 - bits * (k + 1)) & ((1 << bits) - 1) for k in range(per)], 2).reshape(abs(h), -1)[:, :w]
    count = colours or 1 << bits
    table_ = np.frombuffer(raw, np.uint8, min(4 * count, len(raw) - 14 - head) // 4 * 4, 14 + head).reshape(-1, 4)
    if index.size and int(index.max()) >= len(table_):
        raise BadImage("palette")
    rgb = table_[:, 2::-1][index]
    grey = (rgb[:, :, 0] == rgb[:, :, 1]).all() and (rgb[:, :, 1] == rgb[:, :, 2]).all()
    return rgb[:, :, 0].copy() if grey else rgb


def decode(raw: bytes) -> np.ndarray:
    """Samples of a Netpbm (P1-P6) or uncompressed BMP image: ``(h, w)`` or ``(h, w, 3)``, 8 bits."""
    if len(raw) > 2 and raw[:1] == b"P" and raw[1] in b"123456":
        return _netpbm(raw)
    if raw[:2] == b"BM":
        return _bmp(raw)
    raise BadImage("format")


# --- resizing and features ----------------------------------------------------


def area_resize(samples: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over exact pixel areas, rounded half up, from one integral image; larger or smaller."""
    h, w = samples.shape[:2]
    planes = samples.reshape(h, w, -1)
    total = np.zeros((h + 1, w + 1, planes.shape[2]))
    np.cumsum(planes, axis=0, out=total[1:, 1:], dtype=np.float64)
    np.cumsum(total[1:, 1:], axis=1, out=total[1:, 1:])

    def between(table_: np.ndarray, n: int, parts: int) -> np.ndarray:
        """Rows of the integral image at the fractional borders of ``parts`` cells."""
        at = np.arange(parts + 1) * n / parts
        low = np.minimum(at.astype(int), n - 1)
        return table_[low] + (at - low)[:, None, None] * (table_[low + 1] - table_[low])

    cut = between(total, h, height).swapaxes(0, 1)
    cut = between(cut, w, width).swapaxes(0, 1)
    sums = cut[1:, 1:] - cut[:-1, 1:] - cut[1:, :-1] + cut[:-1, :-1]
    out = np.clip(np.floor(sums / (h * w / (height * width)) + 0.5), 0, 255).astype(np.uint8)
    return out.reshape(height, width, *samples.shape[2:])


def difference_hash(samples: np.ndarray) -> str:
    """64 bits as hex: whether each cell of a 9 x 8 grey tile is darker than its right neighbour."""
    grey = samples if samples.ndim == 2 else (samples.astype(np.int64) @ np.array([299, 587, 114]) // 1000)
    small = area_resize(grey.astype(np.uint8), 8, 9)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_tile(samples: np.ndarray, height: int = TILE, width: int = TILE) -> bytes:
    """The resized image as a NPY file."""
    out = io.BytesIO()
    np.save(out, area_resize(samples, height, width), allow_pickle=False)
    return out.getvalue()


# --- columns ------------------------------------------------------------------

IMAGE_FEATURES = "key {kind}, height int, width int, depth int, dhash string, tile binary, error string"


def image_features(media: DataFrame, key: str, image: str = "image", height: int = TILE,
                   width: int = TILE, stored: bool = False) -> DataFrame:
    """``(key, height, width, depth, dhash, tile, error)`` per row; broken or NULL images carry a reason.

    With ``stored`` the columns ``image`` and ``n_bytes`` go along, so that images, tiles and hashes are one table.
    """
    beside = ["image", "n_bytes"] if stored else []
    rows = media.select(F.col(key).alias("key"), F.col(image).alias("image"), *beside[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "image"):
            found = []
            for raw in part.column("image").to_pylist():
                try:
                    x = decode(raw or b"")
                    found.append((*x.shape[:2], 1 if x.ndim == 2 else 3, difference_hash(x), npy_tile(x, height, width), None))
                except BadImage as e:
                    found.append((None, None, None, None, None, str(e)))
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.string()]
            columns = [pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), *columns, *[part.column(c) for c in beside]],
                ["key", "height", "width", "depth", "dhash", "tile", "error", *beside])

    kind = rows.schema["key"].dataType.simpleString()
    schema = IMAGE_FEATURES.format(kind=kind) + (", image binary, n_bytes long" if stored else "")
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def text_images(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH,
                bmp: bool = False) -> DataFrame:
    """``(key, n_bytes, image)``: each whole text as the samples of a grey image, padded with zero bytes."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, offsets = utf8(part.column("text"))
            images = []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                samples = np.zeros(max(width, -(-(b - a) // width) * width), np.uint8)
                samples[: b - a] = data[a:b]
                images.append((encode_bmp if bmp else encode_pgm)(samples.reshape(-1, width)))
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), pa.array(np.diff(offsets), pa.int64()), pa.array(images, pa.binary())],
                ["key", "n_bytes", "image"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, n_bytes long, image binary").withColumnRenamed("key", key)


STORED = ("key {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
          "media_bytes long, media_sha256 string, feature string")


def stored_features(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """What a stored table of images, tiles and hashes holds: payload and file sums, hash and tile as one string.

    ``feature`` is read off the stored columns; the tile must be a NPY file, else the row fails.
    """
    rows = media.select(F.col(key).alias("key"), "n_bytes", "image", "dhash", "tile")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "image"):
            out = []
            for raw, dhash, tile in zip(*[part.column(c).to_pylist() for c in ("image", "dhash", "tile")], strict=True):
                payload = decode(raw).tobytes()
                cells = np.load(io.BytesIO(tile), allow_pickle=False)
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(raw),
                            hashlib.sha256(raw).hexdigest(), f"dhash={dhash};npy={hashlib.sha256(cells.tobytes()).hexdigest()}"))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), part.column("n_bytes"), *columns],
                ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, STORED.format(kind=kind)).withColumnRenamed("key", key)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a greymap with its NPY tile and difference hash, read back and described."""
    path = scratch(spark, "media")
    images = text_images(table(spark, sf_dir, "documents"))
    image_features(images, "doc_id", stored=True).write.option("compression", "zstd").parquet(path)
    return stored_features(spark.read.parquet(path))
