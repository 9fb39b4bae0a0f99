"""Media columns: PNG images in binary columns, written and read chunk by chunk, and low-frequency cosine hashes.

A payload of bytes is stored without loss as the pixels of an 8-bit RGB image WIDTH pixels wide; it is padded with
blanks to a positive multiple of a row's 3 * WIDTH bytes.  Each row has the filter (none, sub or up) with the smallest
sum of absolute differences.  The reader tests the signature, each chunk's checksum, the sizes and the order of
chunks, inflates the image data and undoes all five filters in numpy; a damaged image is an error that names its
fault.  The feature is the 64-bit hash of the signs of the lowest 8 x 8 cosine coefficients of the image's luminance,
averaged down to 32 x 32, against their median.

Null texts count as empty; an empty payload is one row of blanks.  Equal texts have equal columns.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.shared import arrow_map, blocks, table

WIDTH, CHANNELS = 64, 3
STRIDE = WIDTH * CHANNELS
LEVEL = 6
#: Image data that one IDAT chunk holds.
CHUNK = 1 << 20
#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
COLOUR_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
SIDE, LOW = 32, 8


def padded(payload: bytes) -> bytes:
    size = max(STRIDE, -(-len(payload) // STRIDE) * STRIDE)
    return payload.ljust(size, b" ")


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(payload: bytes) -> bytes:
    """The PNG of a payload whose size is a positive multiple of STRIDE."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, STRIDE)
    sub = rows.copy()
    sub[:, CHANNELS:] -= rows[:, :-CHANNELS]
    up = rows.copy()
    up[1:] -= rows[:-1]
    kinds = np.stack((rows, sub, up))
    cost = np.minimum(kinds, 256 - kinds.astype(np.int16)).sum(axis=2)
    best = np.argmin(cost, axis=0)
    out = np.empty((len(rows), STRIDE + 1), np.uint8)
    out[:, 0] = best
    out[:, 1:] = kinds[best, np.arange(len(rows))]
    data = zlib.compress(out.tobytes(), LEVEL)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    return b"".join([SIGNATURE, chunk(b"IHDR", head), *(chunk(b"IDAT", data[i : i + CHUNK]) for i in range(0, len(data), CHUNK)), chunk(b"IEND", b"")])


def chunks(image: bytes) -> Iterator[tuple[bytes, bytes]]:
    if image[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at = 8
    while at < len(image):
        if at + 12 > len(image):
            raise ValueError(f"a chunk is cut off at {at}")
        size, kind = struct.unpack(">I4s", image[at : at + 8])
        data = image[at + 8 : at + 8 + size]
        if len(data) < size or len(image) < at + 12 + size:
            raise ValueError(f"a chunk is cut off at {at}")
        if zlib.crc32(kind + data) != struct.unpack(">I", image[at + 8 + size : at + 12 + size])[0]:
            raise ValueError(f"the chunk at {at} fails its checksum")
        yield kind, data
        at += 12 + size
        if kind == b"IEND":
            if at != len(image):
                raise ValueError("bytes follow the last chunk")
            return
    raise ValueError("no last chunk")


def paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    p = a + b - c
    pa_, pb, pc = np.abs(p - a), np.abs(p - b), np.abs(p - c)
    return np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))


def unfiltered(data: np.ndarray, pixel: int) -> np.ndarray:
    """The samples [rows, bytes] of the filtered rows [rows, 1 + bytes]; runs of one filter are undone at once where it allows."""
    kind, rows = data[:, 0], data[:, 1:].copy()
    if len(kind) and kind.max() > 4:
        raise ValueError("an unknown filter")
    n, width = rows.shape
    sub = kind == 1
    if sub.any():
        rows[sub] = np.cumsum(rows[sub].reshape(-1, width // pixel, pixel), axis=1, dtype=np.uint8).reshape(-1, width)
    edges = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1], [True]))) if n else np.zeros(1, int)
    for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if kind[begin] == 2:
            if begin:
                rows[begin] += rows[begin - 1]
            rows[begin:end] = np.cumsum(rows[begin:end], axis=0, dtype=np.uint8)
        elif kind[begin] >= 3:
            for y in range(begin, end):
                above = rows[y - 1].astype(np.int16) if y else np.zeros(width, np.int16)
                left, corner = np.zeros(pixel, np.int16), np.zeros(pixel, np.int16)
                for x in range(0, width, pixel):
                    b = above[x : x + pixel]
                    guess = (left + b) // 2 if kind[begin] == 3 else paeth(left, b, corner)
                    left = (rows[y, x : x + pixel] + guess) % 256
                    rows[y, x : x + pixel] = left
                    corner = b
    return rows


def pixels(image: bytes) -> np.ndarray:
    """The samples [height, width, channels] of an 8-bit PNG without palette or interlace."""
    found = list(chunks(image))
    if not found or found[0][0] != b"IHDR" or len(found[0][1]) != 13:
        raise ValueError("no header chunk")
    width, height, depth, colour, packing, filtering, interlace = struct.unpack(">IIBBBBB", found[0][1])
    if depth != 8 or colour not in COLOUR_CHANNELS or packing or filtering or interlace:
        raise ValueError("a kind of PNG that is not read")
    pixel = COLOUR_CHANNELS[colour]
    places = [i for i, (k, _) in enumerate(found) if k == b"IDAT"]
    if not places or places[-1] - places[0] + 1 != len(places):
        raise ValueError("the image data is missing or not in a row")
    raw = zlib.decompress(b"".join(d for k, d in found if k == b"IDAT"))
    if len(raw) != height * (1 + width * pixel):
        raise ValueError("the image data has another size than the header says")
    return unfiltered(np.frombuffer(raw, np.uint8).reshape(height, 1 + width * pixel), pixel).reshape(height, width, pixel)


@cache
def cosines() -> np.ndarray:
    """The lowest LOW rows of the type-II cosine transform of SIDE values."""
    k, x = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * SIDE)) * np.where(k == 0, np.sqrt(1 / SIDE), np.sqrt(2 / SIDE))


def averaged(grey: np.ndarray, side: int = SIDE) -> np.ndarray:
    """The image averaged down (or repeated up) to side x side."""
    for axis in (0, 1):
        n = grey.shape[axis]
        if n >= side:
            cuts = np.arange(side) * n // side
            sizes = np.diff(np.append(cuts, n))
            grey = np.add.reduceat(grey, cuts, axis=axis) / (sizes[:, None] if axis == 0 else sizes[None, :])
        else:
            grey = np.take(grey, np.arange(side) * n // side, axis=axis)
    return grey


def cosine_hash(samples: np.ndarray) -> str:
    weights = np.array([0.299, 0.587, 0.114]) if samples.shape[2] >= 3 else np.ones(1)
    grey = averaged(samples[:, :, : len(weights)] @ weights)
    low = np.round(cosines() @ grey @ cosines().T, 6).ravel()
    bits = low > np.median(low[1:])
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"


def stored(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (binary PNG)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for ids, texts in blocks(batches):
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
            yield {"doc_id": ids, "n_bytes": [len(x) for x in raw], "media": [png(padded(x)) for x in raw]}

    return arrow_map(docs.select(F.col(id_).cast("bigint").alias("doc_id"), F.col(text).alias("text")), work, "doc_id bigint, n_bytes bigint, media binary")


def features(media: DataFrame) -> DataFrame:
    """What the stored bytes of rows (doc_id, n_bytes, media) say, read back from them alone."""
    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"

    def one(image: bytes) -> tuple:
        samples = pixels(image)
        payload = samples.tobytes()
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest(), cosine_hash(samples)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = [one(x.as_py()) for x in part.column(2)]
                yield {"doc_id": part.column(0), "n_bytes": part.column(1), **{name: list(x) for name, x in zip(("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"), zip(*found, strict=True), strict=True)}}

    return arrow_map(media.select("doc_id", "n_bytes", "media"), work, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(stored(table(spark, sf_dir, "documents")))
