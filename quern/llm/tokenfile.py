"""Token ids in zstandard files of independent frames with a trailing seek table.

A file holds the documents of one range of ids, in ascending order (null ids first, equal ids by their text's hash).
Each document's ids are one frame, or several of FRAME_IDS ids; a frame is little-endian 16- or 32-bit integers.
Behind them stand two skippable frames that any zstandard reader passes over: the document index, and the seek table
of the public seekable format, with each frame's sizes and the lower 32 bits of the XXH64 of its content.  A reader
finds a document through both and decompresses its frames only; a frame that fails its checksum is an error.

Null texts count as empty: such a document has the end id alone.  An empty table makes no file.
A file's name is its writer's own; the manifest, a table that Spark commits, names those of the tasks that succeeded.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import bpe
from quern.llm.shared import arrow_map, blocks, scratch, table, written

END_ID = 2
FRAME_IDS = 1 << 20
#: Distinct pieces whose ids a worker remembers, some 200 bytes each.
KNOWN = 1_500_000
LEVEL = 3
#: Fixed values of the public formats: a skippable frame of ours, that of a seek table, and the table's last bytes.
SKIP_MAGIC, TABLE_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
INDEX_MARK = b"QDX1"


class Packed(dict):
    """The ids of pieces as bytes; a missing one is encoded by the library and, unless it is long, kept."""

    def __init__(self, tokenizer, kind: str) -> None:
        self.encode, self.kind = tokenizer.encode_batch_fast, kind

    def __missing__(self, piece: str) -> bytes:
        ids = array(self.kind, self.encode([piece], add_special_tokens=False)[0].ids).tobytes()
        if len(piece) <= bpe.KNOWN_CHARS:
            self[piece] = ids
        return ids


class LibraryEncoder(bpe.Encoder):
    """The tokenizers library's ids, as bytes; it encodes each distinct piece of its pattern once.

    The pattern leaves a piece alone in one piece, and merges never cross pieces, so a text's ids are its pieces' ids.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are parallel already
        from tokenizers import Tokenizer

        super().__init__(bpe.vocabulary(path))
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.width, self.kind = (2, "H") if len(self.voc.bytes) <= 1 << 16 else (4, "I")
        self.packed = Packed(self.tokenizer, self.kind)

    def pack(self, texts: list[str | None]) -> list[bytes]:
        if len(self.packed) > KNOWN:
            self.packed.clear()
        return [b"".join(map(self.packed.__getitem__, self.pieces(t))) if t else b"" for t in texts]


@lru_cache(maxsize=1)
def library_encoder(path: str) -> LibraryEncoder:
    """One for all tasks of a worker."""
    return LibraryEncoder(path)


class FrameWriter:
    """Writes documents one after the other; `close` adds the index and the seek table."""

    def __init__(self, out, width: int) -> None:
        self.out, self.width, self.size, self.tokens = out, width, 0, 0
        self.zstd = zstandard.ZstdCompressor(level=LEVEL)
        self.entries: list[bytes] = []
        self.ids: list[int | None] = []
        self.frames: list[int] = []
        self.counts: list[int] = []

    def frame(self, data: bytes) -> None:
        packed = self.zstd.compress(data)
        self.out.write(packed)
        self.size += len(packed)
        self.entries.append(struct.pack("<III", len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def add(self, doc_id: int | None, data: bytes) -> None:
        """data: the ids, each of `width` bytes."""
        step = FRAME_IDS * self.width
        cuts = range(0, max(1, len(data)), step)
        for i in cuts:
            self.frame(data[i : i + step])
        self.ids.append(doc_id)
        self.frames.append(len(cuts))
        self.counts.append(len(data) // self.width)
        self.tokens += len(data) // self.width

    def close(self) -> None:
        n = len(self.ids)
        index = INDEX_MARK + struct.pack("<BQ", self.width, n)
        index += np.array([i or 0 for i in self.ids], "<i8").tobytes() + np.array([i is None for i in self.ids], "u1").tobytes()
        index += np.array(self.frames, "<u4").tobytes() + np.array(self.counts, "<u8").tobytes()
        self.out.write(struct.pack("<II", SKIP_MAGIC, len(index)) + index)
        self.entries.append(struct.pack("<III", len(index) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        seek = b"".join(self.entries) + struct.pack("<IBI", len(self.entries), 0x80, FOOTER_MAGIC)
        self.out.write(struct.pack("<II", TABLE_MAGIC, len(seek)) + seek)
        self.size += len(index) + len(seek) + 16


class Frame(NamedTuple):
    at: int
    packed: int
    size: int
    check: int


class FrameReader:
    """Reads single documents of a file that can be sought in."""

    def __init__(self, file) -> None:
        self.file = file
        end = file.seek(0, 2)
        n, flags, magic = struct.unpack("<IBI", self.bytes(end - 9, 9))
        if magic != FOOTER_MAGIC or flags != 0x80:
            raise ValueError("no seek table with checksums at the file's end")
        entries = np.frombuffer(self.bytes(end - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        ends = np.cumsum(entries[:, 0])
        self.frames = [Frame(int(e - p), int(p), int(s), int(c)) for e, (p, s, c) in zip(ends, entries, strict=True)]
        last = self.frames.pop()
        index = self.bytes(last.at + 8, last.packed - 8)
        if index[:4] != INDEX_MARK:
            raise ValueError("no document index before the seek table")
        self.width, k = struct.unpack("<BQ", index[4:13])
        at = 13
        self.ids = [None if null else int(i) for i, null in zip(np.frombuffer(index, "<i8", k, at), np.frombuffer(index, "u1", k, at + 8 * k), strict=True)]
        held = np.frombuffer(index, "<u4", k, at + 9 * k).astype(np.int64)
        self.first = np.cumsum(held) - held
        self.held = held
        self.counts = np.frombuffer(index, "<u8", k, at + 13 * k).astype(np.int64)
        self.zstd = zstandard.ZstdDecompressor()

    def bytes(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def document(self, k: int) -> np.ndarray:
        """The ids of the file's document number k."""
        parts = []
        for f in self.frames[self.first[k] : self.first[k] + self.held[k]]:
            data = self.zstd.decompress(self.bytes(f.at, f.packed), max_output_size=f.size) if f.size else b""
            if len(data) != f.size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != f.check:
                raise ValueError(f"the frame at {f.at} is damaged")
            parts.append(np.frombuffer(data, f"<u{self.width}"))
        return np.concatenate(parts)

    def find(self, doc_id: int | None) -> list[int]:
        return [k for k, i in enumerate(self.ids) if i == doc_id]


def opened(uri: str):
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int | None = END_ID, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes a file a range of ids under folder (a URI); returns the manifest (part, path, docs, tokens, bytes)."""
    path = path or bpe.default_vocabulary()
    rows = docs.select(F.col(id_).cast("bigint").alias("id"), F.col(text).alias("text")).withColumn("hash", F.xxhash64("text"))
    rows = rows.repartitionByRange("id", "hash").sortWithinPartitions("id", "hash", "text").select("id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        encoder = library_encoder(path)
        end = b"" if end_id is None else end_id.to_bytes(encoder.width, "little")
        part = TaskContext.get().partitionId()
        name, writer, out = f"{folder}/ids-{part:06d}-{uuid.uuid4().hex}.zst", None, None
        for ids, texts in blocks(batches):
            if writer is None:
                system, at = fs.FileSystem.from_uri(name)
                system.create_dir(at.rpartition("/")[0], recursive=True)
                out = system.open_output_stream(at, compression=None)
                writer = FrameWriter(out, encoder.width)
            for i, x in zip(ids, encoder.pack(texts), strict=True):
                writer.add(i, x + end)
        if writer is not None:
            writer.close()
            out.close()
            yield {"part": [part], "path": [name], "docs": [len(writer.ids)], "tokens": [writer.tokens], "bytes": [writer.size]}

    return written(arrow_map(rows, work, "part int, path string, docs bigint, tokens bigint, bytes bigint"), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, path of every document, read back from the files."""
    before = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("path", F.coalesce(before, F.lit(0)).cast("bigint").alias("base"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with opened(path) as f:
                    reader = FrameReader(f)
                    n = len(reader.ids)
                    starts = base + np.cumsum(reader.counts) - reader.counts
                    for i in range(0, n, 2000):
                        some = range(i, min(n, i + 2000))
                        crc = [zlib.crc32(reader.document(k).astype("<u4").tobytes()) for k in some]
                        yield {"doc_id": reader.ids[i : i + 2000], "start": pa.array(starts[i : i + 2000]), "n_tokens": pa.array(reader.counts[i : i + 2000]), "ids_crc32": crc, "path": [path] * len(some)}

    spread = min(max(1, manifest.count()), 4 * int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return arrow_map(files.repartition(spread, "path"), work, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, path string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(table(spark, sf_dir, "documents"), scratch(spark, "ids")))
