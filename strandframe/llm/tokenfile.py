"""Token-ID files: independent zstandard frames, a document index, a trailing seek table with a checksum per frame.

A file is a row of zstandard frames of little-endian unsigned 32-bit ids, then two skippable frames:

* the document index, magic 0x184D2A5D: a zstandard frame of (doc_id int64, number of ids int64) per document;
* the seek table in the public seekable format, magic 0x184D2A5E: per frame its compressed size, its size and the low
  32 bits of XXH64 of its ids, then the number of frames, a descriptor byte (0x80: with checksums) and 0x8F92EAB1.

Any zstandard decoder reads the ids in turn; a reader of one document decompresses only the frames it lies in.
"""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, parallelism, qualified, resting, staged
from .tokens import byte_encoder

END = 2
#: Bytes of ids in a frame, at least, unless the file ends; no frame has over twice as many.
FRAME = 1 << 18
INDEX_MAGIC, SEEK_MAGIC, FOOTER_MAGIC = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1


class Writer:
    """Writes documents' ids to a binary file object."""

    def __init__(self, out, frame: int = FRAME):
        self.out, self.frame = out, frame
        self.compressor = zstandard.ZstdCompressor(level=3)
        self.pending = bytearray()
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int]] = []

    def _flush(self, data: bytes) -> None:
        packed = self.compressor.compress(data)
        self.out.write(packed)
        self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def add(self, doc_id: int, ids: bytes) -> None:
        self.docs.append((doc_id, len(ids) // 4))
        self.pending += ids
        while len(self.pending) >= self.frame:
            n = len(self.pending) if len(self.pending) < 2 * self.frame else self.frame
            self._flush(bytes(self.pending[:n]))
            del self.pending[:n]

    def close(self) -> None:
        if self.pending:
            self._flush(bytes(self.pending))
        index = self.compressor.compress(np.array(self.docs, dtype="<i8").tobytes())
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index) + 8) + index + struct.pack("<Q", len(index)))
        entries = b"".join(struct.pack("<III", *f) for f in self.frames)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(entries) + 9) + entries + struct.pack("<IBI", len(self.frames), 0x80, FOOTER_MAGIC))


class Reader:
    """Reads a file by position; ``docs`` is its (doc_id, number of ids) array."""

    def __init__(self, read_at: Callable[[int, int], bytes], size: int):
        self.read_at = read_at
        self.decompressor = zstandard.ZstdDecompressor()
        n, descriptor, magic = struct.unpack("<IBI", read_at(size - 9, 9))
        if magic != FOOTER_MAGIC or descriptor != 0x80:
            raise ValueError("no seek table with checksums at the end")
        begin = size - 9 - 12 * n
        self.frames = np.frombuffer(read_at(begin, 12 * n), dtype="<u4").reshape(-1, 3).astype(np.int64)
        self.place = np.concatenate(([0], np.cumsum(self.frames[:, 0])))
        self.ends = np.cumsum(self.frames[:, 1])
        (packed,) = struct.unpack("<Q", read_at(begin - 16, 8))
        raw = self.decompressor.decompress(read_at(begin - 16 - packed, packed), max_output_size=1 << 40) if packed else b""
        self.docs = np.frombuffer(raw, dtype="<i8").reshape(-1, 2)
        self.starts = np.concatenate(([0], np.cumsum(self.docs[:, 1])))

    def frame(self, i: int) -> bytes:
        size, length, check = self.frames[i].tolist()
        data = self.decompressor.decompress(self.read_at(int(self.place[i]), size), max_output_size=length)
        if len(data) != length or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {i} is damaged")
        return data

    def document(self, row: int) -> bytes:
        """The ids of the document in this row of the index, from the frames that hold it."""
        a, b = 4 * int(self.starts[row]), 4 * int(self.starts[row + 1])
        i = int(np.searchsorted(self.ends, a, side="right"))
        begin, out = int(self.ends[i] - self.frames[i, 1]), bytearray()
        while a - begin + b - a > len(out):
            out += self.frame(i)
            i += 1
        return bytes(out[a - begin: b - begin])

    def documents(self) -> Iterator[tuple[int, int, bytes]]:
        """(doc_id, start, ids) of every document in turn; each frame is decompressed once."""
        held, frames = bytearray(), iter(range(len(self.frames)))
        for (doc_id, n), start in zip(self.docs.tolist(), self.starts.tolist(), strict=False):
            while len(held) < 4 * n:
                held += self.frame(next(frames))
            yield doc_id, start, bytes(held[: 4 * n])
            del held[: 4 * n]


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI; executors get qualified ones, so a bare path is one of this machine, as in tests."""
    return pafs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (pafs.LocalFileSystem(), uri)


def open_reader(uri: str) -> Reader:
    fs, path = open_store(uri)
    f = fs.open_input_file(path)

    def read_at(at: int, n: int) -> bytes:
        f.seek(at)
        return f.read(n)

    return Reader(read_at, f.size())


def _writing(folder: str, tokenizer: str, end: int, frame: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tail = byte_encoder(tokenizer), end.to_bytes(4, "little")
        part = TaskContext.get().partitionId()
        fs, path = open_store(folder)
        name, own = f"{path}/ids-{part:06d}.zst", f"{path}/_writing-{uuid.uuid4().hex}"
        fs.create_dir(path, recursive=True)
        out = io.BufferedWriter(fs.open_output_stream(own), 1 << 20)
        writer, docs, total = Writer(out, frame), 0, 0
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(t.as_py() or "" for t in batch.column(1)), strict=True):
                ids += tail
                writer.add(-(1 << 63) if doc is None else doc, ids)
                docs, total = docs + 1, total + len(ids) // 4
        writer.close()
        out.close()
        fs.move(own, name)  # a repeated task writes the same file again
        if docs:
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [f"{folder}/ids-{part:06d}.zst"], "docs": [docs], "ids": [total]},
                                             pa.schema([("part", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    return run


def write(docs: DataFrame, folder: str, tokenizer: str, end: int = END, frame: int = FRAME) -> DataFrame:
    """Encode ``docs (doc_id, text)`` and write files in ascending doc_id order; returns (part, file, docs, ids) per file.

    Files are named by their place in the order; a task writes under another name, then moves the whole file into
    place, so lost or repeated tasks leave no half file. Null texts are empty (only the end id). Rows without id come
    first and are stored under the least 64-bit number; equal ids keep their rows, in order of text.
    """
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = picked.repartitionByRange(parallelism(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    return staged(dealt.mapInArrow(resting(_writing(qualified(docs.sparkSession, folder), tokenizer, end, frame), "tokens"), "part int, file string, docs long, ids long"), "files")


def _reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    for batch in batches:
        for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows: list[tuple] = []

            def made() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names)

            for doc, start, ids in open_reader(file).documents():
                rows.append((None if doc == -(1 << 63) else doc, base + start, len(ids) // 4, crc32(ids)))
                if len(rows) == 10_000:
                    yield made()
                    rows = []
            if rows:
                yield made()


def read(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files that ``write`` returned."""
    spark = files.sparkSession
    found = sorted(files.select("part", "file", "ids").collect())  # one row per file
    base, rows = 0, []
    for _, file, n in found:
        rows.append((file, base))
        base += n
    listed = spark.createDataFrame(rows, "file string, base long").repartition(max(1, len(rows)))
    return listed.mapInArrow(resting(_reading), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """Write ``docs`` to files in the shared folder and read all of them back."""
    return read(write(docs, new_path(docs.sparkSession, "token-files"), tokenizer, end))
