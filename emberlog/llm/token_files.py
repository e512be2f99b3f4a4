"""Token files: independent zstandard frames, a trailing seek table and a checksum of every frame.

A file is a sequence of zstandard frames, each a whole number of documents (or a part of one very
long document), followed by two skippable frames that any zstandard reader ignores:

* the document table (compressed): id and number of tokens of each document, in file order;
* the seek table of the zstandard seekable format: compressed size, decompressed size and the low
  32 bits of XXH64 of the decompressed bytes of every frame, then the count, a descriptor and a magic
  number. It is the end of the file, so a reader finds it without a scan.

A reader that wants one document reads the two tables and decompresses the frames that hold it.

Writing is a Spark job: texts are dealt by ranges of the id, sorted inside a range and encoded and
written by the task that holds the range. A file gets a new name on each attempt and counts only once
its row is in the manifest, a table in the shared folder, so attempts of lost executors are ignored.
Files are opened through a file-system URI, so the folder may be on any store that pyarrow knows.

Defined results: a null text is the empty text and gives the end id alone; rows with a null id come
first; rows with equal ids are ordered by text; an empty table gives no file and no rows.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.llm import tokens
from emberlog.llm.common import text_or_empty
from emberlog.session import scratch_path, stage

# Fixed values of the zstandard seekable format.
SKIPPABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
DESCRIPTOR_CHECKSUMS = 0x80
# A skippable frame of our own, in front of the seek table.
DOCUMENT_TABLE = 0x184D2A50

FRAME_BYTES = 256 * 1024
NULL_ID = -(2**63)


class Writer:
    """Writes one file: documents go into a frame until it is full."""

    def __init__(self, sink: io.RawIOBase, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.sink = sink
        self.frame_bytes = frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=False)
        self.frames: list[tuple[int, int, int]] = []
        self.buffer = bytearray()
        self.ids: list[int] = []
        self.counts: list[int] = []

    def add(self, document: int, ids: bytes, count: int) -> None:
        """One document: its id and its packed token ids."""
        if self.buffer and len(self.buffer) + len(ids) > self.frame_bytes:
            self._frame()
        self.buffer += ids
        while len(self.buffer) > 2 * self.frame_bytes:
            self._frame(self.frame_bytes)
        self.ids.append(document)
        self.counts.append(count)

    def _frame(self, size: int | None = None) -> None:
        data = bytes(self.buffer[:size] if size else self.buffer)
        del self.buffer[: len(data)]
        packed = self.compressor.compress(data)
        self.sink.write(packed)
        self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def close(self) -> None:
        """Writes the rest and the two tables."""
        if self.buffer:
            self._frame()
        table = self.compressor.compress(
            np.array(self.ids, dtype="<i8").tobytes() + np.array(self.counts, dtype="<u8").tobytes()
        )
        self.sink.write(struct.pack("<IIQ", DOCUMENT_TABLE, len(table) + 8, len(self.ids)) + table)
        entries = [*self.frames, (len(table) + 16, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)]
        seek = b"".join(struct.pack("<III", *x) for x in entries)
        seek += struct.pack("<IBI", len(entries), DESCRIPTOR_CHECKSUMS, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(seek)) + seek)


class Reader:
    """Reads documents of one file by their place in it; only their frames are decompressed."""

    def __init__(self, source, dtype: str = "<u2"):
        self.source = source
        self.dtype = np.dtype(dtype)
        source.seek(0, 2)
        end = source.tell()
        source.seek(end - 9)
        count, descriptor, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC or descriptor != DESCRIPTOR_CHECKSUMS:
            raise ValueError("not a seekable file with checksums")
        source.seek(end - 9 - 12 * count)
        entries = np.frombuffer(source.read(12 * count), dtype="<u4").reshape(count, 3).astype(np.int64)
        packed = np.concatenate([[0], np.cumsum(entries[:, 0])])
        source.seek(int(packed[-2]))
        kind, size, documents = struct.unpack("<IIQ", source.read(16))
        if kind != DOCUMENT_TABLE:
            raise ValueError("the document table is missing")
        table = zstandard.ZstdDecompressor().decompress(source.read(size - 8)) if documents else b""
        self.ids = np.frombuffer(table[: 8 * documents], dtype="<i8")
        self.counts = np.frombuffer(table[8 * documents :], dtype="<u8").astype(np.int64)
        self.ends = np.cumsum(self.counts) * self.dtype.itemsize
        self.packed = packed[:-2]
        self.sizes, self.sums = entries[:-1, 1], entries[:-1, 2]
        self.unpacked = np.concatenate([[0], np.cumsum(self.sizes)])
        self.packed_sizes = entries[:-1, 0]
        self.decompressor = zstandard.ZstdDecompressor()
        self.last: tuple[int, bytes] = (-1, b"")

    def frame(self, number: int) -> bytes:
        """The bytes of a frame, checked; the last one is kept."""
        if self.last[0] != number:
            self.source.seek(int(self.packed[number]))
            data = self.decompressor.decompress(self.source.read(int(self.packed_sizes[number])))
            if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.sums[number]:
                raise ValueError(f"frame {number} is damaged")
            self.last = (number, data)
        return self.last[1]

    def document(self, place: int) -> np.ndarray:
        """The token ids of the document at a place in the file."""
        end = int(self.ends[place])
        start = end - int(self.counts[place]) * self.dtype.itemsize
        first = int(np.searchsorted(self.unpacked, start, side="right")) - 1
        parts = []
        while start < end:
            base = int(self.unpacked[first])
            data = self.frame(first)
            parts.append(data[start - base : end - base])
            start = base + len(data)
            first += 1
        return np.frombuffer(b"".join(parts), dtype=self.dtype)


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def write_files(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    folder: str,
    file_rows: int = 8_000,
    id_column: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Writes the files below ``folder`` (a URI) and returns the manifest, one row per file, staged."""
    rows = docs.select(
        F.coalesce(F.col(id_column).cast("long"), F.lit(NULL_ID)).alias("doc_id"), text_or_empty(text).alias("text")
    )
    count = docs.select(F.lit(1)).count()
    files = max(1, -(-count // file_rows), min(count, rows.sparkSession.sparkContext.defaultParallelism))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokenizer)
        store, place = _open(folder)
        writer = path = sink = None
        total = 0
        for batch in batches:
            for document, text_ in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if writer is None:
                    path = f"{place}/{uuid.uuid4().hex}.tok.zst"
                    sink = store.open_output_stream(path, compression=None)
                    writer = Writer(sink)
                ids = encode.encode(text_.as_py()) + end_id.to_bytes(encode.dtype.itemsize, "little")
                writer.add(document, ids, len(ids) // encode.dtype.itemsize)
                total += len(ids) // encode.dtype.itemsize
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict(
                {
                    "path": [f"{folder}/{path.rsplit('/', 1)[1]}"],
                    "first_id": [writer.ids[0]],
                    "documents": [len(writer.ids)],
                    "tokens": [total],
                    "dtype": [encode.dtype.str],
                }
            )

    store, place = _open(folder)
    store.create_dir(place, recursive=True)
    ranged = rows.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    schema = "path string, first_id long, documents long, tokens long, dtype string"
    return stage(ranged.mapInArrow(write, schema), "token-manifest")


def read_files(manifest: DataFrame) -> DataFrame:
    """Every document of the files: ``doc_id, start, n_tokens, ids_crc32`` in the order of the files.

    ``start`` is the number of tokens of all documents before. The manifest has one row per file.
    """
    before = Window.orderBy("first_id", "path").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = _open(row["path"])
                with store.open_input_file(path) as source:
                    reader = Reader(source, row["dtype"])
                    starts = row["start"] + np.concatenate([[0], np.cumsum(reader.counts)])
                    for low in range(0, len(reader.ids), 10_000):
                        places = range(low, min(low + 10_000, len(reader.ids)))
                        sums = [zlib.crc32(reader.document(i).astype("<u4").tobytes()) for i in places]
                        part = slice(places.start, places.stop)
                        ids = reader.ids[part]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(ids, mask=ids == NULL_ID),
                                pa.array(starts[part]),
                                pa.array(reader.counts[part]),
                                pa.array(sums, type=pa.int64()),
                            ],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    # One file is one unit of work: deal the few manifest rows out evenly.
    files = manifest.count()
    dealt = placed.select("path", "start", "dtype").repartition(max(1, files), "path")
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(manifest: DataFrame, wanted: list[int]) -> dict[int, list[int]]:
    """Token ids of a few documents, for a reader outside Spark: only their frames are read."""
    found: dict[int, list[int]] = {}
    for row in manifest.toLocalIterator():
        store, path = _open(row["path"])
        with store.open_input_file(path) as source:
            reader = Reader(source, row["dtype"])
            for place in np.flatnonzero(np.isin(reader.ids, wanted)):
                found[int(reader.ids[place])] = reader.document(int(place)).tolist()
    return found


def shared_uri(spark: SparkSession, name: str) -> str:
    """A new folder below the shared scratch folder, as a URI."""
    path = scratch_path(spark, name)
    return path if ":" in path.split("/", 1)[0] else f"file://{path}"
