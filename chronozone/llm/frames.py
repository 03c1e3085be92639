"""Token files: independent zstandard frames, a trailing seek table and a checksum for each frame.

A file holds documents in ascending ``doc_id`` order, each one frame of little-endian unsigned 32-bit ids.  After the frames come
a skippable frame with the documents' ids (``INDEX_MAGIC``: a zstandard frame of 64-bit integers, null as the smallest) and, last,
the seek table of the public zstandard seekable format: a skippable frame (0x184D2A5E) of compressed size, size and checksum
(the low 32 bits of XXH64 of the content) for each frame, then the number of frames, a descriptor byte (0x80: with
checksums) and the magic number 0x8F92EAB1.  Any zstandard tool decodes the whole file; this reader goes from the end of the file to
the seek table and decompresses only the documents asked for.

Files are written by tasks through ``pyarrow.fs`` to any store it knows, under names that no other attempt uses; a file counts
by its row in the manifest, which Spark commits, so attempts that failed leave only unused files.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import parts, shared_dir, stored, table, texts
from .tokens import encoder

SEEK_MAGIC, INDEX_MAGIC, FOOT_MAGIC, LEVEL = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1, 3
END_ID = 2
#: Bytes of ids that a reader holds at once; a longer document is read alone.
READ = 4 << 20
_NULL = -(2**63)
MANIFEST = "file string, part int, first long, n_docs long, n_tokens long, bytes long"


class FrameWriter:
    """Writes one document after another to a binary stream."""

    def __init__(self, out, level: int = LEVEL):
        self.out, self.zip = out, zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.table, self.ids, self.tokens, self.size = [], [], 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.zip.compress(ids)
        self.out.write(frame)
        self.table.append((len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self.ids.append(_NULL if doc_id is None else doc_id)
        self.tokens += len(ids) // 4
        self.size += len(frame)

    def close(self) -> None:
        index = self.zip.compress(np.array(self.ids, "<i8").tobytes())
        seek = np.array(self.table, "<u4").tobytes() + struct.pack("<IBI", len(self.table), 0x80, FOOT_MAGIC)
        tail = struct.pack("<II", INDEX_MAGIC, len(index)) + index + struct.pack("<II", SEEK_MAGIC, len(seek)) + seek
        self.out.write(tail)
        self.size += len(tail)


class FrameReader:
    """Random access to a token file (a seekable binary stream)."""

    def __init__(self, source):
        self.source, self.unzip = source, zstandard.ZstdDecompressor()
        size = source.seek(0, 2)
        n, kind, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOT_MAGIC or kind != 0x80:
            raise ValueError("no seek table with checksums at the end")
        start = size - 9 - 12 * n - 8
        if struct.unpack("<II", self._at(start, 8)) != (SEEK_MAGIC, 12 * n + 9):
            raise ValueError("the seek table is damaged")
        self.table = np.frombuffer(self._at(start + 8, 12 * n), "<u4").reshape(-1, 3)
        self.begin = np.concatenate(([0], np.cumsum(self.table[:, 0].astype(np.int64))))
        magic, width = struct.unpack("<II", self._at(int(self.begin[-1]), 8))
        if magic != INDEX_MAGIC:
            raise ValueError("the index of documents is missing")
        ids = np.frombuffer(self.unzip.decompress(self._at(int(self.begin[-1]) + 8, width)), "<i8").tolist()
        self.ids = [None if x == _NULL else x for x in ids]

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def sizes(self) -> np.ndarray:
        return self.table[:, 1].astype(np.int64) // 4

    def read(self, k: int) -> bytes:
        """The ids of the k-th document; ValueError if its checksum differs."""
        raw = self.unzip.decompress(self._at(int(self.begin[k]), int(self.table[k, 0])))
        if len(raw) != self.table[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"checksum of frame {k}")
        return raw

    def find(self, wanted: set) -> Iterator[tuple[int | None, bytes]]:
        """The documents with these ids, decompressing no others."""
        for k, x in enumerate(self.ids):
            if x in wanted:
                yield x, self.read(k)


def _open(uri: str):
    """The file system of a folder and the folder's path in it; Hadoop's ``s3a`` is ``s3`` there."""
    return pa.fs.FileSystem.from_uri(f"s3://{uri[6:]}" if uri.startswith("s3a://") else uri)


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID, level: int = LEVEL) -> DataFrame:
    """Encode ``doc_id, text`` into token files below ``folder``; the manifest, one row of each file, stored there as well.

    Null text is empty, so it has the end id alone.  Documents without an id come first; rows with equal ids are ordered by text.
    Repeated rows each get a frame, texts may be of any length, and other columns are ignored, whatever their names.
    """

    def run(batches):
        context, enc, end = TaskContext.get(), encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        fs, path = _open(folder)
        fs.create_dir(path, recursive=True)
        name = f"tokens-{context.partitionId():06d}-{uuid.uuid4().hex}.zst"
        writer, first, out = None, None, None
        for batch in parts(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                if writer is None:
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                    writer, first = FrameWriter(out, level), doc_id
                writer.add(doc_id, enc.encode(text) + end)
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "part": pa.array([context.partitionId()], pa.int32()), "first": pa.array([first], pa.int64()), "n_docs": [len(writer.ids)], "n_tokens": [writer.tokens], "bytes": [writer.size]})

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(run, MANIFEST), f"{folder}/manifest")


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, ids`` of every document: ids of all documents before it, and its own as little-endian bytes."""
    before = Window.orderBy(F.col("first").asc_nulls_first(), "part").rowsBetween(Window.unboundedPreceding, -1)  # a row of each file
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        fs, path = _open(folder)
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                with fs.open_input_file(f"{path}/{name}") as source:
                    reader = FrameReader(source)
                    starts = base + np.concatenate(([0], np.cumsum(reader.sizes())))
                    slot = np.cumsum(reader.table[:, 1].astype(np.int64)) // READ  # documents that are read at once
                    cuts = [0, *(np.flatnonzero(np.diff(slot)) + 1).tolist(), len(reader.ids)]
                    for own in map(range, cuts, cuts[1:]):
                        yield pa.RecordBatch.from_arrays([pa.array([reader.ids[k] for k in own], pa.int64()), pa.array(starts[own.start : own.stop]), pa.array([reader.read(k) for k in own], pa.binary())], schema=schema)

    return based.repartition(max(1, manifest.count())).mapInArrow(run, "doc_id long, start long, ids binary")


def query(spark, sf_dir: str) -> DataFrame:
    """op5: position, size and checksum of every document's ids, read back from the files."""
    import public_tokenizers

    folder = shared_dir(spark)
    manifest = write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))

    def run(batches):
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_tokens(manifest, folder).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
