"""Token ids in seekable files: independent zstandard frames, a trailing seek table, a checksum per frame.

File layout, all integers little-endian:

* data frames, each a complete zstandard frame with its own content checksum that holds the uint32 ids of whole
  documents, about ``frame_ids`` ids (a longer document is a frame of its own);
* an index frame (skippable frame 0x184D2A50): for each document its id, its first id in the file and its number of ids
  as three int64 arrays, then the CRC-32 of these bytes as uint32;
* the seek table (skippable frame 0x184D2A5E, the public zstandard seekable format): per data frame the compressed size,
  the decompressed size and a uint32 CRC-32 of the decompressed bytes, then the number of frames, a descriptor byte with
  the checksum bit, and 0x8F92EAB1.

A reader takes the end of the file first, then only the frames that hold the documents it wants.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shorepix.llm.store import shared_folder
from shorepix.llm.tokens import chunks, default_tokenizer, encoder, lazily

INDEX_MAGIC, SEEK_MAGIC, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
FRAME_IDS = 262_144
#: Ids of a file, one gigabyte of them, and its documents: the index of a file stands in memory.
FILE_IDS, FILE_DOCS = 1 << 28, 1 << 20
CHECKSUMS = 0x80


class Writer:
    """Writes one file to a binary stream; ``add`` takes whole documents in order."""

    def __init__(self, out, frame_ids: int = FRAME_IDS, level: int = 1):
        import zstandard

        self.out, self.frame_ids = out, frame_ids
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.waiting: list[np.ndarray] = []
        self.held = self.total = 0
        self.docs: list[tuple[int, int, int]] = []
        self.frames: list[tuple[int, int, int]] = []

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        if self.held and self.held + len(ids) > self.frame_ids:
            self._flush()
        self.docs.append((doc_id, self.total, len(ids)))
        self.waiting.append(ids)
        self.held += len(ids)
        self.total += len(ids)

    def _flush(self) -> None:
        raw = np.concatenate(self.waiting).astype("<u4").tobytes()
        packed = self.compressor.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), zlib.crc32(raw)))
        self.waiting, self.held = [], 0

    def close(self) -> None:
        if self.waiting:
            self._flush()
        index = np.array(self.docs, "<i8").reshape(-1, 3).T.tobytes()
        index += struct.pack("<I", zlib.crc32(index))
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = b"".join(struct.pack("<III", *frame) for frame in self.frames)
        table += struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(table)) + table)


class Reader:
    """Reads a file from a seekable binary stream, decompressing only the frames that are asked for."""

    def __init__(self, stream):
        import zstandard

        self.stream, self.decompressor = stream, zstandard.ZstdDecompressor()
        stream.seek(0, 2)
        size = stream.tell()
        count, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or flags != CHECKSUMS:
            raise ValueError("no seek table at the end of the file")
        length = 12 * count + 9
        head = struct.unpack("<II", self._at(size - length - 8, 8))
        if head != (SEEK_MAGIC, length):
            raise ValueError("the seek table is damaged")
        table = np.frombuffer(self._at(size - length, 12 * count), "<u4").reshape(-1, 3).astype(np.int64)
        self.packed, self.raw, self.sums = table.T if count else np.zeros((3, 0), np.int64)
        self.begin = np.cumsum(self.packed) - self.packed
        self.first = (np.cumsum(self.raw) - self.raw) // 4
        at = int(self.packed.sum())
        magic, length = struct.unpack("<II", self._at(at, 8))
        index = self._at(at + 8, length)
        if magic != INDEX_MAGIC or zlib.crc32(index[:-4]) != struct.unpack("<I", index[-4:])[0]:
            raise ValueError("the document index is damaged")
        self.doc_ids, self.starts, self.counts = np.frombuffer(index[:-4], "<i8").reshape(3, -1)

    def _at(self, offset: int, length: int) -> bytes:
        self.stream.seek(offset)
        return self.stream.read(length)

    def frame(self, k: int) -> np.ndarray:
        raw = self.decompressor.decompress(self._at(int(self.begin[k]), int(self.packed[k])))
        if len(raw) != self.raw[k] or zlib.crc32(raw) != self.sums[k]:
            raise ValueError(f"frame {k} does not match its checksum")
        return np.frombuffer(raw, "<u4")

    def documents(self, wanted=None) -> Iterator[tuple[int, int, np.ndarray]]:
        """(doc_id, first id in the file, ids) in file order; only of ``wanted`` ids if given."""
        rows = np.arange(len(self.doc_ids)) if wanted is None else np.flatnonzero(np.isin(self.doc_ids, list(wanted)))
        held, ids = -1, None
        for row in rows:
            k = int(np.searchsorted(self.first, self.starts[row], "right")) - 1
            if k != held:
                held, ids = k, self.frame(k)
            low = int(self.starts[row] - self.first[k])
            yield int(self.doc_ids[row]), int(self.starts[row]), ids[low:low + int(self.counts[row])]


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_token_files(documents: DataFrame, folder: str | None = None, tokenizer: str | None = None,
                      by_word: bool = True, frame_ids: int = FRAME_IDS, file_ids: int = FILE_IDS,
                      file_docs: int = FILE_DOCS) -> DataFrame:
    """Encode whole texts, close each with id 1 and write the ids below ``folder`` in ascending ``doc_id`` order.

    ``documents`` needs ``doc_id`` (integer) and ``text``; other columns are ignored. Null and empty texts are one id (the
    end id). Rows with a null ``doc_id`` cannot be asked for and are left out. A repeated ``doc_id`` is kept as often as it
    comes. Returns the manifest, one row per file: file_no (ascending with the ids), path, n_docs, n_tokens, n_frames. An
    empty table gives an empty manifest.

    A task closes a file before it would hold more than ``file_ids`` ids (a longer document is a file of its own) or
    ``file_docs`` documents and goes on with the next. It writes under names of its own attempt and the manifest names the
    files of the attempt that succeeded, so lost and speculative tasks leave nothing but unnamed files.
    """
    spark = documents.sparkSession
    folder = folder or shared_folder(spark)
    tokenizer = tokenizer or default_tokenizer()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        encode = encoder(tokenizer, by_word)
        system, root = _filesystem(folder)
        system.create_dir(root, recursive=True)
        part, mark, number = TaskContext.get().partitionId(), uuid.uuid4().hex, 0
        writer = out = name = None

        def closed() -> pa.RecordBatch:
            writer.close()
            out.close()
            return pa.RecordBatch.from_pydict({"file_no": [part << 32 | number], "path": [f"{folder.rstrip('/')}/{name}"],
                                               "n_docs": [len(writer.docs)], "n_tokens": [writer.total],
                                               "n_frames": [len(writer.frames)]})

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for at, texts in chunks(lazily(batch.column(1))):
                ids, counts, _ = encode.chunk(texts)
                ends = np.cumsum(counts)
                for k in range(len(texts)):
                    if writer and (writer.total + counts[k] > file_ids or len(writer.docs) >= file_docs):
                        yield closed()
                        writer, number = None, number + 1
                    if writer is None:
                        name = f"part-{part:08d}-{number:08d}-{mark}.ids"
                        out = system.open_output_stream(f"{root}/{name}")
                        writer = Writer(out, frame_ids)
                    writer.add(doc_ids[at + k], ids[ends[k] - counts[k]:ends[k]])
        if writer is not None:
            yield closed()

    # The id order alone decides; the two further keys let a doc_id that fills many rows spread over several files.
    ordered = (documents.filter(F.col("doc_id").isNotNull())
               .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
               .repartitionByRange(parts, "doc_id", F.xxhash64("text"))
               .sortWithinPartitions("doc_id"))
    written = ordered.mapInArrow(write, "file_no long, path string, n_docs long, n_tokens long, n_frames long")
    manifest = f"{folder.rstrip('/')}/manifest"
    written.write.parquet(manifest)
    return spark.read.schema(written.schema).parquet(manifest)


def read_token_files(manifest: DataFrame, wanted: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (unsigned, of the ids
    as little-endian uint32) and, unless left out, ids (these bytes).

    Every file is read at its end first; with ``wanted`` only the frames of those documents are decompressed. Files are
    spread over the tasks. Each frame is checked against its checksum; a damaged one raises.
    """
    spark = manifest.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # One row per file, not per document: the window over all of them stays small.
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, name = _filesystem(path)
                rows = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []} | ({"ids": []} if with_ids else {})
                held = 0
                with system.open_input_file(name) as stream:
                    for doc_id, start, ids in Reader(stream).documents(wanted):
                        raw = ids.tobytes()
                        held += len(raw) * with_ids
                        for key, value in zip(rows, (doc_id, base + start, len(ids), zlib.crc32(raw), raw), strict=False):
                            rows[key].append(value)
                        if held > 4_000_000:
                            yield pa.RecordBatch.from_pydict(rows)
                            rows, held = {key: [] for key in rows}, 0
                if rows["doc_id"]:
                    yield pa.RecordBatch.from_pydict(rows)

    return (files.select("path", "base").repartition(parts, "path")
            .mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids))
