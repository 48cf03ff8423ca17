"""Token ids in files that can be read in part: independent zstandard frames, a seek table at the end.

A file is a valid zstandard stream in the public seekable layout:

* data frames, each of at most ``frame_ids`` ids as little-endian unsigned 32-bit integers; a document may cross frames;
* one index frame: ``LCTOKIX1``, the number of documents, then their ids, null marks and token counts as arrays;
* a skippable frame with the seek table: compressed size, size and checksum (low half of XXH64) of every frame before it,
  the number of frames, a descriptor byte and the closing magic number.

A reader takes the table from the end of the file, the index from the last frame, and decompresses the frames that the
documents it is asked for lie in.  Files are written by tasks, under names of their own for each attempt; the manifest,
which Spark commits, names the files that count, so a lost or repeated attempt leaves at most a file nobody reads."""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomcast.llm.packing import ByteCodec
from loomcast.llm.pieces import texts_of

#: fixed values of the public layout: skippable frame of a seek table, its closing mark, "entries have checksums"
SKIPPABLE, SEEKABLE, WITH_CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
_ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])
_FOOTER = struct.Struct("<IBI")
_INDEX = b"LCTOKIX1"
#: ids of a frame; text and documents of a file, about
FRAME_IDS, FILE_BYTES, FILE_ROWS = 1 << 18, 128 << 20, 1 << 20
#: a file has at least this much text before a small table is dealt over more cores
LEAST_BYTES = 4 << 20


def _checksum(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class FileWriter:
    """One file: documents go in one after another, in parts of any size."""

    def __init__(self, out, frame_ids: int = FRAME_IDS, level: int = 3):
        self.out, self.full = out, 4 * frame_ids
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.buffer, self.entries = bytearray(), []
        self.ids, self.nulls, self.counts = [], bytearray(), []

    def _frame(self, data: bytes) -> None:
        packed = self.zstd.compress(data)
        self.out.write(packed)
        self.entries.append((len(packed), len(data), _checksum(data)))

    def begin(self, doc_id: int | None) -> None:
        self.ids.append(doc_id or 0), self.nulls.append(doc_id is None), self.counts.append(0)

    def add(self, ids: bytes) -> None:
        """More ids of the document begun last, as little-endian unsigned 32-bit integers."""
        self.counts[-1] += len(ids) // 4
        self.buffer += ids
        while len(self.buffer) >= self.full:
            self._frame(bytes(self.buffer[: self.full]))
            del self.buffer[: self.full]

    def close(self) -> None:
        if self.buffer:
            self._frame(bytes(self.buffer))
        parts = (np.array(self.ids, "<i8"), np.frombuffer(bytes(self.nulls), "u1"), np.array(self.counts, "<u8"))
        self._frame(_INDEX + struct.pack("<Q", len(self.ids)) + b"".join(p.tobytes() for p in parts))
        table = np.array(self.entries, _ENTRY).tobytes() + _FOOTER.pack(len(self.entries), WITH_CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class FileReader:
    """One file: its index, and any of its frames, each checked when it is read."""

    def __init__(self, src):
        self.src, self.zstd = src, zstandard.ZstdDecompressor()
        end = src.size()
        if end < _FOOTER.size + 8:
            raise ValueError("not a token file: too short for a seek table")
        n, kind, magic = _FOOTER.unpack(self._bytes(end - _FOOTER.size, _FOOTER.size))
        size = n * _ENTRY.itemsize + _FOOTER.size
        if magic != SEEKABLE or kind != WITH_CHECKSUMS or n < 1 or end < size + 8:
            raise ValueError("not a token file: no seek table at its end")
        head = struct.unpack("<II", self._bytes(end - size - 8, 8))
        if head != (SKIPPABLE, size):
            raise ValueError("not a token file: the seek table doesn't fit its frame")
        self.entries = np.frombuffer(self._bytes(end - size, n * _ENTRY.itemsize), _ENTRY)
        self.at = np.concatenate([[0], np.cumsum(self.entries["packed"].astype(np.int64))])
        #: where the data frames start, in ids of the file
        self.first = np.concatenate([[0], np.cumsum(self.entries["size"][:-1].astype(np.int64))]) // 4
        if self.at[-1] != end - size - 8:
            raise ValueError("not a token file: frames and seek table don't add up")

    def _bytes(self, at: int, n: int) -> bytes:
        self.src.seek(at)
        data = self.src.read(n)
        if len(data) != n:
            raise ValueError("token file is cut off")
        return data

    @property
    def frames(self) -> int:
        return len(self.entries) - 1

    def frame(self, i: int) -> bytes:
        packed, size, check = (int(x) for x in self.entries[i])
        data = self.zstd.decompress(self._bytes(int(self.at[i]), packed), max_output_size=size)
        if len(data) != size or _checksum(data) != check:
            raise ValueError(f"frame {i} of a token file doesn't have its checksum")
        return data

    def index(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, null marks and token counts of the documents, in the file's order."""
        data = self.frame(self.frames)
        (n,) = struct.unpack_from("<Q", data, 8)
        if data[:8] != _INDEX or len(data) != 16 + 17 * n or self.first[-1] != np.frombuffer(data, "<u8", n, 16 + 9 * n).sum():
            raise ValueError("not a token file: the index doesn't fit the frames")
        return np.frombuffer(data, "<i8", n, 16), np.frombuffer(data, "u1", n, 16 + 8 * n), np.frombuffer(data, "<u8", n, 16 + 9 * n).astype(np.int64)


def _opened(path: str):
    """The file system of a path that all executors see, and the path in it."""
    return fs.FileSystem.from_uri(path)


def write_tokens(
    docs: DataFrame, path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0,
    frame_ids: int = FRAME_IDS, file_bytes: int = FILE_BYTES, file_rows: int = FILE_ROWS,
) -> DataFrame:
    """Tokenise whole texts by the file at ``path`` and write them to ``folder``, in ascending order of the id.

    Ids are those of the tokenizers file without special tokens, then ``end_id``.  Returns the manifest, one row per file
    in order: ``part, file, docs, tokens, bytes``, and ``start``, the ids of all files before it.

    Texts are dealt out by ranges of (id, hash of the text, row), so rows of one id, however many, go to as many files as
    they need; each task tokenises and writes its range as one stream, a long text in stretches.  Null and empty texts are
    the end id alone; null ids come first; rows repeating an id are documents of their own, in an order that is fixed; an
    empty table makes no file; other columns aren't read."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_t"))
    rows, size = src.agg(F.count(F.lit(1)), F.sum(F.octet_length("_t"))).first()
    least = min(spark.sparkContext.defaultParallelism, (size or 0) // LEAST_BYTES)
    files = max(1, least, -(-(size or 0) // file_bytes), -(-rows // file_rows))
    root, kept = f"{folder}/files", f"{folder}/manifest"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                part = TaskContext.get().partitionId()
                name = f"{root}/tokens-{part:06d}-{uuid.uuid4().hex[:12]}.zst"
                system, at = _opened(name)
                system.create_dir(os.path.dirname(at), recursive=True)
                out = system.open_output_stream(at, compression=None)
                writer, codec, tail = FileWriter(out, frame_ids), ByteCodec(path), struct.pack("<I", end_id)
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch)):
                writer.begin(doc_id)
                for ids in codec.encode(text):
                    writer.add(ids)
                writer.add(tail)
        if writer is not None:
            writer.close()
            size = out.tell()
            out.close()
            row = (part, name, len(writer.counts), sum(writer.counts), size)
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["part", "file", "docs", "tokens", "bytes"])

    # the row's number only parts rows that are alike in id and text, so a repeated task writes the same documents
    keyed = src.withColumns({"_h": F.xxhash64("_t"), "_r": F.monotonically_increasing_id()})
    dealt = keyed.repartitionByRange(files, "_id", "_h", "_r").sortWithinPartitions("_id", "_h", "_r").select("_id", "_t")
    dealt.mapInArrow(run, "part bigint, file string, docs bigint, tokens bigint, bytes bigint").write.parquet(kept)
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a folder in order, with ``start``: one row per file, so that one task can add them up."""
    rows = spark.read.schema("part bigint, file string, docs bigint, tokens bigint, bytes bigint").parquet(f"{folder}/manifest")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("long")))


def _one_per_task(files: DataFrame) -> DataFrame:
    """The manifest with every file in a partition of its own; a row of it has some 100 bytes, so it is broadcast."""
    listed = files.withColumn("_n", F.row_number().over(W.orderBy("part")).cast("long") - 1)
    n = max(1, files.count())
    return files.sparkSession.range(0, n, 1, n).join(F.broadcast(listed), F.col("id") == F.col("_n")).select("file", "start")


def _batch(cols: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(cols)], [n for n, _ in cols])


def read_tokens(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """Every document of a folder, read back: ``id_col, start, n_tokens, ids_crc32``.

    A task goes through one file, frame by frame, each checked; a document's ids are never held together."""
    cols = [(id_col, pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, at = _opened(name)
                with system.open_input_file(at) as src:
                    reader = FileReader(src)
                    ids, nulls, counts = reader.index()
                    rows, frame, left, i = [], -1, memoryview(b""), 0
                    for doc_id, null, count in zip(ids.tolist(), nulls.tolist(), counts.tolist()):
                        crc, need = 0, 4 * count
                        while need:
                            if i == len(left):
                                frame, i = frame + 1, 0
                                left = memoryview(reader.frame(frame))
                            take = min(need, len(left) - i)
                            crc = zlib.crc32(left[i : i + take], crc)
                            i, need = i + take, need - take
                        rows.append((None if null else doc_id, start, count, crc))
                        start += count
                        if len(rows) == 10_000:
                            yield _batch(cols, rows)
                            rows = []
                    if rows:
                        yield _batch(cols, rows)

    return _one_per_task(manifest(spark, folder)).mapInArrow(run, f"`{id_col}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def read_documents(spark: SparkSession, folder: str, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents whose ids stand in ``wanted``: ``id_col, start, n_tokens, ids`` (little-endian 32-bit integers).

    Files give their index; what is asked for is then read frame by frame, and no other frame is decompressed.  All
    documents of a repeated id are returned, null asks for none, an id that isn't there gives no row."""
    places = "_id bigint, file string, at bigint, n_tokens bigint, start bigint"

    def list_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, path = _opened(name)
                with system.open_input_file(path) as src:
                    ids, nulls, counts = FileReader(src).index()
                at = np.cumsum(counts) - counts
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=nulls.astype(bool)), pa.array([name] * len(ids)), pa.array(at), pa.array(counts), pa.array(at + start)],
                    ["_id", "file", "at", "n_tokens", "start"],
                )

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, src, reader, number, data = None, None, None, -1, b""
        try:
            for batch in batches:
                for r in batch.to_pylist():
                    if r["file"] != name:
                        if src is not None:
                            src.close()
                        name, number = r["file"], -1
                        system, path = _opened(name)
                        src = system.open_input_file(path)
                        reader = FileReader(src)
                    at, end, parts = r["at"], r["at"] + r["n_tokens"], []
                    while at < end:
                        i = int(np.searchsorted(reader.first, at, side="right")) - 1
                        if i != number:
                            number, data = i, reader.frame(i)
                        stop = min(end, int(reader.first[i]) + len(data) // 4)
                        parts.append(data[4 * (at - int(reader.first[i])) : 4 * (stop - int(reader.first[i]))])
                        at = stop
                    one = (r["_id"], r["start"], r["n_tokens"], b"".join(parts))
                    yield _batch([(id_col, pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())], [one])
        finally:
            if src is not None:
                src.close()

    listed = _one_per_task(manifest(spark, folder)).mapInArrow(list_places, places)
    asked = wanted.select(F.col(id_col).cast("long").alias("_id")).where("_id IS NOT NULL").distinct()
    found = listed.join(asked, "_id", "left_semi")
    near = found.repartition("file", F.floor(F.col("at") / FRAME_IDS)).sortWithinPartitions("file", "at")
    return near.mapInArrow(fetch, f"`{id_col}` bigint, start bigint, n_tokens bigint, ids binary")
