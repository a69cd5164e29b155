"""Token-id files of independent zstandard frames with a trailing seek table (the public zstd seekable format).

A file holds the ids (unsigned 32-bit, little-endian) of its documents in order, cut into frames of FRAME ids
whatever the documents' borders; then a frame with the index (document ids, token counts); then the seek table, a
skippable frame that gives each frame's compressed and plain size and the low half of the XXH64 of its plain
bytes. A reader takes the table and the index from the end of the file and fetches, checks and decompresses only
the frames that the requested documents touch.

Documents are dealt over files by ranges of their ids, sorted inside, and every task streams one file of its own
name into the shared folder; the rows that tasks return name the files, so a repeated task leaves an unused file
and no wrong result. File borders and counts give each document's place among all ids.

Cases: a null or empty text has the end id alone; null document ids come first; repeated rows are documents of
their own; an empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geostrata.llm import common
from geostrata.llm.chunked import encoder, parts

#: Ids of one frame.
FRAME = 65_536
# Fixed values of the zstd seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC, CHECKSUM_FLAG = 0x184D2A5E, 0x8F92EAB1, 0x80
_ENTRY, _FOOTER = struct.Struct("<III"), struct.Struct("<IBI")


class CorruptFrame(ValueError):
    pass


class TokenFileWriter:
    """Streams documents into a file; holds one frame, the seek table and the index."""

    def __init__(self, out, level: int = 1):
        self.out, self.zip = out, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.held, self.size, self.entries = [], 0, []
        self.ids: list[int | None] = []
        self.counts: list[int] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= 4 * FRAME:
            data = b"".join(self.held)
            whole = len(data) // (4 * FRAME) * (4 * FRAME)
            for at in range(0, whole, 4 * FRAME):
                self._frame(data[at : at + 4 * FRAME])
            self.held, self.size = [data[whole:]], len(data) - whole

    def _frame(self, data: bytes) -> None:
        packed = self.zip.compress(data)
        self.entries.append(_ENTRY.pack(len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.out.write(packed)

    def close(self) -> None:
        if self.size:
            self._frame(b"".join(self.held))
        ids = np.array([x or 0 for x in self.ids], "<i8").tobytes()
        known = np.array([x is not None for x in self.ids], "u1").tobytes()
        self._frame(struct.pack("<Q", len(self.ids)) + ids + np.array(self.counts, "<i8").tobytes() + known)
        body = b"".join(self.entries) + _FOOTER.pack(len(self.entries), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)
        self.out.close()


class TokenFileReader:
    def __init__(self, file):
        self.file, end = file, file.size()
        n, flags, magic = _FOOTER.unpack(self._at(end - _FOOTER.size, _FOOTER.size))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise CorruptFrame("no seek table with checksums")
        table = self._at(end - _FOOTER.size - n * _ENTRY.size, n * _ENTRY.size)
        self.entries = list(_ENTRY.iter_unpack(table))
        self.starts = np.cumsum([0, *(e[0] for e in self.entries)], dtype=np.int64)
        index = self.frame(n - 1)
        (docs,) = struct.unpack_from("<Q", index)
        self.ids = np.frombuffer(index, "<i8", docs, 8)
        self.counts = np.frombuffer(index, "<i8", docs, 8 + 8 * docs)
        self.known = np.frombuffer(index, "u1", docs, 8 + 16 * docs).astype(bool)
        self.begins = np.cumsum(np.r_[0, self.counts])

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def frame(self, i: int) -> bytes:
        packed, plain, check = self.entries[i]
        try:
            data = zstandard.ZstdDecompressor().decompress(self._at(int(self.starts[i]), packed), max_output_size=plain)
        except zstandard.ZstdError as e:
            raise CorruptFrame(f"frame {i}: {e}") from e
        if len(data) != plain or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise CorruptFrame(f"frame {i}: checksum")
        return data

    def tokens(self, row: int) -> bytes:
        """Ids of the file's row-th document, from the frames that it touches."""
        begin, end = 4 * int(self.begins[row]), 4 * int(self.begins[row + 1])
        first, last = begin // (4 * FRAME), max(begin, end - 1) // (4 * FRAME)
        if begin == end:
            return b""
        data = b"".join(self._kept(i) for i in range(first, last + 1))
        return data[begin - first * 4 * FRAME : end - first * 4 * FRAME]

    def _kept(self, i: int) -> bytes:
        """The last frame stays at hand, as neighbours share it."""
        if getattr(self, "_last", (None, b""))[0] != i:
            self._last = (i, self.frame(i))
        return self._last[1]

    def rows_of(self, ids: set[int]) -> list[int]:
        return [int(r) for r in np.flatnonzero(np.isin(self.ids, list(ids)) & self.known)]


def _write(folder: str, path: str, cut: str, end: int):
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, writer, name = encoder(path, cut), None, ""
        first = None
        for batch in batches:
            for part in parts(batch, 1):
                if writer is None:
                    where, base = fs.FileSystem.from_uri(folder)
                    where.create_dir(base, recursive=True)
                    name = f"{base}/{uuid.uuid4().hex}.tokens.zst"
                    writer = TokenFileWriter(where.open_output_stream(name, compression=None))
                    first = part.column(0)[0].as_py()
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc_id, ids in zip(part.column(0).to_pylist(), enc.encode(texts), strict=True):
                    writer.add(doc_id, ids + tail)
        if writer is not None:
            writer.close()
            cols = [[name.rpartition("/")[2]], [first], [len(writer.ids)], [sum(writer.counts)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["file", "first_id", "documents", "tokens"])

    return run


def write_tokens(docs: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text", cut: str = "spaces", end: int = 2, files: int | None = None) -> DataFrame:
    """Write token files in ascending id order under ``folder`` (a URI all executors reach); the manifest is
    returned and kept beside them: file, first_id, documents, tokens, start (ids in all files before)."""
    spark = docs.sparkSession
    common.ship(spark)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    n = files or max(common.partitions(spark), common.input_bytes(plain) // (128 << 20))
    # repeated or missing ids spread by their texts' lengths
    dealt = plain.repartitionByRange(n, "id", F.length("text")).sortWithinPartitions("id")
    written = dealt.mapInArrow(common.tidy(_write(f"{folder}/files", path, cut, end)), "file string, first_id long, documents long, tokens long")
    listed = common.staged(written, folder, "written")
    before = Window.orderBy(F.col("first_id").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return common.staged(listed.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0))), folder, "manifest")


def _read(folder: str, wanted: frozenset | None, digest: bool):
    names = ["id", "start", "n_tokens", "ids_crc32" if digest else "ids"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64() if digest else pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, begin in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with where.open_input_file(f"{base}/{file}") as f:
                    reader = TokenFileReader(f)
                    rows = reader.rows_of(wanted) if wanted is not None else range(len(reader.ids))
                    for at in range(0, len(rows), 2000):
                        own = rows[at : at + 2000]
                        ids = [reader.tokens(r) for r in own]
                        cols = [
                            [int(reader.ids[r]) if reader.known[r] else None for r in own], [begin + int(reader.begins[r]) for r in own],
                            [len(x) // 4 for x in ids], [zlib.crc32(x) for x in ids] if digest else ids,
                        ]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return run


def read_tokens(manifest: DataFrame, folder: str, wanted: set[int] | None = None, digest: bool = False, id_col: str = "doc_id") -> DataFrame:
    """Documents of the files: id, start, n_tokens and ids (uint32 bytes), or their crc32 if ``digest``. ``wanted``
    limits what is decompressed to frames that hold these documents."""
    common.ship(manifest.sparkSession)
    dealt = manifest.select("file", "start").repartitionByRange(common.partitions(manifest.sparkSession), "file")
    schema = "id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids binary")
    run = _read(f"{folder}/files", None if wanted is None else frozenset(wanted), digest)
    return dealt.mapInArrow(common.tidy(run), schema).withColumnRenamed("id", id_col)
