"""WARC files and a Merkle audit of their replicas.

Records are gzip members of their own (so that a range of bytes is a record), written in the order in which tasks
read them, without a shuffle; a task begins a new file after FILE_BYTES. A file's leaves are its ordered offset ranges: the hash of a range
covers its bounds and its bytes as they are on disk, so damage to headers is found like damage to payloads. Leaves
pair up to a tree for each file (one row with the hashes of all its nodes, by level), and the roots of the files, in
order, to a root of the replica (one task for that: a row a file). An audit compares replica roots first; where they differ
it compares file roots, and only of differing files the stored trees, level by level, below differing nodes only. What it
returns are the ranges that differ.

Cases: null url or html are written as empty; a url that a header cannot hold as it is has its exact form in a header of its own; null ids have no id in results; repeated rows are
records of their own; a missing or short file differs in all ranges that it lacks, bytes past the last range are a
range of their own; an empty table gives no files and an empty result. Only the id, url and html columns are read.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.llm import common

# Fixed values of the WARC format.
VERSION, BREAK = b"WARC/1.1\r\n", b"\r\n"
#: Date of records, unless write_warc is given another.
DATE = "2024-01-01T00:00:00Z"
INDEX = "file string, seq long, id long, offset long, length long"
HASH = 32
#: Bytes after which a task begins another file.
FILE_BYTES = 1 << 30


def record(page_id: int | None, url: str | None, html: str | None, kind: str = "response", date: str = DATE) -> bytes:
    """One WARC response record."""
    plain = " ".join((url or "").split())
    payload = (html or "").encode("utf-8", "replace")
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}|{url}")
    head = {
        "WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{name}>", "WARC-Date": date, "WARC-Target-URI": plain, **({"X-Url": json.dumps(url)} if url and url != plain else {}),
        "X-Page-Id": "" if page_id is None else str(page_id), "WARC-Payload-Digest": f"sha256:{hashlib.sha256(payload).hexdigest()}",
        "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(body)),
    }
    return VERSION + b"".join(f"{k}: {v}\r\n".encode() for k, v in head.items()) + BREAK + body + BREAK * 2


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record, packed or plain."""
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    head, _, rest = data.partition(BREAK * 2)
    lines = head.split(BREAK)
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("no WARC record here")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines[1:])}
    body = rest[: int(fields["content-length"])]
    if fields.get("content-type", "").startswith("application/http"):
        body = body.partition(BREAK * 2)[2]
    return fields, body


def leaf(offset: int, data: bytes) -> bytes:
    return hashlib.sha256(b"\x00" + offset.to_bytes(8, "big") + len(data).to_bytes(8, "big") + data).digest()


def _tail(f, offset: int) -> bytes:
    """The leaf of all bytes from ``offset`` on, read piece by piece."""
    size = f.size() - offset
    digest = hashlib.sha256(b"\x00" + offset.to_bytes(8, "big") + size.to_bytes(8, "big"))
    f.seek(offset)
    while size > 0:
        data = f.read(min(size, 1 << 20))
        digest.update(data)
        size -= len(data) or size
    return digest.digest()


def levels(leaves: list[bytes]) -> list[list[bytes]]:
    """Levels of a tree from its leaves to its root; an odd node goes up as it is."""
    out = [leaves or [hashlib.sha256(b"\x02").digest()]]
    while len(out[-1]) > 1:
        low = out[-1]
        out.append([hashlib.sha256(b"\x01" + low[i] + low[i + 1]).digest() if i + 1 < len(low) else low[i] for i in range(0, len(low), 2)])
    return out


def differing(a: list[bytes], b: list[bytes]) -> tuple[list[int], int]:
    """Leaves that differ, and how many node pairs were compared on the way. Trees are their levels' hashes in a row, the
    leaves first."""
    same = lambda level, i: a[level][i * HASH : (i + 1) * HASH] == b[level][i * HASH : (i + 1) * HASH]
    if not a or not b or len(a[0]) != len(b[0]):
        wide = max((len(x[0]) // HASH for x in (a, b) if x), default=0)
        return [i for i in range(wide) if not a or not b or (i + 1) * HASH > min(len(a[0]), len(b[0])) or not same(0, i)], wide
    todo, compared = [0], 0
    for level in range(len(a) - 1, -1, -1):
        compared += len(todo)
        bad = [i for i in todo if not same(level, i)]
        if not level:
            return bad, compared
        todo = [j for i in bad for j in (2 * i, 2 * i + 1) if j < len(a[level - 1]) // HASH]
    return [], compared


def _write(folder: str, date: str):
    kinds = (pa.string(), *[pa.int64()] * 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, at, seq = None, "", 0, 0
        where, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for part in range(0, batch.num_rows, 500):
                rows = []
                for i, url, html in zip(*(batch.column(c).slice(part, 500).to_pylist() for c in range(3)), strict=True):
                    if out is not None and at >= FILE_BYTES:
                        out.close()
                        out = None
                    if out is None:
                        where.create_dir(base, recursive=True)
                        name, at, seq = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = where.open_output_stream(f"{base}/{name}", compression=None)
                    data = gzip.compress(record(i, url, html, date=date), 6, mtime=0)
                    out.write(data)
                    rows.append((name, seq, i, at, len(data)))
                    at += len(data)
                    seq += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "seq", "id", "offset", "length"])
        if out is not None:
            out.close()

    return run


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """Write pages as WARC files under folder/files and return their index (file, seq, id, offset, length)."""
    common.ship(pages.sparkSession)
    plain = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return common.staged(plain.mapInArrow(_write(f"{folder}/files", date), INDEX), folder, "index")


def _dealt(index: DataFrame) -> DataFrame:
    """Index rows with all of a file in one task, in order."""
    return index.select("file", "seq", "id", "offset", "length").repartition(common.partitions(index.sparkSession), "file").sortWithinPartitions("file", "seq")


def _by_file(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[dict]]]:
    name, rows = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if r["file"] != name and rows:
                yield name, rows
                rows = []
            name = r["file"]
            rows.append(r)
    if rows:
        yield name, rows


def copy_replica(index: DataFrame, source: str, target: str, fault: Callable[[int | None], bool] | None = None) -> DataFrame:
    """Copy the files, record by record. ``fault`` says for which ids a byte of the copy is flipped (for drills)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, base = fs.FileSystem.from_uri(f"{source}/files")
        b, to = fs.FileSystem.from_uri(f"{target}/files")
        b.create_dir(to, recursive=True)
        for name, rows in _by_file(batches):
            part = f"{to}/{name}.{uuid.uuid4().hex}"  # renamed when whole, so a repeated task does no harm
            with a.open_input_file(f"{base}/{name}") as f, b.open_output_stream(part, compression=None) as out:
                for r in rows:
                    f.seek(r["offset"])
                    data = f.read(r["length"])
                    if fault is not None and fault(r["id"]):
                        at = len(data) * 2 // 3
                        data = data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]
                    out.write(data)
            b.move(part, f"{to}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(rows)], pa.int64())], ["file", "records"])

    return common.staged(_dealt(index).mapInArrow(run, "file string, records long"), target, "copied")


def trees(index: DataFrame, folder: str, name: str = "trees") -> DataFrame:
    """(file, root, levels): every file's tree, as the file is on disk now: each level's hashes in a row, the leaves first.
    A missing file has no levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = fs.FileSystem.from_uri(f"{folder}/files")
        for file, rows in _by_file(batches):
            leaves = []
            if where.get_file_info(f"{base}/{file}").type == fs.FileType.File:
                with where.open_input_file(f"{base}/{file}") as f:
                    for r in rows:
                        f.seek(min(r["offset"], f.size()))
                        leaves.append(leaf(r["offset"], f.read(r["length"])))
                    end = rows[-1]["offset"] + rows[-1]["length"]
                    if f.size() > end:
                        leaves.append(_tail(f, end))
            tree = levels(leaves)
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([tree[-1][0]], pa.binary()), pa.array([[b"".join(x) for x in tree] if leaves else []], pa.list_(pa.binary()))], ["file", "root", "levels"])

    return common.staged(_dealt(index).mapInArrow(run, "file string, root binary, levels array<binary>"), folder, name)


def replica_root(tree: DataFrame) -> bytes | None:
    """The root over the files' roots in the order of their names: one row to the driver."""
    roots = tree.agg(F.array_sort(F.collect_list(F.struct("file", F.hex("root").alias("root")))).alias("all"))
    joined = F.array_join(F.transform("all", lambda x: F.concat(x["file"], F.lit("="), x["root"])), ";")
    row = roots.select(F.sha2(joined, 256).alias("root")).first()
    return bytes.fromhex(row["root"]) if row["root"] else None


def audit(index: DataFrame, one: DataFrame, two: DataFrame) -> DataFrame:
    """(file, seq, compared): ranges in which two replicas differ, by their trees. seq past the index is the tail."""
    if replica_root(one) == replica_root(two):
        return index.sparkSession.createDataFrame([], "file string, seq long, compared long")
    roots = one.select("file", F.col("root").alias("r1")).join(two.select("file", F.col("root").alias("r2")), "file", "full").filter(~F.col("r1").eqNullSafe(F.col("r2"))).select("file")
    pairs = roots.join(one.select("file", F.col("levels").alias("a")), "file", "left").join(two.select("file", F.col("levels").alias("b")), "file", "left").select("file", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                bad, compared = differing(r["a"] or [], r["b"] or [])
                yield pa.RecordBatch.from_arrays([pa.array([r["file"]] * len(bad), pa.string()), pa.array(bad, pa.int64()), pa.array(np.full(len(bad), compared), pa.int64())], ["file", "seq", "compared"])

    return pairs.mapInArrow(run, "file string, seq long, compared long")


def read_warc(index: DataFrame, folder: str) -> DataFrame:
    """(file, seq, id, url, payload): the records, read by their ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = fs.FileSystem.from_uri(f"{folder}/files")
        for file, rows in _by_file(batches):
            with where.open_input_file(f"{base}/{file}") as f:
                for at in range(0, len(rows), 200):
                    own, parsed = rows[at : at + 200], []
                    for r in own:
                        f.seek(r["offset"])
                        parsed.append(parse(f.read(r["length"])))
                    cols = [[file] * len(own), [r["seq"] for r in own], [int(h["x-page-id"]) if h.get("x-page-id") else None for h, _ in parsed], [json.loads(h["x-url"]) if "x-url" in h else h.get("warc-target-uri", "") for h, _ in parsed], [p for _, p in parsed]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], ["file", "seq", "id", "url", "payload"])

    return _dealt(index).mapInArrow(run, "file string, seq long, id long, url string, payload binary")
