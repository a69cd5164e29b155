"""Exact top-k search by inner product: a KD-tree per shard, best-first traversal, a propagated kth score.

Components become integers (floor(scale * x), x as double), so scores are exact: sums are made in doubles where no
sum can reach 2^53, in 64-bit integers where none can reach 2^63, else in Python's. Every shard is one task's vectors
under a KD-tree: median splits of the widest dimension, tight bounding boxes. A block of queries descends a tree
together: a node's bound for a query is the largest inner product that its box allows, rounded up; nodes are taken in
order of their best bound, and a query leaves a node whose bound is below the query's kth score so far. That score starts
from a pilot: the kth best of a bounded sample of vectors, which is never above the true kth score and is handed to
every shard, so that shards send few candidates. Query blocks lie in the shared folder and every task streams
them past its tree (shards x bytes of queries are read in all); nothing is broadcast that grows with the data. The last
step keeps k rows of each query.

Cases: vectors that are null, or hold null or non-finite components (before or after scaling) take no part; nor do rows
without an id; shorter vectors count as padded with zeros; equal scores go to smaller ids; a row is no candidate of
its own, but rows repeated under one id are queries of their own (each has its k rows under that id) and candidates of
each other; a score beyond 64 bits raises OverflowError; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geostrata.llm import common

#: Vectors of a leaf, of the pilot, queries of a block, and components that make a shard (128 MB).
LEAF, PILOT, BLOCK, SHARD = 512, 4096, 512, 1 << 24
NONE = np.iinfo(np.int64).min
#: Components up to this one make no sum of 2^53 in up to 8192 dimensions.
MODEST = 2.0**20


def scaled(batch: pa.RecordBatch, scale: int, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, ids and integer components (as doubles) of the vectors of a batch (row, id, vector) that take part."""
    column = batch.column(2)
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
    if not lists.null_count and not flat.null_count and (sizes == dims).all():
        x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(sizes), dims)
        known = np.ones(len(x), bool)
    else:
        x, known = np.zeros((batch.num_rows, dims)), np.zeros(batch.num_rows, bool)
        for i, v in enumerate(lists):
            if v.is_valid and not v.values.null_count:
                x[i, : len(v.values)], known[i] = v.values.to_numpy(zero_copy_only=False), True
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(scale * x)
    known &= np.isfinite(x).all(axis=1)
    return (*(batch.column(i).to_numpy(zero_copy_only=False)[known].astype(np.int64) for i in (0, 1)), x[known])


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    if most < 2.0**63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = np.array([[int(x) for x in row] for row in a], object) @ np.array([[int(x) for x in row] for row in b], object).T
    if (whole > np.iinfo(np.int64).max).any() or (whole <= NONE).any():
        raise OverflowError("an inner product does not fit a long")
    return whole.astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; vectors with large components are taken apart, as only their sums are slow."""
    out = np.zeros((len(a), len(b)), np.int64)
    if not out.size or not a.shape[1]:
        return out
    x, y = (np.abs(m).max(axis=1) > MODEST for m in (a, b))
    for i in (~x, x):
        for j in (~y, y):
            if i.any() and j.any():
                out[np.ix_(i, j)] = _exact(a[i], b[j])
    return out


class Tree:
    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.rows, self.ids, self.vectors = rows[order], ids[order], vectors[order]
        self.nodes: list[tuple[int, int, int, int]] = []  # first row, end, left child, right child (-1: leaf)
        low, high = [], []
        todo = [(0, len(ids), -1, 0)]
        while todo:
            first, end, parent, side = todo.pop()
            own = self.vectors[first:end]
            lo, hi = (own.min(axis=0), own.max(axis=0)) if end > first else (np.zeros(vectors.shape[1]),) * 2
            me = len(self.nodes)
            self.nodes.append((first, end, -1, -1))
            low.append(lo)
            high.append(hi)
            if parent >= 0:
                p = list(self.nodes[parent])
                p[2 + side] = me
                self.nodes[parent] = tuple(p)
            if end - first <= LEAF or not (hi > lo).any():
                continue
            half = (end - first) // 2
            split = np.argpartition(own[:, int((hi - lo).argmax())], half)
            self.vectors[first:end], self.ids[first:end], self.rows[first:end] = own[split], self.ids[first:end][split], self.rows[first:end][split]
            todo += [(first, first + half, me, 0), (first + half, end, me, 1)]
        self.low, self.high = np.array(low), np.array(high)

    def bound(self, node: int, queries: np.ndarray) -> np.ndarray:
        """No less than the largest product that the node's box allows: what doubles may have lost is added."""
        up, down, low, high = np.maximum(queries, 0), np.minimum(queries, 0), self.low[node], self.high[node]
        with np.errstate(over="ignore", invalid="ignore"):
            lost = (up @ np.abs(high) - down @ np.abs(low)) * ((queries.shape[1] + 8) * 2.0**-52)
            return np.nan_to_num(up @ high + down @ low + lost, nan=np.inf, posinf=np.inf, neginf=-np.inf)

    def search(self, own: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids), k columns in order, of rows other than the query's own row with a score of at least its
        floor; NONE where there are fewer."""
        n = len(queries)
        scores, ids = np.full((n, k), NONE), np.zeros((n, k), np.int64)
        kth = floor.copy()
        if not len(self.ids) or not n:
            return scores, ids
        first = self.bound(0, queries)
        heap = [(-float(first.max()), 0, np.arange(n), first)]
        while heap:
            _, node, active, bound = heapq.heappop(heap)
            keep = bound >= kth[active]
            if not keep.any():
                continue
            active = active[keep]
            begin, end, left, right = self.nodes[node]
            if left >= 0:
                for child in (left, right):
                    b = self.bound(child, queries[active])
                    go = b >= kth[active]
                    if go.any():
                        heapq.heappush(heap, (-float(b[go].max()), child, active[go], b[go]))
                continue
            found, leaf = products(queries[active], self.vectors[begin:end]), self.ids[begin:end]
            hits = (found >= kth[active][:, None]) & (self.rows[begin:end][None, :] != own[active][:, None])
            for row in np.flatnonzero(hits.any(axis=1)):
                q = active[row]
                s, i = np.r_[scores[q], found[row][hits[row]]], np.r_[ids[q], leaf[hits[row]]]
                best = np.lexsort((i, -s.astype(np.float64)))[:k] if np.abs(s[s != NONE]).max(initial=0) < 2**53 else np.array(sorted(range(len(s)), key=lambda j: (-int(s[j]), int(i[j])))[:k])
                scores[q], ids[q] = s[best], i[best]
                kth[q] = max(kth[q], scores[q][-1])
        return scores, ids


def _blocks(scale: int, dims: int, pilot: tuple[np.ndarray, np.ndarray, np.ndarray], k: int):
    """Query rows to blocks (row numbers, ids, vectors and floors as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(*pilot)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                rows, ids, vectors = scaled(batch.slice(at, BLOCK), scale, dims)
                if len(ids):
                    found, _ = tree.search(rows, vectors, k, np.full(len(ids), NONE))
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (rows, ids, vectors, found[:, -1].copy())], ["rows", "ids", "vectors", "floors"])

    return run


def _search(scale: int, dims: int, folder: str, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [scaled(b, scale, dims) for b in batches]
        parts = [p for p in parts if len(p[0])]
        if not parts:
            return
        tree = Tree(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        del parts
        where, base = fs.FileSystem.from_uri(folder)
        files = [f.path for f in where.get_file_info(fs.FileSelector(base)) if f.base_name.endswith(".parquet")]
        for path in sorted(files):
            with where.open_input_file(path) as source:
                for block in pq.ParquetFile(source).iter_batches(batch_size=4):
                    for rows, ids, vectors, floors in zip(*(c.to_pylist() for c in block.columns), strict=True):
                        own, ids = np.frombuffer(rows, np.int64), np.frombuffer(ids, np.int64)
                        scores, found = tree.search(own, np.frombuffer(vectors, np.float64).reshape(len(own), dims), k, np.frombuffer(floors, np.int64))
                        q, r = np.nonzero(scores != NONE)
                        yield pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(ids[q]), pa.array(found[q, r]), pa.array(scores[q, r])], ["query_row", "query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, query_filter, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best others of every row that query_filter(id column) selects."""
    spark = vectors.sparkSession
    common.ship(spark)
    folder = common.shared_dir(spark)
    plain = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).filter("id is not null and vector is not null")
    # a written copy, as row numbers must stay the same however often it is read
    plain = common.staged(plain.select(F.monotonically_increasing_id().alias("row"), "id", "vector"), folder, "vectors")
    facts = plain.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dims")).first()
    dims = facts["dims"] or 0
    # the pilot: a bounded sample in a fixed order
    sample = plain.orderBy(F.xxhash64("id"), "id", "row").limit(PILOT).collect()
    kinds = (("row", pa.int64()), ("id", pa.int64()), ("vector", pa.list_(pa.float64())))
    pilot = scaled(pa.RecordBatch.from_arrays([pa.array([r[c] for r in sample], t) for c, t in kinds], [c for c, _ in kinds]), scale, dims)
    blocks = plain.filter(query_filter(F.col("id"))).repartition(common.partitions(spark), "row").mapInArrow(_blocks(scale, dims, pilot, k), "rows binary, ids binary, vectors binary, floors binary")
    common.staged(blocks, folder, "queries")
    shards = max(common.partitions(spark), -(-facts["n"] * max(dims, 1) // SHARD))
    found = plain.repartition(shards, F.xxhash64("row")).mapInArrow(_search(scale, dims, f"{folder}/queries", k), "query_row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
