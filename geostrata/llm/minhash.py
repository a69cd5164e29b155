"""MinHash near-duplicate groups with b-bit signatures.

A document is the set of its distinct k-word shingles. Its signature keeps the low two bits of each of 128
minima, packed in four longs; 24 bands of four whole minima give the candidates. Steps:

1. features: set size, set digest, packed signature and band keys of every document (one pass, no shuffle);
2. documents with equal sets form one class; only its smallest doc_id goes on;
3. band rows are range-partitioned by (band key, doc_id), so that a hot bucket spreads over tasks of equal size.
   Within a bucket the pairs of a maximum spanning tree of the collision-corrected estimates become candidates:
   as many as the bucket has members, never all pairs. Pieces of a bucket that a partition boundary cuts are
   tied together by one more tree over one member of each piece;
4. candidates whose estimate is within SIGMAS of the threshold are confirmed on full sets, and components built;
5. what the trees cannot have connected is looked at again: buckets that still hold several components are tied to
   clusters, and in each cluster the members outside its most frequent component meet all others of a size that the
   threshold allows: first signatures meet, in cells of bounded size that let only survivors' ids out; survivors' sets
   then meet in cells of an inverted index, which counts common shingles exactly and lets only links out. After that no
   bucket holds an untested pair that could join two components.

A pair at the threshold 0.8 shares no band with probability (1 - 0.8^4)^24 = 3e-6.

Cases: a null or wordless text has an empty set and is linked with nothing; rows without an id are kept, in no
component; repeated rows of one id count as one document of that id (its sets link if they are equal or similar);
an empty table gives an empty result. Only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.llm import common
from geostrata.llm.components import connected_components

HASHES, BITS, BANDS, ROWS = 128, 2, 24, 4
WORDS = HASHES * BITS // 64
#: Matching lanes an estimate may fall short of those expected at the threshold: 5.5 standard deviations.
SIGMAS = 5.5
#: Rows of one bucket that are compared with each other at once.
CHUNK = 4096
#: Members and queries of one cell of a cluster: of sets, and of signatures.
SIDE, WIDE = 128, 512
LANES = np.uint64(0x5555555555555555)
_LINKS = "a long, b long"
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, k: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words make one shingle of them all."""
    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    n = min(k, len(h))
    acc = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        acc = _mix(acc * _MULT[i % 4] + h[i : len(h) - n + 1 + i] + np.uint64(i))
    return np.unique(acc)


def _family() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    return rng.integers(1, 2**63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, HASHES, np.uint64)


def minima(hashes: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    a, b = family
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 2048):
        low = np.minimum(low, (hashes[i : i + 2048, None] * a + b).min(axis=0))
    return low >> np.uint64(32)


def packed(low: np.ndarray) -> np.ndarray:
    """The low BITS of each minimum; minima are mixed first so that their low bits are even."""
    lanes = (_mix(low) & np.uint64(3)).reshape(-1, WORDS, 32)
    return np.bitwise_or.reduce(lanes << (np.arange(32, dtype=np.uint64) * np.uint64(2)), axis=2)


def band_keys(low: np.ndarray) -> np.ndarray:
    rows = low[..., : BANDS * ROWS].reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2]).copy()
    for i in range(ROWS):
        key = _mix(key * _MULT[i] + rows[..., i])
    return key


def matches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal lanes of packed signatures (last axis)."""
    x = a ^ b
    return HASHES - np.bitwise_count((x | (x >> np.uint64(1))) & LANES).sum(axis=-1, dtype=np.int64)


def least_matches(threshold: float) -> int:
    """Lanes that must agree: equal minima with probability J, unequal ones still agree once in four."""
    p = threshold + (1 - threshold) / 2**BITS
    return int(HASHES * p - SIGMAS * (HASHES * p * (1 - p)) ** 0.5)


def _features(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, family = WordHashes(), _family()
        for batch in batches:
            sizes, lows, digests = [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), k, words)
                sizes.append(len(s))
                lows.append(minima(s, family))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
            low = np.array(lows, np.uint64).reshape(-1, HASHES)
            sig, keys = packed(low).view(np.int64), band_keys(low).view(np.int64)
            out = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary())]
            out += [pa.array(sig[:, i]) for i in range(WORDS)]
            flat = pa.array(keys.ravel())
            out.append(pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) * BANDS + 1, BANDS), pa.int32()), flat))
            yield pa.RecordBatch.from_arrays(out, ["id", "n", "digest", *(f"s{i}" for i in range(WORDS)), "bands"])

    return run


def spanning_pairs(sig: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Edges of a maximum spanning tree over estimated similarity, without those below the cut (Prim)."""
    m = len(sig)
    best, parent = matches(sig, sig[0]), np.zeros(m, np.int64)
    best[0] = -1
    out = []
    for _ in range(m - 1):
        j = int(best.argmax())
        if best[j] >= least:
            out.append((int(parent[j]), j))
        best[j] = -1
        near = matches(sig, sig[j])
        closer = (near > best) & (best >= 0)
        best[closer], parent[closer] = near[closer], j
    return out


def _pairs(least: int):
    """Sorted (key, id, s..) rows to records: kind 0 a candidate pair; 1 a member of a bucket with company;
    2 one member of each piece of a bucket that may go on in another piece."""
    names = ["kind", "key", "a", "b", *(f"s{i}" for i in range(WORDS))]

    def record(kind, key, a, b, sig):
        n = len(a)
        cols = [np.full(n, kind, np.int32), key, a, b, *(sig[:, i] for i in range(WORDS))]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

    def piece(key, ids, sig, cut):
        """One whole bucket or a piece of it."""
        out = [(1, key, ids, ids, sig)] if cut or len(ids) > 1 else []
        if len(ids) > 1:
            edges = spanning_pairs(sig.view(np.uint64), least)
            if edges:
                x, y = np.array(edges).T
                a, b = np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])
                out.append((0, key[: len(a)], a, b, sig[: len(a)]))
        if cut:
            out.append((2, key[:1], ids[:1], ids[:1], sig[:1]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        first = True
        for batch in batches:
            if not batch.num_rows:
                continue
            key, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            sig = np.stack([batch.column(2 + i).to_numpy(zero_copy_only=False) for i in range(WORDS)], axis=1)
            if held:
                key, ids, sig = np.concatenate([held[0], key]), np.concatenate([held[1], ids]), np.concatenate([held[2], sig])
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            out: list[tuple] = []
            lone = np.diff(np.r_[starts, len(key)])
            whole = len(starts) - 1
            two = starts[:whole][lone[:whole] == 2]
            two = two[1:] if first and len(two) and two[0] == 0 else two
            if len(two):
                both = np.sort(np.r_[two, two + 1])
                out.append((1, key[both], ids[both], ids[both], sig[both]))
                ok = matches(sig[two].view(np.uint64), sig[two + 1].view(np.uint64)) >= least
                if ok.any():
                    x = two[ok]
                    out.append((0, key[x], np.minimum(ids[x], ids[x + 1]), np.maximum(ids[x], ids[x + 1]), sig[x]))
            for g in np.flatnonzero((lone[:whole] > 2) | (first & (np.arange(whole) == 0))):
                s, e = starts[g], starts[g] + lone[g]
                for i in range(s, e, CHUNK):
                    out += piece(key[i : min(e, i + CHUNK)], ids[i : min(e, i + CHUNK)], sig[i : min(e, i + CHUNK)], first or e - s > CHUNK)
                first = False
            rest = starts[whole]
            while len(key) - rest > 2 * CHUNK:
                out += piece(key[rest : rest + CHUNK], ids[rest : rest + CHUNK], sig[rest : rest + CHUNK], True)
                rest, first = rest + CHUNK, True
            held = (key[rest:], ids[rest:], sig[rest:])
            for x in out:
                yield record(*x)
        if held:
            for i in range(0, len(held[0]), CHUNK):
                for x in piece(*(c[i : i + CHUNK] for c in held), True):
                    yield record(*x)

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            sets = [shingle_set(t.as_py(), k, words).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "set"])

    return run


def _confirm(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_py() or b"", np.uint64) for v in (x, y))
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(large, small)
                both = int((large[np.minimum(at, len(large) - 1)] == small).sum()) if len(large) else 0
                keep.append(both > 0 and den * both >= num * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    left, right = sets.toDF("a", "set_a"), sets.toDF("b", "set_b")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b")
    return both.mapInArrow(common.tidy(_confirm(num, den)), _LINKS)


def _cells(num: int, den: int):
    """Rows of one cell after the other (its members, then its queries) to links between different labels."""

    def links(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        ids, labels = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
        query = np.array([r[2] for r in rows], bool)
        sets = [np.frombuffer(r[3] or b"", np.uint64) for r in rows]
        own = np.flatnonzero(~query)
        sizes = np.array([len(x) for x in sets])
        if not len(own) or len(own) == len(rows):
            return ids[:0], ids[:0]
        flat, owner = np.concatenate([sets[i] for i in own]), np.repeat(np.arange(len(own)), sizes[own])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        a, b = [], []
        for q in np.flatnonzero(query):
            low = np.searchsorted(flat, sets[q])
            n = np.searchsorted(flat, sets[q], "right") - low
            both = np.bincount(owner[np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())], minlength=len(own))
            near = (both > 0) & (den * both >= num * (sizes[q] + sizes[own] - both)) & (labels[own] != labels[q])
            if near.any():  # one link to each other component is enough
                hit = own[near]
                hit = hit[np.unique(labels[hit], return_index=True)[1]]
                a.append(np.minimum(ids[hit], ids[q]))
                b.append(np.maximum(ids[hit], ids[q]))
        return (np.concatenate(a), np.concatenate(b)) if a else (ids[:0], ids[:0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows = None, []
        for batch in batches:
            cols = batch.to_pydict()
            for at, row in zip(zip(cols["cell"], cols["g"], cols["c"], cols["q"], strict=True), zip(cols["id"], cols["label"], cols["query"], cols["set"], strict=True), strict=True):
                if at != cell and rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in links(rows)], ["a", "b"])
                    rows = []
                cell = at
                rows.append(row)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in links(rows)], ["a", "b"])

    return run


def _alike(least: int):
    """Rows of one cell after the other to the ids that an estimate lets meet another component's."""

    def survivors(group: int, rows: dict[str, np.ndarray]) -> pa.RecordBatch:
        query = rows["query"]
        sig = np.stack([rows[f"s{i}"] for i in range(WORDS)], axis=1).view(np.uint64)
        mine, theirs = np.flatnonzero(query), np.flatnonzero(~query)
        met = np.zeros(len(theirs), bool)
        out = []
        for at in range(0, len(mine), 128):
            own = mine[at : at + 128]
            near = (matches(sig[own][:, None, :], sig[theirs][None, :, :]) >= least) & (rows["label"][own][:, None] != rows["label"][theirs][None, :])
            met |= near.any(axis=0)
            out.append(own[near.any(axis=1)])
        kept = np.concatenate([*out, theirs[met]]) if out else mine[:0]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(kept), group)), pa.array(rows["id"][kept]), pa.array(rows["label"][kept]), pa.array(query[kept])], ["g", "id", "label", "query"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in _by_cell(batches):
            if batch is not None:
                held.append(batch)
            elif held:
                whole = pa.Table.from_batches(held)
                held = []
                yield survivors(whole["g"][0].as_py(), {c: whole[c].to_numpy() for c in ("id", "label", "query", *(f"s{i}" for i in range(WORDS)))})

    return run


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """Batches cut where (cell, g, c, q) changes; None after each cell."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(batch.schema.names.index(c)).to_numpy().astype(np.int64) for c in ("cell", "g", "c", "q")], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            now = tuple(keys[start])
            if last is not None and now != last:
                yield None
            last = now
            yield batch.slice(start, end - start)
    if last is not None:
        yield None


def _dealt(marked: DataFrame, queries: DataFrame, payload: list[str], side: int, n: int) -> DataFrame:
    """Members (g, id, label, query, ..) and queries (g, id, label, ..) of groups g, dealt to cells of about ``side`` of
    each; the rows of a cell are neighbours."""
    count = lambda df, name, rows: df.groupBy("g").agg(F.ceil(F.count("*") / side).cast("int").alias(name), F.count("*").alias(rows))
    sizes = count(marked, "cs", "m").join(count(queries, "qs", "k"), "g").withColumn("m", F.col("m") + F.col("k")).drop("k")
    heavy = max(4 * side, marked.count() // 10_000)  # so that at most some 10,000 groups of 16 bytes are broadcast
    part = lambda of, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    cols = ["g", "id", "label", *payload]

    def sized(df: DataFrame) -> DataFrame:
        """Rows with their group's numbers of cells; those of large groups get them by broadcast and are spread."""
        large = F.broadcast(sizes.filter(F.col("m") > heavy).select(F.col("g").alias("of"), F.col("cs").alias("c1"), F.col("qs").alias("q1")))
        to = F.when(F.col("c1").isNull(), F.col("g")).otherwise(F.xxhash64("id", "g"))
        told = df.join(large, F.col("g") == F.col("of"), "left").withColumn("to", to)
        small = sizes.filter(F.col("m") <= heavy).select(F.col("g").alias("to"), "cs", "qs")
        both = told.join(small, "to", "left").withColumns({"cs": F.coalesce("c1", "cs"), "qs": F.coalesce("q1", "qs")})
        return both.filter("qs is not null")

    left = sized(marked).select(*cols, F.lit(False).alias("query"), part("cs", 1).alias("c"), every("qs").alias("q"))
    right = sized(queries).select(*cols, F.lit(True).alias("query"), part("qs", 2).alias("q"), every("cs").alias("c"))
    cells = left.unionByName(right).withColumn("cell", F.xxhash64("g", "c", "q"))
    return cells.repartitionByRange(n, "cell").sortWithinPartitions("cell", "g", "c", "q", "query", "id").select("cell", "g", "c", "q", "id", "label", "query", *payload)


def across(inside: DataFrame, prints: DataFrame, sets: DataFrame, num: int, den: int, n: int, folder: str) -> DataFrame:
    """Links between different labels of one cluster (id, cluster, label), by exact counts of common shingles.

    Members outside a cluster's most frequent label are its queries. prints has id, n and the signatures. A set of n
    shingles is only met by sets of its own size band (a factor of den / num) and the two next to it."""
    spread = inside.groupBy("cluster", "label").agg(F.count("*").alias("k"))
    most = spread.groupBy("cluster").agg(F.max_by("label", F.struct("k", -F.col("label"))).alias("most"))
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(den / num * (1 + 1e-9)))).cast("long")
    sigs = [f"s{i}" for i in range(WORDS)]
    marked = inside.join(most, "cluster").join(prints, "id").select("id", "label", "cluster", (F.col("label") != F.col("most")).alias("query"), band.alias("band"), *sigs)
    marked = common.staged(marked, folder, "marked")
    queries = marked.filter("query").withColumn("band", F.explode(F.array(*(F.col("band") + i for i in (-1, 0, 1)))))
    group = F.xxhash64("cluster", "band").alias("g")  # groups that share a hash only meet in vain
    met = _dealt(marked.select(group, "id", "label", *sigs), queries.select(group, "id", "label", *sigs), sigs, WIDE, n).mapInArrow(common.tidy(_alike(least_matches(num / den))), "g long, id long, label long, query boolean")
    alive = common.staged(met.distinct(), folder, "alive")
    full = alive.join(sets, "id")
    return _dealt(full.filter("not query"), full.filter("query"), ["set"], SIDE, n).mapInArrow(common.tidy(_cells(num, den)), _LINKS)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest reachable id) and kept.

    Documents are linked if den * |intersection| >= num * |union| of their k-word shingle sets."""
    spark = docs.sparkSession
    common.ship(spark)
    folder, n, least = common.shared_dir(spark), common.partitions(spark), least_matches(num / den)
    sigs = [f"s{i}" for i in range(WORDS)]
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    fields = "id long, n long, digest binary, " + ", ".join(f"{s} long" for s in sigs) + ", bands array<long>"
    with common.small_batches(spark, 2000):
        feats = common.staged(plain.mapInArrow(common.tidy(_features(k)), fields), folder, "features")

    known = feats.filter("id is not null and n > 0")
    classes = common.staged(known.groupBy("digest").agg(F.min("id").alias("rep")), folder, "classes")
    rows = known.join(classes.select("rep", F.col("digest").alias("of")), (F.col("id") == F.col("rep")) & (F.col("digest") == F.col("of")), "left_semi").dropDuplicates(["id", "digest"])
    buckets = rows.select(F.explode("bands").alias("key"), "id", *sigs)
    out = "kind int, key long, a long, b long, " + ", ".join(f"{s} long" for s in sigs)
    dealt = buckets.repartitionByRange(n, "key", "id").sortWithinPartitions("key", "id")
    found = common.staged(dealt.mapInArrow(common.tidy(_pairs(least)), out), folder, "found")
    cut = found.filter("kind = 2").select("key", F.col("a").alias("id"), *sigs)
    tied = cut.repartition(n, "key").sortWithinPartitions("key", "id").mapInArrow(common.tidy(_pairs(least)), out).filter("kind = 0")
    pairs = common.staged(found.filter("kind = 0").select("a", "b").union(tied.select("a", "b")).filter("a <> b").distinct(), folder, "pairs")
    members = found.filter("kind = 1").select("key", F.col("a").alias("id"), *sigs)

    wanted = members.select("id").distinct()
    with common.small_batches(spark, 256):  # a set may have megabytes
        sets = common.staged(plain.join(wanted, "id", "left_semi").mapInArrow(common.tidy(_sets(k)), "id long, set binary"), folder, "sets")
        links = common.staged(confirmed(pairs, sets, num, den), folder, "links")
    comps = connected_components(links, folder, "first")

    labelled = members.join(comps, "id", "left").withColumn("label", F.coalesce("component", "id"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("id").alias("root")).filter("lo < hi")
    ties = labelled.select("key", F.col("id").alias("a")).join(mixed.select("key", F.col("root").alias("b")), "key").select("a", "b")
    clusters = connected_components(ties, folder, "clusters").withColumnRenamed("component", "cluster")
    inside = clusters.join(comps, "id", "left").select("id", "cluster", F.coalesce("component", "id").alias("label"))
    with common.small_batches(spark, 256):
        more = common.staged(across(inside, rows.select("id", "n", *sigs), sets, num, den, n, folder), folder, "late")
    if more.take(1):
        comps = connected_components(links.union(more), folder, "second")

    reach = classes.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    done = feats.select("id", "n", "digest").join(reach, "digest", "left")
    own = F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("component"))).otherwise(F.col("id"))
    done = done.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"))
    return done.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
