"""Packing documents into fixed-length sequences by bin completion over the histogram of lengths.

Pieces of equal length are interchangeable, and there are at most ``capacity`` lengths; so the driver only sees
(length, count) rows, as many as the capacity whatever the input. On them, branch and bound:

* best-fit decreasing over runs of equal lengths is the first incumbent;
* around the largest remaining length, the undominated fillings of the rest of the sequence are enumerated one by one, in
  order of waste. A filling is dominated if a piece left over can take the place of some of its pieces (or of none) that
  are no longer than it together, without overflow;
* a filling is repeated as often as the counts allow, then once less, and so on down to one;
* a branch ends where its waste so far leaves no room for fewer sequences than the incumbent; the search ends at
  the bound ceil(tokens / capacity), or when nothing is left to try (the incumbent is then optimal), or after NODES steps
  of the enumeration, its only limit; the incumbent is returned.

The result is a table of slots: pieces of rank r to r + n of a length go to sequences from s, c in each. Ranks come
from salted counts, so that a length that many pieces share spreads over tasks. There is one row of slots a length, with
its ranks in order; a piece finds its slot there by binary search. The table's size has a bound in the capacity alone
(best-fit keeps at most a few runs of sequences a length), so it is broadcast.

Cases: a null or empty text has the end id alone; an empty table gives an empty result; repeated rows are
documents of their own (rows alike in every column share their places among themselves); null ids pass through. Only the
id and text columns are read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geostrata.llm import common
from geostrata.llm.chunked import encoder, parts

CAPACITY = 4096
#: Steps of the enumeration in one search.
NODES = 200_000
#: Of the sums of the least lengths, one in so many is kept.
STEP = 32
Filling = tuple[tuple[int, int], ...]


def _smear(bits: int, by: int) -> int:
    """The bits and those up to ``by`` places above them."""
    have = 0
    while have < by:
        step = min(have + 1, by - have)
        bits |= bits << step
        have += step
    return bits


def dominated(filling: Filling, waste: int, left: int) -> bool:
    """Whether a piece left over (bits of lengths) can replace pieces of the filling that it is as long as, at least."""
    one, more = 0, 0  # sums of one piece, of two and more
    for size, n in filling:
        for _ in range(n):
            more |= (more | one) << size
            one |= 1 << size
    better = _smear(more, waste)
    if waste:
        better |= _smear(one | 1, waste - 1) << 1  # a longer piece for one, or one more piece
    return bool(better & left)


class _Sums:
    """The sums, as bits, of the i least lengths for each i. One in STEP is kept, others are made again when asked for:
    a search holds hundreds of these tables at once, which would be 2 MB each."""

    def __init__(self, counts: dict[int, int], sizes: list[int], room: int):
        self.counts, self.sizes, self.room, self.mask = counts, sizes, room, (1 << (room + 1)) - 1
        self.kept, self.made = [1], {}
        for at in range(0, len(sizes), STEP):
            self.kept.append(self._block(at // STEP)[-1])
        self.all = self.kept[-1]

    def _block(self, block: int) -> list[int]:
        out = [self.kept[block]]
        for size in self.sizes[block * STEP : (block + 1) * STEP]:
            bits, n, k = out[-1], min(self.counts[size], self.room // size), 1
            while n:
                k = min(k, n)
                bits |= bits << (size * k) & self.mask
                n -= k
                k *= 2
            out.append(bits)
        return out

    def __getitem__(self, i: int) -> int:
        block, at = divmod(i, STEP)
        if block not in self.made:
            self.made[block] = self._block(block)
        return self.made[block][at]


def fillings(counts: dict[int, int], lengths: list[int], room: int, budget: list[int]) -> Iterator[tuple[int, Filling]]:
    """(waste, filling) of the undominated multisets of available lengths in ``room``, least waste first; ends early
    where the budget of steps is used up. The counts are read again at every step and have to be the same then."""
    sizes = lengths[: bisect_right(lengths, room)]
    reach = _Sums(counts, sizes, room)
    budget[0] -= len(sizes) // 8
    every = sum(1 << size for size in sizes)
    for waste in range(room + 1):
        if not reach.all >> (room - waste) & 1:
            continue
        stack: list[tuple[int, int, Filling]] = [(len(sizes), room - waste, ())]
        while stack:
            budget[0] -= 1
            if budget[0] < 0:
                return
            i, target, chosen = stack.pop()
            if not target:
                gone = sum(1 << size for size, n in chosen if n == counts[size])
                if not dominated(chosen, waste, every & ~gone):
                    reach.made.clear()  # the search may go on elsewhere for long
                    yield waste, chosen
                continue
            i = min(i, bisect_right(sizes, target))
            if not i:
                continue
            size = sizes[i - 1]
            for n in range(min(counts[size], target // size) + 1):  # the most first, as the last is popped first
                if reach[i - 1] >> (target - n * size) & 1:
                    stack.append((i - 1, target - n * size, (*chosen, (size, n)) if n else chosen))


def best_fit(hist: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing over runs: patterns and how often each is used."""
    open_: dict[int, list[list]] = {}  # room left: [pattern, sequences]
    rooms: list[int] = []
    done: list[tuple[Filling, int]] = []

    def put(room: int, pattern: Filling, n: int) -> None:
        if n and room:
            if room not in open_:
                open_[room] = []
                rooms.insert(bisect_right(rooms, room), room)
            open_[room].append([pattern, n])
        elif n:
            done.append((pattern, n))

    for size in sorted(hist, reverse=True):
        n = hist[size]
        while n:
            at = bisect_right(rooms, size - 1)
            if at == len(rooms):
                each = capacity // size
                full, rest = divmod(n, each)
                put(capacity - each * size, ((size, each),), full)
                put(capacity - rest * size, ((size, rest),) if rest else (), 1 if rest else 0)
                n = 0
                continue
            room = rooms[at]
            pattern, have = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
            each = room // size
            full = min(have, n // each)
            put(room - each * size, (*pattern, (size, each)), full)
            n -= full * each
            have -= full
            if have and n:
                put(room - n * size, (*pattern, (size, n)), 1)
                n, have = 0, have - 1
            put(room, pattern, have)
    for room in rooms:
        done += [(p, n) for p, n in open_[room]]
    return done


def solve(hist: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[Filling, int]]:
    """Patterns and repetitions that hold every piece of the histogram, in as few sequences as found."""
    hist = {size: n for size, n in hist.items() if n > 0}
    total = sum(size * n for size, n in hist.items())
    least = -(-total // capacity)
    incumbent = best_fit(hist, capacity)
    bins = sum(n for _, n in incumbent)
    if bins == least:
        return incumbent
    counts, lengths = dict(hist), sorted(hist)

    def take(pattern: Filling, times: int) -> None:
        for size, n in pattern:
            was = counts.get(size, 0)
            counts[size] = was - n * times
            if counts[size] == 0:
                lengths.pop(bisect_right(lengths, size) - 1)
            elif was == 0:
                lengths.insert(bisect_right(lengths, size), size)

    budget = [nodes]

    def branch() -> Iterator[tuple[int, Filling, int]]:
        """(waste of one, pattern, times) around the largest length left. Whenever it goes on, what was taken since is
        put back, so that the counts are what they were."""
        size = lengths[-1]
        found = fillings(counts, lengths if counts[size] > 1 else lengths[:-1], capacity - size, budget)
        while True:
            counts[size] -= 1
            lost, filling = next(found, (0, None))
            counts[size] += 1
            if filling is None:
                return
            more = dict(filling)
            more[size] = more.get(size, 0) + 1
            pattern = tuple(sorted(more.items(), reverse=True))
            for times in range(min(counts[s] // n for s, n in pattern), 0, -1):
                yield lost, pattern, times

    # depth first; each level: its branches, the pattern applied, how often, its waste
    levels: list[list] = [[branch(), None, 0, 0]]
    waste = 0
    while levels and budget[0] > 0:
        budget[0] -= 1
        level = levels[-1]
        if level[1]:
            take(level[1], -level[2])
            waste -= level[3]
            level[1] = None
        lost, pattern, times = next(level[0], (0, None, 0))
        spare = (bins - 1) * capacity - total
        if pattern is None or waste + lost > spare:  # later patterns waste no less
            levels.pop()
            continue
        if waste + lost * times > spare:
            continue
        level[1:] = pattern, times, lost * times
        take(pattern, times)
        waste += lost * times
        if not lengths:
            incumbent = [(x[1], x[2]) for x in levels]
            bins = sum(n for _, n in incumbent)
            if bins == least:
                break
            continue
        levels.append([branch(), None, 0, 0])
    return incumbent


def slots(patterns: list[tuple[Filling, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank, first sequence, pieces of this length in each, offset of the first)."""
    out, used, sequence = [], {}, 0
    for pattern, times in patterns:
        offset = 0
        for size, n in pattern:
            first = used.get(size, 0)
            used[size] = first + n * times
            out.append((size, first, used[size] - 1, sequence, n, offset))
            offset += size * n
        sequence += times
    return out


def _pieces(path: str, cut: str, end: int, capacity: int, keep_ids: bool):
    names = ["id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, cut)
        for batch in batches:
            for part in parts(batch, 1):
                rows: list[list] = [[] for _ in range(5)]
                for row, ids in enumerate(enc.encode([t or "" for t in part.column(1).to_pylist()])):
                    ids += tail
                    for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[start : start + 4 * capacity]
                        for to, x in zip(rows, (row, piece, start // 4, len(own) // 4, own), strict=True):
                            to.append(x)
                crc = [zlib.crc32(x) for x in rows[4]]
                cols = [part.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays([*cols, *([pa.array(rows[4], pa.binary())] if keep_ids else [])], names)

    return run


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", cut: str = "words", end: int = 1, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """Token pieces of every document: id, piece, start, length, ids_crc32 and, if kept, ids (uint32 bytes)."""
    common.ship(docs.sparkSession)
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(plain.dtypes)["id"]
    return plain.mapInArrow(common.tidy(_pieces(path, cut, end, capacity, keep_ids)), f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces (columns id, piece and length, and any others). ``parts`` is read
    three times: give a written table."""
    spark = parts.sparkSession
    hist = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    by_length: dict[int, list[tuple]] = {}
    for size, first, _, sequence, each, base in slots(solve(hist, capacity)):
        by_length.setdefault(size, []).append((first, sequence, each, base))
    rows = [(size, *map(list, zip(*sorted(own), strict=True))) for size, own in by_length.items()]
    where = spark.createDataFrame(rows, "length long, firsts array<long>, sequences array<long>, eaches array<long>, bases array<long>")
    widest = max(map(len, by_length.values()), default=1)
    salts = max(16, common.partitions(spark))
    salted = parts.withColumn("__salt", F.pmod(F.xxhash64("id", "piece"), F.lit(salts)))
    sums = salted.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    own = Window.partitionBy("length", "__salt").orderBy("id", "piece")
    ranked = salted.withColumn("__row", F.row_number().over(own) - 1).join(sums, ["length", "__salt"]).withColumn("__rank", F.col("__before") + F.col("__row"))
    placed = ranked.join(F.broadcast(where), "length").withColumn("__slot", common.last_at_most(F.col("firsts"), F.col("__rank"), widest))
    own = lambda c: F.get(c, F.col("__slot"))
    at = F.col("__rank") - own("firsts")
    sequence = own("sequences") + F.floor(at / own("eaches"))
    return placed.select(*parts.columns, sequence.cast("long").alias("sequence_id"), (own("bases") + at % own("eaches") * F.col("length")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", cut: str = "words", end: int = 1, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """Pieces of every document with their places: id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    folder = common.shared_dir(docs.sparkSession)
    parts = common.staged(pieces(docs, path, id_col, text_col, cut, end, capacity, keep_ids), folder, "pieces")
    return pack(parts, capacity).withColumnRenamed("id", id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences as uint32 bytes; each holds at most the capacity. Pieces with null ids
    count as empty; an empty table gives an empty result."""
    own = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda acc, x: F.concat(acc, F.coalesce(x["ids"], F.lit(b""))))
    return own.select("sequence_id", joined.alias("ids"))
