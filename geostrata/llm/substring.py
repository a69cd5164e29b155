"""Repeated lines and paragraphs: every unit's digest is grouped globally and all but its earliest occurrence go.

Units are every line and every paragraph (lines up to one without words) of any length, and runs of sentences: a text
is cut at line ends, and at ., ! or ? before white space, and a sentence together with as many of the following as it
takes to reach MIN_WORDS words is a unit. So is every run of WINDOW words, wherever it stands: a passage of as many
words goes from its first word to its last, whatever surrounds it. Units are normalised before hashing: lower case,
punctuation and white space runs reduced to one space; what holds no word is no unit. Occurrences rank by (doc_id,
offset); the first is kept. An occurrence that overlaps the first in its own text is no repeat of it.

Runs of WINDOW words are as many as there are words; so only anchors, some 2 of 26, are grouped first (winnowing), and
a second reading makes the windows around those that occur twice and groups them.

The digests are grouped with map-side partial minima: a very common passage costs one row for each task, and only
(digest, first id) of units that occur twice come back, joined by digest; that join's hot keys are split by AQE. Digests
have 128 bits, so that equal ones mean equal units at any size; anchors, which only point at windows, have 64.

Cases: a null or empty text has no units and stays as it is; rows repeated under one id count as one
document and keep or lose the same; rows without an id are kept whole and take no part; an empty table gives an empty result; only
the id and text columns are read, all others pass through.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geostrata.llm import common
from geostrata.llm.common import own_prefix, quote

MIN_WORDS = 25
#: Words of a window, and of an anchor: of the anchors of a window, the one of the least hash is sent.
WINDOW, ANCHOR = 50, 26
FIRST, INNER, OVER, NEAR = 0, 1, 2, 3
_UNIT = re.compile(r"[^\n.!?]*(?:[.!?]+(?!\s)[^\n.!?]*)*(?:[.!?]+(?=\s|$)|\n|$)[^\S\n]*\n?")
_NORMAL = re.compile(r"[\W_]+")
_BASE, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_BASE2 = 0xC2B2AE3D27D4EB4F
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


@functools.cache
def _codes() -> np.ndarray:
    """A number for each code point of a word, alike for both cases; 0 for others. What words are is as in _NORMAL."""
    small = (c.lower() if len(c.lower()) == 1 else c for c in map(chr, range(0x110000)))
    x = np.fromiter((ord(c) + 1 if c.isalnum() else 0 for c in small), np.uint64, 0x110000)
    return np.where(x > 0, _mixed(_mixed(x * np.uint64(_BASE))), np.uint64(0))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_MIX)
    return x ^ (x >> np.uint64(32))


def _sums(x: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice, base: int = _BASE) -> np.ndarray:
    """Digests of the parts of x from start to end, wherever they stand: rolling hashes modulo 2^64, mixed."""
    n = len(x) + 1
    if base not in _powers or len(_powers[base][0]) < n:
        _powers[base] = tuple(np.cumprod(np.r_[np.uint64(1), np.full(max(n + n // 8, 1 << 16), b, np.uint64)]) for b in (base, pow(base, -1, 2**64)))
    up, down = _powers[base]
    sums = np.zeros(n, np.uint64)
    np.cumsum(x * up[: n - 1], out=sums[1:])
    return _mixed((sums[end] - sums[start]) * down[:n][start])


def words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, digest) of the words of a text."""
    x = _codes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    inside = np.zeros(len(x) + 2, np.int8)
    inside[1:-1] = x != 0
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2], _sums(x, edges[::2], edges[1::2])


def rolled(x: np.ndarray, size: int, base: int = _BASE) -> np.ndarray:
    """The digest of each run of ``size`` words, of the words' digests."""
    return _sums(x, slice(0, len(x) + 1 - size), slice(size, None), base).view(np.int64) if len(x) >= size else np.empty(0, np.int64)


def _sliding(best: np.ufunc, x: np.ndarray, size: int) -> np.ndarray:
    have = 1
    while have < size:
        step = min(have, size - have)
        x = best(x[:-step], x[step:])
        have += step
    return x


def anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(first word, digest) of the anchors of a text: the least of each WINDOW - ANCHOR + 1 neighbouring runs of ANCHOR
    words. Equal windows of WINDOW words have an anchor in common, whatever stands around them."""
    x, size = rolled(words(text)[2], ANCHOR), WINDOW - ANCHOR + 1
    if len(x) < size:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    least = np.full(len(x) + size - 1, np.iinfo(np.int64).min)
    least[size - 1 : len(x)] = _sliding(np.minimum, x, size)
    at = np.flatnonzero(_sliding(np.maximum, least, size) == x)
    return at, x[at]


def windows(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, both halves of the digest) of each run of WINDOW words of a text, from its first letter to its last."""
    start, end, own = words(text)
    x = rolled(own, WINDOW)
    y = rolled(_mixed(own ^ np.uint64(_BASE2)), WINDOW, _BASE2)
    return start[: len(x)], end[WINDOW - 1 :][: len(x)], x, y


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences and line ends of a text; together they cover it without gaps."""
    return [m.span() for m in _UNIT.finditer(text) if m.end() > m.start()]


def _runs(text: str, min_words: int) -> list[tuple[int, int, bytes]]:
    """(start, end, digest) of the lines, paragraphs and sentence runs of a text, by start; longer ones first."""
    spans = sentences(text)
    words = [_NORMAL.sub(" ", text[s:e].lower()).split() for s, e in spans]
    sizes = [len(w) for w in words]
    joined = [" ".join(w) for w in words]
    found: set[tuple[int, int]] = set()
    line, paragraph, lines = 0, -1, 0
    for i, (s, e) in enumerate(spans):
        breaks = text.count("\n", s, e)  # a sentence may end in a line's end and an empty line
        if i + 1 < len(spans) and not breaks:
            continue
        blank = not any(sizes[line : i + 1])
        if not blank:
            found.add((line, i + 1))
            paragraph, lines = line if paragraph < 0 else paragraph, lines + 1
        if paragraph >= 0 and (blank or breaks > 1 or i + 1 == len(spans)):
            if lines > 1:
                found.add((paragraph, line if blank else i + 1))
            paragraph, lines = -1, 0
        line = i + 1
    end = total = 0
    for i in range(len(spans)):
        while end < len(spans) and total < min_words:
            total += sizes[end]
            end += 1
        if total < min_words:
            break
        if sizes[i]:
            found.add((i, end))
        total -= sizes[i]
    out = []
    for i, end in sorted(found, key=lambda x: (x[0], -x[1])):
        body = " ".join(x for x in joined[i:end] if x)
        out.append((spans[i][0], spans[end - 1][1], xxhash.xxh3_128_digest(body.encode("utf-8", "replace"))))
    return out


def _states(found: Iterable[tuple]) -> Iterator[tuple]:
    """The units, by start, with FIRST, INNER or OVER: the first of its digest in the text, one after the first's end,
    and one that overlaps the first and so is no repeat of it, but may be one of an earlier text's."""
    ends: dict[object, int] = {}
    for start, end, digest in found:
        first = ends.setdefault(digest, -1)
        if first < 0:
            ends[digest] = end
        yield start, end, digest, FIRST if first < 0 else INNER if start >= first else OVER


def units(text: str, min_words: int = MIN_WORDS) -> list[tuple]:
    """(start, end, digest) of the units of a text: its lines and paragraphs of any length, and each sentence with as
    many of the following as it takes to reach ``min_words`` words, and each run of WINDOW words; without those that
    overlap their like."""
    start, end, x, y = (x.tolist() for x in windows(text))
    every = zip(start, end, zip(x, y, strict=True), strict=True)
    return [(s, e, d) for found in (_runs(text, min_words), every) for s, e, d, state in _states(found) if state != OVER]


_UNITS = "id long, start int, end int, digest long, digest2 long, state byte"


def _batch(rows: list[tuple], more: list[tuple]) -> pa.RecordBatch:
    """Rows of _UNITS with one digest of 128 bits, and more of them as columns."""
    ids, starts, ends, digests, states = list(zip(*rows, strict=True)) or [()] * 5
    halves = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2)
    cols = [ids, starts, ends, halves[:, 0], halves[:, 1], states]
    kinds = [np.int64, np.int32, np.int32, np.int64, np.int64, np.int8]
    cols = [np.concatenate([np.array(c, k), *(x[i].astype(k) for x in more)]) for i, (c, k) in enumerate(zip(cols, kinds, strict=True))]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["id", "start", "end", "digest", "digest2", "state"])


def _digests(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows: list[tuple] = []
                more: list[tuple] = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    text = text.as_py() or ""
                    rows += ((doc_id, *x) for x in _states(_runs(text, min_words)))
                    word, digest = anchors(text)
                    more.append((np.full(len(word), doc_id), word, word, digest, np.zeros(len(word), np.int64), np.full(len(word), NEAR, np.int8)))
                yield _batch(rows, more)

    return run


def _candidates(text: str, first: np.ndarray, last: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, end, digests, state) of the windows around anchors that occur twice. Those inside one unit that goes are
    left out: they go with it, and its earliest occurrence holds them too."""
    start, end, digest, digest2 = windows(text)
    near = np.zeros(len(start) + WINDOW, np.int64)
    at = first[kind == NEAR]
    np.add.at(near, np.maximum(at - (WINDOW - ANCHOR), 0), 1)
    np.add.at(near, at + 1, -1)
    use = near.cumsum()[: len(start)] > 0
    first, last = first[kind != NEAR], last[kind != NEAR]
    if len(first):
        order = np.argsort(first, kind="stable")
        s, e = first[order], last[order]
        at = np.searchsorted(s, start, "right") - 1
        use &= (at < 0) | (np.maximum.accumulate(e)[at] < end)
    start, end, digest, digest2 = start[use], end[use], digest[use], digest2[use]
    state = np.zeros(len(start), np.int8)
    if len(np.unique(digest)) < len(digest):
        both = zip(digest.tolist(), digest2.tolist(), strict=True)
        state = np.array([x[3] for x in _states(zip(start.tolist(), end.tolist(), both, strict=True))], np.int8)
    return start, end, digest, digest2, state


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        more, n = [], 0
        for doc_id, text, marks in zip(*batch.columns, strict=True):
            found = _candidates(text.as_py() or "", *(marks.values.field(i).to_numpy() for i in range(3)))
            more.append((np.full(len(found[0]), doc_id.as_py()), *found))
            n += len(found[0])
            if n >= 100_000:
                yield _batch([], more)
                more, n = [], 0
        yield _batch([], more)


def duplicate_spans(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, start, end): code-point spans of units that occurred before, at a smaller (id, start). Offsets are 32-bit, as
    Spark's strings are shorter than that."""
    plain = docs.select(F.col(quote(id_col)).cast("long").alias("id"), F.col(quote(text_col)).cast("string").alias("text")).filter("id is not null")
    found = common.staged(plain.mapInArrow(common.tidy(_digests(min_words)), _UNITS), folder, "units")
    again = _again(found, folder, "again")
    hits = common.staged(_hits(found, again), folder, "hits", let_go=True)
    common.discard(docs.sparkSession, folder, "units", "again")  # all that is read from here on is in hits
    marks = hits.groupBy("id").agg(F.collect_set(F.struct("start", "end", "state")).alias("marks"), F.max("state").alias("most")).filter(F.col("most") == NEAR)
    closer = common.staged(plain.join(marks, "id").select("id", "text", "marks").mapInArrow(common.tidy(_windows), _UNITS), folder, "windows", let_go=True)
    late = common.staged(_hits(closer, _again(closer, folder, "again_windows")), folder, "late", let_go=True)
    common.discard(docs.sparkSession, folder, "windows", "again_windows")
    return hits.filter(F.col("state") != NEAR).drop("state").union(late.drop("state"))


def _again(found: DataFrame, folder: str, name: str) -> DataFrame:
    """(digests, first id) of units in two documents, and of anchors in two places."""
    firsts = found.filter(F.col("state").isin(FIRST, NEAR))
    return common.staged(firsts.groupBy("digest", "digest2").agg(F.count("*").alias("n"), F.min("id").alias("first")).filter("n > 1").select("digest", "digest2", "first"), folder, name, let_go=True)


def _hits(found: DataFrame, again: DataFrame) -> DataFrame:
    """(id, start, end, state) of units that occurred before, and of anchors that occur twice."""
    own = found.filter(F.col("state") == INNER).select("id", "start", "end", "state")
    met = found.filter(F.col("state") != INNER).join(again, ["digest", "digest2"]).filter((F.col("state") == NEAR) | (F.col("id") > F.col("first")))
    return met.select("id", "start", "end", "state").union(own)


def _cut(text: str, spans: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """The text without the (merged) spans, and the kept parts' spans in the original."""
    kept, at = [], 0
    for s, e in sorted(spans):
        if s > at:
            kept.append((at, s))
        at = max(at, e)
    if at < len(text):
        kept.append((at, len(text)))
    return "".join(text[s:e] for s, e in kept), kept


def _merged(spans: pa.ListScalar) -> list[tuple[int, int]]:
    """Spans in order of their starts, those that overlap or touch as one."""
    start, end = (spans.values.field(i).to_numpy().astype(np.int64) for i in range(2))
    upto = np.maximum.accumulate(end)
    at = np.flatnonzero(np.r_[True, start[1:] > upto[:-1]])
    return list(zip(start[at].tolist(), upto[np.r_[at[1:], len(end)] - 1].tolist(), strict=True))


def _rewrite(text_at: int, names: list[str], clean: str, kept_name: str):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, kept = [], []
            for text, spans in zip(batch.column(text_at), batch.column(len(names)), strict=True):
                text = text.as_py()
                rest, own = (None, []) if text is None else _cut(text, _merged(spans) if spans.is_valid else [])
                texts.append(rest)
                kept.append([{"start": s, "end": e} for s, e in own])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(texts, pa.string()), pa.array(kept, kind)], [*names, clean, kept_name])

    return run


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, text, kept_spans, removed): every document without its repeated units. kept_spans are the [start, end)
    code points of what is left, in the original text; removed is the number of code points gone."""
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out, clean, kept = _cleaned(plain, "id", "text", min_words)
    removed = F.coalesce(F.length("text") - F.length(clean), F.lit(0)).cast("long")
    return out.select(F.col("id").alias(id_col), F.col(clean).alias(text_col), F.col(kept).alias("kept_spans"), removed.alias("removed"))


def _cleaned(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> tuple[DataFrame, str, str]:
    """docs with two more columns, and their names: the text left and the kept spans. Texts are shuffled to meet their
    spans. The columns may have any names: those added have a prefix that none of them has."""
    spark = docs.sparkSession
    common.ship(spark)
    p = own_prefix(docs)
    of, cut, clean, kept = (p + x for x in ("of", "spans", "clean", "kept"))
    spans = duplicate_spans(docs, common.shared_dir(spark), id_col, text_col, min_words)
    by_doc = spans.groupBy(F.col("id").alias(of)).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias(cut))
    both = docs.join(by_doc, F.col(quote(id_col)).cast("long") == F.col(of), "left").select(*map(quote, docs.columns), cut)
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    plain = [f"c{i}" for i in range(len(docs.columns))]  # mapInArrow does not take names with backticks
    fields = T.StructType([*(T.StructField(c, f.dataType) for c, f in zip(plain, docs.schema.fields, strict=True)), T.StructField(clean, T.StringType()), T.StructField(kept, span)])
    out = both.toDF(*plain, cut).mapInArrow(common.tidy(_rewrite(docs.columns.index(text_col), plain, clean, kept)), fields)
    return out.toDF(*docs.columns, clean, kept), clean, kept


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs, all columns as they were, with repeated units taken out of the text."""
    out, clean, _ = _cleaned(docs, id_col, text_col, min_words)
    return out.select(*(F.col(clean).alias(c) if c == text_col else F.col(quote(c)) for c in docs.columns))
