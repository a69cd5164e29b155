"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams (3 to 5, with word borders) and of itself, hashed into
BUCKETS; so a misspelling that training never saw shares most of its vectors with the word it stands for. A window
of WINDOW words is the mean of its words, a linear softmax over two classes reads the window, and a text is as
toxic as its most toxic window, in training (the gradient goes through that window) as in scoring. Windows overlap
by half and cover the whole text, whatever its length.

Training draws a bounded sample of labelled texts on the driver: at most PER_CLASS of each label, those of least
xxhash64(doc_id); the labels are drawn first, so the texts are read once. Of a text of more than LONGEST characters
training sees PIECES equal pieces of LONGEST characters in all, spread evenly from its start to its end (a bound on
memory; scoring reads whole texts). All other work is one pass over the texts without a shuffle. The trained model has
a fixed size.

Cases: null and empty texts get the score of a text without words (the prior alone); null ids pass through; rows
without a label or with null labels train nothing; an id with both labels counts as toxic, rows repeated under one id
train by the least of their texts; with fewer than two classes to learn from every score is the share of toxic labels
(0 without labels). Only the id and text columns are read.
"""

from __future__ import annotations

import gc
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geostrata.llm import common

BUCKETS, DIM = 1 << 18, 8
WINDOW = 4
PER_CLASS, LONGEST, PIECES = 1500, 40_000, 20
EPOCHS, RATE = 100, 0.5
#: Share of the toxic class in the loss; below half, as clean documents should stay.
TOXIC_WEIGHT = 0.3
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(r"[^\W_]+")
#: Words whose buckets or scores a worker remembers.
BOUND = 300_000


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def buckets_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' n-grams and of the words themselves, and how many each word has; hashes of all
    words at once."""
    marked = [f"<{w}>" for w in words]
    sizes = np.array([len(w) for w in marked])
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(codes))  # characters from here to the word's end
    found, owners = [], []
    for n in (3, 4, 5):
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = (h + codes[at + k]) * _PRIME
        found.append(_mixed(h))
        owners.append(owner[at])
    place = np.arange(len(codes)) - np.repeat(ends - sizes, sizes)
    whole = np.add.reduceat(_mixed(codes + place.astype(np.uint64) * _PRIME), ends - sizes)
    found.append(_mixed(whole))
    owners.append(np.arange(len(words)))
    index, owners = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return (index[order] % np.uint64(BUCKETS)).astype(np.int32), np.bincount(owners, minlength=len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _PRIME
    return x ^ (x >> np.uint64(29))


def window_starts(n: int) -> np.ndarray:
    """First words of the windows of n words: half a window apart, the last one at the end."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    return np.unique(np.r_[np.arange(0, n - WINDOW, WINDOW // 2), n - WINDOW])


@dataclass
class Model:
    """score: of each bucket, its vector times the difference of the two classes' weights."""

    score: np.ndarray
    bias: float

    def words(self, words: list[str]) -> list[float]:
        """Scores of words: the means over their buckets."""
        out: list[float] = []
        for at in range(0, len(words), 20_000):
            index, counts = buckets_of(words[at : at + 20_000])
            out += (np.add.reduceat(self.score[index].astype(np.float64), np.r_[0, np.cumsum(counts)[:-1]]) / counts).tolist()
        return out

    def of(self, scores: np.ndarray) -> float:
        """Probability of class 1 of a text with these word scores."""
        if not len(scores):
            return 1 / (1 + math.exp(-self.bias))
        sums = np.r_[0.0, np.cumsum(scores, dtype=np.float64)]
        at = window_starts(len(scores))
        size = min(WINDOW, len(scores))
        best = float(((sums[at + size] - sums[at]) / size).max()) + self.bias
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, best))))


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, rate: float = RATE) -> Model:
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        share = min(max(float(y.mean()) if len(y) else 0.0, 1e-9), 1 - 1e-9)
        return Model(np.zeros(BUCKETS, np.float32), math.log(share / (1 - share)))
    vocabulary: dict[str, int] = {}
    tokens, starts, sizes, doc = [], [], [], []
    at = 0
    for d, text in enumerate(texts):
        own = [vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)]
        if not own:
            continue
        first = window_starts(len(own))
        starts.append(first + at)
        sizes.append(np.full(len(first), min(WINDOW, len(own))))
        doc.append(np.full(len(first), d))
        tokens.append(np.array(own, np.int32))
        at += len(own)
    if not tokens:
        return train([], [])
    tokens, starts, sizes, doc = map(np.concatenate, (tokens, starts, sizes, doc))
    known = list(vocabulary)
    grams = [buckets_of(known[i : i + 20_000]) for i in range(0, len(known), 20_000)]
    index, counts = np.concatenate([g for g, _ in grams]), np.concatenate([c for _, c in grams])
    cuts = np.r_[0, np.cumsum(counts)[:-1]]
    del grams, vocabulary, known

    rng = np.random.default_rng(7)
    vectors = rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32)
    weights = rng.normal(0, 1, (2, DIM)).astype(np.float32) * 4
    bias = np.zeros(2)
    weight = np.where(y == 1, TOXIC_WEIGHT / (y == 1).sum(), (1 - TOXIC_WEIGHT) / (y == 0).sum())
    groups = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    docs = doc[groups]
    squares_v, squares_w, squares_b = np.full(BUCKETS, 1e-8), np.full((2, DIM), 1e-8), np.full(2, 1e-8)
    for _ in range(epochs):
        u = weights[1] - weights[0]
        word = np.add.reduceat((vectors @ u)[index], cuts) / counts
        sums = np.r_[0.0, np.cumsum(word[tokens], dtype=np.float64)]
        mean = (sums[starts + sizes] - sums[starts]) / sizes
        top = np.maximum.reduceat(mean, groups)
        # the first of the best windows of each text
        best = np.flatnonzero(mean >= np.repeat(top, np.diff(np.r_[groups, len(mean)])))
        best = best[np.r_[True, doc[best][1:] != doc[best][:-1]]]
        p = 1 / (1 + np.exp(-np.clip(mean[best] + bias[1] - bias[0], -50, 50)))
        g = (p - y[docs]) * weight[docs]
        size = sizes[best]
        spread = np.repeat(starts[best] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        dword = np.bincount(tokens[spread], np.repeat(g / size, size), len(word))
        dbucket = np.bincount(index, np.repeat(dword / counts, counts), BUCKETS)
        # all vectors move along u: the gradient is an outer product
        du = vectors.T @ dbucket.astype(np.float32)
        # one step size for all of them, set by the largest gradient so far: rare n-grams move little
        squares_v += dbucket**2 * float(u @ u)
        vectors -= (rate * dbucket / math.sqrt(float(squares_v.max()) + 1e-12)).astype(np.float32)[:, None] * u
        dw = np.stack([-du, du])
        squares_w += dw**2
        weights -= (rate * dw / np.sqrt(squares_w)).astype(np.float32)
        db = np.array([-g.sum(), g.sum()])
        squares_b += db**2
        bias -= rate * db / np.sqrt(squares_b)
    return Model((vectors @ (weights[1] - weights[0])).astype(np.float32), float(bias[1] - bias[0]))


def _spread(text: Column) -> Column:
    """A text as training sees it: whole, or PIECES evenly spaced pieces of it."""
    size = LONGEST // PIECES
    step = (F.length(text) - size) / (PIECES - 1)
    cut = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda i: F.substring(text, F.floor(i * step).cast("int") + 1, F.lit(size)))
    return F.when(F.length(text) > LONGEST, F.array_join(cut, " ")).otherwise(text)


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[list[str], list[int]]:
    """The bounded training sample: at most PER_CLASS texts of each label, in a fixed order."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)")
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    usable = known.join(docs.select(F.col(id_col).cast("long").alias("id")), "id", "left_semi")
    drawn = None
    for label in (0, 1):
        part = usable.filter(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(PER_CLASS)
        drawn = part if drawn is None else drawn.union(part)
    chosen = {r["id"]: r["label"] for r in drawn.collect()}  # at most 2 * PER_CLASS rows
    if not chosen:
        return [], []
    wanted = docs.sparkSession.createDataFrame([(i,) for i in chosen], "id long")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(wanted), "id")
    rows = texts.select("id", _spread(F.col("text")).alias("text")).groupBy("id").agg(F.min("text").alias("text")).orderBy("id").collect()
    return [r["text"] for r in rows], [chosen[r["id"]] for r in rows]


def _score(score: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = Model(score, bias), {}
        for batch in batches:
            out: list[float] = []
            for at in range(0, batch.num_rows, 1000):
                gc.disable()  # no garbage arises here
                texts = [words_of(t.as_py()) for t in batch.column(1).slice(at, 1000)]
                used = set().union(*texts)
                if len(cache) > BOUND:  # what these texts use stays
                    cache = {w: cache[w] for w in used if w in cache}
                new = [w for w in used if w not in cache]
                cache.update(zip(new, model.words(new), strict=True))
                out += [model.of(np.fromiter(map(cache.__getitem__, own), np.float64, len(own))) for own in texts]
                gc.enable()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["id", "score"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): probability that a text is toxic."""
    common.ship(docs.sparkSession)
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(plain.dtypes)["id"]
    return plain.mapInArrow(common.tidy(_score(model.score, model.bias)), f"id {kind}, score double").withColumnRenamed("id", id_col)


def rejected(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """All columns of the documents that are kept: those with a score below ``least``."""
    common.ship(docs.sparkSession)
    run, fields = _score(model.score, model.bias), docs.schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: deque[pa.RecordBatch] = deque()

        def texts() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held.append(batch)
                text = batch.column(batch.schema.names.index(text_col))
                yield pa.RecordBatch.from_arrays([text, text], ["id", "text"])

        for found in run(texts()):
            yield held.popleft().filter(pa.array(found.column(1).to_numpy() < least))

    return docs.mapInArrow(common.tidy(keep), fields)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Train on the bounded sample of labelled texts. Filter ``labels`` to hold rows out."""
    return train(*sample(docs, labels, id_col, text_col, label_col))
