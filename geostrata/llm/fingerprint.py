"""Threshold-scaled document fingerprints, in DataFrame functions alone.

A fingerprint keeps every 64-bit hash of a text's five-word shingles that lies below a fixed fraction of the hash
range. So that short texts are not left empty, a text with fewer than FLOOR such hashes has a higher threshold of
its own: that of its FLOOR-th smallest hash, or the whole range if it has no more than FLOOR shingles. Each
fingerprint states its threshold, and two of them are compared below the smaller one; fingerprints so stay
mergeable (union of hashes below the smaller threshold) whatever the lengths of their texts.

As a string: threshold:hashes, all as 16 hex digits in ascending order, hashes joined without a separator.

Cases: a null, empty or wordless text has the fingerprint of no hashes; two of those are alike (1), one of them
and another text are not (0). Texts of fewer than five words have one shingle, of all their words. Repeated ids
are ordered by a hash of their text, equal rows among them anyhow. Null ids come last in descending order and count as
documents.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geostrata.llm import common

WORDS = 5
#: The fixed fraction: one hash in eight.
SCALE = 8
FLOOR = 64
_TOP = 2**63 - 1


def let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def shingles(text: Column, k: int = WORDS) -> Column:
    """Sorted distinct non-negative 64-bit hashes of the k-word shingles of lower-cased text."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def hashed(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*(h[i + j] for j in range(k))))
        return F.when(F.size(h) >= k, windows).when(F.size(h) > 0, F.array(F.xxhash64(F.concat_ws(" ", h.cast("array<string>")))))

    grams = let(F.transform(words, lambda w: F.xxhash64(w)), hashed)
    empty = F.array().cast("array<bigint>")
    return F.array_sort(F.array_distinct(F.transform(F.coalesce(grams, empty), lambda x: x.bitwiseAND(F.lit(_TOP)))))


def fingerprint(text: Column, k: int = WORDS, scale: int = SCALE, floor: int = FLOOR) -> Column:
    """struct(top: the threshold, hashes: those up to it in ascending order)."""
    fixed = _TOP // scale

    def cut(hashes: Column, top: Column) -> Column:
        return F.struct(top.alias("top"), F.filter(hashes, lambda x: x <= top).alias("hashes"))

    def trimmed(hashes: Column) -> Column:
        whole = F.struct(F.lit(_TOP).alias("top"), hashes.alias("hashes"))
        return F.when(F.size(hashes) <= floor, whole).otherwise(let(F.greatest(F.lit(fixed), F.get(hashes, F.lit(floor - 1))), lambda top: cut(hashes, top)))

    return let(shingles(text, k), trimmed)


def as_text(print_: Column) -> Column:
    digits = lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))
    return F.concat(digits(print_["top"]), F.lit(":"), F.array_join(F.transform(print_["hashes"], digits), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated containment of the smaller text's shingles in the larger one's, from 0 to 1."""

    def within(x: Column, top: Column) -> Column:
        return F.when(x["top"] <= top, x["hashes"]).otherwise(F.filter(x["hashes"], lambda v: v <= top))

    def compared(top: Column) -> Column:
        return let(F.struct(within(a, top).alias("x"), within(b, top).alias("y")), lambda p: F.when(
            (F.size(p["x"]) == 0) & (F.size(p["y"]) == 0), F.lit(1.0)
        ).when((F.size(p["x"]) == 0) | (F.size(p["y"]) == 0), F.lit(0.0)).otherwise(
            F.size(F.array_intersect(p["x"], p["y"])) / F.least(F.size(p["x"]), F.size(p["y"])).cast("double")))

    return F.coalesce(let(F.least(a["top"], b["top"]), compared), F.lit(0.0))


def resemblance(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity, from 0 to 1."""

    def compared(top: Column) -> Column:
        x, y = (F.filter(p["hashes"], lambda v: v <= top) for p in (a, b))
        return let(F.struct(F.size(F.array_intersect(x, y)).alias("i"), F.size(F.array_union(x, y)).alias("u")), lambda p: F.when(p["u"] == 0, F.lit(1.0)).otherwise(p["i"] / p["u"]))

    return let(F.least(a["top"], b["top"]), compared)


def merged(a: Column, b: Column) -> Column:
    """The fingerprint of both texts' shingles together."""
    return let(F.least(a["top"], b["top"]), lambda top: F.struct(top.alias("top"), F.array_sort(F.array_union(F.filter(a["hashes"], lambda v: v <= top), F.filter(b["hashes"], lambda v: v <= top))).alias("hashes")))


def range_bucket(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are <= value: a binary search in one expression."""
    if not bounds:
        return F.lit(0)
    steps, s = [], 1
    while s <= len(bounds):
        steps.insert(0, s)
        s *= 2
    table = F.array(*map(F.lit, bounds))

    def step(at: Column, jump: Column) -> Column:
        return F.when((at + jump <= len(bounds)) & (F.get(table, at + jump - 1) <= value), at + jump).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def bucket_bounds(ids: DataFrame, column: str, buckets: int) -> tuple[list[int], dict[int, int]]:
    """Approximate quantiles of an id column, at most 2 * ``buckets`` numbers whatever the rows; and the ids that fill
    several buckets, with the buckets they fill. Those have a bound below and above them."""
    if buckets < 2:
        return [], {}
    at = [i / buckets for i in range(1, buckets)]
    found = ids.agg(F.percentile_approx(column, at, 10 * buckets).alias("q")).first()["q"] or []
    hot = {v: n for v, n in Counter(found).items() if n > 1}
    return sorted({*found, *(v + 1 for v in hot)}), hot


def with_next(docs: DataFrame, id_col: str, columns: list[str], derive=lambda df: df, rows_per_bucket: int = 512) -> DataFrame:
    """derive(docs) with next_<column>: the value in the row that follows in descending (id, hash of the first of columns,
    that column) order; the last row is followed by the first.

    One shuffle, by id ranges of about ``rows_per_bucket`` rows; rows of one id (or without one) that fill several of
    those are dealt over as many by their hashes. The first row of each bucket follows the last of the one above; those
    rows are found by their ids and hashes and joined by bucket: as many rows as buckets."""
    sizes = docs.agg(F.count("*").alias("n"), F.count(id_col).alias("known")).first()
    bounds, hot = bucket_bounds(docs.select(id_col), id_col, min(20_000, -(-sizes["known"] // rows_per_bucket)))
    parts = {-1: -(-(sizes["n"] - sizes["known"]) // rows_per_bucket)} | {bisect_right(bounds, v): n for v, n in hot.items()}
    parts = {k: n for k, n in parts.items() if n > 1}
    mixed = F.xxhash64(columns[0])

    def bucketed(df: DataFrame) -> DataFrame:
        """df with __hash (of rows of one id only; else 0) and __bucket."""
        bucket = F.when(F.col(id_col).isNull(), F.lit(-1)).otherwise(range_bucket(F.col(id_col), bounds)).cast("long")
        if not parts:
            return df.withColumns({"__hash": F.lit(0).cast("long"), "__bucket": bucket})
        many = F.create_map(*(F.lit(x) for k, n in parts.items() for x in (k, n)))
        df = df.withColumn("__range", bucket).withColumn("__parts", F.coalesce(many[F.col("__range").cast("int")], F.lit(1)))
        df = df.withColumn("__hash", F.when(F.col("__parts") > 1, mixed).otherwise(F.lit(0)).cast("long"))
        part = F.least(F.floor((F.col("__hash") / 2.0**64 + 0.5) * F.col("__parts")), F.col("__parts") - 1)
        return df.withColumn("__bucket", F.col("__range") * (1 << 24) + part).drop("__range", "__parts")

    keyed = bucketed(docs)
    order = [F.col(id_col).desc_nulls_last(), F.col("__hash").desc(), *(F.col(c).desc_nulls_last() for c in columns[:1])]
    w = Window.partitionBy("__bucket").orderBy(*order)
    lead = derive(keyed).withColumn("__next", F.lead(F.struct(*columns)).over(w))

    place = F.struct(F.col(id_col).alias("id"), F.col("__hash").alias("hash"))
    tops = bucketed(docs.select(id_col, *(columns[:1] if parts else []))).groupBy("__bucket").agg(F.max(place).alias("__top"))
    every = Window.orderBy(F.col("__bucket").desc())
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # one row per bucket; the last bucket is followed by the first
    after = tops.select(F.col("__bucket").alias("__of"), F.coalesce(F.lead("__bucket").over(every), F.first("__bucket").over(whole)).alias("__bucket"))
    tops = tops.join(after, "__bucket")
    heads = keyed.join(F.broadcast(tops.select("__bucket", "__top", "__of")), "__bucket").filter(place.eqNullSafe(F.col("__top"))).drop("__bucket", "__top")
    heads = derive(heads).groupBy(F.col("__of").alias("__bucket")).agg(F.max_by(F.struct(*columns), F.struct(F.col(columns[0]))).alias("__head"))
    both = lead.join(heads, "__bucket", "left")
    nxt = F.coalesce("__next", "__head")
    return both.select(*(c for c in lead.columns if not c.startswith("__")), *(nxt[c].alias(f"next_{c}") for c in columns))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form: the last half of its code points replaced by the first
    as many of the next document in descending id order. Columns: id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next (containment), edited_resemblance."""
    plain = docs.select(F.col(id_col).alias("id"), common.text_of(text_col).alias("text"))
    both = with_next(plain, "id", ["text", "fp"], lambda df: df.withColumn("fp", fingerprint(F.col("text"))))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    both = both.select("id", F.length("text").cast("long").alias("n_chars"), "fp", F.col("next_fp"), edited.alias("edited"))
    both = both.select("id", "n_chars", "fp", "next_fp", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("edited")).alias("efp"))
    return both.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), resemblance(F.col("fp"), F.col("efp")).alias("edited_resemblance"),
    )
