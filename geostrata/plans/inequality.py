"""Counts over joins on one or two inequalities, without their pairs.

``SELECT a.k, count(*) FROM a JOIN b ON a.x < b.x AND a.y > b.y GROUP BY a.k`` makes as many pairs as the product of the
sides. Where a statement asks only for columns of one side and for count(*), each distinct (x, y) of that side needs only
the number of rows of the other side beyond it. Both values are cut into at most BUCKETS ranges by quantiles. Ranges wholly
beyond a value's own are added up from a table of running sums; rows of its own range of x or of y are counted one by one,
as they meet by range. So the work grows with rows x rows / BUCKETS at most, on distinct values, and no pair is kept."""

from __future__ import annotations

import math
import re
import uuid

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geostrata.plans.spatial_sql import _END, _fits, _struct, chain, conjuncts
from geostrata.plans.tokens import Token, following, join, split_top, tokens, top_word

#: Ranges of a value, and pairs from which counting by ranges is worth its jobs.
BUCKETS, PAIRS = 1024, 16_000_000
_TYPES = {"tinyint", "smallint", "int", "bigint", "float", "double", "date"}
_MIRROR = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}
_TEST = {"<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}


def _bounds(df: DataFrame, names: list[str]) -> list[list]:
    """Distinct quantiles of each value, ascending."""
    n = min(BUCKETS, max(2, math.isqrt(df.count())))
    shares = F.expr(f"array({', '.join(f'{k / n}D' for k in range(1, n))})")
    row = df.agg(*(F.percentile_approx(c, shares, 4 * n).alias(c) for c in names)).first()
    return [sorted(set(row[c] or [])) for c in names]


def _cut(df: DataFrame, bounds: list[list], kinds: list[str]) -> DataFrame:
    """df with b0[, b1], the numbers of bounds that x0[, x1] have reached: among every 32nd first, then within those 32."""
    blocks = [[xs[i : i + 32] for i in range(0, len(xs), 32)] for xs in bounds]
    row = [x for b in blocks for x in ([c[0] for c in b], b)]
    schema = ", ".join(f"__f{d} array<{t}>, __b{d} array<array<{t}>>" for d, t in enumerate(kinds))
    df = df.crossJoin(F.broadcast(df.sparkSession.createDataFrame([tuple(row)], schema)))
    reached = lambda xs, x: F.size(F.filter(xs, lambda b: b <= x))
    for d in range(len(kinds)):
        df = df.withColumn(f"__k{d}", reached(F.col(f"__f{d}"), F.col(f"x{d}")))
        df = df.withColumn(f"b{d}", F.when(F.col(f"__k{d}") == 0, 0).otherwise((F.col(f"__k{d}") - 1) * 32 + reached(F.get(f"__b{d}", F.col(f"__k{d}") - 1), F.col(f"x{d}"))))
    return df.drop(*(f"__{c}{d}" for c in "fbk" for d in range(len(kinds))))


def beyond(keys: DataFrame, rows: DataFrame, ops: list[str]) -> DataFrame:
    """``keys`` (x0[, x1], distinct) with ``n``, the number of ``rows`` (x0[, x1]) for which row's value ``op`` key's value
    holds throughout; keys of no rows are left out. NULLs are in no pair."""
    names = [f"x{d}" for d in range(len(ops))]
    keys, rows = keys.dropna(subset=names).distinct(), rows.groupBy(*names).agg(F.count("*").alias("n")).dropna(subset=names)
    bounds = _bounds(rows, names)
    kinds = [t for _, t in rows.dtypes][: len(ops)]
    keys, rows = _cut(keys, bounds, kinds), _cut(rows, bounds, kinds)
    after = lambda d, i: F.col(f"r.{i}{d}") > F.col(f"k.{i}{d}") if ops[d][0] == ">" else F.col(f"r.{i}{d}") < F.col(f"k.{i}{d}")
    holds = lambda d: _TEST[ops[d]](F.col(f"r.x{d}"), F.col(f"k.x{d}"))
    # ranges wholly beyond: running sums over the whole table of ranges
    cells = rows.groupBy(*(f"b{d}" for d in range(len(ops)))).agg(F.sum("n").alias("n"))
    table = keys.sparkSession.range(len(bounds[0]) + 1).select(F.col("id").cast("int").alias("b0"))
    if len(ops) > 1:
        table = table.withColumn("b1", F.explode(F.sequence(F.lit(0), F.lit(len(bounds[1])))))
    sums = table.join(cells, [f"b{d}" for d in range(len(ops))], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    for d in range(len(ops)):
        order = F.col(f"b{d}").desc() if ops[d][0] == ">" else F.col(f"b{d}")
        w = Window.partitionBy(*(f"b{e}" for e in range(len(ops)) if e != d)).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("n", F.coalesce(F.sum("n").over(w), F.lit(0)))
    k, out = keys.alias("k"), [F.col(f"k.{c}") for c in names]
    found = [keys.join(sums, [f"b{d}" for d in range(len(ops))]).select(*names, "n")]
    # rows of the key's own range of one value, and of both; rows alike in what is asked of them are one
    for own in [[0], [1], [0, 1]] if len(ops) > 1 else [[0]]:
        rest = [d for d in range(len(ops)) if d not in own]
        by = [*(f"b{d}" for d in range(len(ops))), *(f"x{d}" for d in own)]
        r = rows.groupBy(*by).agg(F.sum("n").alias("n")).alias("r")
        on = [F.col(f"k.b{d}") == F.col(f"r.b{d}") for d in own] + [holds(d) for d in own] + [after(d, "b") for d in rest]
        met = on[0]
        for c in on[1:]:
            met = met & c
        tasks = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        place = [f"b{d}" for d in own]
        found.append(keys.repartition(tasks, *place).alias("k").join(r.repartition(tasks, *(F.col(f"r.{c}") for c in place)).hint("shuffle_merge"), met).groupBy(*out).agg(F.sum("r.n").alias("n")))
    total = found[0]
    for more in found[1:]:
        total = total.unionAll(more)
    return total.groupBy(*names).agg(F.sum("n").alias("n")).filter("n > 0")


def _inequality(part: list[Token], left: DataFrame, right: DataFrame) -> tuple[str, str, str] | None:
    """(left value, right value, operator as right op left) of a conjunct that is an inequality between the sides."""
    depth = 0
    for i, t in enumerate(part):
        depth += (t.text == "(") - (t.text == ")")
        if not depth and t.kind == "op" and t.text in _MIRROR:
            a, b = join(part[:i]).strip(), join(part[i + 1 :]).strip()
            for one, two, op in ((a, b, _MIRROR[t.text]), (b, a, t.text)):
                if _fits(left, one) and _fits(right, two) and not _fits(left, two) and not _fits(right, one):
                    kinds = [df.select(F.expr(x)).dtypes[0][1] for df, x in ((left, one), (right, two))]
                    return (one, two, op) if kinds[0] == kinds[1] and kinds[0] in _TYPES else None
    return None


def counted(spark: SparkSession, text: str) -> str:
    """The statement with its join as a view of rows and numbers of pairs; others as they are."""
    parts = tokens(text)
    low = text.lower()
    if not re.search(r"\bcount\s*\(\s*\*\s*\)", low) or not re.search(r"\bjoin\b", low) or not re.search(r"[<>]", low) or parts[following(parts, 0)].low != "select":
        return text
    source = top_word(parts, {"from"})
    end = top_word(parts, _END, source + 1)
    steps = chain(parts[source + 1 : end])
    tail = join(parts[end:])
    if steps is None or len(steps) != 2 or steps[1].how != "inner" or re.search(r"\b(having|where|window|qualify|union|intersect|except|minus|over|distinct|filter|select)\b", (join(parts[:source])[6:] + tail).lower()):
        return text
    from geostrata.plans.sql import rewrite

    try:
        frames = [spark.sql(rewrite(f"SELECT * FROM {join(s.relation)}")) for s in steps]
    except (AnalysisException, ParseException):
        return text
    columns = [{c.lower() for c in f.columns} for f in frames]
    taken = {s.name.lower() for s in steps} | columns[0] & columns[1]
    if steps[0].name.lower() == steps[1].name.lower():
        return text
    sides = [_struct(f, [c for c in f.columns if c.lower() not in taken], s.name) for f, s in zip(frames, steps, strict=True)]
    tests = [_inequality(x, *sides) for x in conjuncts(steps[1].on)]
    if None in tests or not 1 <= len(tests) <= 2:
        return text
    items = split_top(parts[following(parts, 0) + 1 : source])
    is_count = lambda x: re.match(r"(?i)\s*count\s*\(\s*\*\s*\)", join(x))
    group = re.match(r"(?is)\s*group\s+by\s+(.*?)(\border\s+by\b.*|\blimit\b.*|\s*)$", tail)
    if group is None or re.search(r"(?i)count\s*\(", "".join(join(x) for x in items if not is_count(x)) + tail):
        return text
    plain = [re.sub(r"(?is)\s+as\s+[\w`\"]+\s*$", "", join(x)) for x in items if not is_count(x)] + [join(x) for x in split_top(tokens(group[1]))]
    side = next((i for i in (0, 1) if all(_fits(sides[i], x) for x in plain)), None)
    if side is None or frames[0].count() * frames[1].count() <= PAIRS:
        return text
    ours, theirs = sides[side], sides[1 - side]
    ops = [op if side == 0 else _MIRROR[op] for _, _, op in tests]
    values = [(t[0], t[1]) if side == 0 else (t[1], t[0]) for t in tests]
    mine = [F.expr(v[0]).alias(f"x{d}") for d, v in enumerate(values)]
    found = beyond(ours.select(*mine), theirs.select(*(F.expr(v[1]).alias(f"x{d}") for d, v in enumerate(values))), ops)
    on = [f"__x{d}" for d in range(len(ops))]
    own = ours.select("*", *(c.alias(n) for c, n in zip(mine, on, strict=True)))
    view = f"__count_{uuid.uuid4().hex}"
    own.join(found.select(*(F.col(f"x{d}").alias(n) for d, n in enumerate(on)), F.col("n").alias("__pairs")), on).drop(*on).createOrReplaceTempView(view)
    head = ",".join(re.sub(r"(?i)^(\s*)count\s*\(\s*\*\s*\)", r"\1sum(__pairs)", join(x)) + ("" if not is_count(x) or re.search(r"\)\s*\S", join(x)) else " AS `count(1)`") for x in items)
    return f"SELECT {head} FROM {view} {tail}"
