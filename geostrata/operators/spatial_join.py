"""Spatial joins of every join type, equal to the nested-loop result.

A pair joins if its relation (or distance) holds and a residual condition, if given, is true. Three ways:

* a side within the session's broadcast limit and of at most LOOP rows goes to every task: a broadcast nested loop that
  tests bounding boxes in generated code first and the exact relation after;
* a side within that limit and of more rows is broadcast by cells of a grid (inner joins): each row of the other side
  looks its cells up, so the work does not grow with the product of the sides;
* otherwise both sides meet by cells in a shuffle. ``grid`` = false asks for the loop, which still needs a side of at most
  LOOP rows.

The grid covers the common extent. A geometry's own level is the finest on which it covers at most MAX_CELLS cells
(each level's cells are FACTOR times as long as the one's below). Rows of one side in their own cells meet copies of the
other side's rows that are on the same or a finer level, and the other way round for coarser ones; so a pair meets on the
coarser of its two levels, and only levels that the other side uses are copied to. A pair counts only in the cell
that holds the lower left corner of the boxes' common part, so there is no DISTINCT. Cells that hold more than HEAVY rows
of a side (one geometry over the whole extent, a city among fields) or more than WORK pairs are cut by salts: rows of a
cut side are dealt over its salts and copied to the other side's. Joins of more than WORK possible pairs keep all of the
session's shuffle partitions, as their work is not in their bytes. Levels, counts and the heavy cells (at most HEAVY_CELLS
a side in rows, and as many in pairs) are all that reaches the driver.

Points and rectangles along the axes are their bounds: their relations and distances are comparisons in generated code.
Parts of the residual that speak of one side only choose that side's rows before they meet.

Semi, anti and mark joins look for the first pair of a row in each of its cells and make no others; outer joins are the
inner join and the rows that such a search leaves out. For these, rows get ids in a written copy (the shared checkpoint
folder). Rows with NULL, empty or unreadable geometries never match and stay only where the join type keeps them.
Columns may have any names; the join's own get a prefix that no column has. Settings of the session:
geostrata.spatial_join.rows_per_cell, .heavy_cell_rows and .loop_rows in place of the constants below."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.session import ensure

RELATIONS = ("intersects", "contains", "within", "covers", "coveredby", "touches", "crosses", "overlaps", "equals")
INVERSE = {"contains": "within", "within": "contains", "covers": "coveredby", "coveredby": "covers"}
HOWS = ("inner", "left", "right", "full", "left_semi", "left_anti", "right_semi", "right_anti", "left_mark", "right_mark")
#: Cells that one geometry may cover on its level, and how much longer cells are on the next.
MAX_CELLS, FACTOR = 64, 4.0
#: Rows that a cell of the finest level should hold.
ROWS_PER_CELL = 64
#: Rows of a small side that a nested loop may take.
LOOP = 1000
#: Rows of one side that a cell may hold before it is cut, and cells of a side that may be cut (the first grows with the
#: rows so that the second holds).
HEAVY, HEAVY_CELLS = 20_000, 10_000
#: Pairs of rows that one cell may try before it is cut (grows in the same way), and that a join may try in few tasks.
WORK = 16_000_000


@dataclass(frozen=True)
class Relation:
    """ST_<name>(left, right)."""

    name: str

    def __post_init__(self):
        if self.name not in RELATIONS:
            raise ValueError(f"relation: one of {', '.join(RELATIONS)}")

    def inverse(self) -> Relation:
        return Relation(INVERSE.get(self.name, self.name))


@dataclass(frozen=True)
class Distance:
    """ST_Distance(left, right) <= within, or < if strict; within is a number or a column of one side."""

    within: float | str
    strict: bool = False
    side: str = "left"


def own_prefix(*frames: DataFrame) -> str:
    """A prefix that no column has."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for df in frames for c in df.columns):
        prefix += "_"
    return prefix


def boxed(df: DataFrame, geom: str, grow: Column | None, p: str, raw: bool = False) -> DataFrame:
    """df with the bounds of its geometry, grown; NULL where there is none. Whether the geometry is its bounds (1 a point,
    2 a rectangle) and, if ``raw``, the bounds as they were come beside them."""
    by = F.lit(0.0) if grow is None else F.abs(grow.cast("double"))
    df = df.withColumn(f"{p}box", F.call_function("__k_shape", F.col(quote(geom))))
    edge = lambda c: F.col(f"{p}box.{c}")
    room = lambda c: F.lit(0.0) if grow is None else by + (F.abs(edge(c)) + by) * 2.0**-50  # noqa: E731  # rounding loses no pair at the limit
    bounds = ((edge(c) + s * room(c)).alias(p + c) for c, s in (("xmin", -1), ("ymin", -1), ("xmax", 1), ("ymax", 1)))
    kept = (edge(c).alias(p + "raw_" + c) for c in ("xmin", "ymin", "xmax", "ymax") if raw)
    return df.select(*(quote(c) for c in df.columns if c != f"{p}box"), F.coalesce(edge("plain"), F.lit(0)).alias(p + "plain"), *bounds, *kept)


def option(spark: SparkSession, name: str, default: int) -> int:
    """A setting of the join: spark.geostrata.spatial_join.<name>, in SQL text SET geostrata.spatial_join.<name>."""
    value = int(spark.conf.get(f"spark.geostrata.spatial_join.{name}", str(default)))
    if value < 1:
        raise ValueError(f"geostrata.spatial_join.{name}: 1 or more")
    return value


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def functions_of(predicate: Relation | Distance) -> list[str]:
    """SQL functions that a join on this predicate calls."""
    return ["__k_shape", *([f"ST_{predicate.name}"] if isinstance(predicate, Relation) else ["ST_DWithin", "ST_Distance"])]


def _exact(predicate: Relation | Distance, a: Column, b: Column, within: Column | None, p: str) -> Column:
    """The predicate of a pair (l, r) whose bounds overlap: of points and rectangles in generated code, by their bounds, of
    others in the kernel."""
    c = lambda t, n: F.col(f"{t}.{p}{n}")
    plain = (c("l", "plain") > 0) & (c("r", "plain") > 0)
    if isinstance(predicate, Relation):
        call, name, (o, i) = F.call_function(f"ST_{predicate.name}", a, b), predicate.name, ("l", "r")
        if name in ("within", "coveredby"):
            name, o, i = INVERSE[name], "r", "l"
        if name == "intersects":
            return F.when(plain, True).otherwise(call)
        if name not in ("contains", "covers"):
            return call
        inside = (c(o, "xmin") <= c(i, "xmin")) & (c(i, "xmax") <= c(o, "xmax")) & (c(o, "ymin") <= c(i, "ymin")) & (c(i, "ymax") <= c(o, "ymax"))
        if name == "contains":  # a point on the edge is covered, not contained
            off = (c(o, "xmin") < c(i, "xmin")) & (c(i, "xmax") < c(o, "xmax")) & (c(o, "ymin") < c(i, "ymin")) & (c(i, "ymax") < c(o, "ymax"))
            inside = F.when((c(o, "plain") == 2) & (c(i, "plain") == 1), off).otherwise(inside)
        return F.when(plain, inside).otherwise(call)
    apart = lambda n: F.greatest(c("l", f"raw_{n}min") - c("r", f"raw_{n}max"), c("r", f"raw_{n}min") - c("l", f"raw_{n}max"), F.lit(0.0))
    gap = F.sqrt(apart("x") * apart("x") + apart("y") * apart("y"))
    limit = within.cast("double")
    if predicate.strict:
        return F.when(plain, gap < limit).otherwise(F.call_function("ST_Distance", a, b) < limit)
    return F.when(plain, gap <= limit).otherwise(F.call_function("ST_DWithin", a, b, limit))


def overlap(p: str, a: str = "l", b: str = "r") -> Column:
    c = lambda t, n: F.col(f"{t}.{p}{n}")
    return (c(a, "xmin") <= c(b, "xmax")) & (c(b, "xmin") <= c(a, "xmax")) & (c(a, "ymin") <= c(b, "ymax")) & (c(b, "ymin") <= c(a, "ymax"))


def small(df: DataFrame) -> bool:
    """Whether a side's estimated size is within the session's broadcast limit."""
    limit = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")
    size = int(df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(limit)) if limit != "-1" else -1
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= size


@dataclass(frozen=True)
class Extent:
    """Rows with boxes, and the bounds of them all."""

    n: int
    x0: float
    y0: float
    x1: float
    y1: float

    @staticmethod
    def of(p: str, *frames: DataFrame) -> list[Extent]:
        """Of every frame, in one job."""
        names = (("x0", F.min, "xmin"), ("y0", F.min, "ymin"), ("x1", F.max, "xmax"), ("y1", F.max, "ymax"))
        each = [df.agg(F.lit(i).alias("i"), F.count(p + "xmin").alias("n"), *(f(p + c).alias(k) for k, f, c in names)) for i, df in enumerate(frames)]
        rows = sorted(reduce(DataFrame.unionAll, each).collect(), key=lambda r: r["i"])
        return [Extent(r["n"], *(r[k] or 0.0 for k, _, _ in names)) for r in rows]


@dataclass(frozen=True)
class Grid:
    x0: float
    y0: float
    x1: float
    y1: float
    step: float
    levels: int

    @staticmethod
    def over(a: Extent, b: Extent, rows_per_cell: int = ROWS_PER_CELL) -> Grid | None:
        """The grid of the common extent; None where there is none, so nothing pairs."""
        x0, y0, x1, y1 = max(a.x0, b.x0), max(a.y0, b.y0), min(a.x1, b.x1), min(a.y1, b.y1)
        if not a.n or not b.n or x1 < x0 or y1 < y0:
            return None
        cells = max(1.0, (a.n + b.n) / rows_per_cell)
        area = (x1 - x0) * (y1 - y0)
        step = math.sqrt(area / cells) if area > 0 else max(x1 - x0, y1 - y0, 1.0) / cells
        step = max(step, max(abs(x0), abs(x1), abs(y0), abs(y1)) * 2.0**-40)  # cell numbers stay exact
        # the top level is one cell, whatever the extent
        return Grid(x0, y0, x1, y1, step, max(0, math.ceil(math.log(max(x1 - x0, y1 - y0, step) / step, FACTOR))) + 1)

    def low(self, edge: Column, n: str) -> Column:
        """A lower edge cut to the extent."""
        return F.greatest(edge, F.lit(self.x0 if n == "x" else self.y0))

    def high(self, edge: Column, n: str) -> Column:
        return F.least(edge, F.lit(self.x1 if n == "x" else self.y1))

    def clipped(self, df: DataFrame, p: str) -> DataFrame:
        """Rows that reach into the extent, with the level of their boxes cut to it."""
        c = lambda n: F.col(p + n)
        df = df.filter((c("xmin") <= self.x1) & (c("xmax") >= self.x0) & (c("ymin") <= self.y1) & (c("ymax") >= self.y0))
        level = F.lit(self.levels)
        for k in range(self.levels - 1, -1, -1):
            size = self.step * FACTOR**k
            along = [F.floor((self.high(c(n + "max"), n) - o) / size) - F.floor((self.low(c(n + "min"), n) - o) / size) + 1 for n, o in (("x", self.x0), ("y", self.y0))]
            level = F.when(along[0] * along[1] <= MAX_CELLS, F.lit(k)).otherwise(level)
        return df.withColumn(p + "level", level.cast("int"))

    def size(self, level: Column) -> Column:
        return self.step * F.pow(F.lit(FACTOR), level)

    def celled(self, df: DataFrame, p: str, others: list[int], own: int) -> DataFrame:
        """A row for each cell: the row's own, with role ``own``, and those on levels that the other side uses, with the
        other role. Role 0 is met by the left side in its own cells, with right rows up to its level; role 1 by the right
        side, with left rows below its level."""
        least = F.col(p + "level") + int(own == 0)  # a left row below a right one's level goes up to it, not one beside it
        up = F.filter(F.array(*map(F.lit, others)).cast("array<int>"), lambda k: k >= least)
        places = F.concat(F.array(F.struct(F.lit(own).alias("role"), F.col(p + "level").alias("at"))), F.transform(up, lambda k: F.struct(F.lit(1 - own).alias("role"), k.alias("at"))))
        df = df.withColumn(p + "place", F.explode(places)).withColumns({p + "role": F.col(f"{p}place.role"), p + "at": F.col(f"{p}place.at")}).drop(p + "place")
        size = self.size(F.col(p + "at"))
        along = lambda n, o: F.sequence(F.floor((self.low(F.col(f"{p}{n}min"), n) - o) / size).cast("long"), F.floor((self.high(F.col(f"{p}{n}max"), n) - o) / size).cast("long"))
        return df.withColumn(p + "gx", F.explode(along("x", self.x0))).withColumn(p + "gy", F.explode(along("y", self.y0)))

    def in_corner(self, p: str) -> Column:
        """Whether a pair's cell holds the lower left corner of the boxes' common part."""
        size = self.size(F.col(f"l.{p}at"))
        corner = lambda c, o: F.floor((self.low(F.greatest(F.col(f"l.{p}{c}min"), F.col(f"r.{p}{c}min")), c) - o) / size)
        return (corner("x", self.x0) == F.col(f"l.{p}gx")) & (corner("y", self.y0) == F.col(f"l.{p}gy"))


KEY = ("role", "at", "gx", "gy")


def _levels(p: str, *frames: DataFrame) -> list[list[int]]:
    """The levels that each frame uses, in one job: a few dozen rows at most."""
    each = [df.select(F.lit(i).alias("i"), F.col(p + "level").alias("level")).distinct() for i, df in enumerate(frames)]
    rows = reduce(DataFrame.unionAll, each).collect()
    return [sorted(r["level"] for r in rows if r["i"] == i) for i in range(len(frames))]


def _cut(left: DataFrame, right: DataFrame, p: str, a: Extent, b: Extent) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides' cell rows with salts for cells that are heavy, in rows of either side or in pairs, and the salts' names."""
    heavy = max(option(left.sparkSession, "heavy_cell_rows", HEAVY), (a.n + b.n) // HEAVY_CELLS)
    work = max(WORK, a.n * b.n // HEAVY_CELLS)
    if max(a.n, b.n) <= heavy and a.n * b.n <= work:  # a row is in a cell once
        return left, right, []
    names = [p + k for k in KEY]
    counts = [df.groupBy(*names).agg(F.count("*").alias(n)) for df, n in ((left, "nl"), (right, "nr"))]
    most = F.greatest(F.col("nl"), F.col("nr")) > heavy
    found = {}
    for r in counts[0].join(counts[1], names).filter(most | (F.col("nl") * F.col("nr") > work)).collect():
        ls, rs = -(-r["nl"] // heavy), -(-r["nr"] // heavy)
        more = -(-(r["nl"] * r["nr"]) // (work * ls * rs))
        if r["nl"] * rs >= r["nr"] * ls:
            ls = min(ls * more, r["nl"])
        else:
            rs = min(rs * more, r["nr"])
        found[tuple(r)[:4]] = ls, rs
    if not found:
        return left, right, []
    listed = left.sparkSession.createDataFrame([(*k, *v) for k, v in found.items()], ", ".join(f"{n} {t}" for n, t in zip(names, ("int", "int", "long", "long"), strict=True)) + f", {p}ls int, {p}rs int")

    def salted(df: DataFrame, own: str, other: str) -> DataFrame:
        df = df.join(F.broadcast(listed), names, "left")
        n, m = F.coalesce(p + own, F.lit(1)), F.coalesce(p + other, F.lit(1))
        # by the row's contents, so that a task that is run again deals alike; only rows alike in every column stay together
        mixed = F.xxhash64(*(quote(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()))
        df = df.withColumn(p + "s_" + own, F.pmod(mixed, n).cast("int"))
        return df.withColumn(p + "s_" + other, F.explode(F.sequence(F.lit(0), m - 1))).drop(p + own, p + other)

    return salted(left, "ls", "rs"), salted(right, "rs", "ls"), [p + "s_ls", p + "s_rs"]


def _pairs_by_grid(left: DataFrame, right: DataFrame, p: str, a: Extent, b: Extent, on: Column, side: str | None = None, near: str | None = None) -> DataFrame:
    """Pairs (l.*, r.*) that are overlapping boxes and meet ``on``, each once; with a ``side`` (l or r) the rows of that side
    that are in a pair, which are looked for until the first and come once for each cell at most. ``near`` names a side to
    broadcast."""
    spark = left.sparkSession
    grid = Grid.over(a, b, option(spark, "rows_per_cell", ROWS_PER_CELL))
    if grid is None:
        left, right, meet = left.filter("false"), right.filter("false"), overlap(p)
    else:
        left, right = grid.clipped(left, p), grid.clipped(right, p)
        levels = _levels(p, left, right)
        left, right, salts = grid.celled(left, p, levels[1], 0), grid.celled(right, p, levels[0], 1), []
        if near is None:
            left, right, salts = _cut(left, right, p, a, b)
        keys = [*(p + k for k in KEY), *salts]
        if near is None and a.n * b.n > WORK:  # a set number, as the session would put many pairs of few bytes into one task
            parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
            left, right = left.repartition(parts, *keys), right.repartition(parts, *keys)
        meet = reduce(and_, [F.col(f"l.{c}") == F.col(f"r.{c}") for c in keys]) & overlap(p)
        if side is None:
            meet = meet & grid.in_corner(p)
    left, right = (F.broadcast(df) if s == near else df for df, s in ((left, "l"), (right, "r")))
    if side == "r":
        return right.alias("r").join(left.alias("l"), meet & on, "left_semi")
    return left.alias("l").join(right.alias("r"), meet & on, "inner" if side is None else "left_semi")


def _sided(residual: Column | list[Column] | None, left: DataFrame, right: DataFrame) -> tuple[Column, Column, Column]:
    """Conditions of the left side alone, of the right side alone, and of both."""
    out = [F.lit(True)] * 3
    for c in [] if residual is None else residual if isinstance(residual, list) else [residual]:
        at = next((i for i, df in enumerate((left, right)) if _own(df, c)), 2)
        out[at] = out[at] & c
    return tuple(out)


def _own(df: DataFrame, condition: Column) -> bool:
    """Whether a condition is one of this side alone, the same for a row whenever it is asked."""
    try:
        return bool(df.sparkSession.createDataFrame([], df.schema).filter(condition)._jdf.queryExecution().analyzed().deterministic())
    except AnalysisException:
        return False


def spatial_join(left: DataFrame, right: DataFrame, left_geom: str, right_geom: str, predicate: Relation | Distance | str, how: str = "inner", residual: Column | list[Column] | None = None, suffix: str = "_right", grid: bool | None = None) -> DataFrame:
    """Join on a spatial predicate.

    Right columns whose names the left has get ``suffix``. ``residual`` speaks of the output's column names, and may be a list
    of conditions that all hold. ``grid``
    forces (true) or, where a side has at most LOOP rows, forbids (false) the grid. Mark joins add a boolean column ``mark``; right semi, anti and mark joins
    return the right side's rows."""
    spark = left.sparkSession
    predicate = Relation(predicate.lower().removeprefix("st_").replace("_", "")) if isinstance(predicate, str) else predicate
    ensure(spark, functions_of(predicate))
    if how not in HOWS:
        raise ValueError(f"how: one of {', '.join(HOWS)}")
    taken = {c.lower() for c in left.columns}
    renamed = {c: c + suffix if c.lower() in taken else c for c in right.columns}
    out_right = right.withColumnsRenamed(renamed)
    right_geom = renamed[right_geom]
    within = None
    if isinstance(predicate, Distance):
        within = F.lit(float(predicate.within)) if isinstance(predicate.within, (int, float)) else F.col(quote(predicate.within if predicate.side == "left" else renamed[predicate.within]))
    grow_left = within if isinstance(predicate, Distance) and predicate.side == "left" else None
    grow_right = within if isinstance(predicate, Distance) and predicate.side != "left" else None

    p = own_prefix(left, out_right)
    exact = _exact(predicate, F.col(quote(left_geom)), F.col(quote(right_geom)), within, p)
    mine_alone, yours_alone, both = _sided(residual, left, out_right)
    full = exact & both & mine_alone & yours_alone
    raw = isinstance(predicate, Distance)
    a, b = boxed(left, left_geom, grow_left, p, raw), boxed(out_right, right_geom, grow_right, p, raw)
    mine, yours = [quote(c) for c in left.columns], [quote(c) for c in renamed.values()]
    has = F.col(p + "xmin").isNotNull()
    near, use_grid = ("r" if small(right) else "l" if small(left) else None), grid
    extents = None
    if not grid:
        rows = Extent.of(p, b if near == "r" else a)[0].n if near is not None else math.inf
        use_grid = rows > option(spark, "loop_rows", LOOP)
    if not use_grid and how not in ("left_mark", "right_mark"):
        if how.startswith("right_"):
            close = F.broadcast(a).alias("l") if small(left) else a.alias("l")
            return b.alias("r").join(close, overlap(p) & full, "left" + how[5:]).select(*yours)
        close = F.broadcast(b) if near == "r" else b
        far = F.broadcast(a) if near == "l" and how in ("inner", "right") else a
        joined = far.alias("l").join(close.alias("r"), overlap(p) & full, how)
        return joined.select(*mine) if how in ("left_semi", "left_anti") else joined.select(*mine, *yours)

    from geostrata.plans.staging import numbered

    # rows that stay whether they are in a pair or not get ids
    lid, rid, mark = p + "lid", p + "rid", "mark"
    if how.startswith("left") or how == "full":
        a = numbered(a, lid)
    if how.startswith("right") or how == "full":
        b = numbered(b, rid)
    here, there = a.filter(has & mine_alone), b.filter(has & yours_alone)
    if use_grid:
        extents = Extent.of(p, here, there)

    def met(side: str | None = None) -> DataFrame:
        if use_grid:
            return _pairs_by_grid(here, there, p, *extents, exact & both, side, near if how == "inner" and grid is None else None)
        one, other = (there.alias("r"), here.alias("l")) if side == "r" else (here.alias("l"), there.alias("r"))
        return one.join(other, overlap(p) & exact & both, "left_semi" if side else "inner")

    def kept(side: str, how: str) -> DataFrame:
        """A side's rows that are in a pair (left_semi), or are not (left_anti)."""
        df, key = (a, lid) if side == "l" else (b, rid)
        return df.join(met(side).select(key).distinct(), key, how)

    if how.endswith(("_semi", "_anti")):
        return kept(how[0], "left" + how[-5:]).select(*(mine if how.startswith("left") else yours))
    if how.endswith("_mark"):
        side, key, cols = (a, lid, mine) if how == "left_mark" else (b, rid, yours)
        marked = side.join(met(how[0]).select(key).distinct().withColumn(p + mark, F.lit(True)), key, "left")
        return marked.select(*cols, F.coalesce(p + mark, F.lit(False)).alias(mark))
    out = met().select(*(F.col(f"l.{c}") for c in mine), *(F.col(f"r.{c}") for c in yours))
    nulls = lambda df: [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]
    if how in ("left", "full"):
        out = out.unionAll(kept("l", "left_anti").select(*mine, *nulls(out_right)))
    if how in ("right", "full"):
        out = out.unionAll(kept("r", "left_anti").select(*nulls(left), *yours))
    return out
