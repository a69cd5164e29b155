"""Spatial joins of every type and relation against a nested loop, both ways of joining."""

import random

import pytest
from pyspark.sql import functions as F

from geostrata.operators.spatial_join import HOWS, RELATIONS, Distance, Relation, spatial_join


def shapes(n, seed):
    rnd = random.Random(seed)
    for i in range(n):
        x, y, k = rnd.randrange(60), rnd.randrange(60), i % 7
        w = rnd.randrange(1, 9)
        yield i, [
            f"POINT({x} {y})", f"POINT({x} {y})", f"LINESTRING({x} {y},{x + w} {y + w})", f"POLYGON(({x} {y},{x + w} {y},{x + w} {y + w},{x} {y + w},{x} {y}))", None,
            "POINT EMPTY", f"POLYGON(({x} {y},{x + 6 * w} {y},{x + 3 * w} {y + 5 * w},{x} {y}))",
        ][k], float(rnd.randrange(6))


@pytest.fixture(scope="module")
def sides(geo):
    def make(n, seed, name):
        df = geo.createDataFrame(list(shapes(n, seed)), f"{name} int, w string, d double")
        df = df.select(name, F.expr("ST_GeomFromText(w)").alias("g"), "d").cache()
        df.count()
        return df

    return make(90, 1, "a"), make(80, 2, "b")


@pytest.fixture(scope="module")
def truth(geo, sides):
    """Results of all relations and the distance for all pairs."""
    left, right = sides
    right = right.withColumnsRenamed({"g": "h", "d": "e"})
    cols = [F.call_function(f"ST_{r}", "g", "h").alias(r) for r in RELATIONS]
    return left.crossJoin(right).select("a", "b", "d", "e", *cols, F.call_function("ST_Distance", "g", "h").alias("distance")).toPandas()


PREDICATES = [Relation(r) for r in RELATIONS] + [Distance(4.0), Distance(4.0, strict=True), Distance("d"), Distance("d", side="right")]


def expected(truth, predicate, even):
    if isinstance(predicate, Relation):
        hit = truth[predicate.name].eq(True)
    else:
        limit = predicate.within if not isinstance(predicate.within, str) else truth["d" if predicate.side == "left" else "e"]
        hit = truth["distance"] < limit if predicate.strict else truth["distance"] <= limit
    if even:
        hit &= (truth["a"] + truth["b"]) % 2 == 0
    return set(zip(truth["a"][hit].tolist(), truth["b"][hit].tolist(), strict=True))


def outcome(pairs, how):
    left, right = set(range(90)), set(range(80))
    ml, mr = {a for a, _ in pairs}, {b for _, b in pairs}
    return {
        "inner": pairs, "left": pairs | {(a, None) for a in left - ml}, "right": pairs | {(None, b) for b in right - mr}, "full": pairs | {(a, None) for a in left - ml} | {(None, b) for b in right - mr},
        "left_semi": ml, "left_anti": left - ml, "right_semi": mr, "right_anti": right - mr, "left_mark": {(a, a in ml) for a in left}, "right_mark": {(b, b in mr) for b in right},
    }[how]


def run(sides, predicate, how, grid, residual):
    rows = spatial_join(*sides, "g", "g", predicate, how, residual, grid=grid).collect()
    key = "b" if how.startswith("right_") else "a"
    if how in ("inner", "left", "right", "full"):
        return [(r["a"], r["b"]) for r in rows]
    return [(r[key], r["mark"]) for r in rows] if how.endswith("mark") else [r[key] for r in rows]


@pytest.mark.parametrize("predicate", PREDICATES, ids=lambda p: getattr(p, "name", repr(p)))
def test_inner_and_full(sides, truth, predicate):
    for grid in (True, False):
        got = run(sides, predicate, "inner", grid, None)
        assert sorted(got) == sorted(expected(truth, predicate, False))
    even = (F.col("a") + F.col("b")) % 2 == 0
    got = run(sides, predicate, "full", True, even)
    assert len(got) == len(set(got)) and set(got) == outcome(expected(truth, predicate, True), "full")


@pytest.mark.parametrize("how", HOWS)
def test_every_join_type(sides, truth, how):
    even = (F.col("a") + F.col("b")) % 2 == 0
    for grid in (True, False):
        for residual in (None, even):
            got = run(sides, Relation("intersects"), how, grid, residual)
            assert len(got) == len(set(got)) and set(got) == outcome(expected(truth, Relation("intersects"), residual is not None), how), (grid, residual)


def test_empty_sides(sides):
    left, right = sides
    assert spatial_join(left.limit(0), right, "g", "g", "intersects", "full", grid=True).count() == 80
    assert spatial_join(left, right.limit(0), "g", "g", "intersects", "left", grid=True).count() == 90


def test_arguments():
    with pytest.raises(ValueError, match="relation"):
        Relation("near")
    assert Relation("contains").inverse() == Relation("within")


def test_plan_has_no_python(geo, sides):
    left, right = sides
    plan = spatial_join(left, right, "g", "g", "intersects", grid=False)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "BroadcastNestedLoopJoin" in plan


def both(geo, n, extra=()):
    """Points and unit boxes by rule, and boxes given."""
    points = geo.range(n).select(F.col("id").alias("a"), F.expr("ST_MakePoint(id * 37 % 211, id * 53 % 197)").alias("g"))
    boxes = geo.range(n).select(F.col("id").alias("b"), F.expr("ST_MakeEnvelope(id * 29 % 207, id * 31 % 193, id * 29 % 207 + 2, id * 31 % 193 + 2)").alias("h"))
    for i, box in enumerate(extra):
        boxes = boxes.union(geo.sql(f"SELECT CAST(-{i + 1} AS BIGINT), ST_MakeEnvelope({box})"))
    return points, boxes


def pairs_of(df):
    return sorted((r["a"], r["b"]) for r in df.collect())


def test_heavy_cells_are_salted(geo, monkeypatch):
    """One box over everything, and many points in one place: cells beyond the limit are cut, pairs come once."""
    points, boxes = both(geo, 600, ["-1, -1, 300, 300", "0, 0, 100, 150"])
    crowd = geo.range(300).select((F.col("id") + 1000).alias("a"), F.expr("ST_MakePoint(50.5, 50.5)").alias("g"))
    near = geo.range(40).select((F.col("id") + 2000).alias("b"), F.expr("ST_MakeEnvelope(50, 50, 51, 51)").alias("h"))
    points, boxes = points.union(crowd), boxes.union(near)
    want = pairs_of(spatial_join(points, boxes, "g", "h", "intersects", grid=False))
    for heavy in (20, 20_000):
        monkeypatch.setattr("geostrata.operators.spatial_join.HEAVY", heavy)
        got = pairs_of(spatial_join(points, boxes, "g", "h", "intersects", grid=True))
        assert got == want and len(got) > 12_000


def test_copies_go_to_levels_in_use_only(geo):
    """A box over everything adds one copy a point, not a product: rows that enter the join stay in proportion."""
    points, boxes = both(geo, 2000, ["-1, -1, 300, 300"])
    plan = spatial_join(points, boxes, "g", "h", "intersects", grid=True)
    assert plan.count() > 2000
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text and "Python" not in text


def test_small_sides_of_many_rows_are_broadcast_by_cell(geo, monkeypatch):
    points, boxes = both(geo, 400)
    want = pairs_of(spatial_join(points, boxes, "g", "h", "intersects", grid=False))
    monkeypatch.setattr("geostrata.operators.spatial_join.LOOP", 100)
    joined = spatial_join(points, boxes, "g", "h", "intersects")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert pairs_of(joined) == want and "BroadcastHashJoin" in plan and "NestedLoop" not in plan


def test_settings(geo):
    points, boxes = both(geo, 300, ["-1, -1, 300, 300"])
    want = pairs_of(spatial_join(points, boxes, "g", "h", "intersects", grid=False))
    try:
        for name, value in (("rows_per_cell", 1), ("rows_per_cell", 5000), ("heavy_cell_rows", 7), ("loop_rows", 1)):
            geo.conf.set(f"spark.geostrata.spatial_join.{name}", value)
            assert pairs_of(spatial_join(points, boxes, "g", "h", "intersects", grid=None if name == "loop_rows" else True)) == want
        geo.conf.set("spark.geostrata.spatial_join.loop_rows", 0)
        with pytest.raises(ValueError, match="loop_rows"):
            spatial_join(points, boxes, "g", "h", "intersects")
    finally:
        for name in ("rows_per_cell", "heavy_cell_rows", "loop_rows"):
            geo.conf.unset(f"spark.geostrata.spatial_join.{name}")


def test_columns_of_any_name(geo):
    points, boxes = both(geo, 60)
    points = points.withColumns({"__xmin": F.lit(1), "__level": F.lit("x"), "a`b": F.lit(2), "H": F.lit(3)})
    rows = spatial_join(points, boxes, "g", "h", "intersects", "left", grid=True)
    assert rows.columns == [*points.columns, "b", "h_right"] and {(r["__xmin"], r["__level"], r["a`b"], r["H"]) for r in rows.collect()} == {(1, "x", 2, 3)}


@pytest.mark.parametrize("how", HOWS)
def test_conditions_of_one_side(sides, truth, how):
    """Conditions of one side choose its rows; rows that they leave out still stay where the join type keeps them."""
    hit = {(a, b) for a, b in expected(truth, Relation("intersects"), False) if a % 3 and b % 2 == 0}
    conditions = [F.col("a") % 3 != 0, F.col("b") % 2 == 0]
    for grid in (True, False):
        got = run(sides, Relation("intersects"), how, grid, conditions)
        assert len(got) == len(set(got)) and set(got) == outcome(hit, how)


def test_many_pairs_are_dealt_over_all_tasks(geo, monkeypatch):
    """Pairs of few bytes are not left to one task, though the session would put their shuffle into one partition."""
    points, boxes = both(geo, 300, ["-1, -1, 300, 300"])
    want = pairs_of(spatial_join(points, boxes, "g", "h", "intersects", grid=False))
    monkeypatch.setattr("geostrata.operators.spatial_join.WORK", 50)
    joined = spatial_join(points, boxes, "g", "h", "intersects", grid=True)
    tasks = {r["p"] for r in joined.select(F.spark_partition_id().alias("p")).distinct().collect()}
    assert pairs_of(joined) == want and len(tasks) == int(geo.conf.get("spark.sql.shuffle.partitions"))
    for how in ("left_semi", "right_anti", "full"):
        assert sorted(map(str, spatial_join(points, boxes, "g", "h", "intersects", how, grid=True).collect())) == sorted(map(str, spatial_join(points, boxes, "g", "h", "intersects", how, grid=False).collect()))


def test_semi_joins_stop_at_the_first_pair(geo):
    """No pairs are made for a semi join: the cells meet in a semi join themselves."""
    points, boxes = both(geo, 200)
    plan = spatial_join(points, boxes, "g", "h", "intersects", "left_semi", grid=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftSemi") == 2 and "Join Inner" not in plan


def test_a_loop_needs_a_side_of_few_rows(geo, monkeypatch):
    points, boxes = both(geo, 200)
    want = pairs_of(spatial_join(points, boxes, "g", "h", "intersects", grid=False))
    monkeypatch.setattr("geostrata.operators.spatial_join.LOOP", 100)
    joined = spatial_join(points, boxes, "g", "h", "intersects", grid=False)
    assert "NestedLoop" not in joined._jdf.queryExecution().executedPlan().toString() and pairs_of(joined) == want


def test_distances_of_points_and_boxes_are_rounded_once(geo):
    """The distance of a point from a box beside it is the difference of two coordinates, in the kernel and in joins."""
    points = geo.range(4000).select(F.col("id").alias("a"), F.expr("id * 7919 % 1000003 / 100D").alias("x"), F.expr("ST_MakePoint(id * 7919 % 1000003 / 100D, 400)").alias("g"))
    box = geo.sql("SELECT 1 AS b, 812.37D - 300 AS low, 812.37D + 300 AS high, ST_MakeEnvelope(812.37D - 300, -500, 812.37D + 300, 1300) AS h")
    gap = F.greatest(F.col("x") - F.col("high"), F.col("low") - F.col("x"), F.lit(0.0))
    assert points.crossJoin(box).filter(F.expr("ST_Distance(g, h)") != gap).count() == 0
    limit = points.crossJoin(box).filter("a = 1234").select(gap).first()[0]
    for grid in (True, False):
        for strict in (True, False):
            want = points.crossJoin(box).filter(gap < limit if strict else gap <= limit).count()
            assert spatial_join(points, box, "g", "h", Distance(limit, strict=strict), grid=grid).count() == want


def test_scans_are_dealt_over_tasks_before_kernels(spark, tmp_path):
    """A file of one row group is one task however many cores there are; where kernels run on its rows it is dealt out."""
    from geostrata.operators.relational import TASK_BYTES, spread
    from geostrata.queries.base import views

    spark.range(60_000).selectExpr("id AS p_partkey", "uuid() AS p_name").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    views(spark, str(tmp_path), "select ST_X(ST_MakePoint(p_partkey, 1)) from part")
    tasks = spark.table("part").select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks == 4 * spark.sparkContext.defaultParallelism
    few = spark.range(100).coalesce(1)
    assert spread(few).select(F.spark_partition_id().alias("p")).distinct().count() == 1 and TASK_BYTES > 800
    views(spark, str(tmp_path), "select p_partkey from part")
    assert spark.table("part").select(F.spark_partition_id().alias("p")).distinct().count() < tasks
