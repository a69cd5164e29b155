"""Spatial functions and joins on points, boxes and lines made from numeric columns, where SQL has closed forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.operators.aggregates import st_analyze_agg
from geostrata.operators.relational import spread
from geostrata.operators.spatial_join import Distance, Relation, spatial_join
from geostrata.queries.base import query, views
from geostrata.functions import spatial as S
from geostrata.session import ensure

POINT = "ST_MakePoint(p_retailprice, p_size)"
BOX = "ST_MakeEnvelope(0, 0, p_size, p_retailprice)"
PAIRS = {
    "st_coordinates": (f"SELECT p_partkey, ST_X({POINT}) AS x, ST_Y({POINT}) AS y, ST_XMin({BOX}) AS a, ST_XMax({BOX}) AS b, ST_YMin({BOX}) AS c, ST_YMax({BOX}) AS d, ST_X({BOX}) AS e FROM part", "SELECT p_partkey, p_retailprice AS x, CAST(p_size AS DOUBLE) AS y, 0.0::DOUBLE AS a, CAST(p_size AS DOUBLE) AS b, 0.0::DOUBLE AS c, p_retailprice AS d, NULL::DOUBLE AS e FROM part"),
    "st_area_length": (f"SELECT p_partkey, round(ST_Area({BOX}), 4) AS a, round(ST_Length({BOX}), 4) AS l, ST_Area({POINT}) AS z FROM part", "SELECT p_partkey, round(p_size * p_retailprice, 4) AS a, round(2 * (p_size + p_retailprice), 4) AS l, 0.0::DOUBLE AS z FROM part"),
    "st_text": ("SELECT p_partkey, ST_AsText(ST_MakePoint(p_partkey, p_size)) AS t, ST_AsEWKT(ST_SetSRID(ST_MakePoint(p_partkey, p_size), 4326)) AS e, ST_AsText(ST_GeomFromText(concat('LINESTRING(0 0,', p_size, ' 1)'))) AS l FROM part", "SELECT p_partkey, 'POINT (' || p_partkey || ' ' || p_size || ')' AS t, 'SRID=4326;POINT (' || p_partkey || ' ' || p_size || ')' AS e, 'LINESTRING (0 0, ' || p_size || ' 1)' AS l FROM part"),
    "st_geojson": ("SELECT p_partkey, ST_AsGeoJSON(ST_MakePoint(p_size, p_size / 2)) AS j, ST_AsText(ST_GeomFromGeoJSON(concat('{\"type\":\"Point\",\"coordinates\":[', p_size, ',1]}'))) AS t FROM part", "SELECT p_partkey, '{\"type\":\"Point\",\"coordinates\":[' || p_size || '.0,' || CAST(p_size / 2 AS VARCHAR) || ']}' AS j, 'POINT (' || p_size || ' 1)' AS t FROM part"),
    "st_round_trips": ("SELECT p_partkey, ST_AsEWKT(ST_GeomFromWKB(ST_MakePoint(p_size, 1), 4269)) AS a, ST_AsEWKT(ST_GeomFromEWKB(ST_SetSRID(ST_MakePoint(p_size, 2), 7))) AS b, ST_AsEWKT(ST_GeomFromEWKT(concat('srid = 4326 ;POINT(', p_size, ' 3)'))) AS c, ST_SRID(ST_GeomFromText('POINT(1 2)', 4326)) AS d, ST_SRID(ST_MakePoint(1, 2)) AS e, ST_GeomFromText('nonsense') IS NULL AS f FROM part", "SELECT p_partkey, 'SRID=4269;POINT (' || p_size || ' 1)' AS a, 'SRID=7;POINT (' || p_size || ' 2)' AS b, 'SRID=4326;POINT (' || p_size || ' 3)' AS c, CAST(4326 AS BIGINT) AS d, CAST(NULL AS BIGINT) AS e, true AS f FROM part"),
    "st_types_counts": (f"SELECT p_partkey, ST_GeometryType({POINT}) AS a, ST_GeometryType({BOX}) AS b, ST_NPoints({BOX}) AS c, ST_NumPoints({BOX}) AS d, ST_NumPoints(ST_GeomFromText('LINESTRING(0 0,1 1,2 2)')) AS e, ST_IsEmpty({POINT}) AS f, ST_IsValid({BOX}) AS g, ST_IsEmpty(ST_GeomFromText('POLYGON EMPTY')) AS h FROM part", "SELECT p_partkey, 'Point' AS a, 'Polygon' AS b, CAST(5 AS BIGINT) AS c, CAST(NULL AS BIGINT) AS d, CAST(3 AS BIGINT) AS e, false AS f, true AS g, true AS h FROM part"),
    "st_centroid_envelope": (f"SELECT p_partkey, round(ST_X(ST_Centroid({BOX})), 6) AS x, round(ST_Y(ST_Centroid({BOX})), 4) AS y, ST_AsText(ST_Envelope(ST_MakePoint(p_size, 1))) AS e, ST_GeometryType(ST_Boundary({BOX})) AS b, round(ST_Area(ST_ConvexHull({BOX})), 4) AS h, ST_AsText(ST_Envelope(ST_GeomFromText(concat('LINESTRING(0 0,', p_size, ' 3)')))) AS l FROM part", "SELECT p_partkey, round(p_size / 2, 6) AS x, round(p_retailprice / 2, 4) AS y, 'POINT (' || p_size || ' 1)' AS e, 'LineString' AS b, round(p_size * p_retailprice, 4) AS h, 'POLYGON ((0 0, ' || p_size || ' 0, ' || p_size || ' 3, 0 3, 0 0))' AS l FROM part"),
    "st_box2d": (f"SELECT p_partkey, Box2D({BOX}).xmin AS a, Box2D({BOX}).ymin AS b, Box2D({BOX}).xmax AS c, Box2D({BOX}).ymax AS d FROM part", "SELECT p_partkey, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, CAST(p_size AS DOUBLE) AS c, p_retailprice AS d FROM part"),
    "st_distance": (f"SELECT p_partkey, round(ST_Distance({POINT}, ST_MakePoint(1000, 10)), 6) AS d, ST_DWithin({POINT}, ST_MakePoint(1000, 10), 50) AS w FROM part", "SELECT p_partkey, round(sqrt(pow(p_retailprice - 1000, 2) + pow(p_size - 10, 2)), 6) AS d, sqrt(pow(p_retailprice - 1000, 2) + pow(p_size - 10, 2)) <= 50 AS w FROM part"),
    "st_relations": ("""SELECT p_partkey, ST_Contains(b, p) AS contains, ST_Covers(b, p) AS covers, ST_Intersects(b, p) AS intersects, ST_Within(p, b) AS within, ST_CoveredBy(p, b) AS coveredby, ST_Touches(b, p) AS touches, ST_Equals(p, p) AS equals, ST_Overlaps(b, p) AS overlaps, ST_Crosses(l, b) AS crosses, BBox_Intersects(b, p) AS box
        FROM (SELECT p_partkey, ST_MakePoint(p_size, p_size) AS p, ST_MakeEnvelope(10, 10, 30, 30) AS b, ST_GeomFromText(concat('LINESTRING(0 20,', p_size, ' 20)')) AS l FROM part)""",
        """SELECT p_partkey, p_size > 10 AND p_size < 30 AS contains, p_size BETWEEN 10 AND 30 AS covers, p_size BETWEEN 10 AND 30 AS intersects, p_size > 10 AND p_size < 30 AS within, p_size BETWEEN 10 AND 30 AS coveredby, p_size IN (10, 30) AS touches, true AS equals, false AS overlaps, p_size > 10 AS crosses, p_size BETWEEN 10 AND 30 AS box FROM part"""),
    "st_overlay": ("""SELECT p_partkey, ST_Area(ST_Intersection(a, b)) AS i, ST_Area(ST_Union(a, b)) AS u, ST_Area(ST_Difference(a, b)) AS d, ST_Overlaps(a, b) AS o
        FROM (SELECT p_partkey, p_size, ST_MakeEnvelope(0, 0, 20, 20) AS a, ST_MakeEnvelope(p_size, 5, p_size + 10, 15) AS b FROM part)""",
        """SELECT p_partkey, 10.0 * w AS i, 400 + 100 - 10.0 * w AS u, 400 - 10.0 * w AS d, w > 0 AND w < 10 AS o FROM (SELECT p_partkey, CAST(greatest(0, least(20, p_size + 10) - least(p_size, 20)) AS DOUBLE) AS w FROM part)"""),
    "st_buffer": ("SELECT p_partkey, round(ST_Area(ST_Buffer(ST_MakePoint(0, 0), p_size)), 6) AS a, round(ST_Area(ST_Buffer(ST_MakePoint(0, 0), p_size, 2)), 6) AS b, ST_NPoints(ST_Buffer(ST_MakePoint(0, 0), p_size, 4)) AS n FROM part", "SELECT p_partkey, round(16 * p_size * p_size * sin(2 * pi() / 32), 6) AS a, round(4 * p_size * p_size * sin(2 * pi() / 8), 6) AS b, CAST(17 AS BIGINT) AS n FROM part"),
    "st_simplify": ("SELECT p_partkey, ST_NPoints(ST_Simplify(g, 0.5)) AS a, ST_NPoints(ST_SimplifyPreserveTopology(g, 0.5)) AS b, ST_NPoints(ST_SimplifyVW(g, 0.5)) AS c, ST_SimplifyVW(ST_MakePoint(1, 1), 1) IS NULL AS d FROM (SELECT p_partkey, ST_GeomFromText(concat('LINESTRING(0 0,', p_size, ' 0,', 2 * p_size, ' 0)')) AS g FROM part)", "SELECT p_partkey, CAST(2 AS BIGINT) AS a, CAST(2 AS BIGINT) AS b, CAST(2 AS BIGINT) AS c, true AS d FROM part"),
    "st_translate": (f"SELECT p_partkey, ST_X(ST_Translate({POINT}, 10, -5)) AS x, ST_Y(ST_Translate({POINT}, 10, -5)) AS y FROM part", "SELECT p_partkey, p_retailprice + 10 AS x, CAST(p_size - 5 AS DOUBLE) AS y FROM part"),
    "st_hulls": ("SELECT p_partkey, ST_Area(ST_ConcaveHull(g, 1.0)) AS a, ST_Area(ST_ConvexHull(g)) AS b FROM (SELECT p_partkey, ST_GeomFromText(concat('MULTIPOINT(0 0,', p_size, ' 0,', p_size, ' 2,0 2)')) AS g FROM part)", "SELECT p_partkey, 2.0 * p_size AS a, 2.0 * p_size AS b FROM part"),
    "st_make_valid": ("SELECT p_partkey, ST_Area(ST_MakeValid(g)) AS a, ST_IsValid(g) AS b, ST_IsValid(ST_MakeValid(g)) AS c, ST_AsText(ST_MakeValid(ST_GeomFromText('LINESTRING(0 0,0 0)'))) AS d FROM (SELECT p_partkey, ST_GeomFromText(concat('POLYGON((0 0,', 2 * p_size, ' 2,', 2 * p_size, ' 0,0 2,0 0))')) AS g FROM part)", "SELECT p_partkey, 2.0 * p_size AS a, false AS b, true AS c, 'POINT (0 0)' AS d FROM part"),
    "st_build_area_split": ("SELECT p_partkey, ST_Area(ST_BuildArea(ST_GeomFromText(concat('MULTILINESTRING((0 0,', p_size, ' 0,', p_size, ' 3),(', p_size, ' 3,0 3,0 0))')))) AS a, ST_AsText(ST_Split(ST_GeomFromText(concat('LINESTRING(0 0,', 2 * p_size, ' 0)')), ST_MakePoint(p_size, 0))) AS s, round(ST_Area(ST_Split(ST_MakeEnvelope(0, 0, p_size, 2), ST_GeomFromText(concat('LINESTRING(-1 1,', p_size + 1, ' 1)')))), 6) AS t FROM part", "SELECT p_partkey, 3.0 * p_size AS a, 'GEOMETRYCOLLECTION (LINESTRING (0 0, ' || p_size || ' 0), LINESTRING (' || p_size || ' 0, ' || 2 * p_size || ' 0))' AS s, 2.0 * p_size AS t FROM part"),
    "st_tiles": ("SELECT p_partkey, round(ST_XMin(ST_TileEnvelope(6, p_size, 3)), 4) AS a, round(ST_YMax(ST_TileEnvelope(6, p_size, 3)), 4) AS b, round(ST_XMax(ST_TileEnvelope(2, 1, 1, ST_MakeEnvelope(0, 0, 8, 8))), 6) AS c, ST_AsText(ST_AsMVTGeom(ST_MakePoint(p_size, 10), Box2D(ST_MakeEnvelope(0, 0, 64, 64)), 64, 0)) AS d, ST_AsMVTGeom(ST_MakePoint(1000, 10), Box2D(ST_MakeEnvelope(0, 0, 64, 64)), 64, 0) IS NULL AS e FROM part", "SELECT p_partkey, round(-20037508.342789 + 2 * 20037508.342789 / 64 * p_size, 4) AS a, round(20037508.342789 - 2 * 20037508.342789 / 64 * 3, 4) AS b, 4.0::DOUBLE AS c, 'POINT (' || p_size || ' 54)' AS d, true AS e FROM part"),
    "st_transform": ("SELECT c_custkey, round(ST_X(m), 3) AS x, round(ST_Y(m), 3) AS y, round(ST_X(ST_Transform(m, 4326)), 7) AS lon, round(ST_Y(ST_Transform(m, 4326)), 7) AS lat, ST_SRID(m) AS srid, ST_Transform(ST_MakePoint(1, 1), 3857) IS NULL AS a, ST_Transform(m, 9999) IS NULL AS b FROM (SELECT c_custkey, ST_Transform(ST_SetSRID(ST_MakePoint(c_nationkey * 7 - 81, c_nationkey * 5 - 62), 4326), 3857) AS m FROM customer)",
        "SELECT c_custkey, round(6378137 * radians(c_nationkey * 7 - 81), 3) AS x, round(6378137 * ln(tan(pi() / 4 + radians(c_nationkey * 5 - 62) / 2)), 3) AS y, round(CAST(c_nationkey * 7 - 81 AS DOUBLE), 7) AS lon, round(CAST(c_nationkey * 5 - 62 AS DOUBLE), 7) AS lat, CAST(3857 AS BIGINT) AS srid, true AS a, true AS b FROM customer"),
    "st_make_envelope": ("SELECT p_partkey, ST_AsEWKT(ST_MakeEnvelope(0, 0, p_size, 2, 4326)) AS a FROM part", "SELECT p_partkey, 'SRID=4326;POLYGON ((0 0, 0 2, ' || p_size || ' 2, ' || p_size || ' 0, 0 0))' AS a FROM part"),
    "st_null_contract": ("SELECT p_partkey, ST_Area(NULL) IS NULL AS a, ST_Buffer(ST_MakePoint(1, 1), 1, NULL) IS NOT NULL AS b, ST_Contains(ST_MakePoint(1, 1), NULL) IS NULL AS c, ST_AsText(X'00') IS NULL AS d, ST_Split(ST_MakePoint(0, 0), ST_MakePoint(0, 0)) IS NULL AS e FROM part", "SELECT p_partkey, true AS a, true AS b, true AS c, true AS d, true AS e FROM part"),
    "st_join_in_sql": ("SELECT s_suppkey, count(*) AS n FROM supplier JOIN customer ON ST_Covers(ST_MakeEnvelope(s_acctbal - 500, -1, s_acctbal + 500, 30), ST_MakePoint(c_acctbal, c_nationkey)) GROUP BY s_suppkey", "SELECT s_suppkey, count(*) AS n FROM supplier JOIN customer ON c_acctbal >= s_acctbal - 500 AND c_acctbal <= s_acctbal + 500 AND c_nationkey BETWEEN -1 AND 30 GROUP BY s_suppkey"),
    "st_left_join_in_sql": ("SELECT s_suppkey, c_custkey FROM supplier LEFT JOIN customer ON ST_DWithin(ST_MakePoint(s_acctbal, s_nationkey), ST_MakePoint(c_acctbal, c_nationkey), 3) AND c_custkey > s_suppkey", "SELECT s_suppkey, c_custkey FROM supplier LEFT JOIN customer ON sqrt(pow(s_acctbal - c_acctbal, 2) + pow(s_nationkey - c_nationkey, 2)) <= 3 AND c_custkey > s_suppkey"),
    "st_joins_in_sql": (
        "SELECT s_suppkey, count(*) AS n, min(r_name) AS r FROM supplier s JOIN customer c ON ST_Distance(ST_MakePoint(s_acctbal, s_nationkey), ST_MakePoint(c.c_acctbal, c.c_nationkey)) < s.s_nationkey + 5 AND c_acctbal > 0 JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey IN (SELECT q.s_suppkey FROM supplier q JOIN customer d ON ST_DWithin(ST_MakePoint(q.s_acctbal, 0), ST_MakePoint(d.c_acctbal, 0), 1.5)) GROUP BY s_suppkey",
        "SELECT s_suppkey, count(*) AS n, min(r_name) AS r FROM supplier s JOIN customer c ON sqrt(pow(s_acctbal - c_acctbal, 2) + pow(s_nationkey - c_nationkey, 2)) < s_nationkey + 5 AND c_acctbal > 0 JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE EXISTS (SELECT 1 FROM customer d WHERE abs(s.s_acctbal - d.c_acctbal) <= 1.5) GROUP BY s_suppkey",
    ),
}


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/customer.parquet")).select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment", S.call("ST_MakePoint", F.col("c_acctbal"), F.col("c_nationkey") * 400.0).alias("g"))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("s_acctbal"), F.col("s_nationkey") * 400.0
    return spread(spark.read.parquet(f"{sf_dir}/supplier.parquet")).select("s_suppkey", S.call("ST_MakeEnvelope", x - 300, y - 900, x + 300, y + 900).alias("box"))


def _join(how: str, predicate, residual: str | None = None, grid: bool | None = True) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = spatial_join(_boxes(spark, sf_dir), _points(spark, sf_dir), "box", "g", predicate, how, F.expr(residual) if residual else None, grid=grid)
        return out.select(*(c for c in out.columns if c in ("s_suppkey", "c_custkey", "mark")))

    return run


_ON = "abs(c_acctbal - s_acctbal) {op} 300 AND abs(c_nationkey - s_nationkey) * 400.0 {op} 900"
_COVERS = "c_acctbal >= s_acctbal - 300 AND c_acctbal <= s_acctbal + 300 AND c_nationkey * 400.0 >= s_nationkey * 400.0 - 900 AND c_nationkey * 400.0 <= s_nationkey * 400.0 + 900"
_STRICT = _COVERS.replace(">=", ">").replace("<=", "<")
_FAR = "sqrt(pow(greatest(0, s_acctbal - 300 - c_acctbal, c_acctbal - s_acctbal - 300), 2) + pow(greatest(0, s_nationkey * 400.0 - 900 - c_nationkey * 400.0, c_nationkey * 400.0 - s_nationkey * 400.0 - 900), 2))"
JOINS = {
    "spatial_join_inner": (_join("inner", Relation("covers")), f"SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON {_COVERS}"),
    "spatial_join_contains": (_join("inner", Relation("contains")), f"SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON {_STRICT}"),
    "spatial_join_intersects_loop": (_join("inner", Relation("intersects"), grid=False), f"SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON {_COVERS}"),
    "spatial_join_left": (_join("left", Relation("covers"), "c_acctbal > 0"), f"SELECT s_suppkey, c_custkey FROM supplier LEFT JOIN customer ON {_COVERS} AND c_acctbal > 0"),
    "spatial_join_right": (_join("right", Relation("covers")), f"SELECT s_suppkey, c_custkey FROM supplier RIGHT JOIN customer ON {_COVERS}"),
    "spatial_join_full": (_join("full", Relation("covers"), "c_mktsegment <> 'BUILDING'"), f"SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON {_COVERS} AND c_mktsegment <> 'BUILDING'"),
    "spatial_join_semi": (_join("left_semi", Relation("covers"), "c_acctbal > 9000"), f"SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM customer WHERE {_COVERS} AND c_acctbal > 9000)"),
    "spatial_join_anti": (_join("left_anti", Relation("covers"), "c_acctbal > 9000"), f"SELECT s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM customer WHERE {_COVERS} AND c_acctbal > 9000)"),
    "spatial_join_right_semi": (_join("right_semi", Relation("covers")), f"SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM supplier WHERE {_COVERS})"),
    "spatial_join_right_anti": (_join("right_anti", Relation("covers")), f"SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE {_COVERS})"),
    "spatial_join_mark": (_join("left_mark", Relation("covers"), "c_acctbal > 9000"), f"SELECT s_suppkey, EXISTS (SELECT 1 FROM customer WHERE {_COVERS} AND c_acctbal > 9000) AS mark FROM supplier"),
    "spatial_join_dwithin": (_join("inner", Distance(250.0, side="right")), f"SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON {_FAR} <= 250"),
    "spatial_join_distance": (_join("inner", Distance(100.0, strict=True)), f"SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON {_FAR} < 100"),
}


def analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of a geometry column."""
    ensure(spark, ["ST_MakeEnvelope"])
    views(spark, sf_dir, "part")
    out = st_analyze_agg(spark.sql(f"SELECT {BOX} AS g FROM part"), "g")
    return out.select("count", "minx", "maxx", "miny", F.round("maxy", 4).alias("maxy"), "mean_size_in_bytes", "mean_points_per_geometry", "puntal_count", "polygonal_count", F.round("mean_envelope_width", 6).alias("w"), F.round("mean_envelope_height", 4).alias("h"))


ANALYZE_SQL = """SELECT count(*) AS count, 0.0::DOUBLE AS minx, CAST(max(p_size) AS DOUBLE) AS maxx, 0.0::DOUBLE AS miny, round(max(p_retailprice), 4) AS maxy, CAST(93 AS BIGINT) AS mean_size_in_bytes, 5.0::DOUBLE AS mean_points_per_geometry,
    CAST(0 AS BIGINT) AS puntal_count, count(*) AS polygonal_count, round(avg(p_size), 6) AS w, round(avg(p_retailprice), 4) AS h FROM part"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: query(a) for n, (a, _) in PAIRS.items()} | {n: f for n, (f, _) in JOINS.items()} | {"st_analyze": analyze}


def oracle_sql() -> dict[str, str]:
    return {n: b for n, (_, b) in PAIRS.items()} | {n: b for n, (_, b) in JOINS.items()} | {"st_analyze": ANALYZE_SQL}
