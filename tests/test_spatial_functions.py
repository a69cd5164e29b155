"""Spatial functions against fixed results, the null contract, and shapes whose ring start is not fixed."""

import math

import pytest
from pyspark.sql import functions as F

from geostrata.functions import spatial
from geostrata.plans.sql import sql

G = "ST_GeomFromText('{}')".format
# Results worked out by hand; those that only an engine's own rules fix stand below, as fixed values.
SQUARE = "POLYGON((0 0,6 0,6 6,0 6,0 0))"
CASES = [
    ("ST_AsText(ST_GeomFromText('LINESTRING(2.5 -1,7 8.25)', 3857))", "LINESTRING (2.5 -1, 7 8.25)"),
    (f"ST_AsText(ST_Boundary({G('LINESTRING(1 9,5 4,8 2)')}))", "MULTIPOINT ((1 9), (8 2))"),
    (f"ST_AsText(ST_Boundary({G('POLYGON((0 0,6 0,6 6,0 6,0 0),(2 2,4 2,4 4,2 2))')}))", "MULTILINESTRING ((0 0, 6 0, 6 6, 0 6, 0 0), (2 2, 4 2, 4 4, 2 2))"),
    (f"ST_AsText(ST_Centroid({G('MULTIPOINT(0 0,4 0,4 8,0 8)')}))", "POINT (2 4)"),
    (f"ST_AsText(ST_Envelope({G('POINT(7 -2)')}))", "POINT (7 -2)"),
    (f"ST_AsText(ST_Envelope({G('LINESTRING(2 1,5 9)')}))", "POLYGON ((2 1, 5 1, 5 9, 2 9, 2 1))"),
    (f"ST_AsText(ST_MakeValid({G('LINESTRING(4 4,4 4)')}))", "POINT (4 4)"),
    (f"ST_Area({G('POLYGON((0 0,10 0,7 4,1 4,0 0))')})", 32.0),
    (f"ST_Area({G('POLYGON((0 0,10 0,10 10,0 10,0 0),(2 2,2 5,5 5,5 2,2 2))')})", 91.0),
    (f"ST_Length({G('LINESTRING(0 0,3 4,3 10)')})", 11.0),
    (f"ST_Length({G(SQUARE)})", 24.0),
    (f"ST_GeometryType({G('LINESTRING(0 0,3 5)')})", "LineString"),
    (f"ST_GeometryType({G('GEOMETRYCOLLECTION(POINT(0 0),LINESTRING(0 0,1 1))')})", "GeometryCollection"),
    (f"ST_X({G('POINT(8 -3 2 1)')})", 8.0),
    (f"ST_Y({G('POINT(8 -3 2 1)')})", -3.0),
    (f"ST_X({G('LINESTRING(0 0,1 1)')})", None),
    (f"ST_XMax({G('LINESTRING(-4 2 1,6 9 0)')})", 6.0),
    (f"ST_YMin({G('LINESTRING(-4 2 1,6 9 0)')})", 2.0),
    (f"ST_YMax({G('MULTIPOINT(1 1,5 -2)')})", 1.0),
    (f"ST_IsValid({G('POLYGON((0 0,4 4,4 0,0 4,0 0))')})", False),
    (f"ST_NumPoints({G('LINESTRING(0 0,1 2,3 1,4 4,9 9)')})", 5),
    (f"ST_NPoints({G('POLYGON((0 0,6 0,6 6,0 6,0 0),(2 2,4 2,4 4,2 2))')})", 9),
    ("ST_SRID(ST_GeomFromText('POINT(3 4)', 25832))", 25832),
    (f"ST_AsText(ST_Difference({G('LINESTRING(0 0,0 9)')}, {G('LINESTRING(0 3,0 12)')}))", "LINESTRING (0 0, 0 3)"),
    (f"ST_AsText(ST_Intersection({G('POINT(5 5)')}, {G('LINESTRING(0 1,1 0)')}))", "POINT EMPTY"),
    (f"ST_Area(ST_Intersection({G(SQUARE)}, {G('POLYGON((4 4,9 4,9 9,4 9,4 4))')}))", 4.0),
    (f"ST_AsText(ST_Union({G('POINT(-3 1)')}, {G('POINT(2 5)')}))", "MULTIPOINT ((-3 1), (2 5))"),
    (f"ST_Contains({G(SQUARE)}, {G('POINT(4 5)')})", True),
    (f"ST_Contains({G(SQUARE)}, {G('POINT(6 3)')})", False),
    (f"ST_Covers({G(SQUARE)}, {G('POINT(6 3)')})", True),
    (f"ST_CoveredBy({G('POINT(6 3)')}, {G(SQUARE)})", True),
    (f"ST_Within({G('LINESTRING(1 1,5 5)')}, {G(SQUARE)})", True),
    (f"ST_Intersects({G(SQUARE)}, {G('LINESTRING(7 7,9 9)')})", False),
    (f"ST_Equals({G('LINESTRING(0 0,6 3)')}, {G('LINESTRING(6 3,2 1,0 0)')})", True),
    (f"ST_Overlaps({G(SQUARE)}, {G('POLYGON((4 4,9 4,9 9,4 9,4 4))')})", True),
    (f"ST_Overlaps({G(SQUARE)}, {G('LINESTRING(1 1,9 9)')})", False),
    (f"ST_Touches({G(SQUARE)}, {G('POLYGON((6 0,8 0,8 6,6 6,6 0))')})", True),
    (f"ST_Touches({G('LINESTRING(0 0,3 3)')}, {G('POINT(3 3)')})", True),
    (f"ST_Crosses({G('LINESTRING(-1 3,7 3)')}, {G(SQUARE)})", True),
    (f"BBox_Intersects({G('LINESTRING(0 0,4 4)')}, {G('LINESTRING(3 0,9 1)')})", True),
    (f"ST_Intersects({G('LINESTRING(0 0,4 4)')}, {G('LINESTRING(3 0,9 1)')})", False),
    ("ST_AsEWKT(ST_SetSRID(ST_GeomFromText('POINT(9 7)'), 2154))", "SRID=2154;POINT (9 7)"),
    ("ST_AsEWKT(ST_GeomFromEWKT('SRID = 2154 ;POINT(9 7)'))", "SRID=2154;POINT (9 7)"),
    ("ST_GeomFromEWKT('SRID=x;POINT(9 7)')", None),
    ("ST_GeomFromEWKT('SRID=2154;POINT(9 7)') = ST_GeomFromText('POINT(9 7)', 2154)", True),
    (f"ST_AsGeoJson({G('LINESTRING(0 3,5 1)')})", '{"type":"LineString","coordinates":[[0.0,3.0],[5.0,1.0]]}'),
    ("""ST_AsText(ST_GeomFromGeoJSON('{"type":"MultiPoint","coordinates":[[1.5,-2],[3,4]]}'))""", "MULTIPOINT ((1.5 -2), (3 4))"),
    (f"ST_AsText(ST_SimplifyVW({G('LINESTRING(0 0,4 1,8 0,8 9)')}, 5))", "LINESTRING (0 0, 8 0, 8 9)"),
    (f"ST_AsText(ST_Simplify({G('LINESTRING(0 0,4 1,8 0)')}, 2))", "LINESTRING (0 0, 8 0)"),
    (f"ST_AsText(ST_Simplify({G('LINESTRING(0 0,4 3,8 0)')}, 2))", "LINESTRING (0 0, 4 3, 8 0)"),
    (f"ST_AsText(ST_Split({G('LINESTRING(0 0,9 0)')}, {G('MULTILINESTRING((3 -1,3 1),(7 -2,7 2))')}))", "GEOMETRYCOLLECTION (LINESTRING (0 0, 3 0), LINESTRING (3 0, 7 0), LINESTRING (7 0, 9 0))"),
    (f"ST_AsText(ST_Split({G('MULTILINESTRING((0 0,4 4),(0 4,4 0))')}, {G('POINT(2 2)')}))", "GEOMETRYCOLLECTION (LINESTRING (0 0, 2 2), LINESTRING (2 2, 4 4), LINESTRING (0 4, 2 2), LINESTRING (2 2, 4 0))"),
    ("ST_AsText(ST_MakeEnvelope(-2, 3, 5, 4))", "POLYGON ((-2 3, -2 4, 5 4, 5 3, -2 3))"),
    (f"ST_AsText(ST_ConvexHull({G('MULTIPOINT(0 0,0 8,8 8,8 0,3 4)')}))", "POLYGON ((0 0, 0 8, 8 8, 8 0, 0 0))"),
    (f"ST_AsText(ST_Translate({G('POINT(-7.5 4)')}, 1.25, -6)) ", "POINT (-6.25 -2)"),
    (f"ST_IsEmpty({G('LINESTRING EMPTY')})", True),
    (f"ST_XMin({G('POLYGON EMPTY')})", None),
    (f"ST_NPoints({G('MULTIPOINT(1 1,2 2,3 3)')})", 3),
    (f"ST_Distance({G(SQUARE)}, {G('POINT(9 10)')})", 5.0),
    (f"ST_DWithin({G('POINT(1 1)')}, {G('POINT(6 13)')}, 13)", True),
    (f"ST_DWithin({G('POINT(1 1)')}, {G('POINT(6 13)')}, 12.9)", False),
    # Results that depend on an engine's own rules.
    (f"ST_AsText(ST_ConcaveHull({G('POLYGON((0 0,10 0,10 5,0 -5,0 0))')}, 0.1))", "POLYGON ((10 0, 0 -5, 0 0, 10 5, 10 0))"),
    ("ST_AsText(ST_TileEnvelope(2, 1, 1))", "POLYGON ((-10018754.1713945 0, -10018754.1713945 10018754.1713945, 0 10018754.1713945, 0 0, -10018754.1713945 0))"),
    (f"ST_AsText(ST_Buffer({G('POINT(100 90)')}, 50, 2))", "POLYGON ((150 90, 135.35533905932738 54.64466094067263, 100 40, 64.64466094067262 54.64466094067262, 50 90, 64.64466094067262 125.35533905932738, 100 140, 135.35533905932738 125.35533905932738, 150 90))"),
    ("ST_AsText(ST_AsMVTGeom(ST_GeomFromText('POLYGON((0 0,8 0,8 8,0 8,0 0))'), Box2D(ST_MakeEnvelope(0, 0, 4, 4)), 4, 0))", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))"),
]


@pytest.mark.parametrize(("expression", "expected"), CASES, ids=range(len(CASES)))
def test_fixed_results(geo, expression, expected):
    got = geo.sql(f"SELECT {expression} AS v").first()["v"]
    if expected is not None and "ST_AsMVTGeom" in expression:
        same = geo.sql(f"SELECT ST_Equals(ST_GeomFromText('{got}'), ST_GeomFromText('{expected}')) AS v").first()["v"]
        assert same
    else:
        assert got == expected


def circle(x, y, r, n=24):
    """A regular polygon by its centre."""
    points = [(x + r * math.cos(2 * math.pi * i / n), y + r * math.sin(2 * math.pi * i / n)) for i in range(n)]
    return "((" + ",".join(f"{a:.9f} {b:.9f}" for a, b in [*points, points[0]]) + "))"


@pytest.mark.parametrize("parts", [[circle(50, 50, 30), "((10 5,95 88,90 94,6 12,10 5))"], [circle(x, y, 26) for x in (30, 60) for y in (30, 68, 106)]], ids=["band", "rings"])
def test_make_valid_is_even_odd_over_parts(geo, parts):
    """Parts of a multipolygon that overlap: what an even number of them holds goes, as in symmetric differences."""
    shapes = [f"ST_GeomFromText('POLYGON{p}')" for p in parts]
    geo.sql("SELECT " + ", ".join(f"{g} AS g{i}" for i, g in enumerate(shapes))).createOrReplaceTempView("parts")
    want = "g0"
    for i in range(1, len(parts)):
        want = f"ST_Difference(ST_Union({want}, g{i}), ST_Intersection({want}, g{i}))"
    made = f"ST_MakeValid(ST_GeomFromText('MULTIPOLYGON({','.join(parts)})'))"
    row = geo.sql(f"SELECT ST_IsValid({made}) AS v, ST_Area({made}) AS a, ST_Area({want}) AS w, ST_Area(ST_Difference({made}, {want})) + ST_Area(ST_Difference({want}, {made})) AS off FROM parts").first()
    assert row["v"] and math.isclose(row["a"], row["w"], rel_tol=1e-9) and row["off"] < 1e-6


def test_hulls_hold_their_points(geo):
    rnd = [(37 * i % 101, 53 * i % 97) for i in range(60)]
    points = f"ST_GeomFromText('MULTIPOINT({','.join(f'{x} {y}' for x, y in rnd)})')"
    for share in (0.1, 0.4, 1.0):
        for holes in ("false", "true"):
            hull = f"ST_ConcaveHull({points}, {share}, {holes})"
            row = geo.sql(f"SELECT ST_Covers({hull}, {points}) AS c, ST_Covers(ST_ConvexHull({points}), {hull}) AS w, ST_Equals({hull}, ST_ConvexHull({points})) AS e, ST_IsValid({hull}) AS v").first()
            assert row["c"] and row["w"] and row["v"] and row["e"] == (share == 1.0)


def test_calls_in_values(geo):
    rows = sql(geo, f"SELECT ST_Area(g) AS a, ST_AsText(ST_Centroid(g)) AS c FROM (VALUES ({G(SQUARE)}), (ST_MakeEnvelope(0, 0, 2, 4)), (ST_MakePoint(1, 1)), (NULL)) AS t(g) ORDER BY a DESC").collect()
    assert [tuple(r) for r in rows] == [(None, None), (36.0, "POINT (3 3)"), (8.0, "POINT (1 2)"), (0.0, "POINT (1 1)")]


def test_rings_without_a_fixed_start(geo):
    lines = "MULTILINESTRING((0 0,9 0,9 9),(9 9,0 9,0 0),(2 2,5 2,5 5),(5 5,2 5,2 2))"
    area = "POLYGON((0 0,9 0,9 9,0 9,0 0),(2 2,2 5,5 5,5 2,2 2))"
    assert geo.sql(f"SELECT ST_Equals(ST_BuildArea({G(lines)}), {G(area)}) AS v").first()["v"]
    bow = "POLYGON((0 0,2 2,2 0,0 2,0 0))"
    row = geo.sql(f"SELECT ST_AsText(ST_MakeValid({G(bow)})) AS t, ST_Area(ST_MakeValid({G(bow)})) AS a, ST_IsValid(ST_MakeValid({G(bow)})) AS v").first()
    assert row["a"] == 2.0 and row["v"] and row["t"].startswith("MULTIPOLYGON")
    overlap = "MULTIPOLYGON(((0 0,2 0,2 2,0 2,0 0)),((1 0,3 0,3 2,1 2,1 0)))"
    assert geo.sql(f"SELECT ST_Area(ST_MakeValid({G(overlap)})) AS a").first()["a"] == 4.0  # even-odd: the common part goes


def test_transform(geo):
    row = geo.sql("SELECT ST_AsEWKT(ST_Transform(ST_GeomFromText('POINT(1 1)', 4326), 3587)) AS t").first()["t"]
    x, y = map(float, row.removeprefix("SRID=3587;POINT (").removesuffix(")").split())
    assert math.isclose(x, 16192673.622364368, abs_tol=1e-3) and math.isclose(y, 768721.3525017627, abs_tol=1e-3)
    there = "ST_Transform(ST_GeomFromText('POINT(9.5 51.2)', 4326), {})"
    for srid in (3857, 3395, 32632, 25832, 2154, 3034, 26917):
        back = geo.sql(f"SELECT ST_X(g) AS x, ST_Y(g) AS y FROM (SELECT ST_Transform({there.format(srid)}, 4326) AS g)").first()
        assert math.isclose(back["x"], 9.5, abs_tol=1e-6) and math.isclose(back["y"], 51.2, abs_tol=1e-6), srid
    utm = geo.sql(f"SELECT ST_X({there.format(32632)}) AS x").first()["x"]
    assert 534000 < utm < 536000
    same, none = geo.sql("SELECT ST_AsEWKT(ST_Transform(ST_GeomFromText('POINT(1 2)', 9999), 9999)) AS a, ST_Transform(ST_MakePoint(1, 1), 4326) AS b").first()
    assert same == "SRID=9999;POINT (1 2)" and none is None


def test_every_function_is_null_on_nulls_and_rubbish(geo):
    for name, own in spatial.SPATIAL.functions.items():
        arguments = own[-1].signature.arguments
        required = [a for a in arguments if not a.sees_null]
        nulls = ", ".join(f"CAST(NULL AS {a.type})" for a in required)
        assert geo.sql(f"SELECT {name}({nulls}) AS v").first()["v"] is None, name
        if required[0].type == "BINARY":
            rest = ", ".join({"BINARY": "X'01FF'", "DOUBLE": "1.0D", "BIGINT": "1", "STRING": "'x'", "BOOLEAN": "true"}.get(a.type, f"CAST(NULL AS {a.type})") for a in required)
            assert geo.sql(f"SELECT {name}({rest}) AS v").first()["v"] is None, name


def test_columns_and_names(geo):
    df = geo.range(3).select(spatial.st_makepoint(F.col("id").cast("double"), F.lit(1.0)).alias("g"))
    assert [r[0] for r in df.select(spatial.st_x("g")).collect()] == [0.0, 1.0, 2.0]
    assert geo.sql("SELECT st_AREA(St_MakeEnvelope(0,0,2,2)) AS a").first()["a"] == 4.0
    with pytest.raises(AttributeError):
        spatial.st_nothing  # noqa: B018


def test_three_dimensions_keep_their_ordinates(geo):
    assert geo.sql("SELECT ST_AsText(ST_GeomFromWKB(ST_GeomFromText('POINT Z (1 2 3)'))) AS t").first()["t"] == "POINT Z (1 2 3)"
    assert sql(geo, "SELECT ST_Distance(ST_GeomFromText('POINT Z (0 0 9)'), ST_GeomFromText('POINT(3 4)')) AS d").first()["d"] == 5.0
