"""The ST_ functions: SQL signatures over the JVM kernels, and the same as functions of Columns.

One contract for all: NULL in a required argument gives NULL, and so does anything that cannot be parsed or computed.
Optional arguments that are NULL take their defaults. Geometries are EWKB (little-endian, with SRID where it is not 0).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from geostrata.functions.registry import Registry
from geostrata.session import ensure

#: (signature, body): the body calls kernels over the arguments a, b, c ...
SIGNATURES = [
    ("ST_Area(geometry) -> double", "__k_area(a)"),
    ("ST_Length(geometry) -> double", "__k_length(a)"),
    ("ST_X(geometry) -> double", "__k_x(a)"),
    ("ST_Y(geometry) -> double", "__k_y(a)"),
    ("ST_XMin(geometry) -> double", "__k_xmin(a)"),
    ("ST_XMax(geometry) -> double", "__k_xmax(a)"),
    ("ST_YMin(geometry) -> double", "__k_ymin(a)"),
    ("ST_YMax(geometry) -> double", "__k_ymax(a)"),
    ("ST_IsEmpty(geometry) -> boolean", "__k_isempty(a)"),
    ("ST_IsValid(geometry) -> boolean", "__k_isvalid(a)"),
    ("ST_NPoints(geometry) -> bigint", "__k_npoints(a)"),
    ("ST_SRID(geometry) -> bigint", "__k_srid(a)"),
    ("ST_NumPoints(geometry) -> bigint", "__k_numpoints(a)"),
    ("ST_AsText(geometry) -> string", "__k_astext(a)"),
    ("ST_AsEWKT(geometry) -> string", "__k_asewkt(a)"),
    ("ST_AsGeoJSON(geometry) -> string", "__k_asgeojson(a)"),
    ("ST_GeometryType(geometry) -> string", "__k_geometrytype(a)"),
    ("ST_Centroid(geometry) -> geometry", "__k_centroid(a)"),
    ("ST_ConvexHull(geometry) -> geometry", "__k_convexhull(a)"),
    ("ST_Envelope(geometry) -> geometry", "__k_envelope(a)"),
    ("ST_Boundary(geometry) -> geometry", "__k_boundary(a)"),
    ("ST_MakeValid(geometry) -> geometry", "__k_makevalid(a)"),
    ("ST_BuildArea(geometry) -> geometry", "__k_buildarea(a)"),
    ("ST_Contains(geometry, geometry) -> boolean", "__k_contains(a, b)"),
    ("ST_Intersects(geometry, geometry) -> boolean", "__k_intersects(a, b)"),
    ("ST_Within(geometry, geometry) -> boolean", "__k_within(a, b)"),
    ("ST_Equals(geometry, geometry) -> boolean", "__k_equals(a, b)"),
    ("ST_Covers(geometry, geometry) -> boolean", "__k_covers(a, b)"),
    ("ST_CoveredBy(geometry, geometry) -> boolean", "__k_coveredby(a, b)"),
    ("ST_Touches(geometry, geometry) -> boolean", "__k_touches(a, b)"),
    ("ST_Crosses(geometry, geometry) -> boolean", "__k_crosses(a, b)"),
    ("ST_Overlaps(geometry, geometry) -> boolean", "__k_overlaps(a, b)"),
    ("BBox_Intersects(geometry, geometry) -> boolean", "__k_boxintersects(a, b)"),
    ("ST_Distance(geometry, geometry) -> double", "__k_distance(a, b)"),
    ("ST_Intersection(geometry, geometry) -> geometry", "__k_intersection(a, b)"),
    ("ST_Difference(geometry, geometry) -> geometry", "__k_difference(a, b)"),
    ("ST_Union(geometry, geometry) -> geometry", "__k_union(a, b)"),
    ("ST_Split(geometry, geometry) -> geometry", "__k_split(a, b)"),
    ("Box2D(geometry) -> box2d", "__k_box2d(a)"),
    ("ST_Buffer(geometry, double, bigint = 8) -> geometry", "__k_buffer(a, b, c)"),
    ("ST_Simplify(geometry, double) -> geometry", "__k_simplify(a, b)"),
    ("ST_SimplifyPreserveTopology(geometry, double) -> geometry", "__k_simplifypreservetopology(a, b)"),
    ("ST_SimplifyVW(geometry, double) -> geometry", "__k_simplifyvw(a, b)"),
    ("ST_SetSRID(geometry, bigint) -> geometry", "__k_setsrid(a, b)"),
    ("ST_DWithin(geometry, geometry, double) -> boolean", "__k_dwithin(a, b, c)"),
    ("ST_Translate(geometry, double, double) -> geometry", "__k_translate(a, b, c)"),
    ("ST_ConcaveHull(geometry, double, boolean = false) -> geometry", "__k_concavehull(a, b, c)"),
    ("ST_MakePoint(double, double) -> geometry", "__k_makepoint(a, b)"),
    ("ST_MakeEnvelope(double, double, double, double, bigint = NULL) -> geometry", "__k_makeenvelope(a, b, c, d, e)"),
    ("ST_TileEnvelope(bigint, bigint, bigint, geometry = NULL, double = 0.0D) -> geometry", "__k_tileenvelope(a, b, c, d, e)"),
    ("ST_GeomFromText(string, bigint = NULL) -> geometry", "__k_geomfromtext(a, b)"),
    ("ST_GeomFromEWKT(string) -> geometry", "__k_geomfromewkt(a)"),
    ("ST_GeomFromWKB(binary, bigint = NULL) -> geometry", "__k_geomfromwkb(a, b)"),
    ("ST_GeomFromEWKB(binary) -> geometry", "__k_geomfromwkb(a, CAST(NULL AS BIGINT))"),
    ("ST_GeomFromGeoJSON(string) -> geometry", "__k_geomfromgeojson(a)"),
    ("ST_AsMVTGeom(geometry, box2d, bigint = 4096, bigint = 256, boolean = true) -> geometry", "__k_asmvtgeom(a, b.xmin, b.ymin, b.xmax, b.ymax, c, d, e)"),
    ("ST_Transform(geometry, bigint) -> geometry", "__k_transform(a, b)"),
]

SPATIAL = Registry()
for _signature, _text in SIGNATURES:
    SPATIAL.add(_signature, _text)


def kernels_of(name: str) -> list[str]:
    """Hidden names of the kernels that a function calls."""
    return sorted({k for f in SPATIAL.functions.get(name, []) for k in re.findall(r"__k_\w+", str(f.body))})


def call(name: str, *args: Column | str | float | int | bool) -> Column:
    """A registered function on Columns; plain strings are column names, numbers and booleans literals."""
    if (spark := SparkSession.getActiveSession()) is not None:
        ensure(spark, [name])
    return F.call_function(name, *(F.col(a) if isinstance(a, str) else a if isinstance(a, Column) else F.lit(a) for a in args))


def __getattr__(name: str):
    """st_area(col), st_contains(a, b) ...: every function of the table by its lower-case name."""
    if name in SPATIAL.functions:
        return lambda *args: call(name, *args)
    raise AttributeError(name)
