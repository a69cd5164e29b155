"""Writes Kernels.java: one Spark UDF class for each kernel, from the table below.

A kernel is (class, argument kinds, result kind, body). G arguments reach the body as geometries, others boxed; a null
among the required arguments, and any exception, gives null. Kinds with ? may be null."""

KERNELS = [
    ("Area", "G", "Double", "a.getArea()"),
    ("Length", "G", "Double", "a.getLength()"),
    ("X", "G", "Double", "((Point) a).getX()"),
    ("Y", "G", "Double", "((Point) a).getY()"),
    ("XMin", "G", "Double", "bounds(a).getMinX()"),
    ("XMax", "G", "Double", "bounds(a).getMaxX()"),
    ("YMin", "G", "Double", "bounds(a).getMinY()"),
    ("YMax", "G", "Double", "bounds(a).getMaxY()"),
    ("IsEmpty", "G", "Boolean", "a.isEmpty()"),
    ("IsValid", "G", "Boolean", "a.isValid()"),
    ("NPoints", "G", "Long", "(long) a.getNumPoints()"),
    ("Srid", "G", "Long", "a.getSRID() == 0 ? null : Long.valueOf(a.getSRID())"),
    ("NumPoints", "G", "Long", "(long) ((LineString) a).getNumPoints()"),
    ("AsText", "G", "String", "Codec.text(a)"),
    ("AsEwkt", "G", "String", "Codec.ewkt(a)"),
    ("AsGeoJson", "G", "String", "json(a)"),
    ("GeometryType", "G", "String", "a.getGeometryType()"),
    ("Centroid", "G", "G", "a.getCentroid()"),
    ("ConvexHull", "G", "G", "a.convexHull()"),
    ("Envelope", "G", "G", "Shapes.envelope(a)"),
    ("Boundary", "G", "G", "a.getBoundary()"),
    ("MakeValid", "G", "G", "Shapes.makeValid(a)"),
    ("BuildArea", "G", "G", "Shapes.buildArea(a)"),
    ("Box2D", "G", "Row", "RowFactory.create(bounds(a).getMinX(), bounds(a).getMinY(), bounds(a).getMaxX(), bounds(a).getMaxY())"),
    ("Shape", "G", "Row", "shape(a)"),
    ("Analyze", "G", "Row", "analyze(a, bytes0)"),
    ("Contains", "PG", "Boolean", "a.contains(b)"),
    ("Intersects", "PG", "Boolean", "a.intersects(b)"),
    ("Within", "GP", "Boolean", "b.contains(a)"),
    ("Covers", "PG", "Boolean", "a.covers(b)"),
    ("CoveredBy", "GP", "Boolean", "b.covers(a)"),
    ("Touches", "PG", "Boolean", "a.touches(b)"),
    ("Crosses", "PG", "Boolean", "a.crosses(b)"),
    ("Overlaps", "PG", "Boolean", "a.overlaps(b)"),
    ("Equals", "GG", "Boolean", "a.equalsTopo(b)"),
    ("BoxIntersects", "GG", "Boolean", "a.getEnvelopeInternal().intersects(b.getEnvelopeInternal())"),
    ("Distance", "GG", "Double", "a.isEmpty() || b.isEmpty() ? null : Double.valueOf(distance(a, b))"),
    ("Intersection", "GG", "G", "OverlayNGRobust.overlay(a, b, OverlayNG.INTERSECTION)"),
    ("Difference", "GG", "G", "OverlayNGRobust.overlay(a, b, OverlayNG.DIFFERENCE)"),
    ("Union", "GG", "G", "OverlayNGRobust.overlay(a, b, OverlayNG.UNION)"),
    ("Split", "GG", "G", "Shapes.split(a, b)"),
    ("Buffer", "GDL?", "G", "a.buffer(b, c == null ? 8 : c.intValue())"),
    ("Simplify", "GD", "G", "simplify(a, b)"),
    ("SimplifyPreserveTopology", "GD", "G", "org.locationtech.jts.simplify.TopologyPreservingSimplifier.simplify(a, b)"),
    ("SimplifyVw", "GD", "G", "simplifyVw(a, b)"),
    ("SetSrid", "GL", "G", "withSrid(a, Math.toIntExact(b))"),
    ("DWithin", "GGD", "Boolean", "!a.isEmpty() && !b.isEmpty() && (plain(a) > 0 && plain(b) > 0 ? distance(a, b) <= c : a.isWithinDistance(b, c))"),
    ("Translate", "GDD", "G", "org.locationtech.jts.geom.util.AffineTransformation.translationInstance(b, c).transform(a)"),
    ("ConcaveHull", "GDB?", "G", "org.locationtech.jts.algorithm.hull.ConcaveHull.concaveHullByLengthRatio(a, b, c != null && c)"),
    ("MakePoint", "DD", "G", "Codec.FACTORY.createPoint(new Coordinate(a, b))"),
    ("MakeEnvelope", "DDDDL?", "G", "withSrid(Shapes.box(a, b, c, d, true), e == null ? 0 : Math.toIntExact(e))"),
    ("TileEnvelope", "LLLG?D?", "G", "Shapes.tile(Math.toIntExact(a), Math.toIntExact(b), Math.toIntExact(c), d, e == null ? 0 : e)"),
    ("GeomFromText", "SL?", "G", "withSrid(Codec.wkt(a), b == null ? 0 : Math.toIntExact(b))"),
    ("GeomFromEwkt", "S", "G", "Codec.ewkt(a)"),
    ("GeomFromWkb", "GL?", "G", "b == null ? a : withSrid(a, Math.toIntExact(b))"),
    ("GeomFromGeoJson", "S", "G", "Codec.fromJson(a)"),
    ("AsMvtGeom", "GDDDDL?L?B?", "G", "Shapes.mvt(a, new double[] {b, c, d, e}, f == null ? 4096 : Math.toIntExact(f), g == null ? 256 : Math.toIntExact(g), h == null || h)"),
    ("Transform", "GL", "G", "Projection.transform(a, a.getSRID(), (int) (b & 0xFFFF))"),
]

BOXED = {"D": "Double", "L": "Long", "B": "Boolean", "S": "String", "G": "byte[]", "P": "byte[]"}


def kernel(name: str, kinds: str, result: str, body: str) -> str:
    args = []
    for k in kinds:
        if k == "?":
            args[-1] += "?"
        else:
            args.append(k)
    letters = "abcdefgh"[: len(args)]
    boxed = [BOXED[a[0]] for a in args]
    out = {"G": "byte[]"}.get(result, result)
    lines = [f"    public static final class St{name} implements UDF{len(args)}<{', '.join([*boxed, out])}> {{"]
    lines.append(f"        public {out} call({', '.join(f'{t} {x}{i}' for i, (t, x) in enumerate(zip(boxed, ['v'] * len(args), strict=True)))}) {{")
    need = [f"v{i} == null" for i, a in enumerate(args) if not a.endswith("?")]
    lines.append(f"            if ({' || '.join(need)}) return null;")
    lines.append("            try {")
    slot = 0
    for i, (a, letter) in enumerate(zip(args, letters, strict=True)):
        if a[0] in "GP":
            null = f"v{i} == null ? null : " if a.endswith("?") else ""
            if len([x for x in args if x[0] in "GP" and not x.endswith("?")]) > 1:
                how = f"new Side(v{i}, {slot})" if a[0] == "P" else f"Codec.recent(v{i}, {slot}).geometry"
                slot += 1
            else:
                how = f"Codec.read(v{i})"
            kind = "Side" if a[0] == "P" else "Geometry"
            if a.endswith("?"):
                lines.append(f"                Geometry {letter} = lenient(v{i});")
            else:
                lines.append(f"                {kind} {letter} = {null}{how};")
        else:
            lines.append(f"                {BOXED[a[0]]} {letter} = v{i};")
    if "bytes0" in body:
        lines.append("                byte[] bytes0 = v0;")
    if result == "G":
        lines.append(f"                Geometry out = {body};")
        from_srid = "G" in kinds and kinds[0] == "G" and name not in ("SetSrid", "Transform", "AsMvtGeom", "GeomFromWkb")
        if from_srid:
            lines.append("                if (out != null && out.getSRID() == 0 && a.getSRID() != 0) out = withSrid(out, a.getSRID());")
        lines.append("                return out == null ? null : Codec.write(out);")
    else:
        lines.append(f"                return {body};")
    lines += ["            } catch (Exception | StackOverflowError x) {", "                return null;", "            }", "        }", "    }", ""]
    return "\n".join(lines)


HEAD = """package geostrata;

import org.apache.spark.sql.Row;
import org.apache.spark.sql.RowFactory;
import org.apache.spark.sql.api.java.*;
import org.locationtech.jts.geom.*;
import org.locationtech.jts.geom.prep.*;
import org.locationtech.jts.operation.overlayng.OverlayNG;
import org.locationtech.jts.operation.overlayng.OverlayNGRobust;

/** Spark UDF classes over JTS. Written by generate.py; change the table there. */
public final class Kernels {
    private Kernels() {}

    /** One side of a relation: a plain geometry at first, a prepared one once the same bytes come again. */
    static final class Side {
        final Geometry plain;
        final PreparedGeometry ready;

        Side(byte[] bytes, int slot) throws Exception {
            Codec.Recent r = Codec.recent(bytes, slot);
            plain = r.geometry;
            if (r.prepared == null && r.uses > 0 && plain.getClass() != GeometryCollection.class) r.prepared = new PreparedGeometryFactory().create(plain);
            ready = r.prepared;
        }

        boolean contains(Geometry o) { return ready != null ? ready.contains(o) : plain.contains(o); }

        boolean covers(Geometry o) { return ready != null ? ready.covers(o) : plain.covers(o); }

        boolean intersects(Geometry o) { return ready != null ? ready.intersects(o) : plain.intersects(o); }

        boolean touches(Geometry o) { return ready != null ? ready.touches(o) : plain.touches(o); }

        boolean crosses(Geometry o) { return ready != null ? ready.crosses(o) : plain.crosses(o); }

        boolean overlaps(Geometry o) { return ready != null ? ready.overlaps(o) : plain.overlaps(o); }
    }

    static Envelope bounds(Geometry g) {
        Envelope e = g.getEnvelopeInternal();
        if (e.isNull()) throw new IllegalArgumentException("empty");
        return e;
    }

    static Geometry lenient(byte[] b) {
        try {
            return b == null ? null : Codec.read(b);
        } catch (Exception x) {
            return null;
        }
    }

    static String json(Geometry g) {
        StringBuilder out = new StringBuilder();
        Codec.json(out, g);
        return out.toString();
    }

    static Geometry withSrid(Geometry g, int srid) {
        Geometry out = g.copy();
        out.setSRID(srid);
        return out;
    }

    static Geometry simplify(Geometry g, double tolerance) {
        org.locationtech.jts.simplify.DouglasPeuckerSimplifier s = new org.locationtech.jts.simplify.DouglasPeuckerSimplifier(g);
        s.setDistanceTolerance(tolerance);
        s.setEnsureValid(false);
        return s.getResultGeometry();
    }

    /** The tolerance is the area of a triangle. */
    static Geometry simplifyVw(Geometry g, double area) {
        if (!(g instanceof Lineal || g instanceof Polygonal)) return null;
        org.locationtech.jts.simplify.VWSimplifier s = new org.locationtech.jts.simplify.VWSimplifier(g);
        s.setDistanceTolerance(Math.sqrt(area));
        s.setEnsureValid(false);
        Geometry out = s.getResultGeometry().copy();
        out.apply((CoordinateFilter) c -> {
            if (!Double.isNaN(c.getZ())) c.setZ(Double.NaN);
        });
        return out;
    }

    /** 1 for a point, 2 for a rectangle along the axes: shapes that are their bounds; 0 for others. */
    static int plain(Geometry g) {
        Envelope e = g.getEnvelopeInternal();
        if (!(Double.isFinite(e.getMinX()) && Double.isFinite(e.getMinY()) && Double.isFinite(e.getMaxX()) && Double.isFinite(e.getMaxY()))) return 0;
        return g instanceof Point ? 1 : g instanceof Polygon && g.isRectangle() && e.getArea() > 0 ? 2 : 0;
    }

    /** The distance; between plain shapes that of their bounds, rounded once in each direction. */
    static double distance(Geometry a, Geometry b) {
        if (plain(a) == 0 || plain(b) == 0) return a.distance(b);
        Envelope e = a.getEnvelopeInternal(), f = b.getEnvelopeInternal();
        double x = Math.max(0, Math.max(e.getMinX() - f.getMaxX(), f.getMinX() - e.getMaxX())), y = Math.max(0, Math.max(e.getMinY() - f.getMaxY(), f.getMinY() - e.getMaxY()));
        return Math.sqrt(x * x + y * y);
    }

    static Row shape(Geometry g) {
        Envelope e = bounds(g);
        return RowFactory.create(plain(g), e.getMinX(), e.getMinY(), e.getMaxX(), e.getMaxY());
    }

    /** bytes, points, kind (0 puntal, 1 lineal, 2 polygonal, 3 collection) and bounds of a geometry. */
    static Row analyze(Geometry g, byte[] bytes) {
        Envelope e = g.getEnvelopeInternal();
        int kind = g instanceof Puntal ? 0 : g instanceof Lineal ? 1 : g instanceof Polygonal ? 2 : 3;
        boolean none = e.isNull();
        return RowFactory.create((long) bytes.length, (long) g.getNumPoints(), kind, none ? null : e.getMinX(), none ? null : e.getMinY(), none ? null : e.getMaxX(), none ? null : e.getMaxY());
    }

"""

if __name__ == "__main__":
    from pathlib import Path

    text = HEAD + "\n".join(kernel(*k) for k in KERNELS) + "}\n"
    (Path(__file__).parent / "geostrata" / "Kernels.java").write_text(text)
