"""Scans of other databases and streams."""

import sqlite3

import duckdb
import pytest
from pyspark.sql import functions as F

from geostrata.operators.spatial_join import Relation
from geostrata.plans.sql import sql
from geostrata.sources import text
from geostrata.sources.scan import ScanError, jdbc_options
from geostrata.streaming.joins import stream_static_join, windowed_counts


@pytest.fixture
def files(tmp_path):
    lite, duck = tmp_path / "x.sqlite", tmp_path / "x.duckdb"
    with sqlite3.connect(lite) as c:
        c.execute("create table t(a integer, b text, c real, d blob)")
        c.executemany("insert into t values (?, ?, ?, ?)", [(i, f"s{i}", i / 2, b"x") for i in range(50)] + [(None, None, None, None)])
    with duckdb.connect(str(duck)) as d:
        d.execute("create schema other; create table other.t as select i::bigint a, 's' || i b, i / 2 c, date '2024-01-01' + i::int e, [i] f from range(50) r(i)")
    return lite, duck


def test_sqlite(geo, files):
    lite, _ = files
    assert tuple(sql(geo, f"select count(*), count(a), sum(a), max(c) from sqlite_scan('{lite}', 't')").first()) == (51, 50, 1225, 24.5)
    got = sql(geo, f"select b from sqlite_scan('{lite}', 't', 'ignored') where a > 47 order by a").collect()
    assert [r["b"] for r in got] == ["s48", "s49"]


def test_duckdb(geo, files):
    _, duck = files
    got = sql(geo, f"select a, b, c, cast(e as string) e, f from duckdb_scan('{duck}', 'other', 't') where a = 3").collect()
    assert [tuple(r) for r in got] == [(3, "s3", 1.5, "2024-01-04", [3])]


def test_scans_without_row_ids(geo, tmp_path):
    """Views, tables WITHOUT ROWID and tables with a column of that name are read by one task."""
    lite, duck = tmp_path / "y.sqlite", tmp_path / "y.duckdb"
    with sqlite3.connect(lite) as c:
        c.execute("create table t(k text primary key, v integer) without rowid")
        c.execute("create table own(rowid text, v integer)")
        c.executemany("insert into t values (?, ?)", [(f"k{i}", i) for i in range(30)])
        c.executemany("insert into own values (?, ?)", [(None if i % 2 else "r", i) for i in range(30)])
        c.execute("create view seen as select v * 2 as w from t where v < 20")
    with duckdb.connect(str(duck)) as d:
        d.execute("create table t as select i::bigint i from range(40) r(i)")
        d.execute("create view seen as select i + 1 as j, 's' || i as s from t where i < 10")
    assert sql(geo, f"select count(*), sum(v) from sqlite_scan('{lite}', 't') where v > 4").first()[:] == (25, sum(range(5, 30)))
    assert sql(geo, f"select count(*), sum(w) from sqlite_scan('{lite}', 'seen')").first()[:] == (20, 2 * sum(range(20)))
    assert sql(geo, f"select count(*), count(rowid) from sqlite_scan('{lite}', 'own')").first()[:] == (30, 15)
    assert sql(geo, f"select count(*), sum(j) from duckdb_scan('{duck}', 'main', 'seen') where j > 5").first()[:] == (5, 40)


def test_large_static_side_of_a_stream(geo, tmp_path, monkeypatch):
    monkeypatch.setattr("geostrata.streaming.joins.small", lambda df: False)
    points = geo.range(200).select("id", F.expr("ST_MakePoint(id % 40, id % 7)").alias("g"))
    points.write.parquet(f"{tmp_path}/in")
    boxes = geo.range(90).select(F.col("id").alias("b"), F.expr("ST_MakeEnvelope(id % 30, id % 5, id % 30 + id % 9, id % 5 + 2)").alias("area"))
    boxes = boxes.union(geo.sql("select cast(-1 as bigint), ST_MakeEnvelope(-5, -5, 90, 90)"))
    stream = geo.readStream.schema(points.schema).parquet(f"{tmp_path}/in")
    q = stream_static_join(stream, boxes, "g", "area", Relation("intersects")).select("id", "b").writeStream.format("memory").queryName("met").start()
    q.processAllAvailable()
    q.stop()
    want = points.join(boxes, F.expr("ST_Intersects(g, area)")).select("id", "b")
    assert sorted(map(tuple, geo.table("met").collect())) == sorted(map(tuple, want.collect()))


def test_results_as_text(geo):
    df = sql(geo, "select true as a, 1.5 as b, cast(0.1 as double) + 0.2 as c, '' as d, null as e, date'2024-01-02' as f, array(1, null) as g, Box2D(ST_MakeEnvelope(1, 2, 3, 4)) as h, X'0a' as i, 1e20 as j, -0.0D as k, 7 as l")
    assert text.render(df) == [["true", "1.5", "0.3", "(empty)", "NULL", "2024-01-02", "[1, NULL]", "{xmin: 1, ymin: 2, xmax: 3, ymax: 4}", "0a", "100000000000000000000", "0", "7"]]
    assert text.column_types(df) == "BRRT?D???RRI"


def test_scan_arguments(geo):
    with pytest.raises(ScanError):
        sql(geo, "select * from sqlite_scan('x')")
    with pytest.raises(ScanError):
        sql(geo, "select * from duckdb_scan(a, 'b', 'c')")


def test_jdbc_options():
    a = jdbc_options("postgresql://u:p@h:99/db", "postgresql", "t")
    assert (a["url"], a["user"], a["password"]) == ("jdbc:postgresql://h:99/db", "u", "p")
    b = jdbc_options("host=h user=u dbname=d", "mysql", "t")
    assert b["url"] == "jdbc:mysql://h:3306/d" and "password" not in b


def test_stream_static_join(geo, tmp_path):
    points = geo.range(20).select("id", F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.expr("ST_MakePoint(id, 1)").alias("g"))
    points.write.parquet(f"{tmp_path}/in")
    boxes = geo.sql("select 'a' as box, ST_MakeEnvelope(0, 0, 9, 2) as area union all select 'b', ST_MakeEnvelope(5, 0, 30, 2)")
    stream = geo.readStream.schema(points.schema).parquet(f"{tmp_path}/in")
    joined = stream_static_join(stream, boxes, "g", "area", Relation("intersects"))
    counts = windowed_counts(joined, "ts", ["box"], "10 minutes", "0 seconds")
    q = counts.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["window"]["start"].minute, r["box"]): r["n"] for r in geo.table("counts").collect()}
    assert got == {(0, "a"): 10, (0, "b"): 5, (10, "b"): 10}
