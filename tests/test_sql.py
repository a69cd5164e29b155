"""Statement rewrites, catalog views, functions of PostgreSQL and user functions."""

import pytest
from pyspark.sql import functions as F

from geostrata.functions import compat
from geostrata.functions.registry import USER, Registry, SignatureError, parse, st_function
from geostrata.plans.sql import add_rewrite, null_order, remove_rewrite, rewrite, sql


def rows(spark, text):
    return [tuple(r) for r in sql(spark, text).collect()]


def test_casts_are_stripped_outside_strings_only():
    assert rewrite("select 'a'::regclass, cast(x as pg_catalog.oid), oid '5', '::regclass' from t").split("from")[0].split() == ["select", "'a',", "x,", "'5',", "'::regclass'"]
    assert "::int" in rewrite("select '1'::int")
    assert "regtype" not in rewrite("select x::pg_catalog.regtype[] from t")


def test_wildcards(geo):
    sql(geo, "create or replace temporary view t as select * from (values (1, 2)) as v(a, b)")
    assert sql(geo, "select a, * from t").columns == ["__alias_a", "a", "b"]
    assert sql(geo, "select t.a, t.* from t").columns == ["__alias_a", "a", "b"]
    assert sql(geo, "select a from t").columns == ["a"]


def test_order_of_nulls():
    assert null_order("select a from t order by a, b desc limit 1").split("order by")[1].split("limit")[0].strip() == "a NULLS LAST, b desc NULLS FIRST"
    assert "NULLS LAST" in null_order("select row_number() over (partition by a order by b) from t")
    assert null_order("select a from t order by a nulls first").endswith("a nulls first")


def test_statements(geo):
    assert rows(geo, "begin") == rows(geo, "commit") == []
    assert rows(geo, "set datestyle to 'iso'") == []
    sql(geo, "set geostrata.grid.seed = '7'")
    assert geo.conf.get("spark.geostrata.grid.seed") == "7"
    sql(geo, "prepare q as select $1 + $2 as s")
    assert rows(geo, "execute q (40, 2)") == [(42,)]
    assert sql(geo, "select :x + 1 as y", {"x": 4}).first()["y"] == 5


def test_files(geo, tmp_path):
    sql(geo, f"copy (select * from values (1, 'x'), (2, 'y') as v(a, b)) to '{tmp_path}/out' stored as parquet")
    assert geo.read.parquet(f"{tmp_path}/out").count() == 2
    sql(geo, f"create external table ext stored as parquet location '{tmp_path}/out'")
    assert rows(geo, "select b from ext where a = 2") == [("y",)]
    sql(geo, "drop table ext")


def test_catalog(geo):
    assert len(rows(geo, "select * from pg_catalog.pg_type")) == 28
    assert rows(geo, "select nspname from public.pg_namespace order by oid") == [("pg_catalog",), ("public",), ("information_schema",)]
    assert rows(geo, "select count(*) from pg_class") == [(0,)]
    assert rows(geo, "select column_name from information_schema.columns where table_name = 'pg_namespace' order by ordinal_position") == [("oid",), ("nspname",)]


def test_postgres_functions(geo):
    got = rows(geo, "select format_type(1043, 4), format_type(1043, 5), format_type(1042, 1), format_type(1083, 3), format_type(NULL, 1), format_type(1187, -1), current_schemas(NULL), array_upper(array('a'), 0)")[0]
    assert got == ("character varying", "character varying(1)", "???", "time(3) without time zone", None, "interval[]", None, None)
    with pytest.raises(Exception, match="dimension 1"):
        rows(geo, "select array_upper(array('a'), 2)")


def test_array_helpers(spark):
    a = F.array(*map(F.lit, (1, 2, 3, 4, 5)))
    got = spark.range(1).select(
        compat.array_slice(a, F.lit(-3), F.lit(-1)), compat.array_slice(a, F.lit(1), F.lit(5), 2), compat.array_slice(a, F.lit(4), F.lit(2)), compat.array_element(a, F.lit(9)), compat.array_resize(a, F.lit(2), F.lit(0)),
        compat.array_pop_back(F.array().cast("array<int>")), compat.map_extract(F.create_map(F.lit("a"), F.lit(1)), F.lit("b")), compat.array_has_all(a, F.array(F.lit(9))),
    ).first()
    assert list(got) == [[3, 4, 5], [1, 3, 5], [], None, [1, 2], [], [], False]
    keeps = spark.createDataFrame([(1,), (None,)], "x int").select(compat.array_agg(F.col("x"))).first()[0]
    assert sorted(keeps, key=str) == [1, None]


def test_user_functions(geo):
    @st_function("ST_Twice(double, bigint = 2) -> double")
    def twice(x, n):
        return x * n

    assert rows(geo, "select st_twice(4), ST_TWICE(4, 3), st_twice(NULL)") == [(8.0, 12.0, None)]
    with pytest.raises(SignatureError):
        parse("no signature")
    with pytest.raises(SignatureError):
        parse("f(int = 1, int) -> int")
    own = Registry()
    own.add("f(int) -> int", "a")
    with pytest.raises(SignatureError):
        own.add("f(int, int) -> string", "a")


def test_overloads_by_number_of_arguments(geo):
    own = Registry()
    own.add("g_over(int) -> int", "a * 10")
    own.add("g_over(int, int) -> int", "a + b")
    own.register(geo)
    assert rows(geo, "select g_over(4), g_over(4, 5)") == [(40, 9)]


def test_overloads_by_types_are_refused():
    own = Registry()
    own.add("h_over(int) -> int", "a")
    own.add("h_over(int) -> int", "a + 1")  # the same types: replaced
    with pytest.raises(SignatureError, match="number of arguments"):
        own.add("h_over(string) -> int", "length(a)")
    own.function("many(int) -> int", "many(int, int) -> int")(lambda *cols: cols[0])
    assert len(own.functions["many"]) == 2


@pytest.fixture(scope="module")
def t(geo):
    sql(geo, "create or replace temporary view nums as select * from (values (1, 'a', 10), (2, 'b', 5), (3, 'a', 7), (4, 'b', 5)) as v(id, k, x)")
    return geo


FORMS = [
    ("select * from unnest(array(1, 2)) as u(x)", [(1,), (2,)]),
    ("select id, y from nums, unnest(array(id, x)) as u(y) where id = 2", [(2, 2), (2, 5)]),
    ("select y, n from nums cross join unnest(array(id, x)) with ordinality as u(y, n) where id = 1", [(1, 1), (10, 2)]),
    ("select a, b from unnest(array(1, 2), array('x', 'y')) as u(a, b)", [(1, "x"), (2, "y")]),
    ("select unnest(array(5, 6)) as z", [(5,), (6,)]),
    ("select value from generate_series(1, 10, 4)", [(1,), (5,), (9,)]),
    ("select * from generate_series(3, 1)", []),
    ("select value from generate_series(3, 1, -1)", [(3,), (2,), (1,)]),
    ("select generate_series(1, 3), range(2, 5), range(3), range(9, 3, -4)", [([1, 2, 3], [2, 3, 4], [0, 1, 2], [9, 5])]),
    ("select * from range(2, 4)", [(2,), (3,)]),
    ("select count(*) from (select distinct on (k) k, id from nums order by k, id desc) q", [(2,)]),
    ("with q as (select distinct on (k) k, id from nums order by k, x, id) select * from q order by k", [("a", 3), ("b", 2)]),
    ("select distinct on (k) k, x + id as s from nums order by 1, 2 desc", [("a", 11), ("b", 9)]),
    ("select id from nums qualify row_number() over (partition by k order by x, id) = 1 order by x desc", [(3,), (2,)]),
    ("select id from nums qualify x > 6 union all select 9 order by id", [(1,), (3,), (9,)]),
    ("select k, id, sum(x) over w as s from nums window w as (partition by k order by id) qualify s > 10", [("a", 3, 17)]),
    ("select distinct k from nums qualify count(*) over (partition by k) > 1 order by k", [("a",), ("b",)]),
    ("select id, count(*) over (order by x groups between 1 preceding and current row) as c from nums where id > 0 order by id", [(1, 2), (2, 2), (3, 3), (4, 2)]),
    ("select id, count(*) over w as c from nums n window w as (order by x groups current row) order by n.id", [(1, 1), (2, 2), (3, 1), (4, 2)]),
    ("select id from nums where k similar to '(a|z)%' order by id", [(1,), (3,)]),
    ("select 'a.c' similar to 'a.c', 'abc' similar to 'a.c', 'abc' not similar to 'a_c', 'a%' similar to 'a\\%', 'ab' similar to '[^a]b'", [(True, False, False, True, False)]),
    ("select 'ABC' ~* concat('b', 'c') and 'x' = 'x', 'abc' ~ 'b' || 'c', 'abc' !~ '^b', 'ABC' !~* 'b'", [(True, True, True, False)]),
    ("select array_agg(id order by x desc, id) from nums", [([1, 3, 2, 4],)]),
    ("select array_agg(id order by nullif(x, 7), id desc) from nums", [([4, 2, 1, 3],)]),
    ("select k, first_value(id order by x, id), last_value(id order by id), nth_value(id, 2 order by id) from nums group by k order by k", [("a", 3, 3, 3), ("b", 2, 4, 4)]),
    ("select first_value(id order by nullif(x, 10) desc, id desc) from nums", [(1,)]),
    ("select array_agg(id order by id desc) filter (where x > 5) from nums", [([3, 1],)]),
    ("select string_agg(k, '-' order by id) from nums", [("a-b-a-b",)]),
    ("select approx_percentile_cont(x, 0.5), approx_percentile_cont(0.5) within group (order by x), approx_percentile_cont_with_weight(x, id, 0.5) from nums", [(5, 5, 5.0)]),
    ("select arrow_cast('5', 'Int64'), arrow_cast(3, 'Utf8'), array_any_value(array(null, 4)), array_slice(array(1, 2, 3, 4, 5), 1, 5, 2)", [(5, "3", 4, [1, 3, 5])]),
    ("select to_char(timestamp'2024-03-05 06:07:08', '%Y/%m/%d at %H:%M'), cast(to_date('2024 065', '%Y %j') as string)", [("2024/03/05 at 06:07", "2024-03-05")]),
    ("select trunc(0.29, 2), trunc(-3.78, 1), trunc(5.5), trunc(1.005, 2), trunc(1e300, 2)", [(0.29, -3.7, 5.0, 1.0, 1e300)]),
    ("select extract(dow from date'2024-03-03'), extract(isodow from date'2024-03-03'), extract(year from date'2024-03-03'), date_part('dow', date'2024-03-04')", [(0, 7, 2024, 1.0)]),
    ("select regexp_match('ab12cd34', '([a-z]+)([0-9]+)'), regexp_match('xyz', 'y'), regexp_match('q', 'z'), regexp_match('ABC', '(b)', 'i')", [(["ab", "12"], ["y"], None, ["B"])]),
    ("select cast(date_bin('1 month', timestamp'2024-03-15 10:00:00') as string), cast(date_bin(interval '3 months', timestamp'2024-03-15 10:00:00', timestamp'2024-01-10 12:00:00') as string)", [("2024-03-01 00:00:00", "2024-01-10 12:00:00")]),
    ("select 'pg_catalog.pg_type', 'public.pg_class', 'sqlite_scan(1)', 'unnest(x)', 'a ~ b', 'x::oid'", [("pg_catalog.pg_type", "public.pg_class", "sqlite_scan(1)", "unnest(x)", "a ~ b", "x::oid")]),
    ("select datname from public.pg_database", [("postgres",)]),
    ("select array_upper(array(1, 2, 3), 1)", [(3,)]),
    ("show server_version", [("server_version", "14.10")]),
    ("show no_such_thing", [("no_such_thing", None)]),
    ("select id, k from nums except select 1, 'a' order by id", [(2, "b"), (3, "a"), (4, "b")]),
    ("select * except (x) from nums where id = 1 union all select 9, 'q'", [(1, "a"), (9, "q")]),
]


@pytest.mark.parametrize(("text", "want"), FORMS, ids=range(len(FORMS)))
def test_forms(t, text, want):
    assert rows(t, text) == want


def test_forms_that_raise(t):
    for text in ("select datname from pg_catalog.pg_database", "select date_bin('1 month 2 days', timestamp'2024-03-15 10:00:00')"):
        with pytest.raises(Exception, match="cannot be found|date_bin"):
            rows(t, text)


def test_explain_analyze(t):
    text = sql(t, "explain analyze select k, count(*) from nums group by k").first()["plan"]
    assert "HashAggregate" in text and "numOutputRows=2" in text


def test_plans_of_hints(t):
    plan = sql(t, "select /*+ merge(b) */ count(*) from nums a join nums b on a.id = b.x")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert sql(t, "select /*+ repartition(7, k) */ * from nums").rdd.getNumPartitions() == 7


def test_rewrites_of_ones_own(t):
    change = add_rewrite(lambda text: text.replace("THE_ANSWER", "42"))
    try:
        assert rows(t, "select THE_ANSWER") == [(42,)]
    finally:
        remove_rewrite(change)


def test_external_tables_with_clauses(t, tmp_path):
    sql(t, f"copy nums to '{tmp_path}/p' stored as parquet partitioned by (k)")
    sql(t, f"create external table parted (id int, x int, k string) partitioned by (k) stored as parquet location '{tmp_path}/p'")
    assert rows(t, "select id from parted where k = 'b' order by id") == [(2,), (4,)]
    (tmp_path / "c.csv").write_text("a;b\n1;x\n2;y\n")
    sql(t, f"create external table if not exists semi stored as csv with header row delimiter ';' location '{tmp_path}/c.csv'")
    assert rows(t, "select b from semi where a = 2") == [("y",)]
    sql(t, "drop table parted")
    sql(t, "drop table semi")
    with pytest.raises(ValueError, match="LOCATION"):
        sql(t, "create external table nowhere stored as parquet")


def test_times_beyond_the_year_9999_have_no_sign(spark):
    got = sql(spark, "select cast(to_timestamp_seconds(400000000000) as string) as a, cast(to_timestamp_seconds(id) as text) as b, cast(concat('+1', id) as string) as c from range(1)").first()
    assert tuple(got) == ("14645-06-30 15:06:40", "1970-01-01 00:00:00", "+10")


@pytest.mark.parametrize("one", ["<", ">="])
@pytest.mark.parametrize("two", [">", "<=", None])
def test_counts_over_inequalities(spark, monkeypatch, one, two):
    """Counts by ranges are those of the pairs, with repeated, missing and infinite values; no pairs are made."""
    for name, n, k in (("ia", 150, 7), ("ib", 400, 11)):
        spark.sql(f"select id as {name}k, case when id % 29 = 0 then null when id % 31 = 0 then double('infinity') else id * {k} % 97 / 4D end as {name}x, int(id * 13 % {k}) as {name}y, 1 as shared from range({n})").createOrReplaceTempView(name)
    text = f"SELECT ia.iak, count(*) AS n FROM ia JOIN ib ON ia.iax {one} ib.ibx" + (f" AND ia.iay {two} ib.iby" if two else "") + " GROUP BY ia.iak"
    want = sorted(map(tuple, sql(spark, text).collect()))
    monkeypatch.setattr("geostrata.plans.inequality.PAIRS", 100)
    for ranges in (3, 1024):
        monkeypatch.setattr("geostrata.plans.inequality.BUCKETS", ranges)
        df = sql(spark, text)
        assert sorted(map(tuple, df.collect())) == want and len(want) > 50 and df.dtypes == [("iak", "bigint"), ("n", "bigint")]
    loops = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "NestedLoop" in x]
    assert all("Cross" in x for x in loops)  # with the one row of bounds only
