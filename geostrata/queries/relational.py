"""Relational operators, aggregates and windows: one query each."""

from __future__ import annotations

import os
import sqlite3
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.functions.registry import Registry
from geostrata.operators import relational as R
from geostrata.plans.sql import sql
from geostrata.queries.base import query, views

#: name: statement that both engines read alike.
SAME = {
    "tpch_q1": """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
        round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    "tpch_q3": """SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderpriority FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
        WHERE c_mktsegment = 'BUILDING' GROUP BY l_orderkey, o_orderpriority ORDER BY revenue DESC, l_orderkey LIMIT 10""",
    "tpch_q5": """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
        JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name""",
    "tpch_q6": "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
    "scan_filter_project": "SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders WHERE o_totalprice > 300000 AND o_orderstatus IN ('F', 'O') AND o_orderpriority LIKE '1%'",
    "filter_predicates": "SELECT count(*) AS n, sum(CASE WHEN c_acctbal IS NOT DISTINCT FROM NULL THEN 1 ELSE 0 END) AS d FROM customer WHERE c_acctbal BETWEEN -500 AND 5000 AND c_mktsegment NOT IN ('BUILDING') AND (c_name LIKE '%1' OR NOT c_name LIKE '%2%') AND (c_acctbal > 0) IS NOT FALSE",
    "values_rows": "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS t(a, b)",
    "cross_join": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "join_inner": "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "join_left": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000 GROUP BY c_custkey",
    "join_right": "SELECT p_partkey, l_orderkey FROM lineitem RIGHT JOIN part ON l_partkey = p_partkey AND l_quantity = 50",
    "join_full": "SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey AND s_nationkey = c_nationkey",
    "join_theta": "SELECT s.s_suppkey, count(*) AS n FROM supplier s JOIN customer c ON s.s_acctbal < c.c_acctbal AND s.s_nationkey > c.c_nationkey GROUP BY s.s_suppkey",
    "join_null_safe": "SELECT count(*) AS n FROM (SELECT nullif(c_nationkey, 3) AS k FROM customer) a JOIN (SELECT nullif(n_nationkey, 3) AS k FROM nation) b ON a.k IS NOT DISTINCT FROM b.k",
    "join_using": "SELECT count(*) AS n FROM (SELECT n_nationkey AS k, n_name FROM nation) a JOIN (SELECT c_nationkey AS k, c_custkey FROM customer) b USING (k)",
    "join_semi_exists": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 350000)",
    "join_anti_not_exists": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "join_semi_in": "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)",
    "join_anti_not_in": "SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49.5 AND l_discount > 0.09)",
    "join_mark": "SELECT c_custkey FROM customer WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 380000)",
    "agg_group": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(min(o_totalprice), 2) AS lo, round(max(o_totalprice), 2) AS hi FROM orders GROUP BY o_orderstatus, o_orderpriority HAVING count(*) > 10",
    "agg_distinct_filter": "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(*) FILTER (WHERE o_totalprice > 200000) AS big FROM orders GROUP BY o_orderstatus",
    "agg_grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus) AS g FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())",
    "agg_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "agg_rollup": "SELECT n_regionkey, n_nationkey, count(*) AS n FROM nation GROUP BY ROLLUP (n_regionkey, n_nationkey)",
    "agg_statistics": "SELECT l_returnflag, round(var_samp(l_quantity), 6) AS v, round(var_pop(l_quantity), 6) AS vp, round(stddev_samp(l_quantity), 6) AS s, round(stddev_pop(l_quantity), 6) AS sp, round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_discount), 6) AS cp, round(covar_samp(l_quantity, l_discount), 6) AS cs FROM lineitem GROUP BY l_returnflag",
    "agg_regression": "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, regr_count(l_extendedprice, l_quantity) AS n FROM lineitem",
    "agg_median": "SELECT l_returnflag, median(l_quantity) AS m FROM lineitem GROUP BY l_returnflag",
    "agg_bits_bools": "SELECT bit_and(c_nationkey) AS ba, bit_or(c_nationkey) AS bo, bit_xor(c_nationkey) AS bx, bool_and(c_acctbal > -1000) AS al, bool_or(c_acctbal > 9990) AS an FROM customer",
    "agg_first_min_by": "SELECT o_custkey, min_by(o_orderkey, o_orderkey) AS a, max_by(o_orderkey, o_totalprice) AS b FROM orders GROUP BY o_custkey",
    "window_ranks": "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, ntile(4) OVER w AS nt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)",
    "window_distribution": "SELECT o_orderkey, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderkey)",
    "window_offsets": "SELECT o_orderkey, lag(o_orderkey, 1, -1) OVER w AS a, lead(o_orderkey, 2) OVER w AS b, first_value(o_orderkey) OVER w AS c, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS d, nth_value(o_orderkey, 2) OVER w AS e FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
    "window_frames": "SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 2) AS s, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 200 PRECEDING AND CURRENT ROW) AS a FROM orders",
    "window_groups": "SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM orders WHERE o_totalprice > 1000",
    "sort_nulls": "SELECT c_custkey, nullif(c_nationkey, 7) AS k FROM customer ORDER BY k DESC NULLS LAST, c_custkey LIMIT 30",
    "limit_offset": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10",
    "union_all": "SELECT n_nationkey AS k FROM nation UNION ALL SELECT s_nationkey AS k FROM supplier",
    "union_distinct": "SELECT n_nationkey AS k FROM nation UNION SELECT c_nationkey AS k FROM customer",
    "intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier",
    "intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey AS k FROM supplier",
    "except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey AS k FROM supplier",
    "except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT n_nationkey AS k FROM nation",
    "distinct": "SELECT DISTINCT p_brand, p_size FROM part",
    "distinct_on": "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey",
    "qualify": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1",
    "qualify_in_queries": "WITH dear AS (SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) = 1) SELECT o_custkey AS k, o_orderkey AS v FROM dear UNION ALL SELECT k, v FROM (SELECT c_nationkey AS k, c_custkey AS v FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) QUALIFY row_number() OVER w = 1) x",
    "distinct_on_in_queries": "WITH firsts AS (SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice, o_orderkey) SELECT c_custkey, o_orderkey FROM customer LEFT JOIN firsts ON c_custkey = o_custkey",
    "filter_ilike": "SELECT p_partkey FROM part WHERE p_brand ILIKE 'bRAND#1%' AND NOT p_name ILIKE '%A%'",
    "array_agg_order": "SELECT n_regionkey, array_to_string(array_agg(n_name ORDER BY n_name DESC), '|') AS names FROM nation GROUP BY n_regionkey",
    "subquery_scalar": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 2 FROM orders)",
    "subquery_correlated": "SELECT p_partkey FROM part WHERE p_retailprice >= (SELECT max(l_extendedprice) / 60 FROM lineitem WHERE l_partkey = p_partkey)",
    "cte": "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey) SELECT count(*) AS n, round(max(t), 2) AS m FROM big WHERE t > 500000",
    "recursive_cte": "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t",
    "lateral": "SELECT r_regionkey, x.n_name FROM region, LATERAL (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey ORDER BY n_name LIMIT 2) x",
    "regex_operators": "SELECT p_partkey FROM part WHERE p_brand ~ '[12]$'",
    "case_expressions": "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'low' WHEN c_acctbal < 5000 THEN 'mid' ELSE 'high' END AS band, coalesce(nullif(c_mktsegment, 'BUILDING'), '-') AS seg, greatest(c_nationkey, 5) AS g, least(c_nationkey, 5) AS l FROM customer",
}
#: name: (engine's statement, DuckDB's statement).
PAIRS = {
    "unnest": ("SELECT vec_id, e FROM embeddings, UNNEST(embedding) AS u(e)", "SELECT vec_id, unnest(embedding) AS e FROM embeddings"),
    "unnest_select": ("SELECT event_id, UNNEST(string_to_array(event_type, 'e')) AS part FROM events", "SELECT event_id, unnest(string_split(event_type, 'e')) AS part FROM events"),
    "unnest_position": ("SELECT vec_id, pos, CAST(x AS DOUBLE) AS x FROM embeddings CROSS JOIN UNNEST(embedding) WITH ORDINALITY AS u(x, pos)", "SELECT vec_id, generate_subscripts(embedding, 1) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings"),
    "generate_series": ("SELECT n_nationkey, CAST(i AS BIGINT) AS i FROM nation, generate_series(1, n_nationkey, 7) AS g(i)", "SELECT n_nationkey, i FROM nation, generate_series(1, n_nationkey, 7) g(i)"),
    "range_function": ("SELECT id FROM range(5, 25, 5)", "SELECT range AS id FROM range(5, 25, 5)"),
    "similar_to": ("SELECT p_partkey FROM part WHERE p_brand SIMILAR TO 'Brand#(1|3)_?' AND p_name NOT SIMILAR TO '%(a|e)%'", "SELECT p_partkey FROM part WHERE p_brand SIMILAR TO 'Brand#(1|3).?' AND NOT p_name SIMILAR TO '.*(a|e).*'"),
    "extract_dow": ("SELECT o_orderkey, EXTRACT(dow FROM o_orderdate) AS d, EXTRACT(isodow FROM o_orderdate) AS i FROM orders", "SELECT o_orderkey, CAST(EXTRACT(dow FROM o_orderdate) AS INTEGER) AS d, CAST(EXTRACT(isodow FROM o_orderdate) AS INTEGER) AS i FROM orders"),
    "agg_ordered": ("SELECT o_custkey, first_value(o_orderkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS dear, last_value(o_orderkey ORDER BY o_orderdate, o_orderkey) AS late FROM orders GROUP BY o_custkey", "SELECT o_custkey, first(o_orderkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS dear, last(o_orderkey ORDER BY o_orderdate, o_orderkey) AS late FROM orders GROUP BY o_custkey"),
    "join_merge": ("SELECT /*+ MERGE(orders) */ c_nationkey, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_nationkey", "SELECT c_nationkey, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_nationkey"),
    "repartition": ("SELECT /*+ REPARTITION(7, o_custkey) */ o_custkey, o_orderkey FROM orders", "SELECT o_custkey, o_orderkey FROM orders"),
    "agg_approx_distinct": ("SELECT count(DISTINCT o_custkey) AS n, abs(approx_distinct(o_custkey) - count(DISTINCT o_custkey)) < 0.15 * count(DISTINCT o_custkey) AS near FROM orders", "SELECT count(DISTINCT o_custkey) AS n, abs(approx_count_distinct(o_custkey) - count(DISTINCT o_custkey)) < 0.4 * count(DISTINCT o_custkey) AS near FROM orders"),
    "agg_approx_percentile": ("SELECT median(l_quantity) AS m, abs(approx_percentile_cont(l_quantity, 0.5) - median(l_quantity)) <= 1 AS near, abs(approx_percentile_cont(0.5) WITHIN GROUP (ORDER BY l_quantity) - median(l_quantity)) <= 1 AS close FROM lineitem", "SELECT median(l_quantity) AS m, abs(approx_quantile(l_quantity, 0.5) - median(l_quantity)) <= 2 AS near, abs(approx_quantile(l_quantity, 0.5) - median(l_quantity)) <= 2 AS close FROM lineitem"),
    "agg_weighted_percentile": ("SELECT approx_percentile_cont_with_weight(l_quantity, l_linenumber, 0.5) AS q FROM lineitem", "SELECT quantile_cont(l_quantity, 0.5) AS q FROM lineitem, range(l_linenumber)"),
    "agg_percentile": ("SELECT percentile_cont(0.25) WITHIN GROUP (ORDER BY l_quantity) AS q FROM lineitem", "SELECT quantile_cont(l_quantity, 0.25) AS q FROM lineitem"),
    "agg_string": ("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "agg_array": ("SELECT n_regionkey, array_join(array_sort(array_agg(n_name)), '|') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "wildcard_alias": ("SELECT r_regionkey, * FROM region", "SELECT r_regionkey AS __alias_r_regionkey, r_regionkey, r_name FROM region"),
    "reg_casts": ("SELECT 'pg_class'::regclass AS a, CAST(r_regionkey AS pg_catalog.oid) AS b FROM region", "SELECT 'pg_class' AS a, r_regionkey AS b FROM region"),
    "pg_order_nulls": ("SELECT k FROM (SELECT nullif(n_nationkey, 3) AS k FROM nation) ORDER BY k DESC LIMIT 3", "SELECT k FROM (SELECT nullif(n_nationkey, 3) AS k FROM nation) ORDER BY k DESC NULLS FIRST LIMIT 3"),
    "values_expressions": ("SELECT x + 1 AS y FROM (VALUES (abs(-1)), (abs(-5))) AS t(x)", "SELECT x + 1 AS y FROM (VALUES (1), (5)) AS t(x)"),
    "pg_type": ("SELECT oid, typname, typcategory, typelem FROM pg_catalog.pg_type WHERE oid < 30", "SELECT * FROM (VALUES (CAST(16 AS BIGINT), 'bool', 'B', CAST(0 AS BIGINT)), (17, 'bytea', 'U', 0), (18, 'char', 'Z', 0), (20, 'int8', 'N', 0), (21, 'int2', 'N', 0), (23, 'int4', 'N', 0)) t(oid, typname, typcategory, typelem)"),
    "pg_namespace": ("SELECT oid, nspname FROM public.pg_namespace", "SELECT * FROM (VALUES (CAST(11 AS BIGINT), 'pg_catalog'), (2200, 'public'), (13676, 'information_schema')) t(oid, nspname)"),
    "pg_database": ("SELECT oid, datname, datlastsysoid FROM pg_database", "SELECT CAST(13757 AS BIGINT) AS oid, 'postgres' AS datname, CAST(13756 AS BIGINT) AS datlastsysoid"),
    "pg_empty_tables": ("SELECT (SELECT count(*) FROM pg_catalog.pg_class) AS c, (SELECT count(*) FROM pg_description) AS d", "SELECT CAST(0 AS BIGINT) AS c, CAST(0 AS BIGINT) AS d"),
    "information_schema": ("SELECT table_name FROM information_schema.tables WHERE table_name IN ('pg_type', 'pg_class')", "SELECT * FROM (VALUES ('pg_type'), ('pg_class')) t(table_name)"),
}


def top_k_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three dearest orders of each customer; Catalyst limits groups before the shuffle."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", "o_totalprice")
    return R.top_k(orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey")


def right_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right semi join: orders of customers with a high balance."""
    views(spark, sf_dir, "customer orders")
    return R.join(spark.table("customer").filter("c_acctbal > 9500"), spark.table("orders"), F.expr("c_custkey = o_custkey"), "right_semi").select("o_orderkey")


def right_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "customer orders")
    return R.join(spark.table("orders"), spark.table("customer"), F.expr("c_custkey = o_custkey"), "right_anti").select("c_custkey")


def left_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "customer orders")
    return R.join(spark.table("customer"), spark.table("orders").filter("o_totalprice > 300000"), F.expr("c_custkey = o_custkey"), "left_mark").select("c_custkey", "mark")


def hot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type, counted through salted partial counts."""
    return R.salted_count(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type"), ["event_type"], "n")


def external_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query on files in place: column pruning and filters reach the scan."""
    return spark.sql(f"SELECT o_orderstatus, count(*) AS n FROM parquet.`{sf_dir}/orders.parquet` WHERE o_totalprice > 100000 GROUP BY o_orderstatus")


def prepared_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "nation")
    sql(spark, "PREPARE by_region AS SELECT n_name FROM nation WHERE n_regionkey = $1 AND n_nationkey > $2")
    return sql(spark, "EXECUTE by_region (2, 5)")


def _scratch(spark: SparkSession) -> str:
    """A new folder that executors see: under spark.checkpoint.dir where that is a file system path; on one machine a
    temporary one will do."""
    base = (spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or "").removeprefix("file://")
    if not base.startswith("/") and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return tempfile.mkdtemp(prefix="geostrata-", dir=base if base.startswith("/") and os.path.isdir(base) else None)


def sqlite_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sqlite_scan over a file with the customer table, which is streamed into it; the filter runs in SQLite."""
    path = f"{_scratch(spark)}/customer.sqlite"
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_acctbal")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE customer (c_custkey INTEGER, c_name TEXT, c_acctbal REAL)")
        c.executemany("INSERT INTO customer VALUES (?, ?, ?)", map(tuple, rows.toLocalIterator()))
    return sql(spark, f"SELECT c_custkey, c_name FROM sqlite_scan('{path}', 'customer') WHERE c_acctbal > 1000.5")


def duckdb_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """duckdb_scan over a view of a file's table."""
    import duckdb

    path = f"{_scratch(spark)}/nation.duckdb"
    rows = map(tuple, spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey").toLocalIterator())
    with duckdb.connect(path) as c:
        c.execute("CREATE TABLE nation (n_nationkey BIGINT, n_name VARCHAR, n_regionkey BIGINT)")
        c.executemany("INSERT INTO nation VALUES (?, ?, ?)", rows)
        c.execute("CREATE VIEW named AS SELECT n_regionkey, n_nationkey FROM nation WHERE n_name IS NOT NULL")
    return sql(spark, f"SELECT n_regionkey, count(*) AS n FROM duckdb_scan('{path}', 'main', 'named') WHERE n_nationkey < 20 GROUP BY n_regionkey")


def ddl_dml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE TABLE AS, INSERT and COPY TO, read back."""
    views(spark, sf_dir, "nation region")
    where, name = _scratch(spark), f"geostrata_t_{uuid.uuid4().hex[:12]}"
    sql(spark, f"CREATE TABLE {name} USING parquet LOCATION '{where}/t' AS SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
    sql(spark, f"INSERT INTO {name} SELECT r_regionkey + 100, r_name FROM region")
    sql(spark, f"COPY (SELECT * FROM {name} WHERE n_nationkey > 2) TO '{where}/copy' STORED AS parquet")
    sql(spark, f"DROP TABLE {name}")
    return spark.read.parquet(f"{where}/copy")


def user_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of one's own, by signature, with a default."""
    own = Registry()
    own.add("with_tax(double, double = 0.1D) -> double", lambda price, rate: F.round(price * (1 + rate), 4))
    own.register(spark)
    views(spark, sf_dir, "part")
    return sql(spark, "SELECT p_partkey, with_tax(p_retailprice) AS a, WITH_TAX(p_retailprice, 0.5) AS b, with_tax(NULL) IS NULL AS c FROM part")


CODE = {
    "scan_sqlite": (sqlite_table, "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 1000.5"),
    "scan_duckdb": (duckdb_table, "SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, count(*) AS n FROM nation WHERE n_nationkey < 20 GROUP BY n_regionkey"),
    "ddl_dml": (ddl_dml, "SELECT * FROM (SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1 UNION ALL SELECT r_regionkey + 100, r_name FROM region) WHERE n_nationkey > 2"),
    "user_function": (user_function, "SELECT p_partkey, round(p_retailprice * 1.1, 4) AS a, round(p_retailprice * 1.5, 4) AS b, true AS c FROM part"),
    "top_k_per_group": (top_k_per_group, "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3"),
    "join_right_semi": (right_semi, "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9500)"),
    "join_right_anti": (right_anti, "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
    "join_left_mark": (left_mark, "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) AS mark FROM customer"),
    "salted_count": (hot_counts, "SELECT event_type, count(*) AS n FROM events GROUP BY event_type"),
    "external_table": (external_table, "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderstatus"),
    "prepared_statement": (prepared_statement, "SELECT n_name FROM nation WHERE n_regionkey = 2 AND n_nationkey > 5"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: query(t) for n, t in SAME.items()} | {n: query(a) for n, (a, _) in PAIRS.items()} | {n: f for n, (f, _) in CODE.items()}


def oracle_sql() -> dict[str, str]:
    own = {n: t.replace(" ~ ", " SIMILAR TO ").replace("'[12]$'", "'.*[12]'") for n, t in SAME.items()}
    return own | {n: b for n, (_, b) in PAIRS.items()} | {n: b for n, (_, b) in CODE.items()}
