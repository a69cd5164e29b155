"""Scalar functions by family."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.functions import compat as C
from geostrata.queries.base import query

PAIRS = {
    "fn_math": (
        "SELECT p_partkey, round(sqrt(p_size), 6) AS a, round(ln(p_size), 6) AS b, round(exp(p_size / 50), 6) AS c, round(pow(p_size, 2), 2) AS d, round(atan2(p_size, 3), 6) AS e, abs(p_size - 25) AS f, floor(p_retailprice) AS g, ceil(p_retailprice) AS h, sign(p_size - 25) AS i, round(cbrt(p_size), 6) AS j, round(degrees(p_size), 6) AS k, round(log10(p_size), 6) AS l, p_size % 7 AS m, factorial(p_size % 10) AS n FROM part",
        "SELECT p_partkey, round(sqrt(p_size), 6) AS a, round(ln(p_size), 6) AS b, round(exp(p_size / 50), 6) AS c, round(pow(p_size, 2), 2) AS d, round(atan2(p_size, 3), 6) AS e, abs(p_size - 25) AS f, CAST(floor(p_retailprice) AS BIGINT) AS g, CAST(ceil(p_retailprice) AS BIGINT) AS h, CAST(sign(p_size - 25) AS DOUBLE) AS i, round(cbrt(p_size), 6) AS j, round(degrees(p_size), 6) AS k, round(log10(p_size), 6) AS l, p_size % 7 AS m, CAST(factorial(p_size % 10) AS BIGINT) AS n FROM part",
    ),
    "fn_gcd_lcm": ("SELECT p_partkey, gcd(p_partkey, p_size) AS g, lcm(p_partkey, p_size) AS l, iszero(p_size % 5) AS z, trunc(p_retailprice, 1) AS t, to_hex(p_partkey) AS h FROM part", "SELECT p_partkey, gcd(p_partkey, p_size) AS g, lcm(p_partkey, p_size) AS l, p_size % 5 = 0 AS z, trunc(p_retailprice * 10) / 10 AS t, lower(to_hex(p_partkey)) AS h FROM part"),
    "fn_string": (
        "SELECT p_partkey, upper(p_name) AS a, length(p_name) AS b, substr(p_name, 2, 4) AS c, replace(p_name, 'a', '#') AS d, reverse(p_brand) AS e, lpad(p_brand, 12, '*') AS f, split_part(p_name, ' ', 1) AS g, strpos(p_name, 'e') AS h, repeat(p_brand, 2) AS i, translate(p_brand, 'Bd', 'xy') AS j, ascii(p_name) AS k, concat_ws('-', p_brand, p_name) AS l, starts_with(p_name, 'p') AS m, ends_with(p_name, 'e') AS n, left(p_name, 3) AS o, right(p_name, -2) AS p, levenshtein(p_brand, 'Brand#11') AS q, trim('#' FROM p_brand) AS r FROM part",
        "SELECT p_partkey, upper(p_name) AS a, CAST(length(p_name) AS INTEGER) AS b, substr(p_name, 2, 4) AS c, replace(p_name, 'a', '#') AS d, reverse(p_brand) AS e, lpad(p_brand, 12, '*') AS f, split_part(p_name, ' ', 1) AS g, CAST(strpos(p_name, 'e') AS INTEGER) AS h, repeat(p_brand, 2) AS i, translate(p_brand, 'Bd', 'xy') AS j, ascii(p_name) AS k, concat_ws('-', p_brand, p_name) AS l, starts_with(p_name, 'p') AS m, ends_with(p_name, 'e') AS n, left(p_name, 3) AS o, right(p_name, greatest(length(p_name) - 2, 0)) AS p, CAST(levenshtein(p_brand, 'Brand#11') AS INTEGER) AS q, trim(p_brand, '#') AS r FROM part",
    ),
    "fn_regex": ("SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '', 'g') AS a, regexp_like(p_name, '^[a-m]') AS b, regexp_match(p_brand, '([0-9]+)')[0] AS c, regexp_replace(p_name, '[aeiou]', '') AS d, regexp_count(p_name, 'e') AS e, similar_to(p_brand, 'Brand#_%') AS f FROM part", "SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '', 'g') AS a, regexp_matches(p_name, '^[a-m]') AS b, regexp_extract(p_brand, '([0-9]+)', 1) AS c, regexp_replace(p_name, '[aeiou]', '') AS d, CAST(len(regexp_extract_all(p_name, 'e')) AS INTEGER) AS e, p_brand SIMILAR TO 'Brand#.+' AS f FROM part"),
    "fn_hash": ("SELECT p_partkey, md5(p_name) AS a, sha2(p_name, 256) AS b, encode(p_brand, 'hex') AS c, base64(CAST(p_brand AS BINARY)) AS d, lower(hex(digest(CAST(p_name AS BINARY), 'sha256'))) AS e FROM part", "SELECT p_partkey, md5(p_name) AS a, sha256(p_name) AS b, lower(hex(p_brand)) AS c, to_base64(encode(p_brand)) AS d, sha256(p_name) AS e FROM part"),
    "fn_dates": (
        "SELECT o_orderkey, year(o_orderdate) AS a, month(o_orderdate) AS b, CAST(date_part('dow', o_orderdate) AS INT) AS c, dayofyear(o_orderdate) AS d, date_format(date_trunc('month', o_orderdate), 'yyyy-MM-dd') AS e, date_format(date_bin('7 days', o_orderdate), 'yyyy-MM-dd') AS f, datediff(o_orderdate, DATE'1995-01-01') AS g, date_format(o_orderdate, 'yyyy/MM/dd') AS h, CAST(make_date(year(o_orderdate), 1, 31) AS STRING) AS i, to_unixtime(o_orderdate) AS j, extract(quarter FROM o_orderdate) AS k FROM orders",
        "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS a, CAST(month(o_orderdate) AS INTEGER) AS b, CAST(dayofweek(o_orderdate) AS INTEGER) AS c, CAST(dayofyear(o_orderdate) AS INTEGER) AS d, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS e, strftime(time_bucket(INTERVAL 7 DAY, o_orderdate, TIMESTAMP '1970-01-01'), '%Y-%m-%d') AS f, CAST(date_diff('day', DATE '1995-01-01', o_orderdate) AS INTEGER) AS g, strftime(o_orderdate, '%Y/%m/%d') AS h, CAST(make_date(year(o_orderdate), 1, 31) AS VARCHAR) AS i, CAST(epoch(o_orderdate) AS BIGINT) AS j, CAST(quarter(o_orderdate) AS INTEGER) AS k FROM orders",
    ),
    "fn_timestamps": ("SELECT event_id, CAST(to_timestamp_millis(event_id * 1700000123) AS STRING) AS a, CAST(to_timestamp_seconds(event_id * 100000) AS STRING) AS b, CAST(to_timestamp_micros(event_id * 1700000000123) AS STRING) AS c, unix_micros(to_timestamp_nanos(event_id * 1000003)) AS d FROM events", "SELECT event_id, CAST(make_timestamp(event_id * 1700000123000) AS VARCHAR) AS a, CAST(make_timestamp(event_id * 100000000000) AS VARCHAR) AS b, CAST(make_timestamp(event_id * 1700000000123) AS VARCHAR) AS c, event_id * 1000003 // 1000 AS d FROM events"),
    "fn_conditional": ("SELECT c_custkey, nvl(nullif(c_nationkey, 3), -1) AS a, nvl2(nullif(c_nationkey, 3), 'x', 'y') AS b, ifnull(nullif(c_mktsegment, 'BUILDING'), 'none') AS c FROM customer", "SELECT c_custkey, coalesce(nullif(c_nationkey, 3), -1) AS a, CASE WHEN c_nationkey <> 3 THEN 'x' ELSE 'y' END AS b, ifnull(nullif(c_mktsegment, 'BUILDING'), 'none') AS c FROM customer"),
    "fn_arrays": (
        "SELECT p_partkey, array_length(make_array(p_size, 1, 2)) AS a, array_has(make_array(1, 2, 3), p_size) AS b, array_to_string(list_sort(make_array(p_size, 7, 3)), ',') AS c, array_max(make_array(p_size, 9)) AS d, array_position(make_array(4, p_size), p_size) AS e, array_to_string(array_distinct(make_array(p_size, p_size, 1)), '|') AS f, list_has_any(make_array(1, 2), make_array(p_size)) AS g, array_to_string(string_to_array(p_name, ' '), '+') AS h FROM part",
        "SELECT p_partkey, 3 AS a, list_contains([1, 2, 3], p_size) AS b, array_to_string(list_sort([p_size, 7, 3]), ',') AS c, greatest(p_size, 9) AS d, CASE WHEN p_size = 4 THEN CAST(1 AS BIGINT) ELSE 2 END AS e, CASE WHEN p_size = 1 THEN '1' ELSE p_size || '|1' END AS f, p_size IN (1, 2) AS g, replace(p_name, ' ', '+') AS h FROM part",
    ),
    "fn_array_calls": (
        "SELECT p_partkey, array_join(array_positions(a, 1), ',') AS b, array_join(array_remove_n(a, 1, 1), ',') AS c, array_join(array_replace(a, 1, 9), ',') AS d, array_join(array_replace_all(a, 1, 9), ',') AS e, array_join(array_slice(a, 2, -2), ',') AS f, array_has_all(a, make_array(2, p_size)) AS g, array_element(a, -1) AS h, array_element(a, 77) AS i, concat('a', NULL, p_size) AS j, array_join(array_resize(a, 7, 0), ',') AS k, array_join(array_pop_back(a), ',') AS l, initcap(p_name) AS m, left(p_name, -2) AS n, size(map_extract(map('k', p_size), 'z')) AS o FROM (SELECT p_partkey, p_size, p_name, make_array(p_size, 1, 2, 1, 3) AS a FROM part)",
        """SELECT p_partkey, array_to_string(list_filter(list_transform(a, lambda x, i: CASE WHEN x = 1 THEN i END), lambda x: x IS NOT NULL), ',') AS b,
            array_to_string(list_filter(list_transform(a, lambda x, i: CASE WHEN i <> list_position(a, 1) THEN x END), lambda x: x IS NOT NULL), ',') AS c, array_to_string(list_transform(a, lambda x, i: CASE WHEN i = list_position(a, 1) THEN 9 ELSE x END), ',') AS d,
            array_to_string(list_transform(a, lambda x: CASE WHEN x = 1 THEN 9 ELSE x END), ',') AS e, array_to_string(a[2:4], ',') AS f, list_has_all(a, [2, p_size]) AS g, a[-1] AS h, a[77] AS i, concat('a', NULL, p_size) AS j, array_to_string(list_resize(a, 7, 0), ',') AS k,
            array_to_string(a[1:4], ',') AS l, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS m, p_name[1:-3] AS n, 0 AS o FROM (SELECT p_partkey, p_size, p_name, [p_size, 1, 2, 1, 3] AS a FROM part)""",
    ),
    "fn_maps_structs": ("SELECT p_partkey, map('a', p_size, 'b', 2)['a'] AS a, cardinality(map_keys(map('a', 1, 'b', 2))) AS b, named_struct('x', p_size, 'y', p_brand).y AS c, element_at(map_values(map('k', p_size)), 1) AS d FROM part", "SELECT p_partkey, p_size AS a, 2 AS b, p_brand AS c, p_size AS d FROM part"),
    "fn_typeof": ("SELECT p_partkey, arrow_typeof(p_size) AS a, arrow_typeof(p_name) AS b, arrow_cast(p_size, 'Utf8') AS c, arrow_cast(p_retailprice, 'Int64') AS d FROM part", "SELECT p_partkey, replace(lower(typeof(p_size)), 'integer', 'int') AS a, replace(lower(typeof(p_name)), 'varchar', 'string') AS b, CAST(p_size AS VARCHAR) AS c, CAST(trunc(p_retailprice) AS BIGINT) AS d FROM part"),
    "fn_trunc": ("SELECT p_partkey, trunc(p_size / 100, 2) AS a, trunc(p_retailprice, 1) AS b, trunc(-p_retailprice) AS c FROM part", "SELECT p_partkey, p_size / 100 AS a, CAST(trunc(CAST(p_retailprice AS DECIMAL(18, 4)) * 10) AS DOUBLE) / 10 AS b, -CAST(trunc(p_retailprice) AS DOUBLE) AS c FROM part"),
    "fn_regexp_match": ("SELECT p_partkey, array_join(regexp_match(p_brand, '([A-Za-z]+)#([0-9]+)'), '/') AS a, array_join(regexp_match(p_name, '[aeiou]+'), '') AS b FROM part", "SELECT p_partkey, CASE WHEN regexp_matches(p_brand, '([A-Za-z]+)#([0-9]+)') THEN regexp_extract(p_brand, '([A-Za-z]+)#([0-9]+)', 1) || '/' || regexp_extract(p_brand, '([A-Za-z]+)#([0-9]+)', 2) END AS a, CASE WHEN regexp_matches(p_name, '[aeiou]+') THEN regexp_extract(p_name, '[aeiou]+') END AS b FROM part"),
    "fn_date_bin_months": ("SELECT o_orderkey, date_format(date_bin('3 months', o_orderdate), 'yyyy-MM-dd') AS a, date_format(date_bin('1 year', o_orderdate, TIMESTAMP'1990-04-01 00:00:00'), 'yyyy-MM-dd') AS b FROM orders", "SELECT o_orderkey, strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS a, strftime(date_trunc('year', o_orderdate - INTERVAL 3 MONTH) + INTERVAL 3 MONTH, '%Y-%m-%d') AS b FROM orders"),
    "fn_to_char": ("SELECT o_orderkey, to_char(o_orderdate, '%d.%m.%Y %H:%M') AS a, to_timestamp(to_char(o_orderdate, '%Y-%m-%d'), '%Y-%m-%d') = date_trunc('day', o_orderdate) AS b FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y %H:%M') AS a, strptime(strftime(o_orderdate, '%Y-%m-%d'), '%Y-%m-%d') = date_trunc('day', o_orderdate) AS b FROM orders"),
    "fn_list_calls": ("SELECT p_partkey, array_to_string(range(0, p_size), ',') AS a, array_to_string(generate_series(p_size, p_size + 2), ',') AS b, array_any_value(make_array(nullif(p_size, p_size), p_size)) AS c, array_to_string(array_slice(make_array(p_size, 2, 3, 4, 5), 1, 5, 2), ',') AS d, array_upper(make_array(p_size, 1), 1) AS e FROM part", "SELECT p_partkey, coalesce(array_to_string(range(0, p_size), ','), '') AS a, array_to_string(generate_series(p_size, p_size + 2), ',') AS b, list_any_value([nullif(p_size, p_size), p_size]) AS c, array_to_string([p_size, 2, 3, 4, 5][1:5:2], ',') AS d, len([p_size, 1]) AS e FROM part"),
    "fn_postgres": (
        "SELECT current_schema() AS a, array_join(current_schemas(true), ',') AS b, format_type(1043, 36) AS c, format_type(1114, NULL) AS d, format_type(424242, 1) AS e, format_type(1186, 2) AS f, array_upper(array('a', 'b', 'c'), 1) AS g, pg_catalog.pg_get_expr('x', 1) AS h, pg_catalog.pg_get_partkeydef('1') AS i, version() LIKE 'PostgreSQL 14.10 on %' AS j",
        "SELECT 'public' AS a, 'pg_catalog,public' AS b, 'character varying(32)' AS c, 'timestamp without time zone' AS d, '???' AS e, '-' AS f, CAST(3 AS BIGINT) AS g, '' AS h, '' AS i, true AS j",
    ),
    "fn_json": ("SELECT event_id, get_json_object(props, '$.k') AS k FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events"),
}


def array_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Array functions of open element types, as functions of Columns."""
    a = F.array(F.col("p_size"), F.lit(1), F.lit(2), F.lit(1), F.lit(3))
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(
        "p_partkey", text(C.array_positions(a, F.lit(1))).alias("positions"), text(C.array_remove_n(a, F.lit(1), 1)).alias("removed"), text(C.array_replace(a, F.lit(1), F.lit(9))).alias("replaced"),
        text(C.array_replace_all(a, F.lit(1), F.lit(9))).alias("replaced_all"), text(C.array_pop_back(a)).alias("popped"), text(C.array_pop_front(a)).alias("shifted"), text(C.array_resize(a, F.lit(7), F.lit(0))).alias("resized"),
        text(C.array_slice(a, F.lit(2), F.lit(-2))).alias("sliced"), C.array_has_all(a, F.array(F.lit(2), F.lit(3))).alias("has_all"), C.array_element(a, F.lit(-1)).alias("last"), C.concat(F.lit("a"), F.lit(None).cast("string"), F.lit("b")).alias("joined"),
    )


ARRAY_SQL = """SELECT p_partkey, array_to_string(list_filter(list_transform(a, lambda x, i: CASE WHEN x = 1 THEN i END), lambda x: x IS NOT NULL), ',') AS positions,
    array_to_string(list_filter(list_transform(a, lambda x, i: CASE WHEN i <> list_position(a, 1) THEN x END), lambda x: x IS NOT NULL), ',') AS removed, array_to_string(list_transform(a, lambda x, i: CASE WHEN i = list_position(a, 1) THEN 9 ELSE x END), ',') AS replaced,
    array_to_string(list_transform(a, lambda x: CASE WHEN x = 1 THEN 9 ELSE x END), ',') AS replaced_all, array_to_string(a[1:4], ',') AS popped, array_to_string(a[2:], ',') AS shifted, array_to_string(list_resize(a, 7, 0), ',') AS resized,
    array_to_string(a[2:4], ',') AS sliced, list_has_all(a, [2, 3]) AS has_all, a[-1] AS last, concat('a', NULL, 'b') AS joined FROM (SELECT p_partkey, [p_size, 1, 2, 1, 3] AS a FROM part)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: query(a) for n, (a, _) in PAIRS.items()} | {"fn_array_columns": array_columns}


def oracle_sql() -> dict[str, str]:
    return {n: b for n, (_, b) in PAIRS.items()} | {"fn_array_columns": ARRAY_SQL}
