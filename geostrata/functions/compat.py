"""Scalar functions whose names or semantics differ from Spark's, as SQL functions and, where the argument types are
open (arrays, maps), as functions of Columns and as a renaming map for SQL text (see plans.sql)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geostrata.functions.registry import Registry

COMPAT = Registry()
_add = COMPAT.add

# mathematics
_add("gcd(bigint, bigint) -> bigint", "aggregate(sequence(1, 93), named_struct('x', abs(a), 'y', abs(b)), (s, i) -> CASE WHEN s.y = 0 THEN s ELSE named_struct('x', s.y, 'y', s.x % s.y) END, s -> s.x)")
_add("lcm(bigint, bigint) -> bigint", "CASE WHEN a = 0 OR b = 0 THEN 0 ELSE abs(a) DIV aggregate(sequence(1, 93), named_struct('x', abs(a), 'y', abs(b)), (s, i) -> CASE WHEN s.y = 0 THEN s ELSE named_struct('x', s.y, 'y', s.x % s.y) END, s -> s.x) * abs(b) END")
_add("iszero(double) -> boolean", "a = 0")
# a product within two units of an integer is that integer: 0.29 * 100 is not 28
_add("truncate(double, bigint = 0) -> double", "CASE WHEN abs(a) >= 4503599627370496D OR isnan(a) THEN a WHEN abs(a * pow(10, coalesce(b, 0)) - rint(a * pow(10, coalesce(b, 0)))) <= abs(a * pow(10, coalesce(b, 0))) * 4.5E-16D THEN rint(a * pow(10, coalesce(b, 0))) / pow(10, coalesce(b, 0)) ELSE sign(a) * floor(abs(a) * pow(10, coalesce(b, 0))) / pow(10, coalesce(b, 0)) END")
_add("log_base(double, double) -> double", "ln(b) / ln(a)")
# strings
_add("to_hex(bigint) -> string", "lower(hex(a))")
_add("starts_with(string, string) -> boolean", "startswith(a, b)")
_add("ends_with(string, string) -> boolean", "endswith(a, b)")
_add("strpos(string, string) -> int", "locate(b, a)")
_add("pg_initcap(string) -> string", "array_join(transform(regexp_extract_all(lower(a), '[\\\\p{L}\\\\p{N}]+|[^\\\\p{L}\\\\p{N}]+', 0), x -> concat(upper(substr(x, 1, 1)), substr(x, 2))), '')")
_add("pg_left(string, bigint) -> string", "CASE WHEN b >= 0 THEN left(a, CAST(b AS INT)) ELSE left(a, greatest(CAST(length(a) + b AS INT), 0)) END")
_add("pg_right(string, bigint) -> string", "CASE WHEN b >= 0 THEN right(a, CAST(b AS INT)) ELSE right(a, greatest(CAST(length(a) + b AS INT), 0)) END")
_add("pg_encode(binary, string) -> string", "CASE lower(b) WHEN 'hex' THEN lower(hex(a)) WHEN 'base64' THEN regexp_replace(base64(a), '=+$', '') END")
_add("pg_decode(string, string) -> binary", "CASE lower(b) WHEN 'hex' THEN unhex(a) WHEN 'base64' THEN unbase64(a) END")
_add("digest(binary, string) -> binary", "CASE lower(b) WHEN 'md5' THEN unhex(md5(a)) WHEN 'sha224' THEN unhex(sha2(a, 224)) WHEN 'sha256' THEN unhex(sha2(a, 256)) WHEN 'sha384' THEN unhex(sha2(a, 384)) WHEN 'sha512' THEN unhex(sha2(a, 512)) END")
for _bits in (224, 256, 384, 512):
    _add(f"sha{_bits}(binary) -> binary", f"unhex(sha2(a, {_bits}))")
_add("string_to_array(string, string, string = NULL) -> list<string>", "transform(split(a, concat('\\\\Q', b, '\\\\E')), x -> CASE WHEN x = c THEN NULL ELSE x END)")


def similar_pattern(pattern: Column) -> Column:
    """A SIMILAR TO pattern as a regular expression of the whole text: % and _ are wildcards, | * + ? { } ( ) [ ] work as in
    regular expressions, a backslash takes a character's meaning away, and all else stands for itself."""
    plain = F.regexp_replace(pattern, r"(?<!\\)((?<!\[)\^|[.$])", r"\\$1")
    wild = F.regexp_replace(F.regexp_replace(plain, r"(?<!\\)%", ".*"), r"(?<!\\)_", ".")
    return F.concat(F.lit("(?s)\\A(?:"), wild, F.lit(")\\z"))


_add("pg_similar(string) -> string", similar_pattern)
_add("similar_to(string, string) -> boolean", lambda a, b: F.regexp_like(a, similar_pattern(b)))
_add("ilike(string, string) -> boolean", "lower(a) LIKE lower(b)")
# regular expressions
# the groups of the first match, or the match itself where the pattern has none; a group that took no part is empty
_WHOLE = "concat(CASE WHEN contains(coalesce(c, ''), 'i') THEN '(?i)' ELSE '' END, '(', b, ')')"
_GROUPS = r"size(regexp_extract_all(regexp_replace(b, r'\\.|\[\^?\]?[^\]]*\]', ''), r'\((?!\?)|\(\?<[A-Za-z]', 0))"
_add("regexp_match(string, string, string = '') -> list<string>", f"CASE WHEN a RLIKE {_WHOLE} THEN transform(sequence(least({_GROUPS}, 1), {_GROUPS}), i -> regexp_extract(a, {_WHOLE}, i + 1)) END")
_add("pg_regexp_replace(string, string, string, string = '') -> string", "CASE WHEN contains(coalesce(d, ''), 'g') THEN regexp_replace(a, concat(CASE WHEN contains(d, 'i') THEN '(?i)' ELSE '' END, b), c) ELSE regexp_replace(a, concat(CASE WHEN contains(coalesce(d, ''), 'i') THEN '(?is)' ELSE '(?s)' END, '^(.*?)', '(?:', b, ')'), concat('$1', c)) END")
# dates and times


def date_bin() -> str:
    """The start of the bin that holds a time; bins of months keep the origin's day and time. A stride of months and days
    together, and one of nothing, raise an error."""
    unit = lambda u: f"extract({u} FROM CAST(a AS INTERVAL))"
    months = f"({unit('YEAR')} * 12 + {unit('MONTH')})"
    micros = f"({unit('DAY')} * 86400000000 + {unit('HOUR')} * 3600000000 + {unit('MINUTE')} * 60000000 + CAST({unit('SECOND')} * 1000000 AS BIGINT))"
    apart = "((year(b) - year(c)) * 12 + month(b) - month(c))"
    apart = f"({apart} - CASE WHEN c + make_ym_interval(0, {apart}) > b THEN 1 ELSE 0 END)"
    by_month = f"c + make_ym_interval(0, CAST(floor({apart} / {months}) * {months} AS INT))"
    by_time = f"timestamp_micros(unix_micros(c) + CAST(floor((unix_micros(b) - unix_micros(c)) / {micros}) AS BIGINT) * {micros})"
    wrong = "CAST(raise_error(concat('date_bin: stride ', a)) AS TIMESTAMP)"
    return f"CASE WHEN {months} > 0 AND {micros} = 0 THEN {by_month} WHEN {months} = 0 AND {micros} > 0 THEN {by_time} ELSE {wrong} END"


_add("date_bin(string, timestamp, timestamp = TIMESTAMP'1970-01-01 00:00:00') -> timestamp", "CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN " + date_bin() + " END")
_add("pg_date_part(string, timestamp) -> double", "CASE lower(a) WHEN 'dow' THEN dayofweek(b) - 1 WHEN 'isodow' THEN weekday(b) + 1 WHEN 'doy' THEN dayofyear(b) WHEN 'year' THEN year(b) WHEN 'quarter' THEN quarter(b) WHEN 'month' THEN month(b) WHEN 'week' THEN weekofyear(b) WHEN 'day' THEN day(b) WHEN 'hour' THEN hour(b) WHEN 'minute' THEN minute(b) WHEN 'second' THEN CAST(unix_micros(b) % 60000000 AS DOUBLE) / 1000000 WHEN 'epoch' THEN CAST(unix_micros(b) AS DOUBLE) / 1000000 END")
_add("to_timestamp_seconds(bigint) -> timestamp", "timestamp_seconds(a)")
_add("to_timestamp_millis(bigint) -> timestamp", "timestamp_millis(a)")
_add("to_timestamp_micros(bigint) -> timestamp", "timestamp_micros(a)")
_add("to_timestamp_nanos(bigint) -> timestamp", "timestamp_micros(a DIV 1000)")
_add("to_unixtime(timestamp) -> bigint", "unix_timestamp(a)")
_add("to_local_time(timestamp) -> string", "date_format(a, 'yyyy-MM-dd HH:mm:ss')")

# Arrow's names of types and Spark's.
ARROW_TYPES = {
    "boolean": "BOOLEAN", "int8": "TINYINT", "int16": "SMALLINT", "int32": "INT", "int64": "BIGINT", "uint8": "SMALLINT", "uint16": "INT", "uint32": "BIGINT", "uint64": "DECIMAL(20, 0)", "float16": "FLOAT", "float32": "FLOAT", "float64": "DOUBLE",
    "utf8": "STRING", "largeutf8": "STRING", "utf8view": "STRING", "binary": "BINARY", "largebinary": "BINARY", "binaryview": "BINARY", "date32": "DATE", "date64": "DATE",
    "timestamp(second,none)": "TIMESTAMP_NTZ", "timestamp(millisecond,none)": "TIMESTAMP_NTZ", "timestamp(microsecond,none)": "TIMESTAMP_NTZ", "timestamp(nanosecond,none)": "TIMESTAMP_NTZ",
}

#: Names in SQL text that Spark spells otherwise; arguments are the same.
RENAMED = {
    "approx_distinct": "approx_count_distinct", "approx_median": "median", "approx_percentile_cont": "approx_percentile", "var": "var_samp", "random": "rand", "array_has": "array_contains", "list_contains": "array_contains",
    "list_has": "array_contains", "list_append": "array_append", "list_prepend": "array_prepend", "list_concat": "concat", "array_cat": "concat", "array_concat": "concat", "array_has_any": "arrays_overlap", "list_has_any": "arrays_overlap",
    "array_length": "cardinality", "list_length": "cardinality", "make_array": "array", "make_list": "array", "list_distinct": "array_distinct", "list_sort": "array_sort", "array_reverse": "reverse",
    "list_reverse": "reverse", "array_intersect_all": "array_intersect", "array_indexof": "array_position", "list_position": "array_position", "array_remove_all": "array_remove", "array_to_string": "array_join", "list_to_string": "array_join",
    "list_union": "array_union", "list_except": "array_except", "list_intersect": "array_intersect", "arrow_typeof": "typeof", "row": "struct", "stddev": "stddev_samp", "covar": "covar_samp", "make_map": "map_from_arrays",
}


_PLACE = "CASE WHEN {1} < 0 THEN size({0}) + {1} + 1 ELSE {1} END"
_HITS = "filter(transform({0}, (x, i) -> CASE WHEN x <=> {1} THEN i + 1 END), x -> x IS NOT NULL)"
_SOME = "slice(" + _HITS + ", 1, {n})"
#: Calls in SQL text that become expressions, by number of arguments: {0}, {1} ... are the arguments, {*} all of them.
MACROS = {
    ("concat", None): "concat_ws('', {*})",
    ("array_element", 2): "CASE WHEN {1} <> 0 THEN try_element_at({0}, CAST({1} AS INT)) END",
    ("array_slice", 3): "slice({0}, greatest(" + _PLACE + ", 1), greatest(least(" + _PLACE.replace("{1}", "{2}") + ", size({0})) - greatest(" + _PLACE + ", 1) + 1, 0))",
    ("array_has_all", 2): "size(array_except({1}, {0})) = 0",
    ("list_has_all", 2): "size(array_except({1}, {0})) = 0",
    ("array_positions", 2): _HITS,
    ("list_positions", 2): _HITS,
    ("array_remove_n", 3): "transform(filter(transform({0}, (x, i) -> struct(x AS x, i + 1 AS i)), s -> NOT array_contains(" + _SOME.replace("{n}", "{2}") + ", s.i)), s -> s.x)",
    ("array_replace", 3): "transform({0}, (x, i) -> CASE WHEN array_contains(" + _SOME.replace("{n}", "1") + ", i + 1) THEN {2} ELSE x END)",
    ("array_replace_n", 4): "transform({0}, (x, i) -> CASE WHEN array_contains(" + _SOME.replace("{n}", "{3}") + ", i + 1) THEN {2} ELSE x END)",
    ("array_replace_all", 3): "transform({0}, x -> CASE WHEN x <=> {1} THEN {2} ELSE x END)",
    ("array_pop_back", 1): "slice({0}, 1, greatest(size({0}) - 1, 0))",
    ("array_pop_front", 1): "slice({0}, 2, greatest(size({0}) - 1, 0))",
    ("array_resize", 3): "slice(concat({0}, array_repeat({2}, greatest({1} - size({0}), 0))), 1, {1})",
    ("array_dims", 1): "array(size({0}))",
    ("array_empty", 1): "size({0}) = 0",
    ("empty", 1): "size({0}) = 0",
    ("map_extract", 2): "filter(array(try_element_at({0}, {1})), x -> x IS NOT NULL)",
    ("get_field", 2): "{0}[{1}]",
    ("array_agg", 1): "transform(collect_list(struct({0} AS v)), s -> s.v)",
    ("date_part", 2): "pg_date_part({0}, {1})",
    ("initcap", 1): "pg_initcap({0})",
    ("left", 2): "pg_left({0}, {1})",
    ("right", 2): "pg_right({0}, {1})",
    ("encode", 2): "pg_encode(CAST({0} AS BINARY), {1})",
    ("decode", 2): "pg_decode({0}, {1})",
    ("regexp_replace", 3): "pg_regexp_replace({0}, {1}, {2})",
    ("regexp_replace", 4): "pg_regexp_replace({0}, {1}, {2}, {3})",
    ("trunc", 1): "truncate({0})",
    ("trunc", 2): "truncate({0}, {1})",
    ("log", 1): "log10({0})",
    ("array_slice", 4): "transform(filter(transform(slice({0}, greatest(" + _PLACE + ", 1), greatest(least(" + _PLACE.replace("{1}", "{2}") + ", size({0})) - greatest(" + _PLACE + ", 1) + 1, 0)), (x, i) -> struct(x AS x, i AS i)), s -> s.i % {3} = 0), s -> s.x)",
    ("string_to_array", 2): "split({0}, concat('\\\\Q', {1}, '\\\\E'))",
    ("array_any_value", 1): "try_element_at(filter({0}, x -> x IS NOT NULL), 1)",
    ("list_any_value", 1): "try_element_at(filter({0}, x -> x IS NOT NULL), 1)",
    ("array_upper", 2): "CASE WHEN {1} < 1 THEN NULL WHEN {1} = 1 THEN CAST(size({0}) AS BIGINT) WHEN {1} > 1 THEN CAST(raise_error('array_upper: only dimension 1') AS BIGINT) END",
    ("generate_series", 2): "CASE WHEN {0} <= {1} THEN sequence({0}, {1}) ELSE slice(array({0}), 1, 0) END",
    ("__range", 1): "CASE WHEN {0} > 0 THEN sequence(0, {0} - 1) ELSE slice(array({0}), 1, 0) END",
    ("__range", 2): "CASE WHEN {0} < {1} THEN sequence({0}, {1} - 1) ELSE slice(array({0}), 1, 0) END",
    ("__range", 3): "filter(CASE WHEN ({1} - {0}) * {2} > 0 THEN sequence({0}, {1}, {2}) ELSE slice(array({0}), 1, 0) END, x -> x <> {1})",
    ("approx_percentile_cont_with_weight", 3): "percentile({0}, {2}, CAST({1} AS BIGINT))",
}


# functions of Columns for open types


def concat(*cols: Column) -> Column:
    """Concatenation that skips NULLs (Spark's concat gives NULL)."""
    return F.concat_ws("", *cols)


def array_agg(col: Column) -> Column:
    """array_agg that keeps NULLs."""
    return F.transform(F.collect_list(F.struct(col.alias("v"))), lambda x: x["v"])


def array_has_all(a: Column, b: Column) -> Column:
    return F.size(F.array_except(b, a)) == 0


def array_positions(a: Column, v: Column) -> Column:
    """All 1-based places of a value."""
    return F.filter(F.transform(a, lambda x, i: F.when(x.eqNullSafe(v), i + 1)), lambda x: x.isNotNull())


def array_remove_n(a: Column, v: Column, n: int | Column) -> Column:
    """Without the first n occurrences of a value."""
    at = F.slice(array_positions(a, v), F.lit(1), F.lit(n) if isinstance(n, int) else n)
    kept = F.filter(F.transform(a, lambda x, i: F.struct(x.alias("x"), (i + 1).alias("i"))), lambda s: ~F.array_contains(at, s["i"]))
    return F.transform(kept, lambda s: s["x"])


def array_replace_n(a: Column, old: Column, new: Column, n: int | Column) -> Column:
    """With the first n occurrences of a value replaced."""
    at = F.slice(array_positions(a, old), F.lit(1), F.lit(n) if isinstance(n, int) else n)
    return F.transform(a, lambda x, i: F.when(F.array_contains(at, i + 1), new).otherwise(x))


def array_replace(a: Column, old: Column, new: Column) -> Column:
    return array_replace_n(a, old, new, 1)


def array_replace_all(a: Column, old: Column, new: Column) -> Column:
    return F.transform(a, lambda x: F.when(x.eqNullSafe(old), new).otherwise(x))


def array_pop_back(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a)


def array_pop_front(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.slice(a, F.lit(2), F.size(a))).otherwise(a)


def array_resize(a: Column, n: Column, fill: Column) -> Column:
    return F.slice(F.concat(a, F.array_repeat(fill, F.greatest(n - F.size(a), F.lit(0)).cast("int"))), F.lit(1), n.cast("int"))


def array_slice(a: Column, first: Column, last: Column, step: int = 1) -> Column:
    """Places first to last, both included; negative places count from the end."""
    size = F.size(a)
    place = lambda p: F.when(p < 0, size + p + 1).otherwise(p)
    low, high = F.greatest(place(first), F.lit(1)), F.least(place(last), size)
    cut = F.when(high >= low, F.slice(a, low.cast("int"), (high - low + 1).cast("int"))).otherwise(F.slice(a, F.lit(1), F.lit(0)))
    if step == 1:
        return cut
    kept = F.filter(F.transform(cut, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: s["i"] % abs(step) == 0)
    return F.transform(kept if step > 0 else F.reverse(kept), lambda s: s["x"])


def array_element(a: Column, i: Column) -> Column:
    """1-based, negative from the end, NULL outside."""
    return F.when((i != 0) & (F.abs(i) <= F.size(a)), F.try_element_at(a, i.cast("int")))


def array_dims(a: Column) -> Column:
    return F.array(F.size(a))


def map_extract(m: Column, key: Column) -> Column:
    """A list of the value of a key, empty where there is none."""
    return F.filter(F.array(F.try_element_at(m, key)), lambda x: x.isNotNull())


def date_part_dow(ts: Column) -> Column:
    """Day of the week, Sunday 0."""
    return F.dayofweek(ts) - 1
