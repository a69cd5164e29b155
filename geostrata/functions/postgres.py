"""PostgreSQL-compatible functions: version, schemas, array_upper, format_type and the pg_get_ pair."""

from __future__ import annotations

from geostrata.functions.registry import Registry

VERSION = "PostgreSQL 14.10 on geostrata"
# Oid, typname, category and element oid of the types of pg_type, then how format_type spells them
# (* stands for the modifier in brackets).
PG_TYPES = [
    (16, "bool", "B", 0, "boolean"),
    (17, "bytea", "U", 0, "bytea*"),
    (18, "char", "Z", 0, "character*"),
    (20, "int8", "N", 0, "bigint"),
    (21, "int2", "N", 0, "smallint"),
    (23, "int4", "N", 0, "integer"),
    (700, "float4", "N", 0, "real"),
    (701, "float8", "N", 0, "double precision"),
    (1000, "_bool", "A", 16, "boolean[]"),
    (1001, "_bytea", "A", 17, "bytea*[]"),
    (1002, "_char", "A", 18, "character*[]"),
    (1005, "_int2", "A", 21, "smallint[]"),
    (1007, "_int4", "A", 23, "integer[]"),
    (1015, "_varchar", "A", 1043, "character varying*[]"),
    (1016, "_int8", "A", 20, "bigint[]"),
    (1021, "_float4", "A", 700, "real[]"),
    (1022, "_float8", "A", 701, "double precision[]"),
    (1043, "varchar", "S", 0, "character varying*"),
    (1082, "date", "D", 0, "date*"),
    (1083, "time", "D", 0, "time* without time zone"),
    (1114, "timestamp", "D", 0, "timestamp* without time zone"),
    (1115, "_timestamp", "A", 1114, "timestamp* without time zone[]"),
    (1182, "_date", "A", 1082, "date*[]"),
    (1183, "_time", "A", 1083, "time* without time zone[]"),
    (1184, "timestamptz", "D", 0, "timestamp* with time zone"),
    (1185, "_timestamptz", "A", 1184, "timestamp* with time zone[]"),
    (1186, "interval", "T", 0, "interval"),
    (1187, "_interval", "A", 1186, "interval[]"),
]
_LENGTHS = {"varchar", "_varchar", "char", "_char"}


def _format_type() -> str:
    """One CASE over the type table: b, the modifier, may be NULL."""
    whens = []
    for oid, name, _, _, spelled in PG_TYPES:
        modifier = "CASE WHEN b >= 5 THEN concat('(', b - 4, ')') ELSE '' END" if name in _LENGTHS else "CASE WHEN b >= 0 THEN concat('(', b, ')') ELSE '' END"
        if name.endswith("interval"):
            text = f"CASE WHEN b >= 0 THEN '-' ELSE '{spelled}' END"
        elif "*" in spelled:
            before, after = spelled.split("*")
            text = f"concat('{before}', {modifier}, '{after}')"
        else:
            text = f"'{spelled}'"
        whens.append(f"WHEN {oid} THEN {text}")
    return f"CASE WHEN a IS NULL THEN NULL ELSE CASE a {' '.join(whens)} ELSE '???' END END"


POSTGRES = Registry()
POSTGRES.add("version() -> string", f"'{VERSION}'")
POSTGRES.add("current_schema() -> string", "'public'")
POSTGRES.add("current_schemas(boolean) -> list<string>", "CASE WHEN a THEN array('pg_catalog', 'public') WHEN NOT a THEN array('public') END")
POSTGRES.add("format_type(bigint, bigint = NULL) -> string", _format_type())
POSTGRES.add("pg_get_expr(string, bigint = NULL, boolean = NULL) -> string", "''")
POSTGRES.add("pg_get_partkeydef(string) -> string", "''")
# of the first dimension only: NULL below it, an error above it; SQL text takes arrays of any kind (compat.MACROS)
POSTGRES.add("array_upper(list<string>, bigint) -> bigint", "CASE WHEN b < 1 THEN NULL WHEN b = 1 THEN CAST(size(a) AS BIGINT) WHEN b > 1 THEN CAST(raise_error('array_upper: only dimension 1') AS BIGINT) END")
