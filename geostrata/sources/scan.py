"""Scans of other databases: duckdb_scan, sqlite_scan, postgres_scan and mysql_scan, and file tables.

DuckDB and SQLite files are read by Python data sources (spark.read.format("geostrata_duckdb" / "geostrata_sqlite"))
that push columns and simple filters into the other database and split a table over tasks by row ids, so no table
passes through the driver; what has no row ids (a view, a table WITHOUT ROWID, one with columns of that name) is read by
one task. PostgreSQL and MySQL go through Spark's JDBC source, with its push-down; their driver jars are the user's to add
(spark.jars), and without them the scan fails with Spark's own error. Arguments beyond those named are ignored. Paths must
be reachable by the executors."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from geostrata.plans.staging import ship


class ScanError(ValueError):
    """Arguments that a scan cannot use."""


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class _Part(InputPartition):
    """Row ids from low to high; all rows where they are None."""

    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


_OPERATORS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


class _Reader(DataSourceReader):
    def __init__(self, options, schema: T.StructType):
        self.options, self.schema = dict(options), schema
        self.where: list[str] = []
        self.values: list = []

    def pushFilters(self, filters: list[Filter]):
        """Comparisons of top-level columns with numbers and strings; the rest stays with Spark."""
        for f in filters:
            op = _OPERATORS.get(type(f))
            if op and len(f.attribute) == 1 and isinstance(f.value, (int, float, str)) and not isinstance(f.value, bool):
                self.where.append(f"{quoted(f.attribute[0])} {op} ?")
                self.values.append(f.value)
            elif isinstance(f, IsNotNull) and len(f.attribute) == 1:
                self.where.append(f"{quoted(f.attribute[0])} IS NOT NULL")
            else:
                yield f

    def partitions(self):
        found = self.bounds()
        if found is None:
            return [_Part(None, None)]
        low, high = found
        n = max(1, int(self.options.get("numpartitions", 8)))
        step = max(1, -(-(high - low + 1) // n))
        return [_Part(i, min(i + step - 1, high)) for i in range(low, high + 1, step)] or [_Part(0, -1)]

    def statement(self, part: _Part) -> tuple[str, list]:
        columns = ", ".join(quoted(f.name) for f in self.schema.fields)
        where = [*([] if part.low is None else [f"rowid BETWEEN {part.low} AND {part.high}"]), *self.where]
        return f"SELECT {columns or '1'} FROM {self.table()}" + (f" WHERE {' AND '.join(where)}" if where else ""), self.values


class DuckDBReader(_Reader):
    def connect(self):
        import duckdb

        return duckdb.connect(self.options["path"], read_only=True)

    def table(self) -> str:
        return f"{quoted(self.options.get('schema', 'main'))}.{quoted(self.options['table'])}"

    def bounds(self) -> tuple[int, int] | None:
        import duckdb

        with self.connect() as c:
            columns = {r[0].lower() for r in c.execute(f"DESCRIBE SELECT * FROM {self.table()}").fetchall()}
            try:
                low, high = (None, None) if "rowid" in columns else c.execute(f"SELECT min(rowid), max(rowid) FROM {self.table()}").fetchone()
            except duckdb.Error:
                return None
        return None if "rowid" in columns else (0, -1) if low is None else (low, high)

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        sql, values = self.statement(partition)
        want = to_arrow_schema(self.schema)
        with self.connect() as c:
            for batch in c.sql(sql, params=values).to_arrow_reader(8192):
                if not len(want):
                    yield pa.RecordBatch.from_struct_array(pa.array([{}] * batch.num_rows, pa.struct([])))
                    continue
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(batch.columns, want, strict=True)], schema=want)


class DuckDBSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geostrata_duckdb"

    def schema(self) -> T.StructType:
        reader = DuckDBReader(self.options, T.StructType())
        with reader.connect() as c:
            return from_arrow_schema(c.sql(f"SELECT * FROM {reader.table()} LIMIT 0").to_arrow_reader(1).schema)

    def reader(self, schema: T.StructType) -> DuckDBReader:
        return DuckDBReader(self.options, schema)


class SQLiteReader(_Reader):
    def connect(self):
        import sqlite3

        return sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True, timeout=5)

    def table(self) -> str:
        return quoted(self.options["table"])

    def bounds(self) -> tuple[int, int] | None:
        import sqlite3

        c = self.connect()
        try:
            kind = c.execute("SELECT type FROM sqlite_master WHERE lower(name) = lower(?)", [self.options["table"]]).fetchone()
            columns = {r[1].lower() for r in c.execute(f"PRAGMA table_info({self.table()})")}
            if kind is None or kind[0] != "table" or "rowid" in columns:
                return None
            low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {self.table()}").fetchone()
        except sqlite3.OperationalError:  # no row ids
            return None
        finally:
            c.close()
        return (0, -1) if low is None else (low, high)

    def read(self, partition: _Part) -> Iterator[tuple]:
        c = self.connect()
        try:
            kinds = [f.dataType for f in self.schema.fields]
            for row in c.execute(*self.statement(partition)):
                yield tuple(_as(v, k) for v, k in zip(row, kinds, strict=True))
        finally:
            c.close()


def _as(value, kind: T.DataType):
    """SQLite values have types of their own; those that do not fit the column are NULL."""
    try:
        if value is None:
            return None
        if isinstance(kind, T.LongType):
            return int(value)
        if isinstance(kind, T.DoubleType):
            return float(value)
        if isinstance(kind, T.BinaryType):
            return value if isinstance(value, bytes) else str(value).encode()
        return value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)
    except (TypeError, ValueError):
        return None


class SQLiteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geostrata_sqlite"

    def schema(self) -> T.StructType:
        c = SQLiteReader(self.options, T.StructType()).connect()
        try:
            table = quoted(self.options["table"])
            rows = c.execute(f"PRAGMA table_info({table})").fetchall()
            # columns without a declared type (a view's expressions) are of the kind of their first value
            found = {r[1]: c.execute(f"SELECT typeof({quoted(r[1])}) FROM {table} WHERE {quoted(r[1])} IS NOT NULL LIMIT 1").fetchone() for r in rows if not r[2]}
        finally:
            c.close()
        if not rows:
            raise ScanError(f"no table {self.options['table']}")

        def kind(declared: str) -> T.DataType:
            d = (declared or "").upper()
            return T.LongType() if "INT" in d or "BOOL" in d else T.DoubleType() if any(x in d for x in ("REAL", "FLOA", "DOUB", "NUM", "DEC")) else T.BinaryType() if "BLOB" in d or not d else T.StringType()

        return T.StructType([T.StructField(r[1], kind(r[2] or (found[r[1]] or ("",))[0])) for r in rows])

    def reader(self, schema: T.StructType) -> SQLiteReader:
        return SQLiteReader(self.options, schema)


def _arguments(name: str, args: tuple, least: int) -> tuple[str, ...]:
    if len(args) < least:
        raise ScanError(f"{name} needs {least} arguments")
    if not all(isinstance(a, str) for a in args[:least]):
        raise ScanError(f"{name} takes string literals")
    return args[:least]


def duckdb_scan(spark: SparkSession, *args: str, partitions: int = 8) -> DataFrame:
    """duckdb_scan(path, schema, table)"""
    path, schema, table = _arguments("duckdb_scan", args, 3)
    register(spark)
    return spark.read.format("geostrata_duckdb").options(path=path, schema=schema, table=table, numpartitions=partitions).load()


def sqlite_scan(spark: SparkSession, *args: str, partitions: int = 8) -> DataFrame:
    """sqlite_scan(path, table)"""
    path, table = _arguments("sqlite_scan", args, 2)
    register(spark)
    return spark.read.format("geostrata_sqlite").options(path=path, table=table, numpartitions=partitions).load()


def jdbc_options(dsn: str, kind: str, table: str) -> dict[str, str]:
    """JDBC options from a URL (postgresql://user:password@host:port/db) or key=value DSN."""
    default = {"postgresql": "5432", "mysql": "3306"}[kind]
    m = re.fullmatch(r"\w+://(?:([^:@/]*)(?::([^@/]*))?@)?([^:/?]*)(?::(\d+))?/?([^?]*)(?:\?.*)?", dsn)
    if m:
        user, password, host, port, db = (x or "" for x in m.groups())
    else:
        pairs = dict(re.findall(r"(\w+)\s*=\s*'?([^'\s]+)'?", dsn))
        user, password, host, port, db = (pairs.get(k, "") for k in ("user", "password", "host", "port", "dbname"))
    out = {"url": f"jdbc:{kind}://{host or 'localhost'}:{port or default}/{db}", "dbtable": table, "pushDownPredicate": "true", "pushDownAggregate": "true", "pushDownLimit": "true"}
    return out | {k: v for k, v in (("user", user), ("password", password)) if v}


def postgres_scan(spark: SparkSession, *args: str, **options: str) -> DataFrame:
    """postgres_scan(dsn, schema, table); pass partitionColumn, lowerBound, upperBound and numPartitions to split it."""
    dsn, schema, table = _arguments("postgres_scan", args, 3)
    return spark.read.format("jdbc").options(**jdbc_options(dsn, "postgresql", f"{quoted(schema)}.{quoted(table)}"), **options).load()


def mysql_scan(spark: SparkSession, *args: str, **options: str) -> DataFrame:
    """mysql_scan(dsn, database, table)"""
    dsn, database, table = _arguments("mysql_scan", args, 3)
    return spark.read.format("jdbc").options(**jdbc_options(dsn, "mysql", f"`{database}`.`{table}`"), **options).load()


SCANS = {f.__name__: f for f in (duckdb_scan, sqlite_scan, postgres_scan, mysql_scan)}


def register(spark: SparkSession) -> None:
    """Register the data sources, and send this package to the executors, where their readers run."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DuckDBSource)
    spark.dataSource.register(SQLiteSource)
