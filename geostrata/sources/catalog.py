"""PostgreSQL catalog tables as temporary views (pg_type, pg_namespace ...), and information_schema over Spark's catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.functions.postgres import PG_TYPES

# Rows of the catalog tables.
NAMESPACES = [(11, "pg_catalog"), (2200, "public"), (13676, "information_schema")]
DATABASES = [(13757, "postgres", 13756)]


def pg_type(spark: SparkSession) -> DataFrame:
    rows = [(oid, name, 11, category, 0, element, 0, -1) for oid, name, category, element, _ in PG_TYPES]
    return spark.createDataFrame(rows, "oid long, typname string, typnamespace long, typcategory string, typrelid long, typelem long, typbasetype long, typtypmod int")


def pg_namespace(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NAMESPACES, "oid long, nspname string")


def pg_database(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DATABASES, "oid long, datname string, datlastsysoid long")


def pg_class(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "oid long, relnamespace long, relkind string, relpartbound string")


def pg_description(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "objoid long, classoid long, objsubid int, description string")


TABLES = {f.__name__: f for f in (pg_type, pg_namespace, pg_database, pg_class, pg_description)}
#: Tables that are found under public only.
PUBLIC_ONLY = {"pg_database"}


def _listed(spark: SparkSession) -> list[tuple[str, str, str]]:
    """(schema, name, kind) of every table of every database, and of the temporary views, which count as public."""
    out = [("public", t.name, "VIEW") for t in spark.catalog.listTables() if not t.namespace]
    for db in spark.catalog.listDatabases():
        out += [(db.name, t.name, "VIEW" if t.tableType == "VIEW" else "BASE TABLE") for t in spark.catalog.listTables(db.name) if t.namespace]
    return out


def tables(spark: SparkSession) -> DataFrame:
    """information_schema.tables over the current catalog: names only, no data is read."""
    rows = [("spark_catalog", *r) for r in _listed(spark)]
    return spark.createDataFrame(rows, "table_catalog string, table_schema string, table_name string, table_type string")


def columns(spark: SparkSession) -> DataFrame:
    """information_schema.columns over the current catalog."""
    rows, temporary = [], {t.name for t in spark.catalog.listTables() if not t.namespace}
    for schema, name, _ in _listed(spark):
        own = f"`{name}`" if schema == "public" and name in temporary else f"`{schema}`.`{name}`"
        for i, f in enumerate(spark.table(own).schema.fields):
            rows.append(("spark_catalog", schema, name, f.name, i + 1, "YES" if f.nullable else "NO", f.dataType.simpleString()))
    return spark.createDataFrame(rows, "table_catalog string, table_schema string, table_name string, column_name string, ordinal_position int, is_nullable string, data_type string")


def schemata(spark: SparkSession) -> DataFrame:
    names = [(n,) for _, n in NAMESPACES] + [(d.name,) for d in spark.catalog.listDatabases()]
    return spark.createDataFrame(names, "schema_name string").select(F.lit("spark_catalog").alias("catalog_name"), "schema_name").distinct()


INFORMATION = {"tables": tables, "columns": columns, "schemata": schemata}
