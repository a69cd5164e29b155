"""Queries over the driver's tables, by name, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from geostrata.queries import relational, scalar, spatial


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return relational.queries() | scalar.queries() | spatial.queries()


def oracle_sql() -> dict[str, str]:
    return relational.oracle_sql() | scalar.oracle_sql() | spatial.oracle_sql()
