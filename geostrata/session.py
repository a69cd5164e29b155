"""Turns a Spark session into a spatially aware, PostgreSQL-flavoured one.

``register_all`` registers everything, for plain ``spark.sql``. ``ensure`` registers only functions and catalog views
of given names, and builds the kernels only if one of them is spatial; ``plans.sql`` calls it with a statement's words."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession

_done: dict[tuple[str, str], object] = {}


def _first(spark: SparkSession, name: str, mark: object = True) -> bool:
    """Whether this session meets ``name`` with this mark for the first time."""
    key = (spark._jsparkSession.sessionUUID(), name)
    if _done.get(key) == mark:
        return False
    _done[key] = mark
    return True


def ensure(spark: SparkSession, names: Iterable[str]) -> SparkSession:
    """Register the engine's functions and catalog views among these names; those already there cost nothing."""
    from geostrata.functions import compat, kernels, postgres, registry, spatial
    from geostrata.sources import catalog

    for name in sorted({n.lower() for n in names}):
        for kernel in [name] if name in kernels.BY_NAME else spatial.kernels_of(name):
            if _first(spark, "__kernels"):
                kernels.add(spark)
            if _first(spark, kernel):
                kernels.register(spark, kernel)
        for own in (spatial.SPATIAL, postgres.POSTGRES, compat.COMPAT, registry.USER):
            if name in own.functions and _first(spark, f"{name}()", tuple(map(id, own.functions[name]))):
                registry.create(spark, own.functions[name])
        if name in catalog.TABLES and _first(spark, name):
            catalog.TABLES[name](spark).createOrReplaceTempView(name)
    return spark


def register_all(spark: SparkSession) -> SparkSession:
    """Register kernels, SQL functions, catalog views and data sources in this session; a second call adds only what is new."""
    from geostrata.functions import compat, postgres, registry, spatial
    from geostrata.sources import catalog, scan

    scan.register(spark)
    return ensure(spark, ["__k_analyze", *(n for own in (spatial.SPATIAL, postgres.POSTGRES, compat.COMPAT, registry.USER) for n in own.functions), *catalog.TABLES])
