"""Aggregates over geometries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geostrata.session import ensure


def analyze_columns(geom: str | Column) -> list[Column]:
    """Aggregate columns of the statistics of a geometry column: mergeable counts, sums and bounds, one pass."""
    a = F.call_function("__k_analyze", F.col(geom) if isinstance(geom, str) else geom)
    known = F.count(a["bytes"])
    wide, high = F.avg(a["xmax"] - a["xmin"]), F.avg(a["ymax"] - a["ymin"])
    kind = lambda k: F.count(F.when(a["kind"] == k, 1))
    return [
        known.alias("count"), F.min(a["xmin"]).alias("minx"), F.min(a["ymin"]).alias("miny"), F.max(a["xmax"]).alias("maxx"), F.max(a["ymax"]).alias("maxy"),
        F.when(known > 0, F.floor(F.sum(a["bytes"]) / known)).cast("long").alias("mean_size_in_bytes"), (F.sum(a["points"]) / known).alias("mean_points_per_geometry"),
        kind(0).alias("puntal_count"), kind(1).alias("lineal_count"), kind(2).alias("polygonal_count"), kind(3).alias("geometrycollection_count"),
        wide.alias("mean_envelope_width"), high.alias("mean_envelope_height"), (wide * high).alias("mean_envelope_area"),
    ]


def st_analyze_agg(df: DataFrame, geom: str, by: list[str] | None = None) -> DataFrame:
    """Statistics of a geometry column: one row, or one for each group."""
    ensure(df.sparkSession, ["__k_analyze"])
    return df.groupBy(*(by or [])).agg(*analyze_columns(geom))
