"""Tables as views, and queries from SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from geostrata.operators.relational import spread
from geostrata.plans.sql import sql

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def views(spark: SparkSession, sf_dir: str, text: str) -> None:
    """Temporary views of the tables that a statement names; where kernels run on their rows, dealt over all tasks."""
    low = text.lower()
    for t in TABLES:
        if t in low:
            df = spark.read.parquet(f"{sf_dir}/{t}.parquet")
            (spread(df) if "st_" in low else df).createOrReplaceTempView(t)


def query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query of one statement in the engine's SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, text)
        return sql(spark, text)

    return run
