"""Written copies of intermediate frames in the folder that spark.checkpoint.dir names, and the package for executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[2]


def one_machine(spark: SparkSession) -> bool:
    return spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all machines share. Only where there is one machine, a temporary one will do."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not one_machine(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        named = "file://" + tempfile.mkdtemp(prefix="geostrata-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def staged(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: lineage ends there, and lost executors do not matter."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a row id that stays the same however often it is read."""
    return staged(df.withColumn(name, F.monotonically_increasing_id()))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once; on one machine they have it."""
    sc = spark.sparkContext
    if one_machine(spark) or getattr(sc, "_geostrata_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="geostrata-zip-")) / "geostrata.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted((ROOT / "geostrata").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(archive))
    sc._geostrata_shipped = True
