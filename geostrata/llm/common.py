"""What the training-data operators share: staged tables, partition counts, text columns."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.plans.staging import checkpoint_dir, ship

__all__ = ["ship"]


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir; a local one only where that setting is absent and there is one machine."""
    base, sc = checkpoint_dir(spark), spark.sparkContext
    if "://" not in base:  # as Hadoop would read it
        at = sc._jvm.org.apache.hadoop.fs.Path(base)
        root = at.getFileSystem(sc._jsc.hadoopConfiguration()).getUri().toString().rstrip("/")
        base = f"{'file://' if root == 'file:' else root}{at.toUri().getPath()}"
    path = f"{base.rstrip('/')}/geostrata-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None:
        return
    try:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone at exit; the folder is then left to its owner
        return


def tidy(run):
    """A function of batches that gives its freed memory back to the machine when a task ends, as workers live on."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # glibc only
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


@contextlib.contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Fewer rows in an Arrow batch for the actions inside, where single rows are large."""
    with _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows)):
        yield


def staged(df: DataFrame, folder: str, name: str, let_go: bool = False) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage and survives the loss of executors. With ``let_go``, the
    shuffles of this query are deleted once it is written, not whenever the driver collects its garbage."""
    path = f"{folder}/{name}"
    with _setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true") if let_go else contextlib.nullcontext():
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, folder: str, *names: str) -> None:
    """Delete staged tables that nothing reads any more. The driver's garbage goes with them, as Spark keeps the files of a
    shuffle for as long as an object of the driver speaks of it."""
    for name in names:
        _remove(spark, f"{folder}/{name}")
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a frame (the files' size for a plain scan); 0 where there is none."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else 0


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def own_prefix(df: DataFrame) -> str:
    """A prefix that no column has."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def text_of(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def last_at_most(ascending: Column, value: Column, longest: int) -> Column:
    """Place (from 0) of the last element of an ascending array that is <= value; -1 if there is none. A binary search
    in one expression, for arrays of up to ``longest`` elements."""
    steps = [F.lit(1 << k) for k in range(max(longest, 1).bit_length() - 1, -1, -1)]
    step = lambda at, jump: F.when((at + jump <= F.size(ascending)) & (F.get(ascending, at + jump - 1) <= value), at + jump).otherwise(at)
    return F.aggregate(F.array(*steps), F.lit(0), step) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; the folder is a parameter (PUBLIC_TOKENIZERS) and nothing is copied."""
    folder = os.environ.get("PUBLIC_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
