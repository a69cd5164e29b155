"""Relational operators that Spark has under other names or not at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def join(left: DataFrame, right: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """Joins of every type; right semi and anti swap the inputs, mark joins add a boolean column ``mark``."""
    if how in ("right_semi", "right_anti"):
        return right.join(left, on, "left" + how[5:])
    if how == "right_mark":
        return join(right, left, on, "left_mark")
    if how == "left_mark":
        # an existence join, as Catalyst plans EXISTS under OR: no rows are multiplied
        from geostrata.plans.staging import numbered

        own = numbered(left, "__id")
        hits = own.join(right, on, "left_semi").select("__id").withColumn("mark", F.lit(True))
        return own.join(hits, "__id", "left").select(*left.columns, F.coalesce("mark", F.lit(False)).alias("mark"))
    return left.join(right, on, how)


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return top_k(df, keys, order, 1)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key; groups are cut to k rows before and after the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= k).drop("__n")


def salted_count(df: DataFrame, keys: list[str], name: str, salts: int = 16) -> DataFrame:
    """Counts by key through a salted first step, for keys that hold much of the rows. Rows alike in every column get
    different salts too: a salt is a row's place in its partition."""
    part = df.groupBy(*keys, F.pmod(F.monotonically_increasing_id(), F.lit(salts)).alias("__salt")).agg(F.count("*").alias("__n"))
    return part.groupBy(*keys).agg(F.sum("__n").alias(name))


def pg_order(*columns: str | Column) -> list[Column]:
    """PostgreSQL's order: nulls last ascending. A name with a leading - sorts descending, nulls first."""
    out = []
    for c in columns:
        if isinstance(c, Column):
            out.append(c)
        else:
            out.append(F.col(c[1:]).desc_nulls_first() if c.startswith("-") else F.col(c).asc_nulls_last())
    return out


def intersect_by(left: DataFrame, right: DataFrame, every: bool = False) -> DataFrame:
    return left.intersectAll(right) if every else left.intersect(right)


def except_by(left: DataFrame, right: DataFrame, every: bool = False) -> DataFrame:
    return left.exceptAll(right) if every else left.subtract(right)


#: Bytes of a scanned table to a task where each row costs much more than its reading.
TASK_BYTES = 64 << 10


def spread(df: DataFrame) -> DataFrame:
    """A scanned table dealt over tasks, as a file of one row group is read by one: at most four tasks a core."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    tasks = min(size // TASK_BYTES, 4 * df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(tasks) if tasks > 1 else df
