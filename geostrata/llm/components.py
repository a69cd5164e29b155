"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is two aggregations and joins over the edges alone; nothing is gathered on the driver but a count and
a checksum that tell when the edges no longer change. Each round is written to the shared folder, so lineage stays
short and a lost executor costs one round at most.

A node of very many edges is no task's burden: its least neighbour is found by partial aggregates, and it is
broadcast to the edges where they lie. There are at most 2 * edges / HUB such nodes, and HUB grows with the edges so that
they stay below HUBS; other nodes meet their edges in a shuffle, with at most HUB edges each.

Cases: links with a null end are dropped; repeated links, links in both directions and loops change nothing; without
links the result is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.llm import common


#: Edges that make a node a hub, and hubs that may be broadcast (16 bytes each).
HUB, HUBS = 500, 20_000


def _mark(edges: DataFrame) -> tuple:
    """Edges, different b, and a checksum."""
    return tuple(edges.agg(F.count("*"), F.countDistinct("b"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())


def _stars(edges: DataFrame, mark: tuple) -> bool:
    """Whether every node is either a centre or tied to one centre: nothing is left to do."""
    return mark[0] == mark[1] and not edges.join(edges.select(F.col("b").alias("c")), F.col("a") == F.col("c"), "left_semi").take(1)


def _told(edges: DataFrame, least: DataFrame, key: str, hub: int) -> DataFrame:
    """edges with m, the least of their key. Edges of hubs are told by broadcast and go on under keys of their own, so that
    the shuffle spreads them."""
    few = F.broadcast(least.filter(F.col("n") > hub).select(F.col(key).alias("of"), F.col("m").alias("told")))
    spread = F.when(F.col("told").isNull(), F.col(key)).otherwise(F.xxhash64("a", "b"))
    e = edges.join(few, F.col(key) == F.col("of"), "left").select("a", "b", "told", spread.alias("to"))
    rest = least.filter(F.col("n") <= hub).select(F.col(key).alias("to"), "m")
    return e.join(rest, "to", "left").select("a", "b", F.coalesce("told", "m").alias("m"))


def _large_star(edges: DataFrame, hub: int) -> DataFrame:
    """Every greater neighbour of u is tied to the least of u and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("m", "a"))
    return _told(both.filter("b > a"), least, "a", hub).select(F.col("m").alias("a"), "b").filter("a <> b").distinct()


def _small_star(edges: DataFrame, hub: int) -> DataFrame:
    """u and its lesser neighbours are tied to the least of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("n"))
    tied = _told(edges, least, "b", hub).select(F.col("m").alias("a"), F.col("a").alias("b")).filter("a <> b")
    return tied.union(least.select(F.col("m").alias("a"), "b")).distinct()


def connected_components(links: DataFrame, folder: str, name: str) -> DataFrame:
    """(id, component) of every node in (a, b) links; component is the smallest id reachable."""
    edges = links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = common.staged(edges, folder, f"{name}-0")
    before, step = _mark(edges), 0
    while before[0] and not _stars(edges, before):
        step += 1
        hub = max(HUB, 2 * before[0] // HUBS)
        edges = common.staged(_small_star(_large_star(edges, hub), hub), folder, f"{name}-{step}")
        after = _mark(edges)
        if after == before:
            break
        before = after
    ends = edges.select(F.col("b").alias("id"), F.col("a").alias("component"))
    return ends.union(edges.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
