"""Connected components of an undirected edge list, by alternating star contraction.

Each round replaces every edge by edges to the smallest neighbour, first among the larger
neighbours of a node and then among the smaller ones; a path of n nodes shrinks to a star in
O(log n) rounds. Rows never exceed the edges plus the nodes. Rows go by node into partitions of
about ``MEGABYTES`` of the table before them, so a task holds no more as tables grow; a node of more than ``HOT``
edges, as the centre of a giant component, goes in shares by its neighbours (the driver learns
these nodes, one for ``HOT`` ends of edges at most). Each round is written to the shared folder, so lost executors
recompute one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.session import discard, partitions, written

MEGABYTES = 8
HOT = 1 << 20


def _parts(df: DataFrame) -> int:
    return partitions(df, MEGABYTES, df.sparkSession.sparkContext.defaultParallelism)


def _spread(pairs: DataFrame, hot: DataFrame | None, n: int) -> tuple[DataFrame, list[str]]:
    """pairs(u, v) in ``n`` partitions by u, hot ones in shares by v, and the columns that tell the place of a row."""
    if hot is None:
        return pairs.repartition(n, "u"), ["u"]
    share = F.coalesce(F.pmod(F.xxhash64("v"), F.col("shares")), F.lit(0)).alias("share")
    return pairs.join(F.broadcast(hot), "u", "left").select(*(F.col(c) for c in pairs.columns), share).repartition(n, "u", "share"), ["u", "share"]


def _star(pairs: DataFrame, larger: bool, hot: DataFrame | None, n: int) -> DataFrame:
    """pairs(u, v): both directions for the large star, u > v for the small star."""
    placed, at = _spread(pairs, hot, n)
    least = placed.groupBy(*at).agg(F.min("v").alias("m"))
    if hot is not None:
        least = least.groupBy("u").agg(F.min("m").alias("m")).join(F.broadcast(hot), "u", "left")
        least = least.select("u", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("shares", F.lit(1)) - 1)).alias("share")).repartition(n, *at)
    joined = placed.join(least.withColumn("m", F.least("m", "u")), at)
    kept = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if larger else joined.select(
        F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v")
    )
    return kept.where(F.col("u") != F.col("v"))


def _state(links: DataFrame, hot: DataFrame | None, n: int) -> tuple[bool, DataFrame | None]:
    """Whether no node is both a member and the centre of a star, nor the member of two; and the hot nodes (u, shares)."""
    ends = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    placed, at = _spread(ends, hot, n)
    below, seen = F.when(F.col("v") < F.col("u"), F.col("v")), F.max(F.col("v") > F.col("u"))
    nodes = placed.groupBy(*at).agg(F.count("*").alias("n"), F.min(below).alias("lo"), F.max(below).alias("hi"), seen.alias("centre"))
    if hot is not None:
        nodes = nodes.groupBy("u").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("centre").alias("centre"))
    open_ = F.col("lo").isNotNull() & (F.col("centre") | (F.col("lo") != F.col("hi")))
    shares = F.ceil(F.col("n") / F.lit(HOT)).alias("shares")
    told = nodes.agg(F.max(open_).alias("open"), F.collect_list(F.when(F.col("n") > HOT, F.struct("u", shares))).alias("hot")).first()
    few = links.sparkSession.createDataFrame(told["hot"], f"u {links.schema['u'].dataType.simpleString()}, shares long") if told["hot"] else None
    return not told["open"], few


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node reachable; nodes come from the edges.

    Null ends and self loops are ignored; repeated edges count once; no edges give no rows.
    Nodes without an edge are the caller's to add (each is its own component).
    """
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    links, path = written(links.repartition(_parts(edges), "u", "v").distinct(), "cc")
    hot = None
    for _ in range(max_rounds):
        n = _parts(links)
        settled, hot = _state(links, hot, n)
        if settled:
            break
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, True, hot, n)
        last = path
        links, path = written(_star(large, False, hot, n).repartition(n, "u", "v").distinct(), "cc")
        discard(edges.sparkSession, last)
    else:
        raise RuntimeError("components did not settle")
    members = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    # the members of a centre are in shares before each centre is told once
    shares = members.select("component", F.pmod(F.xxhash64("node"), F.lit(64)).alias("share")).repartition(n, "component", "share").distinct()
    return members.unionByName(shares.select(F.col("component").alias("node"), "component").distinct())
