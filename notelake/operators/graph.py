"""Link graph: resolution, degrees, roots, orphans, hubs and components. Multiplicities count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.functions.text import base_name, link_key
from notelake.operators.components import connected_components

# Names of entry notes, and the fan-out that makes a hub.
ROOT_NAMES = ["index", "_index", "log", "readme", "00-index", "home"]
HUB_FRACTION, HUB_LEAST = 0.10, 5


def resolve(links: DataFrame, paths: DataFrame) -> DataFrame:
    """links(src, target) with ``rel``: by full path, else by basename (the last in walk order), else null."""
    full = paths.groupBy(link_key(F.col("rel")).alias("k")).agg(F.max_by("rel", F.split("rel", "/")).alias("by_path"))
    named = paths.groupBy(link_key(base_name(F.col("rel"))).alias("n")).agg(F.max_by("rel", F.split("rel", "/")).alias("by_name"))
    keyed = links.withColumn("k", link_key(F.col("target"))).withColumn("n", link_key(base_name(F.col("k"))))
    return keyed.join(full, "k", "left").join(named, "n", "left").withColumn("rel", F.coalesce("by_path", "by_name")).drop("k", "n", "by_path", "by_name")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """rel, out_degree, in_degree, is_root, is_orphan. edges: src, dst."""
    out, into = edges.groupBy(F.col("src").alias("rel")).agg(F.count("*").alias("o")), edges.groupBy(F.col("dst").alias("rel")).agg(F.count("*").alias("i"))
    rows = nodes.select("rel").join(out, "rel", "left").join(into, "rel", "left").select("rel", F.coalesce("o", F.lit(0)).alias("out_degree"), F.coalesce("i", F.lit(0)).alias("in_degree"))
    bound = F.broadcast(nodes.agg(F.greatest(F.floor(F.count("*") * HUB_FRACTION), F.lit(HUB_LEAST)).alias("hub")))  # one row
    stem = F.regexp_replace(F.lower(base_name(F.col("rel"))), r"\.md$", "")
    placed = F.col("rel").startswith("moc/") | ~F.contains(F.col("rel"), F.lit("/")) | stem.isin(ROOT_NAMES)
    rooted = rows.crossJoin(bound).withColumn("is_root", placed | (F.col("out_degree") >= F.col("hub"))).drop("hub")
    return rooted.withColumn("is_orphan", (F.col("in_degree") == 0) & ~F.col("is_root"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """rel, component: the smallest member stands for the component; lone nodes are their own."""
    found = connected_components(edges, "src", "dst")
    return nodes.select("rel").join(found, nodes["rel"] == found["node"], "left").select("rel", F.coalesce("component", "rel").alias("component"))


def component_sizes(members: DataFrame, roots: DataFrame) -> DataFrame:
    """component, size, share of all nodes, rootless (over one member and no root)."""
    total = F.broadcast(members.agg(F.count("*").alias("total")))
    sized = members.join(roots.select("rel", "is_root"), "rel", "left").groupBy("component").agg(F.count("*").alias("size"), F.coalesce(F.bool_or("is_root"), F.lit(False)).alias("rooted"))
    return sized.crossJoin(total).select("component", "size", (F.col("size") / F.col("total")).alias("share"), ((F.col("size") > 1) & ~F.col("rooted")).alias("rootless"))
