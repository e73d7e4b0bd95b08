"""When each URL may be probed: the probes of a host one spacing apart, hosts side by side, all computed before any request.

A URL's number within its host is its place in the order of a hash and the URL. It is counted within the host's share of one hash value and
shifted by the counts of the shares before, so a host of half of all URLs is 256 sorts and not one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notelake.functions.text import host


def numbered(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``rows`` (key, value; distinct) with ``nth`` from 0: gapless numbers within each key."""
    share = rows.withColumn("share", F.substring(F.md5(value), 1, 2))
    counts = share.groupBy(key, "share").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(key).orderBy("share")) - F.col("n")  # 256 rows a key
    own = F.row_number().over(Window.partitionBy(key, "share").orderBy(value)) - 1
    return share.withColumn("own", own).join(counts.select(key, "share", before.alias("before")), [key, "share"]).withColumn("nth", F.col("own") + F.col("before")).drop("share", "own", "before")


def due(urls: DataFrame, cache: DataFrame, now_s: int, ttl_s: int) -> DataFrame:
    """url: those that a probe has to answer: no verdict within its time is cached, or the last one was unreachable."""
    held = cache.where((F.col("verdict") != "unreachable") & (F.lit(now_s) - F.col("checked_s") <= ttl_s)).select("url")
    return urls.select("url").where("url is not null").distinct().join(held, "url", "left_anti")


def schedule(urls: DataFrame, probed: DataFrame, now_ms: int, spacing_ms: int) -> DataFrame:
    """url, host, slot, at_ms: the time of each URL's probe (each URL once); null URLs have none.

    probed: host, last_ms (the last request to a host, by this or an earlier run): a host is not asked again within its spacing of that.
    """
    rows = urls.select("url").where("url is not null").distinct().withColumn("host", host(F.col("url")))
    last = probed.groupBy("host").agg(F.max("last_ms").alias("last_ms"))
    slots = numbered(rows, "host", "url").join(last, "host", "left")
    start = F.greatest(F.lit(now_ms), F.coalesce(F.col("last_ms") + spacing_ms, F.lit(now_ms)))
    return slots.select("url", "host", F.col("nth").alias("slot"), (start + F.col("nth") * spacing_ms).alias("at_ms"))
