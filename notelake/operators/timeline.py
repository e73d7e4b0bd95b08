"""Rows along time: the last value before a moment, the versions of a key, and the versions in force at a moment.

A key may hold most rows, so nothing here sorts the rows of a key in one task. Times are cut into ``CELLS`` even cells; rows are ordered
within a key's cell, and one row for each cell carries the last value from cell to cell. Rows of one key and one time are one row before that.

Versions in force are found by equi joins. The moments of a key of few versions (``DIRECT``) meet all of them. For other keys a validity [from, to) is cut into
aligned blocks of radix-4 widths, as few as possible, and a moment lies in one block of each width; so each pair that meets is a version and a moment in
it, however many versions a key has.

Where no key has more than ``PLAIN`` rows, the rows of a key are ordered as they are, without cells.

Times are longs or whole days as integers. A null key or time matches nothing; an open end is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelake.session import materialize

CELLS = 1024
RADIX = 4
#: Versions of a key up to which a moment meets each of them.
DIRECT = 64
#: Rows of a key up to which they are ordered together.
PLAIN = 4096


def celled(rows: DataFrame, at: str) -> DataFrame:
    """``rows`` with ``cell``: even cells between the first and the last time."""
    ends = rows.agg(F.min(at).alias("lo"), F.max(at).alias("hi")).first()
    if ends["lo"] is None:
        return rows.withColumn("cell", F.lit(0).cast("long"))
    width = max(1, -(-(ends["hi"] - ends["lo"] + 1) // CELLS))
    return rows.withColumn("cell", F.floor((F.col(at) - F.lit(ends["lo"])) / F.lit(width)))


def last_before(points: DataFrame, values: DataFrame, keys: list[str], at: str) -> DataFrame:
    """keys, at, value: for distinct points (keys, at) the value of the newest row of ``values`` (keys, at, value) at or before it.

    Of values of one key and time the largest wins; null values do not count. Points without an earlier value give null.
    """
    known = values.where("value is not null").where(" and ".join(f"`{c}` is not null" for c in [*keys, at])).groupBy(*keys, at).agg(F.max("value").alias("value"))
    asked = points.select(*keys, at).where(" and ".join(f"`{c}` is not null" for c in [*keys, at])).distinct()
    both = known.select(*keys, at, F.lit(0).alias("side"), "value").unionByName(asked.withColumn("side", F.lit(1)), allowMissingColumns=True)
    rows = materialize(both, "timeline")
    if _crowded(rows, keys, PLAIN).isEmpty():
        so_far = Window.partitionBy(*keys).orderBy(at, "side").rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn("value", F.last("value", ignorenulls=True).over(so_far)).where("side = 1").select(*keys, at, "value")
    rows = celled(rows, at)
    within = Window.partitionBy(*keys, "cell").orderBy(at, "side").rowsBetween(Window.unboundedPreceding, 0)
    lasts = rows.groupBy(*keys, "cell").agg(F.max_by("value", F.when(F.col("side") == 0, F.col(at))).alias("last"))
    carry = lasts.select(*keys, "cell", F.last("last", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))  # CELLS rows a key
    found = rows.withColumn("own", F.last("value", ignorenulls=True).over(within)).where("side = 1").join(carry, [*keys, "cell"])
    return found.select(*keys, at, F.coalesce("own", "carry").alias("value"))


def _crowded(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The keys of more than ``most`` rows."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > most).drop("n")


def versions(events: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The events (one for each key and time) with ``until``: the time of the next event of the key, null for the last."""
    rows = materialize(events, "timeline")
    if _crowded(rows, keys, PLAIN).isEmpty():
        told = rows.where(" and ".join(f"`{c}` is not null" for c in [*keys, at]))
        return told.withColumn("until", F.lead(at).over(Window.partitionBy(*keys).orderBy(at)))
    rows = celled(rows, at)
    cells = rows.groupBy(*keys, "cell").agg(F.min(at).alias("first"))
    follows = cells.select(*keys, "cell", F.lead("first").over(Window.partitionBy(*keys).orderBy("cell")).alias("follows"))  # CELLS rows a key
    own = F.lead(at).over(Window.partitionBy(*keys, "cell").orderBy(at))
    return rows.withColumn("own", own).join(follows, [*keys, "cell"]).withColumn("until", F.coalesce("own", "follows")).drop("own", "follows", "cell")


def _on(level: Column):
    return lambda x: F.struct(level.alias("level"), x.cast("long").alias("block"))


def _blocks(start: Column, end: Column, levels: int) -> Column:
    """Aligned blocks (level, block) that make up [start, end)."""
    parts = []
    for level in range(levels):
        w, up = RADIX**level, RADIX ** (level + 1)
        a, b = F.ceil(start / F.lit(w)), F.floor(end / F.lit(w))
        if level + 1 == levels:
            parts.append((a, b, F.lit(level)))
        else:  # up to the next wider block, and from the last wider block on
            left, right = F.ceil(start / F.lit(up)) * RADIX, F.floor(end / F.lit(up)) * RADIX
            parts.append((a, F.least(b, left), F.lit(level)))
            parts.append((F.greatest(right, F.least(b, left), a), b, F.lit(level)))
    none = F.expr("cast(array() as array<struct<level:int,block:bigint>>)")
    return F.concat(*(F.when(a < b, F.transform(F.sequence(a, b - 1), _on(k))).otherwise(none) for a, b, k in parts))


def in_force(points: DataFrame, held: DataFrame, keys: list[str], at: str, start: str = "since", end: str = "until") -> DataFrame:
    """The rows of ``points`` joined with the rows of ``held`` of their key whose [start, end) has their time. Other columns must differ."""
    held = held.where(F.col(start).isNotNull())
    crowded = materialize(_crowded(held, keys, DIRECT), "crowded")
    holds = (F.col(at) >= F.col(start)) & (F.col(end).isNull() | (F.col(at) < F.col(end)))
    columns = [*keys, *(c for c in [*points.columns, *held.columns] if c not in keys)]
    if crowded.isEmpty():
        return points.join(held, keys).where(holds).select(*columns)
    few = points.join(crowded, keys, "left_anti").join(held, keys).where(holds).select(*columns)
    return few.union(_by_blocks(points.join(crowded, keys, "left_semi"), held.join(crowded, keys, "left_semi"), keys, at, start, end).select(*columns))


def _by_blocks(points: DataFrame, held: DataFrame, keys: list[str], at: str, start: str, end: str) -> DataFrame:
    span = held.agg(F.min(start).alias("lo"), F.max(F.greatest(start, end)).alias("hi")).first()
    last = points.agg(F.max(at).alias("hi")).first()["hi"]
    low, high = span["lo"], max(span["hi"], span["hi"] if last is None else last) + 1  # an open end is beyond all times
    levels = 1
    while RADIX**levels < high - low:
        levels += 1
    from_ = (F.col(start) - F.lit(low)).cast("long")
    to = (F.coalesce(F.col(end), F.lit(high)) - F.lit(low)).cast("long")
    blocks = held.withColumn("_b", F.explode(_blocks(from_, to, levels))).select(*(F.col(f"`{c}`") for c in held.columns), F.col("_b.level").alias("_level"), F.col("_b.block").alias("_block"))
    moment = (F.col(at) - F.lit(low)).cast("long")
    places = F.array(*(F.struct(F.lit(k).alias("level"), F.floor(moment / F.lit(RADIX**k)).alias("block")) for k in range(levels)))
    asked = points.where(F.col(at) >= low).withColumn("_p", F.explode(places)).select(*(F.col(f"`{c}`") for c in points.columns), F.col("_p.level").alias("_level"), F.col("_p.block").alias("_block"))
    return asked.join(blocks, [*keys, "_level", "_block"]).drop("_level", "_block")
