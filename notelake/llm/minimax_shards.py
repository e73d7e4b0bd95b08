"""Sharding by bytes: a minimax contiguous partition of groups that must stay whole.

Rows of equal texts are one atomic group; groups are in the order of a hash of the text. The cuts minimise the largest
shard: the smallest feasible capacity is found by binary search, each capacity checked greedily (fill a shard while the next
group fits, at most K shards), and the shards are cut with that capacity, each as near to its equal share as it allows.

The driver never holds the groups. It holds sums over ranges of the hash, 65,536 at first. A greedy check over ranges gives
two answers: cuts only between ranges (feasible for sure) and cuts anywhere in a range (infeasible for sure if that fails).
They bracket the capacity and each cut. The largest ranges in which a cut may still lie are divided by one more pass over the groups, at most
``CELLS`` sums a pass, until each cut is one boundary between groups: a few passes, their number grows with the logarithm of the groups.
The result is that of the search over all groups: the tests compare them.

A group above its fair share (what is left over the shards that are left) fills a shard of its own; there are fewer of these than shards,
the largest first, and the rest is cut into the other shards. Cuts are hash values, so a row's shard is an expression over its own text.

Slots number the rows of a shard without gaps, in the order of a hash of id and text: identical rows are counted first, the hash deals
rows into even slices, each slice numbers its own rows of each shard, and the sums by slice and shard give each slice its first number.

Defined results: a null text is an empty one; null ids are numbered like others; repeated rows each get a slot; shards may be
empty where there are fewer groups than shards; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelake.session import materialize, partitions

SHARDS = 8
KEY_BITS = 60
CELLS = 1 << 16
#: Ranges divided in one pass.
DIVIDED = 32
#: Identical rows numbered by one task.
CHUNK = 4096


def _hash60(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


class Ranges:
    """Sizes over ranges [first, last] of keys, in order; a range with one key is whole: no cut lies in it."""

    def __init__(self, rows: list[tuple[int, int, int]]):
        rows = sorted(rows)
        self.first, self.last, self.size = (np.array([r[k] for r in rows], dtype=np.int64) for k in range(3))
        self.ends = np.concatenate([[0], np.cumsum(self.size)])
        self.total = int(self.ends[-1])
        self.open = self.first < self.last

    def _at(self, y: int) -> int:
        return int(np.searchsorted(self.ends, y, side="right")) - 1

    def below(self, y: int) -> tuple[int, int]:
        """Between which values the largest boundary up to y lies."""
        j = self._at(min(y, self.total))
        sure = int(self.ends[j])
        return sure, (y if j < len(self.open) and self.open[j] and y > sure else sure)

    def above(self, y: int) -> tuple[int, int]:
        """Between which values the smallest boundary from y on lies."""
        y = max(y, 0)
        j = self._at(y)
        if self.ends[j] == y:
            return y, y
        end = int(self.ends[j + 1])
        return (y if self.open[j] else end), end

    def reach(self, capacity: int, shards: int) -> tuple[list[int], list[int]]:
        """Where greedily filled shards end, at least and at most."""
        low, high = [0], [0]
        for _ in range(shards):
            low.append(self.below(low[-1] + capacity)[0])
            high.append(min(self.total, self.below(high[-1] + capacity)[1]))
        return low, high

    def capacity(self, shards: int) -> tuple[int, int]:
        """Between which values the smallest feasible capacity lies."""

        def smallest(side: int) -> int:
            lo, hi = -(-self.total // shards), self.total
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (lo, mid) if self.reach(mid, shards)[side][-1] >= self.total else (mid + 1, hi)
            return lo

        return smallest(1), smallest(0)

    def cuts(self, shards: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """The values between which each cut lies, and all places that must be known better before they meet."""
        lo, hi = self.capacity(shards)
        greedy = list(zip(self.reach(lo, shards)[0], self.reach(hi, shards)[1])) if lo < hi else []
        least = [(self.total, self.total)]  # where a cut must lie at least, for the rest to fit
        for _ in range(shards - 1):
            a, b = least[-1]
            least.append((self.above(a - hi)[0], self.above(b - lo)[1]))
        least = least[::-1]
        found = [(0, 0)]
        for i in range(1, shards):
            aim = self.total * i // shards
            (f, f2), (c, c2) = self.below(aim), self.above(aim)
            near = (f if aim - f <= c - aim else c,) * 2 if f == f2 and c == c2 else (f, c2)
            a, b = found[-1]
            most = self.below(a + lo)[0], self.below(b + hi)[1]
            found.append(tuple(max(least[i - 1][s], min(near[s], most[s])) for s in (0, 1)))
        return found[1:], [p for p in greedy + least + found if p[0] < p[1]]

    def unknown(self, places: list[tuple[int, int]], most: int) -> list[int]:
        """The largest open ranges in which one of the places may lie."""
        hit = np.zeros(len(self.size), dtype=bool)
        for a, b in places:
            hit |= (self.ends[:-1] < b) & (self.ends[1:] > a)
        found = np.flatnonzero(hit & self.open)
        return found[np.argsort(-self.size[found], kind="stable")][:most].tolist()

    def rows(self, without: set[int]) -> list[tuple[int, int, int]]:
        return [(int(a), int(b), int(n)) for k, (a, b, n) in enumerate(zip(self.first, self.last, self.size)) if k not in without]


def _sums(groups: DataFrame, cell: Column) -> list[tuple[int, int, int]]:
    """At most CELLS rows."""
    by = groups.groupBy(cell.alias("cell")).agg(F.min("key").alias("first"), F.max("key").alias("last"), F.sum("size").alias("size"))
    return [(r["first"], r["last"], r["size"]) for r in by.collect()]


def _giants(groups: DataFrame, total: int, shards: int) -> list[int]:
    """Keys of the groups above their fair share, the largest first: fewer than ``shards``."""
    found, left = [], total
    for r in groups.orderBy(F.desc("size"), "key").limit(shards - 1).collect():
        if r["size"] * (shards - len(found)) <= left:
            break
        found.append(r["key"])
        left -= r["size"]
    return found


def shard_plan(groups: DataFrame, shards: int = SHARDS) -> tuple[list[int], list[int]]:
    """Of groups (key, size): the keys that fill a shard alone, and the first keys of the shards after the first of the rest."""
    total = groups.agg(F.sum("size")).first()[0] or 0
    giants = _giants(groups, total, shards)
    rest = groups.where(~F.col("key").isin(giants)) if giants else groups
    ranges = Ranges(_sums(rest, F.shiftright("key", KEY_BITS - 16)))
    k = shards - len(giants)
    while True:
        cuts, places = ranges.cuts(k)
        divided = ranges.unknown(places, DIVIDED)
        if not divided:
            break
        fan = CELLS // len(divided)
        cell, within = F.lit(None).cast("long"), []
        for n, j in enumerate(divided):
            first, last = int(ranges.first[j]), int(ranges.last[j])
            step = -(-(last - first + 1) // fan)
            here = F.col("key").between(first, last)
            within.append(here)
            cell = F.when(here, F.lit(n * fan) + F.floor((F.col("key") - first) / F.lit(step))).otherwise(cell)
        some = within[0]
        for w in within[1:]:
            some = some | w
        ranges = Ranges(ranges.rows(set(divided)) + _sums(rest.where(some), cell))
    first = [*ranges.first.tolist(), 1 << KEY_BITS]  # a cut at the end: nothing lies after it
    return giants, [first[int(np.searchsorted(ranges.ends, a))] for a, _ in cuts]


def shard_of(key: Column, giants: list[int], firsts: list[int]) -> Column:
    shard = F.lit(len(giants))
    for first in firsts:
        shard = shard + (key >= first).cast("int")
    for n, g in enumerate(giants):
        shard = F.when(key == g, F.lit(n)).otherwise(shard)
    return shard.cast("int")


def _numbered(rows: DataFrame, columns: list[str], order: Column) -> DataFrame:
    """The rows with ``slot``: gapless numbers in each shard, by ``order`` (uniform over KEY_BITS bits) and the columns."""
    counted = rows.groupBy(*columns, "shard").agg(F.count("*").alias("copies"))
    n = partitions(rows)
    counted = materialize(counted.withColumn("order", order).withColumn("slice", F.floor(F.col("order") / F.lit(float(1 << KEY_BITS)) * n).cast("int")), "shard-rows")
    by = counted.groupBy("slice", "shard").agg(F.sum("copies").alias("n"))  # at most n times the shards
    before = by.select("slice", "shard", (F.sum("n").over(Window.partitionBy("shard").orderBy("slice")) - F.col("n")).alias("before"))
    own = F.sum("copies").over(Window.partitionBy("slice", "shard").orderBy("order", *columns).rowsBetween(Window.unboundedPreceding, 0)) - F.col("copies")
    placed = counted.withColumn("own", own).join(before, ["slice", "shard"]).withColumn("from", F.col("before") + F.col("own"))
    few = placed.where(F.col("copies") <= CHUNK).select(*columns, "shard", F.col("from").alias("chunk"), F.lit(0).cast("long").alias("skip"), "copies")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(CHUNK).cast("long"))).alias("skip")
    many = placed.where(F.col("copies") > CHUNK).select(*columns, "shard", F.col("from").alias("chunk"), starts, "copies")
    many = many.repartition(n, "chunk", "skip")  # identical rows beyond a chunk are made by other tasks
    each = F.explode(F.sequence(F.col("skip"), F.least(F.col("skip") + CHUNK, F.col("copies")) - 1)).alias("nth")
    return few.union(many).select(*columns, "shard", "chunk", each).select(*columns, "shard", (F.col("chunk") + F.col("nth")).alias("slot"))


def sharded(documents: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), _hash60(body).alias("key"))
    rows = materialize(rows, "shard-sizes")
    groups = materialize(rows.groupBy("key").agg(F.sum("size").alias("size")), "shard-groups")
    giants, firsts = shard_plan(groups, shards)
    placed = rows.withColumn("shard", shard_of(F.col("key"), giants, firsts))
    order = _hash60(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "key"))
    found = _numbered(placed, ["doc_id", "size", "text_crc32", "key"], order)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


_TABLE = "(select list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))) order by n) from range(256) t(n))"
_CRC = """xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda h: cast('0x' || h as bigint))),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"""
_FILL = "list_reduce(list_concat([cast(0 as bigint)], range(k)), lambda x, y: list_max(list_filter(ends, lambda e: e <= x + {c})))"

ORACLE_SQL = f"""
with recursive t as materialized (select {_TABLE} as tab),
d as materialized (select row_number() over () as rid, doc_id, body, octet_length(encode(body)) + 1 as size, cast('0x' || substr(md5(body), 1, 15) as bigint) as key, {_CRC} as text_crc32
    from (select doc_id, coalesce(text, '') as body from documents), t),
g as materialized (select key, cast(sum(size) as bigint) as size from d group by key),
big as (select key, size, row_number() over (order by size desc, key) - 1 as j from g qualify j < {SHARDS} - 1),
fair as (select *, size * ({SHARDS} - j) > (select sum(size) from g) - coalesce(sum(size) over (order by j rows between unbounded preceding and 1 preceding), 0) as above from big),
giant as materialized (select key, j from fair where j < coalesce((select min(j) from fair where not above), {SHARDS})),
r as materialized (select key, size, cast(sum(size) over (order by key) as bigint) as pos from g where key not in (select key from giant)),
l as materialized (select list_concat([cast(0 as bigint)], list(pos order by pos)) as ends, coalesce(max(pos), 0) as total, {SHARDS} - (select count(*) from giant) as k from r),
search as (select (total + k - 1) // k as lo, total as hi from l
    union all select case when {_FILL.format(c="(lo + hi) // 2")} >= total then lo else (lo + hi) // 2 + 1 end, case when {_FILL.format(c="(lo + hi) // 2")} >= total then (lo + hi) // 2 else hi end
    from search, l where lo < hi),
cap as materialized (select lo as c from search where lo = hi),
need as (select k as i, total as pos from l
    union all select i - 1, list_min(list_filter(ends, lambda e: e >= pos - c)) from need, l, cap where i > 1),
cut as (select cast(0 as bigint) as i, cast(0 as bigint) as pos
    union all select i + 1, greatest(low, least(case when aim - f <= n - aim then f else n end, most)) from (
        select cut.i as i, total * (cut.i + 1) // k as aim, list_max(list_filter(ends, lambda e: e <= total * (cut.i + 1) // k)) as f, list_min(list_filter(ends, lambda e: e >= total * (cut.i + 1) // k)) as n,
            list_max(list_filter(ends, lambda e: e <= cut.pos + c)) as most, need.pos as low
        from cut, l, cap, need where need.i = cut.i + 1 and cut.i + 1 < k)),
s as (select key, cast((select count(*) from giant) + (select count(*) from cut where i > 0 and cut.pos <= r.pos - r.size) as integer) as shard from r union all select key, cast(j as integer) from giant),
o as (select d.*, s.shard, cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'null') || ':' || d.key), 1, 15) as bigint) as h from d join s on d.key = s.key)
select doc_id, size, text_crc32, 'bytes' as law, shard, row_number() over (partition by shard order by h, doc_id nulls first, size, text_crc32, key) - 1 as slot, cast(null as integer) as grown_shard from o"""
