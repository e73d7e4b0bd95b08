"""Tolerant as-of join: the latest order at or before a time, at most a tolerance earlier.

Time is cut into buckets as wide as the tolerance. An order goes into its own bucket and into the next one,
so whatever a click can match lies in the click's bucket: an equi join on client and bucket, an exact
filter on the times, and ``row_number`` in the order of ties leave one order for each click.

Two things keep a group small, however the rows are spread:

* orders of one client at one time are one row (the first in the order of ties, and their number), and so are clicks of one
  client and time, made before anything is joined; the answers go back to the clicks by client and time;
* a bucket of more than ``MOST`` times is split into ``FAN`` narrower ones, again and again while it has to
  be. The last order before a narrower bucket goes into it too, as the replicas do on the first level, and
  a click whose bucket was split meets one marker, which sends it to the narrower bucket of its time.

So a click meets at most ``MOST`` orders on the level where its bucket is whole, and one marker on each level above;
levels are at most log(tolerance in microseconds) to the base ``FAN``, 9 for 30 days. The rows made by a split are at most
``FAN`` a bucket of more than ``MOST`` rows, so they grow with the orders. Nothing is
collected but whether any bucket was split, and nothing is broadcast: the joins are merge joins, whose hot keys Spark splits.

Defined results: a null client or time, on either side, never matches, and such a click is returned unmatched;
copies of a click count once (of copies that differ, the latest time, then the largest client); a null click_id is an id like
any other, and is not floored; repeated sales are orders of their own; a sale without an id makes one order, which is not floored;
a total that is null or not finite counts as null; an empty table of clicks gives no rows, one of sales leaves all
clicks unmatched; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelake.session import materialize

HOUR = 3_600_000_000
TOLERANCE = 720 * HOUR
GRAIN = 6 * HOUR
MOST = 32
FAN = 32


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 of a timestamp; one without a zone is read as UTC, whatever the session's zone."""
    at = F.col(f"`{column}`")
    if df.schema[column].dataType.typeName() != "timestamp_ntz":
        return F.unix_micros(at)
    seconds = F.hour(at).cast("long") * 3600 + F.minute(at) * 60
    return F.unix_date(at.cast("date")).cast("long") * (24 * HOUR) + seconds * 1_000_000 + (F.expr(f"extract(second from `{column}`)") * 1_000_000).cast("long")


def _floored(at: Column, h: Column, grain: int) -> Column:
    return F.when(h % 2 == 1, at - F.pmod(at, F.lit(grain))).otherwise(at)


def _tied(orders: DataFrame, ties: list[str]) -> DataFrame:
    """key, o: one row for each key and time, the first in the order of ties, with the number of all."""
    best = F.max(F.struct(*ties)).alias("best")  # nulls are smallest, so they lose
    rows = orders.where("key is not null and at is not null").groupBy("key", "at").agg(best, F.count("*").alias("n_tied"))
    return rows.select("key", F.struct("at", *(F.col(f"best.{c}").alias(c) for c in ties), "n_tied").alias("o"))


def _narrower(rows: DataFrame, width: int, fan: int) -> DataFrame:
    """The rows of split buckets in buckets of ``width``: each in its own, and the last before a bucket in that one too."""
    sub = F.greatest(F.floor((F.col("o.at") - F.col("start")) / F.lit(width)), F.lit(-1)).cast("long")  # -1: before the bucket
    dealt = rows.select("key", "start", sub.alias("sub"), "o")
    own = dealt.where("sub >= 0").select("key", (F.col("start") + F.col("sub") * F.lit(width)).alias("start"), "o")
    last = dealt.groupBy("key", "start", "sub").agg(F.max("o").alias("o"))
    # fan + 1 entries at most
    lists = last.groupBy("key", "start").agg(F.collect_list(F.struct("sub", "o")).alias("lasts"))
    before = F.array_max(F.filter("lasts", lambda x: x["sub"] < F.col("sub")))
    carried = lists.select("key", "start", "lasts", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(fan - 1).cast("long"))).alias("sub")).select("key", (F.col("start") + F.col("sub") * F.lit(width)).alias("start"), before["o"].alias("o"))
    return own.union(carried.where("o is not null"))


def tolerant_asof(asks: DataFrame, orders: DataFrame, ties: list[str], tolerance: int = TOLERANCE, most: int = MOST, fan: int = FAN) -> DataFrame:
    """ask, key, at, o: for each row of ``asks`` (ask, key, at) the struct ``o`` (at, the columns ``ties``, n_tied) of its
    order, or null. ``orders``: key, at and the columns ``ties``, the largest of which wins among equal times, the first column first."""
    asks = materialize(asks.select("ask", "key", "at"), "asof-asks")
    whole = asks.where("key is not null and at is not null")
    tied = materialize(_tied(orders, ties), "asof-orders")
    none = asks.where("key is null or at is null").withColumn("o", F.lit(None).cast(tied.schema["o"].dataType))
    own = F.col("o.at") - F.pmod(F.col("o.at"), F.lit(tolerance))
    rows = tied.select("key", F.explode(F.array(own, own + tolerance)).alias("start"), "o")
    at = F.col("at")
    asked = whole.select("key", "at").distinct().withColumn("start", at - F.pmod(at, F.lit(tolerance)))
    width, found = tolerance, []
    while True:
        counts = rows.groupBy("key", "start").count()
        split = materialize(counts.where(F.col("count") > most).select("key", "start", F.lit(True).alias("split")), "asof-split")
        last = width == 1 or split.isEmpty()
        marked = rows.withColumn("split", F.lit(None).cast("boolean")) if last else materialize(rows.join(split.hint("merge"), ["key", "start"], "left"), "asof-rows")
        targets = marked.where("split is null")
        if not last:
            targets = targets.unionByName(split, allowMissingColumns=True)
        t = targets.select(F.col("key").alias("t_key"), F.col("start").alias("t_start"), "o", "split").hint("merge")
        fits = F.col("split") | ((F.col("o.at") <= at) & (F.col("o.at") >= at - tolerance))
        pairs = asked.join(t, (F.col("key") == F.col("t_key")) & (F.col("start") == F.col("t_start")) & fits, "left")
        first = F.row_number().over(Window.partitionBy("key", "at").orderBy(F.col("o").desc_nulls_last()))
        best = pairs.select("key", "at", "start", "o", "split", first.alias("nth")).where("nth = 1")
        if last:
            found.append(best.select("key", "at", "o"))
            break
        best = materialize(best, "asof-level")
        found.append(best.where("split is null").select("key", "at", "o"))
        width = -(-width // fan)
        asked = best.where("split").select("key", "at", (F.col("start") + F.floor((at - F.col("start")) / F.lit(width)) * F.lit(width)).alias("start"))
        rows = materialize(_narrower(marked.where("split"), width, fan), "asof-rows")
    answers = reduce(DataFrame.union, found).hint("merge")
    return whole.join(answers, ["key", "at"], "left").select("ask", "key", "at", "o").union(none)


def clicks_once(clicks: DataFrame) -> DataFrame:
    """ask, key, at: one row for each click_id; times of odd hashes floored."""
    rows = clicks.select(F.col("click_id").cast("long").alias("ask"), F.struct(micros(clicks, "ts").alias("at"), F.col("client_id").cast("long").alias("key")).alias("row"))
    once = rows.groupBy("ask").agg(F.max("row").alias("row"))
    return once.select("ask", "row.key", _floored(F.col("row.at"), F.crc32(F.col("ask").cast("string")), GRAIN).alias("at"))


def orders_of(sales: DataFrame) -> DataFrame:
    """key, at, total_cents, sale_id: the orders of all sales, with their second ones."""
    total = F.col("total").cast("double")
    cents = F.when(~F.isnan(total) & (F.abs(total) < float("inf")), F.floor(100 * total + 0.5)).cast("long")
    rows = sales.select(F.col("client_id").cast("long").alias("key"), F.col("sale_id").cast("long").alias("id"), F.crc32(F.col("sale_id").cast("bigint").cast("string")).alias("h"), micros(sales, "sold_at").alias("at"), cents.alias("total_cents"))
    ids = F.when(F.col("h") % 3 != 0, F.array("id", -1 - F.col("id"))).otherwise(F.array("id"))
    return rows.select("key", _floored(F.col("at"), F.col("h"), GRAIN).alias("at"), "total_cents", F.explode(ids).alias("sale_id"))


def click_orders(clicks: DataFrame, sales: DataFrame) -> DataFrame:
    """click_id, client_id, ts_us, sale_id, lag_us, total_cents, n_tied of every click."""
    rows = tolerant_asof(clicks_once(clicks), orders_of(sales), ["total_cents", "sale_id"])
    return rows.select(
        F.col("ask").alias("click_id"),
        F.col("key").alias("client_id"),
        F.col("at").alias("ts_us"),
        "o.sale_id",
        (F.col("at") - F.col("o.at")).alias("lag_us"),
        "o.total_cents",
        F.coalesce("o.n_tied", F.lit(0)).cast("long").alias("n_tied"),
    )


def _crc32(column: str) -> str:
    """The unsigned CRC-32 of a long's decimal digits, bit by bit."""
    digits = f"list_transform(string_split(cast({column} as varchar), ''), lambda d: cast(ord(d) as bigint))"
    step = "lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_concat([4294967295], {digits}), {step}), 4294967295)"


ORACLE_SQL = f"""
with c as (select click_id, max(struct_pack(us := epoch_us(ts), client_id := client_id)) as r, {_crc32("click_id")} as h from clicks group by click_id),
a as (select click_id, r.client_id as client_id, case when h % 2 = 1 then r.us - ((r.us % {GRAIN}) + {GRAIN}) % {GRAIN} else r.us end as ts_us from c),
s as (select client_id, sale_id, epoch_us(sold_at) as us, {_crc32("sale_id")} as h,
    case when isfinite(total) then cast(floor(100 * total + 0.5) as bigint) end as total_cents from sales),
f as (select client_id, sale_id, h, total_cents, case when h % 2 = 1 then us - ((us % {GRAIN}) + {GRAIN}) % {GRAIN} else us end as us from s),
o as (select client_id, us, total_cents, sale_id from f union all select client_id, us, total_cents, -1 - sale_id from f where h % 3 <> 0),
b as (select *, count(*) over (partition by client_id, us) as n_tied from o where client_id is not null and us is not null
    qualify row_number() over (partition by client_id, us order by total_cents desc nulls last, sale_id desc nulls last) = 1),
m as (select a.click_id, a.client_id, a.ts_us, b.sale_id, a.ts_us - b.us as lag_us, b.total_cents, b.n_tied
    from a asof left join b on a.client_id = b.client_id and a.ts_us >= b.us)
select click_id, client_id, ts_us, case when lag_us <= {TOLERANCE} then sale_id end as sale_id, case when lag_us <= {TOLERANCE} then lag_us end as lag_us,
    case when lag_us <= {TOLERANCE} then total_cents end as total_cents, case when lag_us <= {TOLERANCE} then n_tied else 0 end as n_tied from m"""
