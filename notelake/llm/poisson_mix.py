"""Mixing sources to target weights by Poisson replication.

A source with share s of all documents and target weight w (weights sum to one) has the mean repetition
rate w / s times the budget, as a part of the documents. Each document gets a count by inverting the
Poisson distribution of that rate at a number in [0, 1) drawn from a seeded hash of its id, so the mix is
the same on every run, on every partitioning, and whatever else is in the table. Rates above ``PIECE`` are
sums of several draws. Documents are repeated by their counts and shuffled globally: sorted by a hash of
seed, id and copy, over range partitions.

The statistics of sources are one row for each source; they are broadcast only where they are few, and
joined with salted keys beyond that. Targets not named are in proportion to size ** ``temperature``, so
that small sources are repeated and large ones thinned.

Defined results: a null source is a source of its own; a null id is drawn as the id 'null'; repeated rows
get equal counts and stay repeated; a source in the targets that has no documents is skipped and the rest
is scaled; a target of zero removes its source; an empty table gives no rows; all columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.session import partitions

PIECE = 16.0
#: Past so many counts the Poisson tail at rate PIECE is below 2**-52.
MOST = 80
SEED = 17
MOST_BROADCAST = 10_000
SALTS = 32
TEMPERATURE = 0.7


def _hash52(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long")


def rates(documents: DataFrame, targets: dict[str, float] | None = None, temperature: float = TEMPERATURE, budget: float = 1.0, source: str = "source") -> DataFrame:
    """source, n, rate, draws, cdf: one row for each source."""
    sizes = documents.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"))
    if targets:
        pairs = F.create_map(*(x for k, v in targets.items() for x in (F.lit(k), F.lit(float(v)))))
        wish = F.coalesce(F.try_element_at(pairs, F.coalesce("source", F.lit(""))), F.lit(0.0))
    else:
        wish = F.pow(F.col("n").cast("double"), F.lit(temperature))
    wished = sizes.withColumn("wish", wish)
    total = wished.agg(F.sum("n").alias("n"), F.sum(F.round("wish", 9).cast("decimal(38,9)")).cast("double").alias("wish")).first()
    all_n, all_wish = total["n"] or 0, total["wish"] or 0.0
    rate = F.lit(budget) * F.lit(float(all_n)) * F.round("wish", 9) / F.lit(all_wish) / F.col("n") if all_wish > 0 else F.lit(0.0)
    drawn = wished.withColumn("rate", rate).withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / PIECE)).cast("int")).withColumn("each", F.col("rate") / F.col("draws"))
    start = F.struct(F.exp(-F.col("each")).alias("p"), F.array(F.exp(-F.col("each"))).alias("cdf"))
    grown = F.aggregate(
        F.sequence(F.lit(1), F.lit(MOST)),
        start,
        lambda a, k: F.struct((a["p"] * F.col("each") / k).alias("p"), F.array_append(a["cdf"], F.element_at(a["cdf"], -1) + a["p"] * F.col("each") / k).alias("cdf")),
    )
    return drawn.select("source", "n", "rate", "draws", grown["cdf"].alias("cdf"))


def counted(documents: DataFrame, rated: DataFrame, seed: int = SEED, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """``documents`` with its columns in ``row`` and the count of each row."""
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"), key.alias("key"), F.col(source).alias("src"))
    if rated.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        joined = rows.join(F.broadcast(rated), rows["src"].eqNullSafe(rated["source"]))
    else:
        salted = rated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("at", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
        joined = joined.join(salted, joined["src"].eqNullSafe(salted["source"]) & (joined["at"] == salted["salt"]))
    drawn = lambda k: _hash52(F.lit(seed).cast("string"), F.col("key"), k.cast("string")).cast("double") / float(2**52)
    # the numbers are drawn once each, outside the lambda that compares them with the distribution
    numbers = F.transform(F.sequence(F.lit(1), F.col("draws")), drawn)
    return joined.select("row", "key", F.aggregate(numbers, F.lit(0), lambda a, u: a + F.size(F.filter("cdf", lambda c: c <= u))).alias("count"))


def mix(documents: DataFrame, targets: dict[str, float] | None = None, temperature: float = TEMPERATURE, budget: float = 1.0, seed: int = SEED, doc_id: str = "doc_id", source: str = "source", shuffle: bool = True) -> DataFrame:
    """row (all columns), copy (from 0) and order_key; with ``shuffle`` in the order of order_key over all partitions."""
    copies = counted(documents, rates(documents, targets, temperature, budget, source), seed, doc_id, source).where("count > 0")
    copies = copies.select("row", "key", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("copy"))
    copies = copies.select("row", "copy", _hash52(F.lit(seed).cast("string"), F.lit("order"), F.col("key"), F.col("copy").cast("string")).alias("order_key"))
    if not shuffle:
        return copies
    # order keys are uniform, so even cuts of their range are even partitions, and none is sampled
    n = partitions(documents)
    return copies.repartitionById(n, F.floor(F.col("order_key") / float(2**52) * n).cast("int")).sortWithinPartitions("order_key")


def mixture(documents: DataFrame) -> DataFrame:
    """doc_id, source, copy, order_key, text_sha256 of the mixed corpus; the texts are shuffled with their rows."""
    rows = mix(documents.select("doc_id", "source", "text"))
    return rows.select("row.doc_id", "row.source", "copy", "order_key", F.sha2(F.coalesce("row.text", F.lit("")), 256).alias("text_sha256"))


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """The columns of ``documents``, rows repeated and shuffled."""
    return mix(documents, **options).select("row.*")


ORACLE_SQL = f"""
with s as (select source, count(*) as n, round(pow(cast(count(*) as double), {TEMPERATURE}), 9) as wish from documents group by source),
t as (select sum(n) as all_n, cast(sum(cast(wish as decimal(38, 9))) as double) as all_wish from s),
r as (select source, cast(all_n as double) * wish / all_wish / n as rate from s, t),
e as (select source, rate, cast(greatest(1, ceil(rate / {PIECE})) as integer) as draws from r),
d as (select row_number() over () as rid, doc_id, documents.source, sha256(coalesce(text, '')) as text_sha256, rate / draws as each, unnest(range(1, draws + 1)) as k
    from documents join e on documents.source is not distinct from e.source),
u as (select *, cast(concat('0x', substr(md5({SEED} || ':' || coalesce(cast(doc_id as varchar), 'null') || ':' || k), 1, 13)) as bigint) / 4503599627370496.0 as x from d),
c as (select rid, doc_id, source, text_sha256, sum(len(list_filter(list_transform(range(0, {MOST + 1}),
        lambda i: exp(-each) * list_sum(list_transform(range(0, i + 1), lambda j: pow(each, j) / gamma(j + 1)))), lambda v: v <= x))) as n
    from u group by all),
o as (select doc_id, source, text_sha256, unnest(range(0, cast(n as bigint))) as copy from c)
select doc_id, source, text_sha256, cast(copy as integer) as copy,
    cast(concat('0x', substr(md5({SEED} || ':order:' || coalesce(cast(doc_id as varchar), 'null') || ':' || copy), 1, 13)) as bigint) as order_key from o"""
