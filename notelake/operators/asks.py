"""Ask log, coverage, staleness, weekly trend, budget and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notelake.functions.dates import days_overdue, index_stale, recall_stale

KEPT_WEEKS = 12
MINUTES_SAVED = 15


def topics(asks: DataFrame, slugs: DataFrame) -> DataFrame:
    """topic, asked, written: only events of kind ask with a topic count."""
    counted = asks.where((F.col("event") == "ask") & (F.coalesce("topic", F.lit("")) != "")).groupBy("topic").agg(F.count("*").alias("asked"))
    known = slugs.select(F.col("slug").alias("topic")).distinct().withColumn("w", F.lit(True))
    return counted.join(known, "topic", "left").select("topic", "asked", F.coalesce("w", F.lit(False)).alias("written"))


def hit_rate(asked: DataFrame) -> DataFrame:
    """One row: asked, hits, hit_rate in percent (0 without asks), minutes saved."""
    total = asked.agg(F.coalesce(F.sum("asked"), F.lit(0)).alias("asked"), F.coalesce(F.sum(F.when(F.col("written"), F.col("asked"))), F.lit(0)).alias("hits"))
    return total.select("asked", "hits", F.when(F.col("asked") > 0, 100.0 * F.col("hits") / F.col("asked")).otherwise(F.lit(0.0)).alias("hit_rate"), (F.col("hits") * MINUTES_SAVED).alias("minutes_saved"))


def gaps(asked: DataFrame, least: int = 2) -> DataFrame:
    return asked.where(~F.col("written") & (F.col("asked") >= least)).select("topic", "asked")


def staleness(notes: DataFrame, asked: DataFrame, now_s: int) -> DataFrame:
    """slug, days_overdue, asks, score: days times asks if any ask exists, else days. notes: slug, verified_s, freshness_days."""
    over = notes.withColumn("days_overdue", days_overdue(F.col("verified_s"), F.col("freshness_days"), F.lit(now_s))).where("days_overdue is not null")
    any_ask = F.broadcast(asked.agg(F.coalesce(F.max("asked"), F.lit(0)).alias("most")))  # one row
    rows = over.join(asked.select(F.col("topic").alias("slug"), "asked"), "slug", "left").crossJoin(any_ask).withColumn("asks", F.coalesce("asked", F.lit(0)))
    return rows.select("slug", "days_overdue", "asks", F.when(F.col("most") > 0, F.col("asks") * F.col("days_overdue")).otherwise(F.col("days_overdue")).alias("score"))


def stale_flags(notes: DataFrame, now_s: int) -> DataFrame:
    """rel, for_recall, for_index. notes: rel, verified, updated (text), verified_s, freshness_days."""
    return notes.select(
        "rel", recall_stale(F.col("verified"), F.col("updated"), F.col("freshness_days"), F.lit(now_s)).alias("for_recall"), index_stale(F.col("verified_s"), F.col("freshness_days"), F.lit(now_s)).alias("for_index")
    )


def coverage(notes: DataFrame, vocabulary: DataFrame, column: str) -> DataFrame:
    """word, notes: every word of the vocabulary, zero where nothing carries it."""
    counted = notes.select(F.explode(F.array_distinct(column)).alias("word")).groupBy("word").agg(F.count("*").alias("notes"))
    return vocabulary.join(counted, "word", "left").select("word", F.coalesce("notes", F.lit(0)).alias("notes"))


def weekly(stats: DataFrame, measures: list[str], keep: int = KEPT_WEEKS) -> DataFrame:
    """The last weeks with the change of each measure since the week recorded before (gaps allowed)."""
    order = Window.orderBy("week")  # a row a week: a few hundred rows in a lifetime
    rows = stats.select("week", *measures, *((F.col(m) - F.lag(m).over(order)).alias(f"{m}_delta") for m in measures), F.row_number().over(Window.orderBy(F.col("week").desc())).alias("age"))
    return rows.where(F.col("age") <= keep).drop("age")


def week_row(notes: DataFrame, asked: DataFrame, graded: DataFrame, findings: DataFrame) -> DataFrame:
    """One row, the measures of a week: notes, hit_rate, orphans, drift (notes with a broken or suspect citation).

    notes: rel; asked: as of :func:`topics`; graded: rel, is_orphan; findings: note, verdict.
    """
    orphans = graded.where("is_orphan").agg(F.count("*").alias("orphans"))
    drift = findings.where("verdict in ('broken', 'suspect')").agg(F.count_distinct("note").alias("drift"))
    return notes.agg(F.count("*").alias("notes")).crossJoin(hit_rate(asked).select("hit_rate")).crossJoin(orphans).crossJoin(drift)  # one row each


def remaining(spent: DataFrame, caps: DataFrame, day: str) -> DataFrame:
    """tier, spent, cap, remaining on a day, for tiers that have either."""
    today = spent.where(F.col("day") == day).groupBy("tier").agg(F.sum("usd").alias("usd"))
    both = today.join(caps, "tier", "full_outer")
    return both.select("tier", F.coalesce("usd", F.lit(0.0)).alias("spent"), F.coalesce("cap", F.lit(0.0)).alias("cap"), (F.coalesce("cap", F.lit(0.0)) - F.coalesce("usd", F.lit(0.0))).alias("remaining"))


def route(chains: DataFrame, left: DataFrame, present: DataFrame, locked: list[str]) -> DataFrame:
    """stage, engine, exhausted: the first available candidate, none if there is none; locked stages get none.

    chains: stage, chain; left: tier, remaining; present: engine (installed). api and advisor are metered.
    """
    metered = F.col("engine").isin("api", "advisor")
    rows = chains.select("stage", F.posexplode("chain").alias("pos", "engine")).join(left.select(F.col("tier").alias("engine"), "remaining"), "engine", "left")
    rows = rows.join(present.select("engine", F.lit(True).alias("here")), "engine", "left")
    ok = (F.col("engine") == "none") | (F.coalesce("here", F.lit(False)) & (~metered | (F.coalesce("remaining", F.lit(0.0)) > 0)))
    picked = rows.withColumn("ok", ok).groupBy("stage").agg(F.min_by(F.when(F.col("ok"), F.col("engine")), F.when(F.col("ok"), F.col("pos"))).alias("engine"), F.bool_or(metered & ~F.col("ok")).alias("exhausted"))
    return picked.select("stage", F.when(F.col("stage").isin(locked), "none").otherwise(F.coalesce("engine", F.lit("none"))).alias("engine"), (F.col("exhausted") & ~F.col("stage").isin(locked)).alias("exhausted"))
