"""Structured Streaming forms of what the engine recomputes: each equals its batch form on the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.functions.text import conclusions, short_hash
from notelake.operators.index_store import BUCKETS, IndexStore
from notelake.sources.logs import ASK


def ask_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """The append-only ask log as it grows."""
    return spark.readStream.schema(ASK).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def topic_counts(asks: DataFrame) -> DataFrame:
    """topic, asked; the state is a row for each topic. For update or complete mode."""
    return asks.where("event = 'ask' and coalesce(topic, '') <> ''").groupBy("topic").agg(F.count("*").alias("asked"))


def weekly_topics(asks: DataFrame, delay: str = "2 days") -> DataFrame:
    """week, topic, asked in weeks that start on Monday; a week is final once the watermark passes its end."""
    rows = asks.where("event = 'ask' and coalesce(topic, '') <> ''").withWatermark("ts", delay)
    return rows.groupBy(F.window("ts", "7 days", startTime="4 days").alias("w"), "topic").agg(F.count("*").alias("asked")).select(F.col("w.start").alias("week"), "topic", "asked")


def new_conclusions(texts: DataFrame, delay: str = "7 days") -> DataFrame:
    """session_id, hash, conclusion, ts: each conclusion of a session once. texts: session_id, ts, text.

    State is dropped a watermark after the last duplicate could come.
    """
    found = texts.withWatermark("ts", delay).select("session_id", "ts", F.explode(conclusions(F.col("text"))).alias("conclusion")).where("conclusion <> ''")
    return found.withColumn("hash", short_hash(F.col("conclusion"), 16)).dropDuplicatesWithinWatermark(["session_id", "hash"])


def edits_within(added: DataFrame, edits: DataFrame, days: int = 7) -> DataFrame:
    """key, added_ts, edited_ts: edits up to ``days`` after the addition. Both sides expire by watermark."""
    a = added.withWatermark("added_ts", f"{days} days").alias("a")
    e = edits.withWatermark("edited_ts", f"{days} days").alias("e")
    return a.join(e, F.expr(f"a.key = e.key and e.edited_ts between a.added_ts and a.added_ts + interval {days} days")).select("a.key", "added_ts", "edited_ts")


def note_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """rel, mtime, size, body of notes as they come: the file name within its folder, its time and its size."""
    rows = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    rel = F.element_at(F.split("path", "/"), -1)
    return rows.select(rel.alias("rel"), F.unix_millis("modificationTime").alias("mtime"), F.col("length").alias("size"), F.decode("content", "utf-8").alias("body"))


def upsert(path: str, key: str, order: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: of each key the row with the largest ``order`` wins, in a batch and against what is stored.

    Rows lie in an :class:`IndexStore`, so a batch writes the buckets it touches and is seen at once or not at all; a batch that is run
    again makes no version.
    """

    def put(batch: DataFrame, epoch: int) -> None:
        IndexStore(batch.sparkSession, path, key, buckets, order).patch(batch, epoch=epoch)

    return put
