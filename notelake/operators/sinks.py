"""Writers: keyed upserts and pruning of tables, managed blocks in texts, unique slugs, files written only if changed."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notelake.functions.text import slug
from notelake.operators.ledger import running_total
from notelake.operators.timeline import last_before
from notelake.session import materialize


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those of their key; the rest of ``old`` stays."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def pruned(rows: DataFrame, live: DataFrame, key: str) -> DataFrame:
    return rows.join(live.select(key).distinct(), key, "left_semi")


def child_rows(notes: DataFrame, key: str, column: str) -> DataFrame:
    """One row for each element of a list column, without repeats."""
    return notes.select(key, F.explode(F.array_distinct(column)).alias("value"))


def with_lists(notes: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """The list column put together again; children without a note are dropped, notes without children get an empty list."""
    lists = children.groupBy(key).agg(F.sort_array(F.collect_set("value")).alias(name))
    return notes.join(lists, key, "left").withColumn(name, F.coalesce(name, F.expr("cast(array() as array<string>)")))


def put_block(text: Column, begin: str, end: str, body: Column, before: Column | None = None) -> Column:
    """The text with the lines between the marker lines replaced, or the block added before a line (from 1), else at the end."""
    lines = F.split(text, "\n")
    b, e = F.array_position(lines, begin).cast("int"), F.array_position(lines, end).cast("int")
    block = F.concat(F.array(F.lit(begin)), F.split(body, "\n"), F.array(F.lit(end)))
    inside = F.concat(F.slice(lines, F.lit(1), b - 1), block, F.slice(lines, e + 1, F.size(lines)))
    if before is None:
        added = F.concat(F.when(F.get(lines, F.size(lines) - 1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines), block, F.array(F.lit("")))
    else:
        added = F.concat(F.slice(lines, F.lit(1), before - 1), block, F.slice(lines, before, F.size(lines)))
    return F.array_join(F.when((b > 0) & (e > b), inside).otherwise(added), "\n")


def drop_block(text: Column, begin: str, end: str) -> Column:
    lines = F.split(text, "\n")
    b, e = F.array_position(lines, begin).cast("int"), F.array_position(lines, end).cast("int")
    return F.when((b > 0) & (e > b), F.array_join(F.concat(F.slice(lines, F.lit(1), b - 1), F.slice(lines, e + 1, F.size(lines))), "\n")).otherwise(text)


def unique_slugs(titles: DataFrame, taken: DataFrame) -> DataFrame:
    """title, slug: the slug, or the first of slug-2, slug-3, ... that is free; equal titles follow each other.

    What another title of the batch is itself called is not given out as a number either. A base that most titles have, as ``untitled``, is no
    single sort: equal titles are counted first, a base's titles are numbered by shares of a hash, and the k-th free number is looked up among
    the counts of free numbers before each used one.
    """
    wanted = titles.select("title", F.coalesce(F.nullif(slug(F.col("title")), F.lit("")), F.lit("untitled")).alias("base"))
    counted = materialize(wanted.groupBy("base", "title").agg(F.count("*").alias("copies")), "slugs")
    shared = counted.withColumn("share", F.substring(F.md5(F.coalesce("title", F.lit(""))), 1, 2))
    shares = shared.groupBy("base", "share").agg(F.sum("copies").alias("n"))
    before = F.sum("n").over(Window.partitionBy("base").orderBy("share")) - F.col("n")  # 256 rows a base
    own = F.sum("copies").over(Window.partitionBy("base", "share").orderBy("title").rowsBetween(Window.unboundedPreceding, 0)) - F.col("copies")
    placed = shared.withColumn("own", own).join(shares.select("base", "share", before.alias("before")), ["base", "share"]).withColumn("from", F.col("own") + F.col("before"))
    pieces = placed.select("base", "title", "from", "copies", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(1000).cast("long"))).alias("skip")).repartition("base", "from", "skip")
    turns = pieces.select("base", "title", F.explode(F.sequence(F.col("skip"), F.least(F.col("skip") + 1000, F.col("copies")) - 1)).alias("at"), "from").select("base", "title", (F.col("from") + F.col("at") + 1).alias("turn"))

    every = taken.select("slug").union(counted.select("base")).distinct()
    numbers = every.select(F.regexp_replace("slug", "-[0-9]{1,9}$", "").alias("base"), F.regexp_extract("slug", "-([0-9]{1,9})$", 1).try_cast("long").alias("n")).where("n >= 2").distinct()
    ranked = running_total(numbers.withColumn("one", F.lit(1).cast("long")), ["base"], ["n"], "one")
    free_before = ranked.select("base", (F.col("n") - 1 - F.col("total")).alias("k"), F.col("total").alias("value"))
    exact = taken.select(F.col("slug").alias("base")).distinct().withColumn("used", F.lit(True))
    rows = turns.join(exact, "base", "left").withColumn("k", F.col("turn") + F.when(F.col("used"), 1).otherwise(0) - 2)  # free numbers before this one
    found = last_before(rows.where("k >= 0").select("base", "k"), free_before, ["base"], "k")
    named = rows.join(found, ["base", "k"], "left")
    return named.select("title", F.when(F.col("k") < 0, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("k") + 2 + F.coalesce("value", F.lit(0)))).alias("slug"))


def fragments(files: DataFrame, begin: str, end: str) -> DataFrame:
    """dir, text: a managed block for every directory with its cited files. files: dir, file, slugs array<string>, text (of the directory's document, '' if none)."""
    lines = F.array_sort(F.collect_list(F.concat(F.lit("- `"), "file", F.lit("`: "), F.array_join("slugs", ", "))))
    grouped = files.groupBy("dir").agg(F.first("text").alias("text"), F.array_join(lines, "\n").alias("body"))
    return grouped.select("dir", put_block(F.col("text"), begin, end, F.col("body")).alias("text"))


def write_if_changed(path: str, text: str) -> bool:
    """For reports on the driver: an unchanged file is left alone."""
    file, data = Path(path), text.encode()
    if file.exists() and file.read_bytes() == data:
        return False
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_bytes(data)
    return True


def write_all_or_nothing(rows: DataFrame, path: str, error: str) -> None:
    """Write ``rows`` only if none of them has an error: a scrub or an export that fails leaves nothing."""
    bad = rows.where(F.col(error).isNotNull()).select(error).limit(3).collect()
    if bad:
        raise ValueError("nothing was written: " + "; ".join(r[0] for r in bad))
    rows.drop(error).write.mode("errorifexists").parquet(path)


def read_generation(spark: SparkSession, path: str, version: int) -> DataFrame | None:
    """A cached index of the wanted version, or None; another version is a miss."""
    try:
        found = spark.read.parquet(path).where(F.col("version") == version)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return None if found.isEmpty() else found.drop("version")
