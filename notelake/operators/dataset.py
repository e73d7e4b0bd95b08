"""Training sets from captured records: interval joins, anonymised exports, tier statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.functions.redact import redacted

WINDOW_S = 7 * 86_400
# Which formats each tier can be exported in.
FORMATS = {"d1": ("sft", "csv"), "d2": ("sft",), "d3": ("sft", "dpo"), "d4": ("sft", "dpo"), "d5": ("sft",)}


def edits_within(added: DataFrame, edits: DataFrame, window_s: int = WINDOW_S) -> DataFrame:
    """key, added_s, edited_s: edits from 0 to ``window_s`` after the addition of their key.

    The interval is folded into an equi join on (key, bucket): an edit meets the additions of its own and
    the previous window only.
    """
    a = added.select("key", "added_s", F.explode(F.array(F.floor(F.col("added_s") / window_s), F.floor(F.col("added_s") / window_s) + 1)).alias("bucket"))
    e = edits.select("key", "edited_s", F.floor(F.col("edited_s") / window_s).alias("bucket"))
    return a.join(e, ["key", "bucket"]).where((F.col("edited_s") >= F.col("added_s")) & (F.col("edited_s") - F.col("added_s") <= window_s)).select("key", "added_s", "edited_s")


def sft(records: DataFrame, prompt: Column, completion: Column) -> DataFrame:
    """id, line, redactions: one JSON line for each record, redacted for export."""
    p, n = redacted(prompt, urls=True)
    q, m = redacted(completion, urls=True)
    return records.select("id", F.to_json(F.struct(p.alias("prompt"), q.alias("completion"))).alias("line"), (n + m).cast("long").alias("redactions"))


def dpo(records: DataFrame, prompt: Column, chosen: Column, rejected: Column) -> DataFrame:
    p, a = redacted(prompt, urls=True)
    c, b = redacted(chosen, urls=True)
    r, d = redacted(rejected, urls=True)
    return records.select("id", F.to_json(F.struct(p.alias("prompt"), c.alias("chosen"), r.alias("rejected"))).alias("line"), (a + b + d).cast("long").alias("redactions"))


def csv(records: DataFrame) -> DataFrame:
    """topic, stack (blank-joined), top_score (3 places), candidates, decision as one CSV line."""
    quoted = lambda x: F.when(x.rlike(r'[",\n\r]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)
    cells = [F.coalesce("topic", F.lit("")), F.concat_ws(" ", "stack"), F.format_string("%.3f", "top_score"), F.col("candidates").cast("string"), F.coalesce("decision", F.lit(""))]
    return records.select("id", F.concat_ws(",", *map(quoted, cells)).alias("line"))


def check_format(tier: str, kind: str) -> None:
    if kind not in FORMATS.get(tier, ()):
        raise ValueError(f"{tier} has no export as {kind}")


# The volumes at which more can be done with a tier; pairs for distillation have a third.
LADDERS = {"d1": (100, 1000), "d2": (100, 1000, 10_000), "d3": (100, 1000, 10_000), "d4": (100, 1000), "d5": (100, 1000)}


def band(tier: Column, n: Column) -> Column:
    """under-100, under-1000, under-10000 or over, by the ladder of the tier; empty for other tiers."""
    found = F.lit("")
    for name, steps in LADDERS.items():
        of = F.lit("over")
        for step in reversed(steps):
            of = F.when(n < step, f"under-{step}").otherwise(of)
        found = F.when(tier == name, of).otherwise(found)
    return found


def tier_stats(records: DataFrame) -> DataFrame:
    """tier, n, first, last (stamps of zero do not count), band by the tier's own ladder. records: tier, stamp_s."""
    stamped = F.when(F.col("stamp_s") > 0, F.col("stamp_s"))
    counted = records.groupBy("tier").agg(F.count("*").alias("n"), F.min(stamped).alias("first"), F.max(stamped).alias("last"))
    return counted.withColumn("band", band(F.col("tier"), F.col("n")))


def distribution(records: DataFrame, column: str) -> DataFrame:
    """value, n, biased: a top share of 60 percent or more (whole percents) marks a bias."""
    counted = records.select(F.explode(column).alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    total = F.broadcast(counted.agg(F.sum("n").alias("total"), F.max("n").alias("top")))  # one row
    return counted.crossJoin(total).select("value", "n", ((F.col("n") == F.col("top")) & (F.floor(F.col("n") * 100 / F.col("total")) >= 60)).alias("biased"))


def patched(old: DataFrame, changed: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Old rows whose key has not changed, and the fresh ones."""
    return old.join(changed.select(key).distinct(), key, "left_anti").unionByName(fresh)


def appended(log: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows, one for each key, that the log does not hold."""
    return new.dropDuplicates(keys).join(log.select(*keys).distinct(), keys, "left_anti")


def hashed_path(rel: Column) -> Column:
    """The folder and the extension stay, the name becomes 16 digits of its hash."""
    base = F.element_at(F.split(rel, "/"), -1)
    folder = F.regexp_replace(rel, "[^/]*$", "")
    return F.concat(folder, F.substring(F.sha2(F.regexp_replace(base, r"\.[^.]*$", ""), 256), 1, 16), F.regexp_extract(base, r"(\.[^.]*)$", 1))


def anonymised(records: DataFrame, texts: list[str], lists: list[str], paths: list[str], blanked: list[str]) -> DataFrame:
    """The records with texts and lists redacted for export, paths hashed and identifying hashes blanked; ``redactions`` counts."""
    count, columns = F.lit(0), {}
    for c in texts:
        columns[c], n = redacted(F.coalesce(c, F.lit("")), urls=True)
        count = count + n
    for c in lists:
        columns[c] = F.transform(c, lambda x: redacted(x, urls=True)[0])
        count = count + F.aggregate(F.coalesce(c, F.expr("cast(array() as array<string>)")), F.lit(0), lambda a, x: a + redacted(x, urls=True)[1])
    columns |= {c: hashed_path(F.col(c)) for c in paths} | {c: F.lit("") for c in blanked}
    return records.select(*((columns[c] if c in columns else F.col(c)).alias(c) for c in records.columns), count.cast("long").alias("redactions"))
