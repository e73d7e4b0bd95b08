"""Migration of notes of an older layout: types, axes, depths, destinations and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Type and confidence of a note by its old folder, and the cues of a body.
BY_FOLDER = {"decisions": ("decision", "high"), "concepts": ("concept", "low"), "entities": ("concept", "low"), "syntheses": ("concept", "low")}
OUTAGE = r"(?i)\b(outage|incident|down|postmortem|post-mortem)\b"
IMPERATIVE = r"(?m)^(?:\d+\.\s|```|\$ |- \[ \])"
LINK = r"\[\[([^\]|#]+)([#|][^\]]*)?\]\]"


def inferred(rel: Column, body: Column) -> Column:
    """struct<type, confidence, depth> from the folder, else from the body."""
    top = F.split_part(rel, F.lit("/"), F.lit(1))
    kind = F.lit("concept")
    for folder, (name, _) in BY_FOLDER.items():
        kind = F.when(top == folder, name).otherwise(kind)
    kind = F.when(top == "issues", F.when(body.rlike(OUTAGE), "incident").otherwise("pitfall")).when(top == "TIL", F.when(body.rlike(IMPERATIVE), "howto").otherwise("concept")).otherwise(kind)
    return F.struct(kind.alias("type"), F.when(top == "decisions", "high").otherwise("low").alias("confidence"), F.when(top == "syntheses", "4").otherwise("").alias("depth"))


def axes(stack: Column, tags: Column, vocabulary: list[str], aliases: dict[str, str]) -> Column:
    """struct<stack, tags>: a single list of tags dealt out to technologies and concepts, aliases replaced; null if there is a stack already."""
    table = F.create_map(*(x for k, v in {"": "", **aliases}.items() for x in (F.lit(k), F.lit(v))))
    plain = F.array_distinct(F.transform(tags, lambda t: F.coalesce(F.try_element_at(table, t), t)))
    known = F.array(*map(F.lit, vocabulary))
    return F.when(F.coalesce(F.size(stack), F.lit(0)) <= 0, F.struct(F.array_intersect(plain, known).alias("stack"), F.array_except(plain, known).alias("tags")))


def collisions(moves: DataFrame, taken: DataFrame) -> DataFrame:
    """dst, n: destinations that several notes claim, or that exist. moves: src, dst; taken: rel."""
    claimed = moves.groupBy("dst").agg(F.count("*").alias("n"))
    there = taken.select(F.col("rel").alias("dst")).distinct().withColumn("there", F.lit(True))
    return claimed.join(there, "dst", "left").where("n > 1 or there").select("dst", "n")


def _bare(path: Column) -> Column:
    return F.regexp_replace(path, r"\.md$", "")


def relinked(notes: DataFrame, moves: DataFrame, rels: DataFrame) -> DataFrame:
    """rel, body, n: links to moved notes follow them, by path or, if the name is unique among ``rels`` and has changed, by name.

    Links are joined one row each; a text is only put together again where some of its links change.
    notes: rel, body; moves: src, dst; rels: rel of all notes.
    """
    base = lambda c: F.element_at(F.split(_bare(c), "/"), -1)
    paths = moves.select(_bare(F.col("src")).alias("target"), _bare(F.col("dst")).alias("to"))
    unique = rels.groupBy(base(F.col("rel")).alias("target")).agg(F.count("*").alias("n")).where("n = 1").select("target")
    names = moves.select(base(F.col("src")).alias("target"), base(F.col("dst")).alias("to")).where("target <> to").join(unique, "target")
    table = paths.where(F.contains("target", F.lit("/"))).unionByName(names).dropDuplicates(["target"])
    found = notes.select("rel", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(LINK), F.lit(1)))).alias("as_written")).withColumn("target", F.trim(_bare(F.col("as_written"))))
    changed = found.join(table, "target").groupBy("rel").agg(F.map_from_entries(F.collect_list(F.struct("as_written", "to"))).alias("to"))
    rows = notes.join(changed, "rel", "left")
    spans, gaps = F.regexp_extract_all("body", F.lit(LINK), F.lit(0)), F.split("body", LINK, -1)
    target = lambda s: F.try_element_at(F.col("to"), F.regexp_extract(s, LINK, 1))
    new = F.transform(spans, lambda s: F.coalesce(F.concat(F.lit("[["), target(s), F.regexp_extract(s, LINK, 2), F.lit("]]")), s))
    body = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(new, i), F.lit("")))), "")
    n = F.size(F.filter(spans, lambda s: target(s).isNotNull()))
    return rows.select("rel", F.when(F.col("to").isNull(), F.col("body")).otherwise(body).alias("body"), F.when(F.col("to").isNull(), F.lit(0)).otherwise(n).alias("n"))
