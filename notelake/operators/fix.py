"""Mechanical repair of note contracts, and rendering of frontmatter with the body untouched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.functions.text import stripped
from notelake.operators.gates import DATE

# Keys whose value is constant if absent.
DEFAULTS = {"depth": "3", "confidence": "medium"}
NO_TEXTS = "cast(array() as array<string>)"


def _sound(day: Column) -> Column:
    return F.coalesce(day.rlike(DATE) & F.try_to_date(day, "yyyy-MM-dd").isNotNull(), F.lit(False))


def _canonical(items: Column, aliases: dict[str, str]) -> Column:
    table = F.create_map(*(x for k, v in aliases.items() for x in (F.lit(k), F.lit(v))))
    plain = lambda x: F.lower(stripped(x))
    return F.transform(items, lambda x: F.coalesce(F.try_element_at(table, plain(x)), plain(x)))


def _told(key: str):
    return lambda p: F.concat(F.lit(f'{key}: "'), p["was"], F.lit('" -> "'), p["now"], F.lit('"'))


def fixed(notes: DataFrame, aliases: dict[str, dict[str, str]]) -> DataFrame:
    """notes repaired, with ``changes``: what was changed, in order; a repaired note has none.

    notes: rel, mtime (seconds), stack, tags, created, updated, verified, date (legacy), source (legacy),
    sources array<struct<url, accessed, kind>>, depth, confidence; null is an absent key.
    """
    legacy = F.btrim(F.coalesce("date", F.lit("")), F.lit("\"' "))
    stamp = F.when(_sound(legacy), legacy).otherwise(F.date_format(F.timestamp_seconds("mtime"), "yyyy-MM-dd"))
    rows = notes.withColumn("stamp", stamp)
    told = []
    for key in ("stack", "tags"):
        rows = rows.withColumn(f"new_{key}", _canonical(F.col(key), aliases.get(key, {"": ""})))
        pairs = F.filter(F.arrays_zip(F.col(key).alias("was"), F.col(f"new_{key}").alias("now")), lambda p: p["was"] != p["now"])
        told.append(F.transform(F.coalesce(pairs, F.expr("cast(array() as array<struct<was:string,now:string>>)")), _told(key)))
    for key in ("created", "updated", "verified"):
        told.append(F.when(~_sound(F.col(key)), F.array(F.concat(F.lit(f"{key}: <- "), F.col("stamp")))).otherwise(F.expr(NO_TEXTS)))
    source = F.btrim(F.coalesce("source", F.lit("")), F.lit("\"' "))
    carried = (source != "") & (F.coalesce(F.size("sources"), F.lit(0)) <= 0)
    told.append(F.when(carried, F.array(F.concat(F.lit('sources: <- source: "'), source, F.lit('"')))).otherwise(F.expr(NO_TEXTS)))
    for key, value in DEFAULTS.items():
        told.append(F.when(F.col(key).isNull(), F.array(F.lit(f"{key}: <- {value}"))).otherwise(F.expr(NO_TEXTS)))
    day = {key: F.when(_sound(F.col(key)), F.col(key)).otherwise(F.col("stamp")) for key in ("created", "updated", "verified")}
    entry = F.array(F.struct(source.alias("url"), day["created"].alias("accessed"), F.lit("session").alias("kind")))
    none = F.expr("cast(array() as array<struct<url:string,accessed:string,kind:string>>)")
    return rows.select(
        "rel",
        *(F.array_distinct(F.filter(f"new_{key}", lambda x: x != "")).alias(key) for key in ("stack", "tags")),
        *(c.alias(key) for key, c in day.items()),
        F.when(carried, entry).otherwise(F.coalesce("sources", none)).alias("sources"),
        *(F.coalesce(key, F.lit(value)).alias(key) for key, value in DEFAULTS.items()),
        F.flatten(F.array(*told)).alias("changes"),
    )


def rendered(scalars: list[str], lists: list[str], order: list[str], body: Column) -> Column:
    """Frontmatter in the given key order before the body, which stays byte for byte; absent keys are left out."""
    lines = [F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k}: "), F.col(k))) if k in scalars else F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k}: ["), F.array_join(k, ", "), F.lit("]"))) for k in order if k in scalars or k in lists]
    return F.concat(F.lit("---\n"), F.array_join(F.filter(F.array(*lines), lambda x: x.isNotNull()), "\n"), F.lit("\n---\n"), body)
