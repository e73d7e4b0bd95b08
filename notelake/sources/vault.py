"""A folder of markdown notes as a DataFrame: walk, frontmatter, populations, incremental refresh."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders a walk skips (the last is the engine's own state), and what is no content note.
SKIPPED = [".git", ".obsidian", ".trash", "node_modules", ".idea", ".notelake"]
PLAIN_FILES = ["CLAUDE.md", "README.md", "lint-report.md"]
PLAIN_FOLDERS = ["raw/", "sources/", "_archive/", "archive/", "reports/", "moc/weekly/"]
TYPE_FOLDERS = r"^notes/([^/]+)/"


def walk(spark: SparkSession, root: str) -> DataFrame:
    """rel, src, mtime, size of every note below ``root``, skipped folders left out. Order: by split(rel, '/')."""
    base = root.rstrip("/")
    files = spark.read.text(base, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    whole = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), r"^file:/+", "/")
    rel = F.regexp_replace(whole, "^.*?" + _quoted(base) + "/", "")
    rows = files.select(rel.alias("rel"), F.col("value").alias("src"), F.unix_seconds("_metadata.file_modification_time").alias("mtime"), F.col("_metadata.file_size").alias("size"))
    return rows.where(~F.exists(F.split("rel", "/"), lambda part: part.isin(SKIPPED)))


def _quoted(path: str) -> str:
    import re

    return re.escape(path.removeprefix("file://"))


def split_frontmatter(src: Column) -> tuple[Column, Column, Column]:
    """(has, yaml, body): a leading block between --- lines; the first closing --- decides."""
    text = F.replace(src, F.lit("\r\n"), F.lit("\n"))
    close = F.locate("\n---", text, 4)
    after = F.substring(text, close + 4, F.lit(1))
    has = text.startswith("---\n") & (close > 0) & after.isin("", "\n")
    yaml = F.when(has, F.substring(text, F.lit(5), close - 5))
    body = F.when(has, F.substr(text, close + 5)).otherwise(src)
    return has, yaml, body


def parse_frontmatter(notes: DataFrame) -> DataFrame:
    """notes with fm (key -> list of source texts), keys in order and fm_error; scalars stay as written.

    Node-level YAML keeps dates, 007 and yes as text; a note that cannot be parsed keeps its error.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for frame in frames:
            keys, maps, errors = [], [], []
            for text in frame["yaml"]:
                order, found, error = [], {}, None
                if text is not None:
                    try:
                        node = yaml.compose(text, Loader=yaml.BaseLoader)
                        if node is not None and not isinstance(node, yaml.MappingNode):
                            raise ValueError("not a mapping")
                        for k, v in node.value if node is not None else []:
                            if k.value not in found:
                                order.append(k.value)
                            items = v.value if isinstance(v, yaml.SequenceNode) else [v]
                            texts = [i.value if isinstance(i, yaml.ScalarNode) else yaml.serialize(i).strip() for i in items]
                            found[k.value] = [] if isinstance(v, yaml.ScalarNode) and v.value in ("", "null") else texts
                    except Exception as e:  # the error is data: one bad note must not stop a scan
                        order, found, error = [], {}, str(e)[:200]
                keys.append(order)
                maps.append(found)
                errors.append(error)
            yield frame.assign(keys=keys, fm=maps, fm_error=errors)

    from pyspark.sql.types import ArrayType, MapType, StringType, StructType

    schema = StructType([*notes.schema.fields]).add("keys", ArrayType(StringType())).add("fm", MapType(StringType(), ArrayType(StringType()))).add("fm_error", StringType())
    return notes.mapInPandas(run, schema)


def load(spark: SparkSession, root: str) -> DataFrame:
    """rel, mtime, size, body, keys, fm, fm_error, title, is_content, is_contract, note_type."""
    has, yaml, body = split_frontmatter(F.col("src"))
    notes = parse_frontmatter(walk(spark, root).select("rel", "mtime", "size", "src", yaml.alias("yaml"), body.alias("body")))
    heading = F.regexp_extract("body", r"(?m)^# (.+)$", 1)
    stem = F.regexp_replace(F.element_at(F.split("rel", "/"), -1), r"\.md$", "")
    title = F.coalesce(F.nullif(F.trim(F.try_element_at(F.try_element_at("fm", F.lit("title")), F.lit(1))), F.lit("")), F.nullif(F.trim(heading), F.lit("")), stem)
    return notes.withColumn("title", title).withColumn("is_content", content_note(F.col("rel"))).withColumn("is_contract", contract_note(F.col("rel"))).withColumn("note_type", F.regexp_extract("rel", TYPE_FOLDERS, 1)).drop("yaml")


def content_note(rel: Column) -> Column:
    base = F.element_at(F.split(rel, "/"), -1)
    placed = F.lit(False)
    for folder in PLAIN_FOLDERS:
        placed = placed | rel.startswith(folder)
    return ~(base.isin(PLAIN_FILES) | base.startswith("_index") | placed)


def contract_note(rel: Column) -> Column:
    return content_note(rel) & ~rel.isin("index.md", "log.md") & ~rel.startswith("moc/")


def refresh(cached: DataFrame, walked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, stale): cached rows whose (rel, mtime, size) still hold, and walked files to parse again."""
    keys = ["rel", "mtime", "size"]
    return cached.join(walked.select(*keys), keys, "left_semi"), walked.join(cached.select(*keys), keys, "left_anti")
