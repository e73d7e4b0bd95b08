"""JSON lines, transcripts, commit logs and dependency manifests as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASK = "ts timestamp, event string, q_hash string, topic string, stack array<string>, decision string, recall_top_score double, duration_ms bigint, sources bigint, project string"
LINK = "url string, verdict string, checked_s long"
LINE_BYTES = 16 << 20
TRANSCRIPT = "message struct<role:string,content:array<struct<type:string,text:string>>>"


def _absent(error: Exception) -> bool:
    return "PATH_NOT_FOUND" in str(error)


def permissive(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines that parse; others are skipped; an absent file is empty."""
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except Exception as e:
        if not _absent(e):
            raise
        return spark.createDataFrame([], schema)


def strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Any bad line, or one over ``LINE_BYTES``, fails the read and is named by file and line; an absent file is empty."""
    try:
        lines = spark.read.text(path)
    except Exception as e:
        if not _absent(e):
            raise
        return spark.createDataFrame([], schema)
    marked = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    parsed = marked.withColumn("r", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    wrong = (F.trim("value") != "") & (F.col("r._bad").isNotNull() | F.col("r").isNull() | (F.octet_length("value") > LINE_BYTES))
    first = parsed.where(wrong).select("file", "block", "at").orderBy("file", "block", "at").limit(1).collect()
    if first:
        f = first[0]
        line = marked.where((F.col("file") == f["file"]) & ((F.col("block") < f["block"]) | ((F.col("block") == f["block"]) & (F.col("at") <= f["at"])))).count()
        raise ValueError(f"{f['file']}:{line}: not a record of the log")
    return parsed.where(F.trim("value") != "").select("r.*").drop("_bad")


def link_cache(spark: SparkSession, path: str) -> DataFrame:
    """url, verdict, checked_s of earlier probes; a cache that is absent or damaged is an empty one."""
    return permissive(spark, path, LINK).where("url is not null and verdict in ('alive', 'dead', 'unreachable') and checked_s is not null")


def assistant_texts(spark: SparkSession, path: str) -> DataFrame:
    """Text blocks of assistant turns in transcripts."""
    rows = permissive(spark, path, TRANSCRIPT).where("message.role = 'assistant'").select(F.explode("message.content").alias("c"))
    return rows.where("c.type = 'text' and c.text is not null").select("c.text")


def commit_log(spark: SparkSession, path: str) -> DataFrame:
    """sha, author, ts, files from log text: commits begin with NUL and have sha, author, ISO time parted by 0x1f."""
    blocks = spark.read.option("lineSep", "\0").text(path).where(F.trim("value") != "")
    lines = F.split("value", "\n")
    head = F.split(F.element_at(lines, 1), "\x1f")
    files = F.filter(F.transform(F.slice(lines, 2, F.size(lines)), lambda x: F.trim(x)), lambda x: x != "")
    return blocks.where(F.size(head) >= 3).select(F.get(head, F.lit(0)).alias("sha"), F.get(head, F.lit(1)).alias("author"), F.get(head, F.lit(2)).try_cast("timestamp").alias("ts"), files.alias("files")).where("ts is not null")


def dependencies(manifests: DataFrame) -> DataFrame:
    """name, version from manifest texts (path, text); the later path wins."""
    maven = F.transform(F.regexp_extract_all("text", F.lit(r"(?s)<dependency>(.*?)</dependency>"), F.lit(1)), lambda d: F.struct(F.regexp_extract(d, r"<artifactId>\s*([^<\s]+)", 1).alias("name"), F.regexp_extract(d, r"<version>\s*([^<\s]+)", 1).alias("version")))
    gradle = F.transform(F.regexp_extract_all("text", F.lit(r"""["']([\w.-]+:[\w.-]+:[\w.-]+)["']"""), F.lit(1)), lambda d: F.struct(F.split_part(d, F.lit(":"), F.lit(2)).alias("name"), F.split_part(d, F.lit(":"), F.lit(3)).alias("version")))
    package = F.from_json("text", "dependencies map<string,string>, devDependencies map<string,string>")
    entries = lambda m: F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("version")))
    none = F.expr("cast(array() as array<struct<name:string,version:string>>)")
    npm = F.concat(F.coalesce(entries(package["dependencies"]), none), F.coalesce(entries(package["devDependencies"]), none))
    base = F.element_at(F.split("path", "/"), -1)
    found = F.when(base == "pom.xml", maven).when(base.startswith("build.gradle"), gradle).when(base == "package.json", npm).otherwise(none)
    rows = manifests.select("path", F.explode(found).alias("d")).where("d.name <> ''")
    return rows.groupBy("d.name").agg(F.max_by("d.version", "path").alias("version"))

