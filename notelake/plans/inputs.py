"""The driver's tables in the roles of the engine's entities, in Spark and as SQL views of the same name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.session import table

NOW_S = 946_684_800  # 2000-01-01
ASK_NOW_S = 1_706_659_200  # 2024-01-31
QUESTION = "How does the ertion pattern and ndthe work with thing in en"

VIEWS = {
    "notes": """select 'notes/' || lpad(cast(doc_id as varchar), 8, '0') || '.md' as rel, doc_id, text as body, lang, source,
        array_to_string(list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda w: w <> '')[1:8], ' ') as title from documents""",
    "changes": "select l_orderkey as sha, 'c' || o_custkey as author, 'f' || l_partkey as file from lineitem join orders on l_orderkey = o_orderkey",
    "cited": "select distinct 'f' || l_suppkey as file, 'n' || l_partkey as note from lineitem",
    "code_files": "select 'f' || p_partkey as file, p_brand as dir, p_type as symbol, p_size as lines from part",
    "asks": "select event_id, 'ask' as event, event_type || '-' || user_id as topic, user_id, ts, epoch(ts) as ts_s, value from events where event_type <> 'error'",
    "slugs": "select distinct kind || '-' || user_id as slug from events, (values ('click'), ('view'), ('purchase')) k(kind) where event_type in ('signup', 'error')",
    "page_links": "select 'pages/' || page_id || '.md' as src, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as target from pages",
    "page_paths": "select 'pages/' || page_id || '.md' as rel from pages union all select distinct 'words/' || list_extract(string_split_regex(text, '[ \\t\\r\\n]+'), 1) || '.md' as rel from documents",
    "order_notes": "select 'o' || o_orderkey as rel, strftime(o_orderdate, '%Y-%m-%d') as verified, cast(epoch(o_orderdate) as bigint) as verified_s, (o_orderkey % 4) * 365 as freshness_days from orders",
}


def notes(spark: SparkSession, sf: str) -> DataFrame:
    head = F.regexp_extract("text", r"^[ \t\r\n]*((?:[^ \t\r\n]+[ \t\r\n]+){0,7}[^ \t\r\n]*)", 1)  # the text is not split beyond its title
    words = F.filter(F.split(head, r"[ \t\r\n]+"), lambda w: w != "")
    return table(spark, sf, "documents").select(
        F.concat(F.lit("notes/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".md")).alias("rel"), "doc_id", F.col("text").alias("body"), "lang", "source", F.array_join(F.slice(words, 1, 8), " ").alias("title")
    )


def changes(spark: SparkSession, sf: str) -> DataFrame:
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(F.col("l_orderkey").alias("sha"), F.concat(F.lit("c"), "o_custkey").alias("author"), F.concat(F.lit("f"), "l_partkey").alias("file"))


def cited(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.concat(F.lit("f"), "l_suppkey").alias("file"), F.concat(F.lit("n"), "l_partkey").alias("note")).distinct()


def code_files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.concat(F.lit("f"), "p_partkey").alias("file"), F.col("p_brand").alias("dir"), F.col("p_type").alias("symbol"), F.col("p_size").alias("lines"))


def seconds(column: str):
    return F.unix_seconds(F.col(column).cast("timestamp"))


def asks(spark: SparkSession, sf: str) -> DataFrame:
    topic = F.concat("event_type", F.lit("-"), "user_id")
    return table(spark, sf, "events").where("event_type <> 'error'").select("event_id", F.lit("ask").alias("event"), topic.alias("topic"), "user_id", "ts", "value")


def slugs(spark: SparkSession, sf: str) -> DataFrame:
    """Topics of users who signed up or met an error count as written."""
    e = table(spark, sf, "events").where("event_type in ('signup', 'error')").select(F.explode(F.array(*map(F.lit, ["click", "view", "purchase"]))).alias("kind"), "user_id")
    return e.select(F.concat_ws("-", "kind", "user_id").alias("slug")).distinct()


def page_links(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(F.concat(F.lit("pages/"), "page_id", F.lit(".md")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))


def page_paths(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "documents").select(F.concat(F.lit("words/"), F.get(F.split("text", r"[ \t\r\n]+"), F.lit(0)), F.lit(".md")).alias("rel")).distinct()
    return table(spark, sf, "pages").select(F.concat(F.lit("pages/"), "page_id", F.lit(".md")).alias("rel")).union(words)


def order_notes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.concat(F.lit("o"), "o_orderkey").alias("rel"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("verified"), seconds("o_orderdate").alias("verified_s"), ((F.col("o_orderkey") % 4) * 365).cast("int").alias("freshness_days")
    )
