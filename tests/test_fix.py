from __future__ import annotations

from pyspark.sql import functions as F

from notelake.operators import dataset, fix

SCHEMA = "rel string, mtime long, stack array<string>, tags array<string>, created string, updated string, verified string, date string, source string, sources array<struct<url:string,accessed:string,kind:string>>, depth string, confidence string"


def test_fix_is_idempotent(spark):
    rows = [("a", 86400 * 365, ["Java", " k8s", "java"], ["Cache"], "2024-01-01", "yesterday", None, "'2023-05-06'", '"log.jsonl"', None, None, "high"), ("b", 0, None, None, "2024-01-01", "2024-01-02", "2024-01-03", None, None, None, "2", "low")]
    aliases = {"stack": {"k8s": "kubernetes"}, "tags": {"cache": "caching"}}
    once = fix.fixed(spark.createDataFrame(rows, SCHEMA), aliases)
    a, b = once.orderBy("rel").collect()
    assert (a["stack"], a["tags"], a["created"], a["updated"], a["verified"], a["depth"]) == (["java", "kubernetes"], ["caching"], "2024-01-01", "2023-05-06", "2023-05-06", "3")
    assert [tuple(s) for s in a["sources"]] == [("log.jsonl", "2024-01-01", "session")]
    assert a["changes"] == ['stack: "Java" -> "java"', 'stack: " k8s" -> "kubernetes"', 'tags: "Cache" -> "caching"', "updated: <- 2023-05-06", "verified: <- 2023-05-06", 'sources: <- source: "log.jsonl"', "depth: <- 3"]
    assert b["changes"] == []
    again = fix.fixed(once.withColumn("mtime", F.lit(0)).withColumn("date", F.lit(None).cast("string")).withColumn("source", F.lit(None).cast("string")), aliases)
    assert all(r["changes"] == [] for r in again.collect())


def test_rendered_keeps_the_body(spark):
    row = spark.createDataFrame([("T", ["a", "b"], None, "body\r\n---\n")], "title string, tags array<string>, origin string, body string")
    text = row.select(fix.rendered(["title", "origin"], ["tags"], ["title", "tags", "origin"], F.col("body")).alias("x")).first()["x"]
    assert text == "---\ntitle: T\ntags: [a, b]\n---\nbody\r\n---\n"


def test_anonymised(spark):
    rows = spark.createDataFrame([("mail a@b.org", ["x", "c@d.org"], "notes/howto/secret-name.md", "abc")], "topic string, stack array<string>, note string, sha string")
    r = dataset.anonymised(rows, ["topic"], ["stack"], ["note"], ["sha"]).first()
    assert (r["topic"], r["stack"], r["sha"], r["redactions"]) == ("mail [REDACTED-EMAIL]", ["x", "[REDACTED-EMAIL]"], "", 2)
    assert r["note"].startswith("notes/howto/") and r["note"].endswith(".md") and "secret" not in r["note"] and len(r["note"]) == len("notes/howto/.md") + 16
