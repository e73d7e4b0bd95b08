from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from notelake.operators import sinks
from notelake.plans import reports


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_upsert_prune_and_children(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "rel string, n int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "rel string, n int")
    both = sinks.upserted(old, new, "rel")
    assert sorted(map(tuple, both.collect())) == [("a", 1), ("b", 3), ("c", 4)]
    assert sorted(map(tuple, sinks.pruned(both, old, "rel").collect())) == [("a", 1), ("b", 3)]
    tagged = spark.createDataFrame([("a", ["y", "x", "x"]), ("b", [])], "rel string, tags array<string>")
    rows = sinks.child_rows(tagged, "rel", "tags").union(spark.createDataFrame([("gone", "z")], "rel string, value string"))
    assert sorted(map(tuple, sinks.with_lists(old.select("rel"), rows, "rel", "tags").collect())) == [("a", ["x", "y"]), ("b", [])]


def test_blocks(spark):
    text, b, e = "one\ntwo\n", "<!-- b -->", "<!-- e -->"
    put = one(spark, sinks.put_block(F.lit(text), b, e, F.lit("x\ny")))
    assert put == "one\ntwo\n<!-- b -->\nx\ny\n<!-- e -->\n"
    assert one(spark, sinks.put_block(F.lit(put), b, e, F.lit("x\ny"))) == put
    assert one(spark, sinks.put_block(F.lit(put), b, e, F.lit("z"))) == "one\ntwo\n<!-- b -->\nz\n<!-- e -->\n"
    assert one(spark, sinks.put_block(F.lit(text), b, e, F.lit("z"), before=F.lit(2))) == "one\n<!-- b -->\nz\n<!-- e -->\ntwo\n"
    assert one(spark, sinks.drop_block(F.lit(put), b, e)) == text and one(spark, sinks.drop_block(F.lit(text), b, e)) == text


def test_unique_slugs(spark):
    taken = spark.createDataFrame([("a-note",), ("a-note-2",), ("a-note-4",), ("untitled",)], "slug string")
    titles = spark.createDataFrame([("A note",), ("New",), ("???",)], "title string")
    assert {r["title"]: r["slug"] for r in sinks.unique_slugs(titles, taken).collect()} == {"A note": "a-note-3", "New": "new", "???": "untitled-2"}


def test_all_or_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, "bad")], "id int, error string")
    with pytest.raises(ValueError):
        sinks.write_all_or_nothing(rows, str(tmp_path / "out"), "error")
    assert not (tmp_path / "out").exists()
    sinks.write_all_or_nothing(rows.where("id = 1"), str(tmp_path / "out"), "error")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    assert sinks.read_generation(spark, str(tmp_path / "absent"), 1) is None


def test_reports_run_twice_change_nothing(spark, tmp_path):
    gaps = spark.createDataFrame([("t|1", 5), ("t2", 9)], "topic string, asked int")
    told = lambda: reports.write_reports(reports.suite({"gaps": lambda: gaps, "cost": lambda: 1 / 0, "orphans": lambda: spark.createDataFrame([], "rel string")}), str(tmp_path), "2024-01-31")
    assert told() == {"orphans.md": "written", "gaps.md": "written", "cost.md": "failed: ZeroDivisionError"}
    assert told()["gaps.md"] == "unchanged"
    assert (tmp_path / "gaps.md").read_text().splitlines()[-2:] == ["| t2 | 9 |", "| t\\|1 | 5 |"]
    assert reports.trim("ab\ncd\n", 4) == "ab\n"
