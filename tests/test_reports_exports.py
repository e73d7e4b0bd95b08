"""The stats report, bands by tier, the week's measures, exports that are logged first."""

from __future__ import annotations

import json

import pytest

from notelake.operators import asks, capture, dataset
from notelake.plans import reports

ASKED = "topic string, asked long, written boolean"
WEEKS = "week string, notes long, hit_rate double, orphans long, drift long"


def test_stats(spark):
    asked = spark.createDataFrame([(f"t{i:02d}", i % 7 + 1, i % 3 == 0) for i in range(40)], ASKED)
    weeks = spark.createDataFrame([(f"2024-W{k:02d}", k, 50.0, 1, 2) for k in range(1, 15)], WEEKS)
    lines = reports.stats(asked, weeks).split("\n")
    hits, total = sum(i % 7 + 1 for i in range(0, 40, 3)), sum(i % 7 + 1 for i in range(40))
    assert lines[2] == f"{100 * hits / total:.1f} % of {total} asks about 40 topics met a note."
    most = lines[lines.index("## Most asked") + 2 :]
    assert most[:2] == ["- t06: 7, written", "- t13: 7, not written"] and most[15] == "- and more"
    assert f"About {15 * hits} minutes, at 15 minutes for each of {hits} hits." in lines
    shown = [x for x in lines if x.startswith("- 2024-W")]
    assert shown[0].startswith("- 2024-W03: 3 notes, 50.0 % hits") and len(shown) == 12
    empty = reports.stats(spark.createDataFrame([], ASKED), spark.createDataFrame([], WEEKS))
    assert "0.0 % of 0 asks about 0 topics" in empty and "- no gaps" in empty and "- no week was recorded" in empty


def test_bands_are_those_of_the_tier(spark):
    cases = [("d1", 99, "under-100"), ("d1", 100, "under-1000"), ("d1", 1000, "over"), ("d5", 99_999, "over"), ("d2", 1000, "under-10000"), ("d3", 10_000, "over"), ("d3", 9_999, "under-10000"), ("d4", 1000, "over"), ("x", 5, "")]
    rows = spark.createDataFrame([c[:2] for c in cases], "tier string, n long")
    from pyspark.sql import functions as F

    assert [r["b"] for r in rows.select(dataset.band(F.col("tier"), F.col("n")).alias("b")).collect()] == [c[2] for c in cases]


def test_week_row(spark):
    row = asks.week_row(
        spark.createDataFrame([("a",), ("b",)], "rel string"),
        spark.createDataFrame([("t", 3, True), ("u", 1, False)], ASKED),
        spark.createDataFrame([("a", True), ("b", False)], "rel string, is_orphan boolean"),
        spark.createDataFrame([("a", "broken"), ("a", "suspect"), ("b", "ok")], "note string, verdict string"),
    ).collect()
    assert [tuple(r) for r in row] == [(2, 75.0, 1, 1)]


def test_exports_are_logged_before_they_are_written(spark, tmp_path):
    report, lines = spark.createDataFrame([("d1", 2)], "tier string, n int"), spark.createDataFrame([("{}",), ("[]",)], "line string")
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    capture.write_export(report, lines, log, out)
    assert sorted(r[0] for r in spark.read.text(out).collect()) == ["[]", "{}"]
    with pytest.raises(Exception):
        capture.write_export(report, lines, log, out)  # it is there: nothing is overwritten, and the attempt is on record
    logged = [json.loads(x) for p in (tmp_path / "log").glob("*.json") for x in p.read_text().splitlines()]
    assert logged == [{"tier": "d1", "n": 2}] * 2
