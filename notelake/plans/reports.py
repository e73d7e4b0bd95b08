"""Reports: ordered frames of bounded size, rendered to markdown on the driver.

A header carries a date and no time, rows are in a total order, and a file is written only if it changed, so
a second run over the same data changes nothing. One report that fails costs only its own file.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.operators.asks import KEPT_WEEKS, MINUTES_SAVED, gaps, hit_rate
from notelake.operators.sinks import write_if_changed


@dataclass(frozen=True)
class Report:
    file: str
    title: str
    build: Callable[[], DataFrame]
    order: tuple
    limit: int
    empty: str = "nothing to report"


def render(report: Report, day: str) -> str:
    rows = report.build().orderBy(*report.order).limit(report.limit + 1).collect()
    out = [f"# {report.title}", "", f"_{day}_", ""]
    if not rows:
        return "\n".join([*out, f"_{report.empty}_", ""])
    names = rows[0].__fields__
    out += ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    out += ["| " + " | ".join("" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v).replace("|", "\\|") for v in r) + " |" for r in rows[: report.limit]]
    if len(rows) > report.limit:
        out += ["", "_and more_"]
    return "\n".join([*out, ""])


def trim(text: str, most: int) -> str:
    """At most so many bytes, cut at the end of a line."""
    data = text.encode()
    if len(data) <= most:
        return text
    return data[: data.rfind(b"\n", 0, most) + 1].decode()


def write_reports(reports: list[Report], folder: str, day: str) -> dict[str, str]:
    """file -> written, unchanged or failed: why."""
    told = {}
    for r in reports:
        try:
            told[r.file] = "written" if write_if_changed(f"{folder}/{r.file}", render(r, day)) else "unchanged"
        except Exception as e:
            told[r.file] = f"failed: {type(e).__name__}"
    return told


def down(column: str):
    return F.col(column).desc()


def suite(frames: dict[str, Callable[[], DataFrame]]) -> list[Report]:
    """The standard reports for which a frame is given."""
    known = [
        Report("coverage.md", "Coverage", frames.get("coverage"), (down("notes"), "word"), 200),
        Report("staleness.md", "Staleness", frames.get("staleness"), (down("score"), "slug"), 40, "no note is past its freshness window"),
        Report("duplicates.md", "Duplicates", frames.get("duplicates"), (down("score"), "a", "b"), 200, "no similar notes"),
        Report("orphans.md", "Orphans", frames.get("orphans"), ("rel",), 500, "no orphans"),
        Report("graph.md", "Graph health", frames.get("components"), (down("size"), "component"), 50),
        Report("gaps.md", "Gaps", frames.get("gaps"), (down("asked"), "topic"), 30, "no gaps"),
        Report("churn.md", "Churn", frames.get("churn"), (down("commits"), "file"), 25),
        Report("coupling.md", "Changed together", frames.get("coupling"), (down("commits"), "a", "b"), 15),
        Report("dead-links.md", "Dead links", frames.get("links"), ("url",), 500, "no dead links"),
        Report("drift.md", "Drift", frames.get("drift"), ("note", "pos"), 500, "no drift"),
        Report("cost.md", "Cost", frames.get("cost"), ("tier",), 50),
        Report("codebase.md", "Code groups", frames.get("groups"), (down("commits"), "dir"), 20),
        Report("undocumented.md", "Undocumented", frames.get("uncovered"), (down("commits"), down("lines"), "symbol", "file"), 25),
        Report("weekly.md", "Weekly", frames.get("weekly"), (down("week"),), 12),
        Report("dataset.md", "Dataset", frames.get("tiers"), ("tier",), 10),
    ]
    return [r for r in known if r.build is not None]


def stats(asked: DataFrame, weeks: DataFrame, topics: int = 15) -> str:
    """The figures of an ask log as text: hit rate, most asked, gaps, time saved, trend.

    asked: topic, asked, written; weeks: week, notes, hit_rate, orphans, drift. Lists are as long as they say, and say if there is more.
    """
    rate = hit_rate(asked).first()
    count = asked.count()

    def section(title: str, rows: DataFrame, line, none: str, most: int) -> list[str]:
        found = rows.limit(most + 1).collect()
        lines = [f"- {line(r)}" for r in found[:most]] or [f"- {none}"]
        return ["", f"## {title}", "", *lines, *(["- and more"] if len(found) > most else [])]

    out = ["# Asks", "", f"{rate['hit_rate']:.1f} % of {rate['asked']} asks about {count} topics met a note."]
    out += section("Most asked", asked.orderBy(down("asked"), "topic"), lambda r: f"{r['topic']}: {r['asked']}, {'written' if r['written'] else 'not written'}", "nothing was asked", topics)
    out += section("Asked and not written", gaps(asked).orderBy(down("asked"), "topic"), lambda r: f"{r['topic']}: {r['asked']}", "no gaps", 2 * topics)
    out += ["", "## Time saved", "", f"About {rate['minutes_saved']} minutes, at {MINUTES_SAVED} minutes for each of {rate['hits']} hits."]
    shown = lambda r: f"{r['week']}: {r['notes']} notes, {r['hit_rate']:.1f} % hits, {r['orphans']} orphans, {r['drift']} drifted"
    newest = weeks.orderBy(down("week")).limit(KEPT_WEEKS).orderBy("week")
    out += section("Weeks", newest, shown, "no week was recorded", KEPT_WEEKS)
    return "\n".join([*out, ""])
