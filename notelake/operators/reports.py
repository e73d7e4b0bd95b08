"""Frames behind the reports: dead links, index, statistics, datasheet, explanation of a score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notelake.functions.dates import index_stale
from notelake.operators.gates import TYPES


def dead_per_note(cited: DataFrame, status: DataFrame) -> DataFrame:
    """note, dead: how many addresses of a note are dead. cited: note, url; status: url, verdict."""
    return cited.distinct().join(status.where("verdict = 'dead'").select("url"), "url").groupBy("note").agg(F.count("*").alias("dead"))


def citing_notes(cited: DataFrame, status: DataFrame) -> DataFrame:
    """url, verdict, notes (sorted) of the addresses that are not alive. Those are few; what is alive is dropped before notes are gathered."""
    bad = status.where("verdict <> 'alive'")
    return bad.join(cited.distinct(), "url").groupBy("url", "verdict").agg(F.sort_array(F.collect_set("note")).alias("notes"))


def recent(notes: DataFrame, by: str, most: int = 15) -> DataFrame:
    return notes.orderBy(F.col(by).desc(), "rel").limit(most)


def stalest(notes: DataFrame, now_s: int, most: int = 15) -> DataFrame:
    """The notes past their window that were verified longest ago. notes: rel, verified, verified_s, freshness_days."""
    return notes.where(index_stale(F.col("verified_s"), F.col("freshness_days"), F.lit(now_s))).orderBy("verified", "rel").limit(most)


def most_asked(asks: DataFrame, most: int = 15) -> DataFrame:
    return asks.groupBy("topic").agg(F.count("*").alias("asked")).orderBy(F.col("asked").desc(), "topic").limit(most)


def queued(notes: DataFrame, flag: str) -> DataFrame:
    """Notes that wait for an advisor: the flag says true, in either case."""
    return notes.where(F.lower(flag) == "true").select("rel")


def by_type(notes: DataFrame) -> DataFrame:
    """type, notes: every type of the contract, zero where no note has it."""
    every = notes.sparkSession.createDataFrame([(t,) for t in TYPES], "type string")
    return every.join(notes.groupBy("type").agg(F.count("*").alias("notes")), "type", "left").select("type", F.coalesce("notes", F.lit(0)).alias("notes"))


def act_now(lines: DataFrame, order: list[str]) -> DataFrame:
    """line, kind, target: one line a kind, the named kinds first. lines: kind, target (a row a kind)."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col("kind")), F.lit(0)), F.lit(len(order) + 1))
    return lines.select(F.row_number().over(Window.orderBy(rank, "kind")).alias("line"), "kind", "target")  # a row a kind


def top_finding(findings: DataFrame, verdict: str = "broken") -> DataFrame:
    """The finding with the smallest note and place. findings: note, pos, verdict and others."""
    return findings.where(F.col("verdict") == verdict).orderBy("note", "pos").limit(1)


def documented(groups: DataFrame) -> DataFrame:
    """The code groups that some note cites, most commits first."""
    return groups.where("notes > 0").orderBy(F.col("commits").desc(), "dir")


def datasheet(stats: DataFrame, shares: DataFrame, redactions: int) -> str:
    """Markdown on an export: counts, span, distributions with their bias, limits. stats: tier rows; shares: value, n, biased."""
    out = ["# Datasheet", "", "## Composition", ""]
    out += [f"- {r['tier']}: {r['n']} records, {r['first']} to {r['last']} ({r['band']})" for r in stats.orderBy("tier").collect()]  # five rows at most
    out += ["", "## Distribution", ""]
    out += [f"- {r['value']}: {r['n']}" + (" (over 60 percent: biased)" if r["biased"] else "") for r in shares.orderBy(F.col("n").desc(), "value").limit(50).collect()]
    return "\n".join([*out, "", "## Limitations", "", f"- {redactions} redactions; topics and profile values are kept in plain words", ""])


def knowledge_map(groups: DataFrame, most: int = 200) -> str:
    rows = documented(groups).limit(most).collect()
    return "\n".join(["# Knowledge map", "", *(f"- `{r['dir']}`: {r['notes']} notes, {r['files']} files, {r['commits']} commits" for r in rows), ""])


def vault_index(summary: DataFrame, types: DataFrame, newest: DataFrame, oldest: DataFrame, most_bytes: int = 4096) -> str:
    """The index of a collection, cut at the end of a line to its budget."""
    from notelake.plans.reports import trim

    s = summary.first()
    out = ["# Index", "", f"{s['notes']} notes, {s['valid']} valid, {s['invalid']} invalid, {s['orphans']} orphans", "", "## Types", ""]
    out += [f"- {r['type']}: {r['notes']}" for r in types.orderBy(F.col("notes").desc(), "type").collect()]  # seven rows
    for title, rows in (("Recent", newest), ("Stale", oldest)):
        out += ["", f"## {title}", "", *(f"- {r['rel']}" for r in rows.collect())]  # fifteen rows
    return trim("\n".join([*out, ""]), most_bytes)


def explain(channels: DataFrame) -> str:
    """The arithmetic of one candidate's score. channels: name, weight, value, active (four rows)."""
    rows = channels.collect()
    active = [r for r in rows if r["active"]]
    total = sum(r["weight"] for r in active)
    score = sum(r["weight"] * r["value"] for r in active) / total if total else 0.0
    return "\n".join([*(f"{r['name']}: " + (f"{r['weight']:.2f} * {r['value']:.3f}" if r["active"] else "off") for r in rows), f"score: {score:.3f} over weight {total:.2f}", ""])
