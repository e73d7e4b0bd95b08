"""Capture of training records: routing, critiques, human corrections, repairs, accepted notes; inbox, scrubbing, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelake.functions.redact import redacted
from notelake.functions.text import conclusions, short_hash
from notelake.operators.dataset import WINDOW_S

# The names of the records, the origins of generated notes, the profile keys that are kept.
KINDS = {"d1": "d1-routing", "d2": "d2-advisor-critique", "d3": "d3-human-edit", "d4": "d4-repair", "d5": "d5-style"}
GENERATED = ["ask", "session-capture", "garden"]
PROFILE_KEYS = ["primary_language", "frameworks", "infra", "seniority", "default_depth", "note_language", "explain_style"]
QUESTIONS = "## Open questions"
STUBS = 3
INTENT = 0.7


def enabled(config: dict, tier: str) -> bool:
    """Both the master switch and the tier's own entry must be on."""
    return bool(config.get("enabled")) and tier in config.get("capture", [])


def routing(results: DataFrame) -> DataFrame:
    """One record for each answered question; the question itself leaves only its hash. results: question, topic, decision, stack, top_score, candidates, at_s."""
    return results.select(F.lit(KINDS["d1"]).alias("kind"), short_hash(F.col("question"), 12).alias("q_hash"), "topic", "decision", "stack", F.col("top_score").alias("recall_top_score"), "candidates", F.col("at_s").alias("captured_s"))


def critiques(calls: DataFrame) -> DataFrame:
    """Drafts with their critiques, word for word. calls: stage, draft, critique, at_s; calls without a critique give none."""
    return calls.where("critique is not null").select(F.lit(KINDS["d2"]).alias("kind"), "stage", "draft", "critique", F.col("at_s").alias("captured_s"))


def is_note(rel: Column) -> Column:
    return F.startswith(rel, F.lit("notes/")) & F.endswith(rel, F.lit(".md"))


def corrections(edits: DataFrame, own: DataFrame, added: DataFrame, blobs: DataFrame, facts: DataFrame, window_s: int = WINDOW_S) -> DataFrame:
    """Human corrections of generated notes: a note changed within the window of its addition, by a commit of another hand.

    edits: sha, rel, status, edited_s; own: sha of commits with the engine's trailer; added: rel, gen_sha, gen_path, added_s (the
    first addition, through renames); blobs: sha, path, text; facts: sha, path, origin, topic. Commits of the engine, paths outside the notes,
    deletions, notes born in the commit, edits before the addition or past the window, texts
    that did not change and notes that were not generated give no record.
    """
    mine = edits.where(F.col("status").isin("M", "R") & is_note(F.col("rel"))).join(own.select("sha"), "sha", "left_anti")
    late = F.col("edited_s") - F.col("added_s")
    rows = mine.join(added, "rel").where((F.col("gen_sha") != F.col("sha")) & (late >= 0) & (late <= window_s))
    rows = rows.join(facts.where(F.col("origin").isin(GENERATED)).select(F.col("sha").alias("gen_sha"), F.col("path").alias("gen_path"), "origin", "topic"), ["gen_sha", "gen_path"])
    rows = rows.join(blobs.select(F.col("sha").alias("gen_sha"), F.col("path").alias("gen_path"), F.col("text").alias("generated")), ["gen_sha", "gen_path"])
    rows = rows.join(blobs.select("sha", F.col("path").alias("rel"), F.col("text").alias("preferred")), ["sha", "rel"]).where("generated <> preferred")
    return rows.select(F.lit(KINDS["d3"]).alias("kind"), F.col("rel").alias("note"), "topic", short_hash(F.col("generated"), 24).alias("content_hash"), "origin", F.col("added_s").alias("generated_s"), "edited_s", F.col("gen_sha").alias("gen_commit"), F.col("sha").alias("edit_commit"), "generated", "preferred")


def repairs(failures: DataFrame, passes: DataFrame, consumed: DataFrame) -> DataFrame:
    """path, failing_draft, gate_error, fixed_draft: what failed at a path and the first draft that passed and named it.

    failures: path, draft, error; passes: previous (path), body, at_s; consumed: path. A failure pairs once, in all runs.
    """
    first = passes.groupBy(F.col("previous").alias("path")).agg(F.min_by(F.struct("body", "at_s"), F.struct("at_s", "body")).alias("p"))
    open_ = failures.join(consumed.select("path"), "path", "left_anti")
    return open_.join(first, "path").select(F.lit(KINDS["d4"]).alias("kind"), "path", F.col("draft").alias("failing_draft"), F.col("error").alias("gate_error"), F.col("p.body").alias("fixed_draft"), F.col("p.at_s").alias("captured_s"))


def accepted(notes: DataFrame, profile: Column) -> DataFrame:
    """Accepted notes with the whitelisted, non-empty keys of the profile. notes: slug, rel, body, stack, sources, at_s."""
    kept = F.map_filter(profile, lambda k, v: k.isin(PROFILE_KEYS) & (v != ""))
    return notes.select(F.lit(KINDS["d5"]).alias("kind"), F.col("slug").alias("topic"), "rel", F.col("body").alias("note"), kept.alias("profile"), "stack", "sources", F.col("at_s").alias("captured_s"))


def since(records: DataFrame, tier: str, cut_s: int | None) -> DataFrame:
    """Records at or after a moment: edits by when they were edited, all others by when they were captured."""
    return records if cut_s is None else records.where(F.col("edited_s" if tier == "d3" else "captured_s") >= cut_s)


def first_unseen(texts: DataFrame, seen: DataFrame, most: int = STUBS) -> DataFrame:
    """session, hash, text: the first unseen conclusions of every session, three at most. texts: session, pos, text; seen: session, hash.

    What was concluded in another session counts as new; a session's own repeats count once.
    """
    found = texts.select("session", "pos", F.posexplode(conclusions(F.col("text"))).alias("k", "text")).where("text <> ''").withColumn("hash", short_hash(F.col("text"), 16))
    once = found.groupBy("session", "hash").agg(F.min(F.struct("pos", "k", "text")).alias("x")).join(seen.select("session", "hash"), ["session", "hash"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("session").orderBy("x.pos", "x.k"))
    return once.withColumn("rank", rank).where(F.col("rank") <= most).select("session", "hash", "x.text", "rank")


def intent_hits(results: DataFrame, bar: float = INTENT) -> DataFrame:
    """The best candidate of a question, if its score is above the bar. results: question_id, rank, rel, score."""
    return results.where((F.col("rank") == 1) & (F.col("score") > bar)).select("question_id", "rel", "score")


def to_inbox(notes: DataFrame) -> DataFrame:
    """path, confidence, body of drafts that are held back, with their open questions once. notes: slug, body, questions array<string>; a note without a slug is an error."""
    lines = F.concat(F.array_join(F.transform("questions", lambda q: F.concat(F.lit("- "), q)), "\n"), F.lit("\n"))
    ended = F.when((F.col("body") == "") | F.endswith("body", F.lit("\n")), F.col("body")).otherwise(F.concat("body", F.lit("\n")))
    asked = F.concat(ended, F.lit(f"\n{QUESTIONS}\n\n"), lines)
    body = F.when((F.coalesce(F.size("questions"), F.lit(0)) <= 0) | F.contains("body", F.lit(QUESTIONS)), F.col("body")).otherwise(asked)
    slug = F.when(F.coalesce("slug", F.lit("")) == "", F.raise_error(F.lit("a draft without a slug cannot be found again")).cast("string")).otherwise(F.col("slug"))
    return notes.select(F.concat(F.lit("_inbox/"), slug, F.lit(".md")).alias("path"), F.lit("low").alias("confidence"), body.alias("body"))


def _clean(notes: DataFrame) -> DataFrame:
    """notes with title, sources and body redacted, and ``redactions``."""
    title, a = redacted(F.col("title"))
    body, b = redacted(F.col("body"))
    sources = F.transform("sources", lambda s: F.struct(redacted(s["url"])[0].alias("url"), s["accessed"].alias("accessed"), s["kind"].alias("kind")))
    c = F.aggregate(F.coalesce("sources", F.expr("cast(array() as array<struct<url:string,accessed:string,kind:string>>)")), F.lit(0), lambda n, s: n + F.coalesce(redacted(s["url"])[1], F.lit(0)))
    return notes.withColumns({"redactions": (F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)) + c).cast("long"), "sources": sources, "title": title, "body": body})


def scrubbed(notes: DataFrame, found_before: DataFrame, judge) -> DataFrame:
    """notes with title, sources and body redacted, ``redactions`` and ``error``: what was valid and is not any more.

    notes: as for validation, and body; found_before: their issues; judge: notes -> issues. To be written by ``write_all_or_nothing``.
    A judge that needs no other rows than the note's own has a cheaper way in :func:`scrubbed_alone`.
    """
    clean = _clean(notes)
    broken = judge(clean).join(found_before.select("rel"), "rel", "left_anti").groupBy("rel").agg(F.min(F.struct("key", "code")).alias("i"))
    return clean.join(broken, "rel", "left").withColumn("error", F.when(F.col("i").isNotNull(), F.concat_ws(" ", "rel", "i.key", "i.code"))).drop("i")


def scrubbed_alone(notes: DataFrame, found: Column) -> DataFrame:
    """As :func:`scrubbed`, where ``found`` tells the issues of a note, array<struct<key, code>>, from its row: each text is read once and does not move."""
    clean = _clean(notes.withColumn("sound", F.size(found) == 0))
    # a note in which nothing is redacted is as valid as it was
    first = F.when(F.col("sound") & (F.col("redactions") > 0), F.array_min(found))
    return clean.withColumn("i", first).withColumn("error", F.when(F.col("i").isNotNull(), F.concat_ws(" ", "rel", "i.key", "i.code"))).drop("i", "sound")


def cached_source(rows: DataFrame, ttl_days: int, day: str) -> DataFrame:
    """file, text of fetched sources: named by the hash of the address, with a header that says when and for how long. rows: url, body."""
    return rows.select(F.concat(short_hash(F.col("url"), 16), F.lit(".md")).alias("file"), F.concat(F.lit("---\nurl: "), "url", F.lit(f"\nfetched: {day}\nttl_days: {ttl_days}\n---\n"), "body").alias("text"))


def hook_fields(payload: Column, names: list[str]) -> Column:
    """The named text fields of a hook's JSON; null where it has none or is no JSON."""
    return F.from_json(payload, ", ".join(f"{n} string" for n in names), {"mode": "PERMISSIVE"})


def write_log(records: DataFrame, path: str) -> None:
    """Append one JSON line for each record."""
    records.write.mode("append").json(path)


def write_export(report: DataFrame, lines: DataFrame, log: str, path: str) -> None:
    """The report goes to the log before the lines are written, so that no export goes unrecorded."""
    write_log(report, log)
    lines.select("line").write.mode("errorifexists").text(path)
