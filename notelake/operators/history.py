"""Commit history: churn, ownership, co-change, code groups, revisions as of a date, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.operators.timeline import last_before
from notelake.session import partitions

#: Commits of more files than this tell nothing about coupling.
WIDE = 25
#: MB of the tables read for one task that makes pairs.
PAIRED_MB = 4


def churn(changes: DataFrame) -> DataFrame:
    """file, commits. changes: sha, author, file (one row each)."""
    return changes.groupBy("file").agg(F.count("*").alias("commits"))


def owners(changes: DataFrame) -> DataFrame:
    """file, owner, share: the author of most commits, ties to the smaller name."""
    by = changes.groupBy("file", "author").agg(F.count("*").alias("n"))
    best = by.groupBy("file").agg(F.min(F.struct((-F.col("n")).alias("m"), "author")).alias("b"), F.sum("n").alias("total"))
    return best.select("file", F.col("b.author").alias("owner"), (-F.col("b.m") / F.col("total")).alias("share"))


def coupling(changes: DataFrame, wide: int = WIDE, least: int = 2) -> DataFrame:
    """a, b, commits of files changed together; wide commits are left out, so a commit yields few pairs."""
    # a commit's pairs are many times its files, so tasks have few commits: their partial counts stay small
    changes = changes.select("sha", "file").repartition(partitions(changes, PAIRED_MB), "sha")
    few = changes.groupBy("sha").agg(F.count("*").alias("n")).where(F.col("n") <= wide)  # counted first: a wide commit is gathered nowhere
    narrow = changes.join(few.select("sha"), "sha", "left_semi").groupBy("sha").agg(F.collect_set("file").alias("files"))
    sides = F.flatten(F.transform("files", lambda a: F.transform(F.filter("files", lambda b: a < b), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return narrow.select(F.explode(sides).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("commits")).where(F.col("commits") >= least)


def code_groups(files: DataFrame, counted: DataFrame, owned: DataFrame, cited: DataFrame) -> DataFrame:
    """dir, files, commits, notes, owners (by commits, then name). files: file, dir; cited: file, note."""
    rows = files.join(counted, "file", "left").join(owned.select("file", "owner"), "file", "left")
    base = rows.groupBy("dir").agg(F.count("*").alias("files"), F.coalesce(F.sum("commits"), F.lit(0)).alias("commits"))
    notes = files.join(cited, "file").groupBy("dir").agg(F.count_distinct("note").alias("notes"))
    ranked = rows.where("owner is not null").groupBy("dir", "owner").agg(F.sum("commits").alias("c"))
    named = ranked.groupBy("dir").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("m"), "owner"))), lambda x: x["owner"]), ",").alias("owners"))
    return base.join(notes, "dir", "left").join(named, "dir", "left").select("dir", "files", "commits", F.coalesce("notes", F.lit(0)).alias("notes"), F.coalesce("owners", F.lit("")).alias("owners"))


def uncovered(symbols: DataFrame, counted: DataFrame, cited: DataFrame, least_commits: int = 2, least_lines: int = 15) -> DataFrame:
    """Symbols in uncited files that change and are long enough. symbols: file, symbol, lines."""
    return symbols.join(cited, "file", "left_anti").join(counted, "file").where((F.col("commits") >= least_commits) & (F.col("lines") >= least_lines)).select("file", "symbol", "commits", "lines")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, when: str, value: str) -> DataFrame:
    """left with the ``value`` of the newest right row of its key at or before ``at`` (null if none; of one time the largest value).

    Moments of a key are answered once, in cells of time (:func:`notelake.operators.timeline.last_before`), so a hot key is
    not one task's sort, and go back to the rows by an equi join. Times may be timestamps or numbers.
    """
    number = lambda df, c: F.unix_micros(F.col(c).cast("timestamp")) if df.schema[c].dataType.typeName().startswith("timestamp") else F.col(c)
    asked = left.withColumns({"_k": F.col(key), "_t": number(left, at)})
    known = right.select(F.col(key).alias("_k"), number(right, when).alias("_t"), F.col(value).alias("value"))
    found = last_before(asked.select("_k", "_t"), known, ["_k"], "_t").withColumnRenamed("value", "_v")
    return asked.join(found, ["_k", "_t"], "left").select(*(F.col(f"`{c}`") for c in left.columns), F.col("_v").alias(value))


def confidence(notes: DataFrame, findings: DataFrame, demotions: DataFrame) -> DataFrame:
    """slug, action (demoted, restored, stamped), confidence, remembered after a drift run.

    notes: slug, confidence; findings: slug, pos, verdict; demotions: slug, prior. Notes without a finding
    are not evaluated and give no row.
    """
    per = findings.groupBy("slug").agg(F.bool_or(F.col("verdict") == "broken").alias("broken"))
    rows = notes.join(per, "slug").join(demotions, "slug", "left")
    known = F.col("prior").isNotNull()
    action = F.when(F.col("broken") & ~F.coalesce("confidence", F.lit("")).isin("", "low") & ~known, "demoted").when(~F.col("broken") & known, "restored").otherwise("stamped")
    return rows.withColumn("action", action).select(
        "slug",
        "action",
        F.when(F.col("action") == "demoted", "low").when(F.col("action") == "restored", F.col("prior")).otherwise(F.col("confidence")).alias("confidence"),
        F.when(F.col("action") == "demoted", F.col("confidence")).when(F.col("action") == "restored", F.lit(None).cast("string")).otherwise(F.col("prior")).alias("remembered"),
    )


def resolved_in(refs: DataFrame, files: DataFrame, by: list[str] | None = None) -> DataFrame:
    """ref_id, n, at: how many files a citation names, the smallest of them; citations that name none have no row.

    An equi join on the basename and the cited part before it (and on ``by``), then the cited parts in order; the fewest unstated parts win, but a
    bare file name keeps all its matches. A bare name needs no list of its matches: what it names is counted
    for each basename and repository first, so that a very common name meets one row.
    """
    from notelake.functions.text import is_subsequence, segments

    by = by or []
    base = lambda c: F.lower(F.try_element_at(F.col(c), F.lit(-1)))
    want = refs.select("ref_id", *by, F.col("repo").alias("want_repo"), segments(F.col("path")).alias("want")).withColumn("base", base("want"))
    have = files.select(*by, "repo", "path", segments(F.col("path")).alias("have")).withColumn("base", base("have")).where("base is not null")
    spot = F.concat_ws(":", "repo", "path")
    counted = have.groupBy(*by, "base", "repo").agg(F.count("*").alias("n"), F.min(spot).alias("at"))
    whole = counted.groupBy(*by, "base").agg(F.sum("n").alias("n"), F.min("at").alias("at")).withColumn("want_repo", F.lit(""))
    bare = want.where(F.size("want") == 1).join(counted.withColumnRenamed("repo", "want_repo").where("want_repo <> ''").unionByName(whole), [*by, "base", "want_repo"]).select("ref_id", "n", "at")
    # parts may be left out, so the last two of a longer one are no suffix; but its last part but one is some part of the file's folders,
    # so a base name that many files have is no key by itself
    folders = have.withColumn("part", F.explode(F.array_distinct(F.transform(F.slice("have", F.lit(1), F.size("have") - 1), F.lower))))
    hits = want.where(F.size("want") > 1).withColumn("part", F.lower(F.try_element_at("want", F.lit(-2)))).join(folders, [*by, "base", "part"]).where(((F.col("want_repo") == "") | (F.col("want_repo") == F.col("repo"))) & is_subsequence(F.col("want"), F.col("have")))
    best = hits.groupBy("ref_id", (F.size("have") - F.size("want")).alias("extra")).agg(F.count("*").alias("n"), F.min(spot).alias("at"))
    return bare.unionByName(best.groupBy("ref_id").agg(F.min_by(F.struct("n", "at"), "extra").alias("b")).select("ref_id", "b.n", "b.at"))


def resolve_paths(refs: DataFrame, files: DataFrame) -> DataFrame:
    """ref_id, status, repo_path: shorthand citations against repository files. refs: ref_id, path, repo ('' any)."""
    tight = resolved_in(refs, files)
    return refs.select("ref_id").join(tight, "ref_id", "left").select(
        "ref_id", F.when(F.col("n").isNull(), "unresolved").when(F.col("n") == 1, "resolved").otherwise("ambiguous").alias("status"), F.when(F.col("n") == 1, F.col("at")).alias("repo_path")
    )
