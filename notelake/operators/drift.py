"""Drift of all kinds of citations: by path, by symbol alone, unresolved; with evidence of deletions.

The rows of a citation are followed through equi joins: path to file, symbol to declaration (the full name
first, else what follows its last dot), and either to the revision at which its note was verified.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.functions.text import is_subsequence, segments
from notelake.operators.history import resolved_in
from notelake.operators.similarity import fnv1a
from notelake.operators.timeline import in_force, versions
from notelake.session import materialize

#: States of a file, and files of a name, up to which they make up one row, which the citations of the file or name meet.
TREE = 1024
#: Buckets in which the files of names are counted.
NAMES = 1 << 20

# The language of a source file by its extension.
LANGUAGES = {"java": "java", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript"}


def language(path: Column) -> Column:
    table = F.create_map(*(x for k, v in LANGUAGES.items() for x in (F.lit(k), F.lit(v))))
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


#: White space that a body's hash does not see.
_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def body_hash(source: Column) -> Column:
    """16 hex digits, FNV-1a of the body with each run of white space as one blank; null stays null."""

    @F.pandas_udf("string")
    def hashed(bodies: pd.Series) -> pd.Series:
        told = [_BLANK.sub(" ", b).strip(" ").encode("utf-8", "surrogatepass") for b in bodies.dropna()]
        return pd.Series([f"{h:016x}" for h in fnv1a(told).tolist()], index=bodies.dropna().index, dtype=object).reindex(bodies.index)

    return hashed(source)


def file_hash(symbols: DataFrame, by: list[str]) -> DataFrame:
    """``by``, file_hash: names and body hashes of a file's declarations in their order; lines do not count."""
    told = F.transform(F.array_sort(F.collect_list(F.struct("start", "name", "body_hash"))), lambda s: F.concat(s["name"], F.lit(":"), s["body_hash"]))
    return symbols.groupBy(*by).agg(F.sha2(F.array_join(told, ";"), 256).alias("file_hash"))


def declared(symbols: DataFrame, by: list[str] | None = None) -> DataFrame:
    """wanted, full, repo, path, start, body_hash: the declaration that a name finds, the first by repo, path, start, name.

    A name is found under its full name, or under what follows its last dot. symbols: repo, path, name, start,
    body_hash and the columns ``by`` (say, a revision), which are kept apart.
    """
    by = by or []
    place = F.struct("repo", "path", "start", "name", "body_hash")
    short = F.regexp_extract("name", r"^.+\.([^.]*)$", 1)
    both = symbols.select(*by, F.col("name").alias("wanted"), F.lit(0).alias("rank"), place.alias("at")).unionByName(symbols.where(F.col("name").rlike(r"^.+\.[^.]*$")).select(*by, short.alias("wanted"), F.lit(1).alias("rank"), place.alias("at")))
    first = both.groupBy(*by, "wanted").agg(F.min(F.struct("rank", "at")).alias("x"))
    return first.select(*by, "wanted", (F.col("x.rank") == 0).alias("full"), "x.at.repo", "x.at.path", "x.at.start", "x.at.name", "x.at.body_hash")


def verdict(present: Column, symbol: Column, symbol_now: Column, hash_then: Column, hash_now: Column, line_then: Column, line_now: Column) -> Column:
    """The ladder of a citation: file gone, symbol gone, body changed, line moved, fine; body before line."""
    return (
        F.when(~present, "broken")
        .when((symbol != "") & ~symbol_now, "broken")
        .when(hash_then.isNotNull() & (hash_then != hash_now), "suspect")
        .when((symbol != "") & (line_then != 0) & (line_then != line_now), "repaired")
        .otherwise("ok")
    )


def _in_files(symbols: DataFrame) -> DataFrame:
    """repo, path, symbol, start, body_hash: what every full or short name finds within its file, and the file itself ('')."""
    named = symbols.where("symbol <> ''").select(F.struct("repo", "path").alias("file"), "repo", "path", F.col("symbol").alias("name"), "start", "body_hash")
    found = declared(named, ["file"]).select("file.repo", "file.path", F.col("wanted").alias("symbol"), "start", "body_hash")
    return found.unionByName(symbols.where("symbol = ''").select("repo", "path", "symbol", "start", "body_hash"))


def held(events: DataFrame) -> DataFrame:
    """repo, path, name, since, until, start, body_hash: how long each state of a declaration held.

    events: repo, path, name, at (a day), gone, start, body_hash: what commits left of a declaration; of one day there is one row.
    """
    return versions(events, ["repo", "path", "name"], "at").where("not gone").select("repo", "path", "name", F.col("at").alias("since"), "until", "start", "body_hash")


def held_files(states: DataFrame) -> DataFrame:
    """repo, path, since, until, file_hash: how long the declarations of a file stayed as they were. states: as of :func:`held`."""
    days = states.select("repo", "path", F.explode(F.array("since", "until")).alias("at")).where("at is not null").distinct()
    then = file_hash(in_force(days, states.select("repo", "path", "since", "until", "name", "start", "body_hash"), ["repo", "path"], "at"), ["repo", "path", "at"])
    spans = versions(days.join(then, ["repo", "path", "at"], "left"), ["repo", "path"], "at")
    return spans.where("file_hash is not null").select("repo", "path", F.col("at").alias("since"), "until", "file_hash")


def drift(refs: DataFrame, states: DataFrame) -> DataFrame:
    """Citations whose path names one file (``unresolved`` has the others), with their verdict.

    Each note is judged by the tree of its own verification: a body that differs from the one in force at the end of that day is
    suspect. A note that was never verified, a day before the history, a file or a symbol that was not there yet give no baseline and no suspicion.

    refs: note, pos, repo, path, symbol ('' is the whole file), line, verified (a day or null); states: as of :func:`held`. What
    holds still is the tree at HEAD. Gives note, pos, repo, path, symbol, line, line_now, verdict.
    Files of more than ``TREE`` states are judged apart, their states row by row.
    """
    crowded = materialize(states.groupBy("repo", "path").agg(F.count("*").alias("n")).where(F.col("n") > TREE).drop("n"), "crowded")
    if crowded.isEmpty():
        return _drift_of_trees(refs, states)
    among = lambda rows, how: rows.join(crowded, ["repo", "path"], how)
    return _drift_of_trees(among(refs, "left_anti"), among(states, "left_anti")).unionByName(_drift_of_rows(among(refs, "left_semi"), among(states, "left_semi")))


def _drift_of_trees(refs: DataFrame, states: DataFrame) -> DataFrame:
    """:func:`drift` where the states of a file are one row: citations and states move once, by file."""
    short = F.when(F.col("name").rlike(r"^.+\.[^.]*$"), F.regexp_extract("name", r"^.+\.([^.]*)$", 1)).alias("short")
    trees = states.repartition("repo", "path").groupBy("repo", "path").agg(F.collect_list(F.struct("start", "name", "body_hash", short, "since", "until")).alias("tree"), F.bool_or(F.col("until").isNull()).alias("present"))
    symbol, day = F.col("symbol"), F.col("verified")
    named = F.filter("tree", lambda s: (symbol == "") | (s["name"] == symbol) | (s["short"] == symbol))
    rows = refs.join(trees, ["repo", "path"], "left").withColumn("tree", named)
    rows = rows.withColumns({"then": F.filter("tree", lambda s: (s["since"] <= day) & (s["until"].isNull() | (day < s["until"]))), "now": F.filter("tree", lambda s: s["until"].isNull())})
    # the whole file is told by its declarations in their order, a symbol by the first that it finds, full names before short ones
    whole = lambda c: F.when(F.size(c) > 0, F.array_join(F.transform(F.array_sort(c), lambda s: F.concat(s["name"], F.lit(":"), s["body_hash"])), ";"))
    first = lambda c: F.array_min(F.transform(c, lambda s: F.struct((s["name"] != symbol).alias("rank"), s["start"].alias("start"), s["name"].alias("name"), s["body_hash"].alias("body_hash"))))
    rows = rows.withColumns({"at_then": F.when(symbol != "", first("then")), "at_now": F.when(symbol != "", first("now"))})
    told = lambda one, c: F.when(symbol == "", whole(c)).otherwise(F.col(one)["body_hash"])
    rows = rows.withColumns({"hash_then": told("at_then", "then"), "hash_now": told("at_now", "now"), "line_now": F.col("at_now")["start"]})
    return _judged(rows)


def _judged(rows: DataFrame) -> DataFrame:
    return rows.withColumn(
        "verdict", verdict(F.coalesce("present", F.lit(False)), F.col("symbol"), F.col("hash_now").isNotNull(), F.col("hash_then"), F.col("hash_now"), F.col("line"), F.col("line_now"))
    ).select("note", "pos", "repo", "path", "symbol", "line", "line_now", "verdict")


def _drift_of_rows(refs: DataFrame, states: DataFrame) -> DataFrame:
    """:func:`drift` for files of any number of states."""
    files = materialize(held_files(states), "held-files")
    now = states.where("until is null").select("repo", "path", F.col("name").alias("symbol"), "start", "body_hash")
    whole = lambda rows, *more: rows.select("repo", "path", F.lit("").alias("symbol"), F.lit(None).cast(states.schema["start"].dataType).alias("start"), F.col("file_hash").alias("body_hash"), *more)
    head = _in_files(now.unionByName(whole(files.where("until is null")))).select("repo", "path", "symbol", F.col("start").alias("line_now"), F.col("body_hash").alias("hash_now"))
    # every full and short name finds its declarations of that day: the full name first, then the first of the file
    named = states.select("repo", "path", F.col("name").alias("symbol"), F.lit(0).alias("rank"), "name", "start", "body_hash", "since", "until")
    short = named.where(F.col("name").rlike(r"^.+\.[^.]*$")).withColumns({"symbol": F.regexp_extract("name", r"^.+\.([^.]*)$", 1), "rank": F.lit(1)})
    found = named.unionByName(short).unionByName(whole(files, "since", "until").withColumns({"rank": F.lit(0), "name": F.lit("")}))
    asked = refs.where("verified is not null").select("repo", "path", "symbol", "verified").distinct()
    base = in_force(asked, found, ["repo", "path", "symbol"], "verified").groupBy("repo", "path", "symbol", "verified").agg(F.min(F.struct("rank", "start", "name", "body_hash")).alias("x"))
    base = base.select("repo", "path", "symbol", "verified", F.col("x.body_hash").alias("hash_then"))
    present = now.select("repo", "path").distinct().withColumn("present", F.lit(True))
    rows = refs.join(present, ["repo", "path"], "left").join(head, ["repo", "path", "symbol"], "left").join(base, ["repo", "path", "symbol", "verified"], "left")
    return _judged(rows)


def symbol_only(refs: DataFrame, now: DataFrame, then: DataFrame, deep: bool) -> DataFrame:
    """Citations that name a symbol and no path: note, pos, symbol, repo, path, line, line_now, verdict.

    A symbol that is declared is judged by its body and line. One that is not is skipped, unless the
    run is deep and it was declared when the note was verified: then it is broken. refs: note, pos, symbol, line, rev (of
    the note's verification, null if none); now: repo, path, name, start, body_hash; then: the same and rev.
    """
    here = declared(now).select(F.col("wanted").alias("symbol"), F.col("repo").alias("repo_now"), F.col("path").alias("path_now"), F.col("start").alias("line_now"), F.col("body_hash").alias("hash_now"))
    # what stood in the same file under the cited name, to compare bodies with
    base = then.select("rev", F.col("repo").alias("repo_now"), F.col("path").alias("path_now"), F.col("name"), F.col("start"), "body_hash")
    in_file = declared(base.withColumnRenamed("repo_now", "repo").withColumnRenamed("path_now", "path").withColumn("file", F.concat_ws(":", "repo", "path")), ["rev", "file"]).select("rev", "file", F.col("wanted").alias("symbol"), F.col("body_hash").alias("hash_then"))
    was = declared(then, ["rev"]).select("rev", F.col("wanted").alias("symbol"), F.col("repo").alias("repo_then"), F.col("path").alias("path_then"))
    rows = refs.join(here, "symbol", "left").withColumn("file", F.concat_ws(":", "repo_now", "path_now"))
    rows = rows.join(in_file, ["rev", "file", "symbol"], "left").join(was, ["rev", "symbol"], "left")
    present = F.col("hash_now").isNotNull()
    verdict = (
        F.when(present & F.col("hash_then").isNotNull() & (F.col("hash_then") != F.col("hash_now")), "suspect")
        .when(present & (F.col("line") != 0) & (F.col("line") != F.col("line_now")), "repaired")
        .when(present, "ok")
        .when(F.lit(deep) & F.col("repo_then").isNotNull(), "broken")
        .otherwise("skipped")
    )
    gone = verdict == "broken"
    return rows.select("note", "pos", "symbol", F.when(gone, F.col("repo_then")).otherwise(F.col("repo_now")).alias("repo"), F.when(gone, F.col("path_then")).otherwise(F.col("path_now")).alias("path"), "line", "line_now", verdict.alias("verdict"))


def unresolved(refs: DataFrame, files: DataFrame, deleted: DataFrame | None, files_then: DataFrame, deep: bool) -> DataFrame:
    """note, pos, path, repo_path, verdict of the citations whose path names no file, or several.

    Several are skipped. Of those that name none, a run over a range of commits (``deleted`` is given) calls broken
    what a deletion in it bears out, by the file name in either case and the smallest path, and says nothing of the rest. A
    whole run calls broken what resolved to one file when the note was verified, if it is deep, and skips the rest.
    refs: note, pos, path, repo ('' any), rev; files: repo, path; files_then: repo, path, rev; deleted: repo, path. A file may come more than once.

    The files of a name make up one row, which the citations of the name meet; names of more than ``TREE`` files are judged apart, row by row.
    """
    if deleted is None and not deep:  # nothing but the status is asked
        return _unresolved_of_rows(refs, files, None, files_then, False)
    crowded = _crowded(files if deleted is not None else files.select("repo", "path").unionByName(files_then.select("repo", "path")))
    if crowded is None:
        return _unresolved_of_trees(refs, files, deleted, files_then)
    refs = materialize(refs, "cited")
    among = lambda rows, how: rows if rows is None else rows.withColumn("base", _base("path")).join(crowded, "base", how).drop("base")
    apart, rest = (tuple(among(x, how) for x in (refs, files, deleted, files_then)) for how in ("left_semi", "left_anti"))
    return _unresolved_of_trees(*rest).unionByName(_unresolved_of_rows(*apart, deep))


def _base(path: str) -> Column:
    """The last part of a path in lower case; the parts are only told apart where the last one is empty or a dot."""
    last = F.substring_index(F.replace(F.col(path), F.lit("\\"), F.lit("/")), "/", -1)
    return F.when(last.isin("", "."), F.lower(F.try_element_at(segments(F.col(path)), F.lit(-1)))).otherwise(F.lower(last))


def _is_plain(path: Column) -> Column:
    """No part of the path is empty or a dot."""
    around = F.concat(F.lit("/"), F.replace(path, F.lit("\\"), F.lit("/")), F.lit("/"))
    return ~F.contains(around, F.lit("//")) & ~F.contains(around, F.lit("/./"))


def _parts(path: Column) -> Column:
    """The parts of a path in lower case."""
    return F.when(_is_plain(path), F.split(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/")).otherwise(F.transform(segments(path), F.lower))


def _folders(path: Column, base: Column) -> Column:
    """The folders of a path in lower case, each between slashes: /a/b/."""
    plain = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    parts = F.transform(segments(path), F.lower)
    joined = F.array_join(F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.concat(p, F.lit("/"))), "")
    return F.concat(F.lit("/"), F.when(_is_plain(path), F.substr(plain, F.lit(1), F.length(plain) - F.length(base))).otherwise(joined))


def _crowded(files: DataFrame) -> DataFrame | None:
    """base: the names of more than ``TREE`` files; none if there are none. They are counted in ``NAMES`` buckets first, one by one in full ones alone."""
    named = files.select(_base("path").alias("base")).where("base is not null").withColumn("bucket", F.pmod(F.xxhash64("base"), F.lit(NAMES)))
    many = lambda rows, by: rows.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") > TREE).select(by)
    full = materialize(many(named, "bucket"), "full-buckets")
    if full.isEmpty():
        return None
    crowded = materialize(many(named.join(full, "bucket", "left_semi"), "base"), "crowded-names")
    return None if crowded.isEmpty() else crowded


def _unresolved_of_trees(refs: DataFrame, files: DataFrame, deleted: DataFrame | None, files_then: DataFrame) -> DataFrame:
    """:func:`unresolved` where the files of a name are one row: citations and files move once, by name.

    A file is one string there: revision, repository, folders and place, with a NUL after each but the last, so that strings alone are looked through.
    """
    here, then = F.col("kind") == 0, F.col("kind") == 1
    rows = files.select(_base("path").alias("base"), F.lit(0).alias("kind"), F.lit("").alias("rev"), "repo", "path")
    others = files_then.where("rev is not null").select("rev", "repo", "path") if deleted is None else deleted.select(F.lit("").alias("rev"), "repo", "path")
    rows = rows.unionByName(others.select(_base("path").alias("base"), F.lit(1).alias("kind"), "rev", "repo", "path")).where("base is not null").repartition("base")
    nul, spot = F.lit("\0"), F.concat_ws(":", "repo", "path")
    rows = rows.withColumn("file", F.concat("rev", nul, F.coalesce("repo", F.lit("")), nul, _folders(F.col("path"), F.col("base")), nul, spot))
    were = F.collect_set(F.when(then, F.col("file"))) if deleted is None else F.min(F.when(then, F.struct("path", "repo")))
    trees = rows.groupBy("base").agg(F.collect_set(F.when(here, F.col("file"))).alias("here"), were.alias("then"))
    cited = refs.select("note", "pos", "path", "repo", "rev", _base("path").alias("base")).join(trees, "base", "left")
    owner = F.when(F.col("repo") == "", "").otherwise(F.concat("repo", nul))
    cited = cited.withColumns({"want": _parts(F.col("path")), "owner": owner}).withColumns({"folder": F.concat(F.lit("/"), F.try_element_at("want", F.lit(-2)), F.lit("/")), "here_by": F.concat(nul, "owner"), "then_by": F.concat("rev", nul, "owner")})
    # what names one file goes no further; a generator, so that the files are looked through once
    found = cited.withColumn("found", F.explode(F.filter(F.array(_fewest_unstated("here", "here_by")), lambda r: r["n"] != 1)))
    several = F.col("found")["n"] > 1
    if deleted is not None:
        told = found.where(several | F.col("then").isNotNull())
        return told.select("note", "pos", "path", F.when(~several, F.concat_ws(":", "then.repo", "then.path")).alias("repo_path"), F.when(several, "skipped").otherwise("broken").alias("verdict"))
    was = F.when(~several & F.col("rev").isNotNull(), _fewest_unstated("then", "then_by"))
    told = found.withColumn("was", was).withColumn("repo_path", F.when(F.col("was")["n"] == 1, F.col("was")["at"]))
    return told.select("note", "pos", "path", "repo_path", F.when(F.col("repo_path").isNotNull(), "broken").otherwise("skipped").alias("verdict"))


def _fewest_unstated(among: str, by: str) -> Column:
    """extra, n, at: how many files of a name, of those that begin with ``by``, the parts ``want`` of a path name in their order with the fewest unstated
    ones, and the smallest of them, as in :func:`resolved_in`.

    A bare name keeps all its files. Of two parts the first is any folder of the file.
    """
    size, begins = F.size("want"), lambda f: F.startswith(f, F.col(by))
    folders = lambda f: F.substring_index(F.substring_index(f, "\0", -2), "\0", 1)
    whole = lambda f: is_subsequence(F.col("want"), F.split(F.concat(F.substr(folders(f), F.lit(2)), "base"), "/"))
    named = lambda f: F.contains(f, F.col("folder")) & begins(f) & F.contains(folders(f), F.col("folder")) & ((size == 2) | whole(f))
    at = lambda f: F.substring_index(f, "\0", -1)
    told = lambda extra, n, at: F.struct(extra.cast("int").alias("extra"), n.cast("long").alias("n"), at.alias("at"))
    none = told(F.lit(None), F.lit(0), F.lit(None).cast("string"))
    bare = F.transform(F.array(F.transform(F.filter(among, begins), at)), lambda ats: told(F.lit(0), F.size(ats), F.array_min(ats)))[0]
    row = lambda f: told(F.size(F.split(folders(f), "/")) - 1 - size, F.lit(1), at(f))
    less = lambda best, f: F.when(best["extra"].isNull() | (f["extra"] < best["extra"]), f).when(f["extra"] == best["extra"], told(f["extra"], best["n"] + 1, F.least(best["at"], f["at"]))).otherwise(best)
    return F.when(F.col(among).isNull(), none).when(size == 1, bare).when(size > 1, F.aggregate(F.transform(F.filter(among, named), row), none, less)).otherwise(none)


def _unresolved_of_rows(refs: DataFrame, files: DataFrame, deleted: DataFrame | None, files_then: DataFrame, deep: bool) -> DataFrame:
    """:func:`unresolved` for names of any number of files."""
    keyed = materialize(refs.withColumn("ref_id", F.struct("note", "pos")), "cited")  # a citation is known by its note and place
    found = resolved_in(keyed.select("ref_id", "path", "repo"), materialize(files.select("repo", "path").distinct(), "files")).select("ref_id", "n")
    rows = keyed.join(found, "ref_id", "left").where("n is null or n > 1")
    if deleted is None and deep:
        rows = materialize(rows, "unresolved")
    ambiguous = rows.where("n > 1").select("note", "pos", "path", F.lit(None).cast("string").alias("repo_path"), F.lit("skipped").alias("verdict"))
    none = rows.where("n is null").drop("n")
    if deleted is not None:
        gone = deleted.select(_base("path").alias("base"), F.struct("path", "repo").alias("at")).groupBy("base").agg(F.min("at").alias("at"))
        told = none.withColumn("base", _base("path")).join(gone, "base").select("note", "pos", "path", F.concat_ws(":", "at.repo", "at.path").alias("repo_path"), F.lit("broken").alias("verdict"))
        return ambiguous.unionByName(told)
    if not deep:
        return ambiguous.unionByName(none.select("note", "pos", "path", F.lit(None).cast("string").alias("repo_path"), F.lit("skipped").alias("verdict")))
    then = resolve_paths_at(none.select("ref_id", "path", "repo", "rev"), files_then.select("repo", "path", "rev").distinct())
    told = none.join(then, "ref_id", "left").select("note", "pos", "path", "repo_path", F.when(F.col("repo_path").isNotNull(), "broken").otherwise("skipped").alias("verdict"))
    return ambiguous.unionByName(told)


def resolve_paths_at(refs: DataFrame, files: DataFrame) -> DataFrame:
    """ref_id, repo_path where a path resolved to one file among those of its revision. refs: ref_id, path, repo, rev; files: repo, path, rev."""
    return resolved_in(refs.where("rev is not null"), files, ["rev"]).where("n = 1").select("ref_id", F.col("at").alias("repo_path"))


def in_roots(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """path, repo, rel: absolute paths below the root of a repository, the longest root first.

    Every prefix of a path that ends before a slash is looked up, so this is an equi join. paths: path; roots: repo, root.
    """
    parts = F.split("path", "/")
    prefixes = paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("root"))
    hits = prefixes.join(roots.select("repo", F.rtrim("root", F.lit("/")).alias("root")), "root").groupBy("path").agg(F.max_by(F.struct("repo", "root"), F.struct(F.length("root"), "repo")).alias("r"))
    return hits.select("path", "r.repo", F.expr("substring(path, length(r.root) + 2)").alias("rel"))


def markers(refs: DataFrame, now: DataFrame, repo: str) -> DataFrame:
    """path, name, start, slugs: the cited declarations of one repository, the citing notes in the order of their first citation.

    refs: slug, pos (over all notes), symbol.
    """
    here = declared(now).where(F.col("repo") == repo).select(F.col("wanted").alias("symbol"), "path", "name", "start")
    first = refs.where("symbol <> ''").join(here, "symbol").groupBy("path", "name", "start", "slug").agg(F.min("pos").alias("pos"))
    return first.groupBy("path", "name", "start").agg(F.array_sort(F.collect_list(F.struct("pos", "slug"))).alias("s")).select("path", "name", "start", F.transform("s", lambda x: x["slug"]).alias("slugs"))


def cited_refs(frontmatter: DataFrame, body: DataFrame) -> DataFrame:
    """note, pos, raw: the citations of the frontmatter before those of the body, numbered; both: note, pos, raw."""
    from pyspark.sql import Window

    both = frontmatter.select("note", F.lit(0).alias("part"), "pos", "raw").unionByName(body.select("note", F.lit(1).alias("part"), "pos", "raw"))
    return both.select("note", (F.row_number().over(Window.partitionBy("note").orderBy("part", "pos")) - 1).alias("pos"), "raw")


def gated(findings: DataFrame, touched: DataFrame) -> DataFrame:
    """The findings in files that a range of commits touched."""
    return findings.join(touched.select("path").distinct(), "path", "left_semi")
