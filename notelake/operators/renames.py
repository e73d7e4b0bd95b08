"""Where files come from: the commit that first added a path, followed back through renames.

A rename points to the last addition or rename of its old path before it (one as-of lookup for all). Then pointers double among the events that are pointed to: each round every
pointer jumps to where its target points, so a chain of n renames takes log2(n) rounds, each an equi join. Names that are used again are no
trouble, since an event is a path at a place of the history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.operators.timeline import last_before
from notelake.session import materialize


def _beyond(jumps: DataFrame, table: DataFrame) -> DataFrame:
    """``jumps`` with far_path, far_pos: where the target points by ``table``, null where it does not."""
    further = table.select("repo", F.col("path").alias("to_path"), F.col("pos").alias("to_pos"), F.col("to_path").alias("far_path"), F.col("to_pos").alias("far_pos"))
    return jumps.join(further, ["repo", "to_path", "to_pos"], "left")


def _jumped(joined: DataFrame) -> DataFrame:
    return joined.select("repo", "path", "pos", F.coalesce("far_path", "to_path").alias("to_path"), F.coalesce("far_pos", "to_pos").alias("to_pos"))


def origins(changes: DataFrame) -> DataFrame:
    """repo, path, pos, origin_pos, origin_path of every addition and rename.

    changes: repo, path, pos (place in the history, growing), status (A, C and R count; of a path and place there is one), old_path. A
    rename of a path that nothing added before, as in a history that was cut, is its own origin.
    """
    events = materialize(changes.where("status in ('A', 'C', 'R')").select("repo", "path", F.col("pos").cast("long").alias("pos"), F.when(F.col("status") == "R", F.col("old_path")).alias("old_path")), "renames")
    asked = events.where("old_path is not null").select("repo", "path", "pos", "old_path", (F.col("pos") - 1).alias("before"))
    points = asked.select("repo", F.col("old_path").alias("name"), F.col("before").alias("at"))
    known = events.select("repo", F.col("path").alias("name"), F.col("pos").alias("at"), F.col("pos").alias("value"))
    found = last_before(points, known, ["repo", "name"], "at").where("value is not null")
    step = asked.join(found.select("repo", F.col("name").alias("old_path"), F.col("at").alias("before"), "value"), ["repo", "old_path", "before"])
    jumps = materialize(step.select("repo", "path", "pos", F.col("old_path").alias("to_path"), F.col("value").alias("to_pos")), "renames")
    # pointers double among the events that something was renamed from; all others follow in one step
    targets = jumps.select("repo", F.col("to_path").alias("path"), F.col("to_pos").alias("pos")).distinct()
    inner = materialize(jumps.join(targets, ["repo", "path", "pos"], "left_semi"), "renames")
    while True:
        joined = materialize(_beyond(inner, inner), "renames")
        if joined.where("far_pos is not null").isEmpty():
            break
        inner = _jumped(joined)
    jumps = _jumped(_beyond(jumps, inner))
    return events.join(jumps, ["repo", "path", "pos"], "left").select("repo", "path", "pos", F.coalesce("to_pos", "pos").alias("origin_pos"), F.coalesce("to_path", "path").alias("origin_path"))


def first_added(changes: DataFrame, paths: DataFrame) -> DataFrame:
    """repo, path, gen_sha, gen_path, added_s of the wanted paths (repo, path): the origin of the last event of each.

    changes: as above, with sha and ts.
    """
    rooted = origins(changes)
    last = rooted.join(paths, ["repo", "path"], "left_semi").groupBy("repo", "path").agg(F.max_by(F.struct("origin_path", "origin_pos"), "pos").alias("o"))
    where = changes.where("status in ('A', 'C', 'R')").select("repo", F.col("path").alias("gen_path"), F.col("pos").alias("gen_pos"), F.col("sha").alias("gen_sha"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("added_s"))
    return last.select("repo", "path", F.col("o.origin_path").alias("gen_path"), F.col("o.origin_pos").alias("gen_pos")).join(where, ["repo", "gen_path", "gen_pos"]).select("repo", "path", "gen_sha", "gen_path", "added_s")
