"""Repositories as tables: files at a revision, changes of a range with their status, blobs, declarations.

All of them are read by the executors through :mod:`notelake.sources.git`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.operators import renames
from notelake.sources.declarations import declarations
from notelake.sources.git import git_table, is_source

SYMBOLS = "repo string, path string, name string, kind string, start int, end int, body string"


def listing(spark: SparkSession, repo: str, root: str, rev: str = "HEAD") -> DataFrame:
    """repo, path of the source files at a revision."""
    return git_table(spark, "files", {repo: root}, rev=rev).select("repo", "path")


def changed(spark: SparkSession, repo: str, root: str, since: str, rev: str = "HEAD") -> DataFrame:
    """repo, path, status (A, M, D, ...) of what changed between two revisions; a rename is a deletion and an addition."""
    return git_table(spark, "diff", {repo: root}, since=since, rev=rev)


def blobs(spark: SparkSession, repo: str, root: str, paths: DataFrame | None = None, rev: str = "HEAD") -> DataFrame:
    """repo, path, text of the source files at a revision, or of those of ``paths`` (path) that exist in it, whatever their kind."""
    rows = git_table(spark, "blobs", {repo: root}, rev=rev, all=paths is not None)
    return rows if paths is None else rows.join(paths.select("path").distinct(), "path", "left_semi").select("repo", "path", "text")


def first_added(spark: SparkSession, repo: str, root: str, paths: DataFrame, rev: str = "HEAD") -> DataFrame:
    """rel, gen_sha, gen_path, added_s: the commit that added each of ``paths`` (path), followed through renames."""
    changes = git_table(spark, "changes", {repo: root}, rev=rev)
    return renames.first_added(changes, paths.select(F.lit(repo).alias("repo"), "path")).select(F.col("path").alias("rel"), "gen_sha", "gen_path", "added_s")


def symbols(files: DataFrame) -> DataFrame:
    """SYMBOLS of source texts (repo, path, text); other files give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(repo, path, *d) for repo, path, text in zip(batch["repo"], batch["path"], batch["text"]) if is_source(path) for d in declarations(text or "", path.lower().endswith(".java"))]
            yield pd.DataFrame(rows, columns=["repo", "path", "name", "kind", "start", "end", "body"])

    from notelake.session import ship

    ship(files.sparkSession)
    return files.select("repo", "path", "text").mapInPandas(run, SYMBOLS)
