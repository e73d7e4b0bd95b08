"""The repository source over three clones, and rename chains against a plain walk."""

from __future__ import annotations

import random
import subprocess

import pytest
from pyspark.sql import functions as F

from notelake.operators import renames
from notelake.sources.git import git_table


class Repo:
    def __init__(self, root):
        self.root, self.day = root, 0
        root.mkdir()
        self("init", "-q", "-b", "main")

    def __call__(self, *args):
        when = f"2024-{1 + self.day // 28:02d}-{1 + self.day % 28:02d}T12:00:00+00:00"
        env = {"GIT_AUTHOR_DATE": when, "GIT_COMMITTER_DATE": when, "GIT_AUTHOR_NAME": "Ada L", "GIT_COMMITTER_NAME": "c", "GIT_AUTHOR_EMAIL": "a@b.co", "GIT_COMMITTER_EMAIL": "a@b.co", "PATH": "/usr/bin:/bin:/usr/local/bin"}
        return subprocess.run(["git", "-C", str(self.root), *args], check=True, capture_output=True, text=True, env=env).stdout

    def commit(self, message="m", **files):
        for name, text in files.items():
            path = self.root / name.replace("__", "/").replace("_DOT_", ".")
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(text)
        self("add", "-A")
        self("commit", "-q", "--allow-empty", "-m", message)
        self.day += 1
        return self("rev-parse", "HEAD").strip()


@pytest.fixture(scope="module")
def repos(tmp_path_factory):
    top = tmp_path_factory.mktemp("repos")
    a, b, c = (Repo(top / n) for n in "abc")
    a.commit("one\n\nReviewed-by: B\n", src__A_DOT_java="class A {}", src__odd_name_DOT_ts="x", README_DOT_md="m")
    a("mv", "src/A.java", "src/B.java")
    a.commit("two", x_DOT_js="1")
    a("checkout", "-q", "-b", "side", "HEAD~1"), a.commit("side", side_DOT_ts="s"), a("checkout", "-q", "main"), a("merge", "-q", "--no-edit", "side")
    a.commit("tab", **{"we\tird é.ts": "t"})
    for k in range(25):
        b.commit(f"c{k}", **{f"f{k % 4}_DOT_java": f"class F {{ int v = {k}; }}"})
    c.commit("only", main_DOT_mjs="export {}")
    return {r.root.name: str(r.root) for r in (a, b, c)}


def test_commits_of_all_repositories(spark, repos):
    rows = git_table(spark, "commits", repos, commits_per_partition=10).collect()
    want = {n: subprocess.run(["git", "-C", r, "log", "--no-merges", "--format=%H"], capture_output=True, text=True).stdout.split() for n, r in repos.items()}
    assert {n: sorted(r["sha"] for r in rows if r["repo"] == n) for n in repos} == {n: sorted(s) for n, s in want.items()}
    first = next(r for r in rows if r["trailers"])
    assert (first["author"], first["trailers"], sorted(first["files"])) == ("Ada L", "Reviewed-by: B", ["README.md", "src/A.java", "src/odd_name.ts"])
    renamed = next(r for r in rows if "x.js" in r["files"])
    assert sorted(renamed["files"]) == ["src/A.java", "src/B.java", "x.js"]  # no renames here
    assert any(r["files"] == ["we\tird é.ts"] for r in rows)
    assert git_table(spark, "commits", repos, commits_per_partition=10).rdd.getNumPartitions() == 1 + 3 + 1


def test_filters_are_pushed(spark, repos):
    rows = git_table(spark, "commits", repos, commits_per_partition=5).where("repo = 'b' and committed >= timestamp '2024-01-20 00:00:00+00:00'")
    assert rows.rdd.getNumPartitions() == 2 and rows.count() == 6  # of seven partitions of three repositories
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Filter (repo" not in plan and "repo#" in plan
    assert "= b)" not in plan.split("BatchScan")[0]  # what was taken over is not compared again
    files = git_table(spark, "files", repos).where("path like 'src/%'")
    assert sorted((r["repo"], r["path"]) for r in files.collect()) == [("a", "src/B.java"), ("a", "src/odd_name.ts")]
    text = git_table(spark, "blobs", repos, shares=3).where("path = 'f1.java'")
    assert [(r["repo"], r["text"]) for r in text.collect()] == [("b", "class F { int v = 21; }")]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    assert [r["repo"] for r in git_table(spark, "commits", repos).where("repo = 'c'").collect()] == ["c"]


def test_trees_differences_and_blobs(spark, repos):
    files = {(r["repo"], r["path"]) for r in git_table(spark, "files", repos).collect()}
    assert files == {("a", "src/B.java"), ("a", "src/odd_name.ts"), ("a", "x.js"), ("a", "side.ts"), ("a", "we\tird é.ts"), *(("b", f"f{k}.java") for k in range(4)), ("c", "main.mjs")}
    assert git_table(spark, "files", repos, all=True).count() == len(files) + 1
    texts = {r["path"]: r["text"] for r in git_table(spark, "blobs", {"a": repos["a"]}).collect()}
    assert texts == {"src/B.java": "class A {}", "src/odd_name.ts": "x", "x.js": "1", "side.ts": "s", "we\tird é.ts": "t"}
    diff = {(r["path"], r["status"]) for r in git_table(spark, "diff", {"a": repos["a"]}, since="HEAD~2").collect()}
    assert {("side.ts", "A"), ("we\tird é.ts", "A")} <= diff and not any(s == "R" for _, s in diff)
    old = {r["path"] for r in git_table(spark, "files", {"a": repos["a"]}, rev="main~2").collect()}
    assert "src/B.java" in old and "we\tird é.ts" not in old


def test_errors_name_the_repository(spark, repos, tmp_path):
    with pytest.raises(Exception, match="rev-parse"):
        git_table(spark, "commits", {"x": str(tmp_path)}).collect()
    with pytest.raises(ValueError, match="no table"):
        git_table(spark, "branches", repos)
    assert git_table(spark, "commits", {}).count() == 0


def test_chains_of_renames_in_a_repository(spark, tmp_path):
    """Ten renames in a row; the first name is used again by another file."""
    repo = Repo(tmp_path / "r")
    first = repo.commit(n0_DOT_md="the first note\n" * 5)
    for k in range(10):
        repo("mv", f"n{k}.md", f"n{k + 1}.md")
        repo.commit(f"rename {k}")
    again = repo.commit(n0_DOT_md="quite another text\n" * 7)
    changes = git_table(spark, "changes", {"r": str(tmp_path / "r")}, commits_per_partition=4)
    assert sorted({r["pos"] for r in changes.collect()}) == list(range(12))
    paths = spark.createDataFrame([("r", "n10.md"), ("r", "n0.md"), ("r", "absent.md")], "repo string, path string")
    found = {r["path"]: (r["gen_sha"], r["gen_path"]) for r in renames.first_added(changes, paths).collect()}
    assert found == {"n10.md": (first, "n0.md"), "n0.md": (again, "n0.md")}


@pytest.mark.parametrize("seed", range(2))
def test_origins_brute_force(spark, seed):
    rng, rows = random.Random(seed), []
    for pos in range(120):
        for path in rng.sample("abcdefg", rng.randrange(1, 3)):
            status = rng.choice("ARRRMD")
            rows.append(("r" if pos % 7 else "s", path, pos, status, rng.choice("abcdefg") if status == "R" else None))
    events = {(repo, path, pos): (status, old) for repo, path, pos, status, old in rows if status in "AR"}

    def origin(repo, path, pos):
        status, old = events[repo, path, pos]
        before = [p for (r, q, p) in events if r == repo and q == old and p < pos] if status == "R" else []
        return origin(repo, old, max(before)) if before else (pos, path)

    found = renames.origins(spark.createDataFrame(rows, "repo string, path string, pos long, status string, old_path string")).collect()
    assert {(r["repo"], r["path"], r["pos"]): (r["origin_pos"], r["origin_path"]) for r in found} == {e: origin(*e) for e in events}
    assert renames.origins(spark.createDataFrame(rows, "repo string, path string, pos long, status string, old_path string").where(F.lit(False))).count() == 0
