"""Repositories as a Spark data source: commits, changes, listings, differences and blobs, read by the executors.

    spark.dataSource.register(GitSource)
    spark.read.format("git_tables").option("table", "commits").option("repos", '{"app": "/shared/app.git"}').load()

A partition is a repository and a range of its commits, or a share of its paths. Planning runs git for a revision's name and the number of
commits only; what git prints is parsed in the executors as it comes, so nothing of a repository passes through the driver and no task holds
more than one record of a log or one blob. Clones have to be where executors see them. The revision is resolved once, so all
partitions read one tree.

| table | columns | of git |
|-|-|-|
| commits | repo, sha, author, ts (author's), committed, trailers, files | no merges, no renames |
| changes | repo, sha, ts, committed, pos, path, status, old_path | renames are found; pos counts from the oldest commit |
| files | repo, path, blob, size | the source files of a revision |
| diff | repo, path, status | between the options ``since`` and ``rev``; a rename is a deletion and an addition |
| blobs | repo, path, text | the source files of a revision, or of any extension with the option ``all`` |

Pushed down (with ``spark.sql.python.filterPushdown.enabled``): ``repo`` prunes partitions; ``committed`` bounds the walk; ``path``, equal or with a
prefix, bounds listings and blobs and is left out of what a log gives.
"""

from __future__ import annotations

import json
import subprocess
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, StringStartsWith

from notelake.session import ship

# Extensions of source files.
SOURCES = ("java", "ts", "tsx", "js", "jsx", "mjs")
SCHEMAS = {
    "commits": "repo string, sha string, author string, ts timestamp, committed timestamp, trailers string, files array<string>",
    "changes": "repo string, sha string, ts timestamp, committed timestamp, pos long, path string, status string, old_path string",
    "files": "repo string, path string, blob string, size long",
    "diff": "repo string, path string, status string",
    "blobs": "repo string, path string, text string",
}
HEAD = b"\x1e"
META = "%x1e%H%x1f%an%x1f%aI%x1f%cI%x1f%(trailers:only,unfold)%x1f"


def is_source(path: str) -> bool:
    return "." in path and path.rsplit(".", 1)[-1].lower() in SOURCES


def _git(root: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", root, *args], stdout=subprocess.PIPE, stderr=subprocess.PIPE)
    if done.returncode:
        raise RuntimeError(f"git {args[0]} in {root}: {done.stderr.decode('utf-8', 'replace').strip()}")
    return done.stdout.decode("utf-8", "replace")


def _tokens(root: str, *args: str) -> Iterator[bytes]:
    """What git prints, cut at NUL, as it comes."""
    process = subprocess.Popen(["git", "-C", root, *args], stdout=subprocess.PIPE, stderr=subprocess.PIPE)
    rest = b""
    try:
        while chunk := process.stdout.read(1 << 16):
            *whole, rest = (rest + chunk).split(b"\0")
            yield from whole
        if rest:
            yield rest
        error = process.stderr.read().decode("utf-8", "replace").strip()
        if process.wait():
            raise RuntimeError(f"git {args[0]} in {root}: {error}")
    finally:
        process.kill()
        process.wait()
        process.stdout.close()
        process.stderr.close()


def _text(data: bytes) -> str:
    return data.decode("utf-8", "replace")


@dataclass
class Share(InputPartition):
    """A range of a repository's commits (from the newest), or one of ``of`` shares of its paths."""

    repo: str
    root: str
    rev: str
    at: int = 0
    n: int = 1
    total: int = 0

    def __post_init__(self):
        super().__init__(None)


@dataclass
class Pushed:
    repos: list[str] | None = None
    since: datetime | None = None
    paths: list[str] = field(default_factory=list)
    prefixes: list[str] = field(default_factory=list)

    def takes(self, path: str) -> bool:
        return all(path == p for p in self.paths) and all(path.startswith(p) for p in self.prefixes)

    def pathspec(self) -> list[str]:
        """What git is asked for; :meth:`takes` decides."""
        folders = [p.rsplit("/", 1)[0] for p in self.prefixes if "/" in p]
        longest = max([*self.paths, *folders], key=len, default="")
        return ["--", f":(literal){longest}"] if longest else []


class GitReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.table, self.repos = options.get("table", "commits"), json.loads(options["repos"])
        self.rev, self.since, self.all = options.get("rev", "HEAD"), options.get("since"), options.get("all", "false").lower() == "true"
        self.step, self.shares = int(options.get("commits_per_partition", "10000")), int(options.get("shares", "8"))
        self.pushed = Pushed()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        at = self.pushed
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column == "repo" and isinstance(f, (EqualTo, In)):
                named = [f.value] if isinstance(f, EqualTo) else list(f.value)
                at.repos = [r for r in named if at.repos is None or r in at.repos]
            elif column == "path" and isinstance(f, EqualTo):
                at.paths.append(f.value)
            elif column == "path" and isinstance(f, StringStartsWith):
                at.prefixes.append(f.value)
            else:
                if column == "committed" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    at.since = f.value if at.since is None else max(at.since, f.value)
                yield f  # times are compared again: git counts whole seconds

    def _bound(self) -> list[str]:
        when = self.pushed.since
        if when is None:
            return []
        when = when if when.tzinfo else when.astimezone()
        return [f"--since-as-filter={int(when.astimezone(timezone.utc).timestamp())}"]

    def partitions(self) -> list[Share]:
        out = []
        for repo, root in sorted(self.repos.items()):
            if self.pushed.repos is not None and repo not in self.pushed.repos:
                continue
            rev = _git(root, "rev-parse", "--verify", f"{self.rev}^{{commit}}").strip()
            if self.table == "diff":
                out.append(Share(repo, root, rev))
            elif self.table in ("files", "blobs"):
                out += [Share(repo, root, rev, k, self.shares) for k in range(self.shares)]
            else:
                merges = ["--no-merges"] if self.table == "commits" else []
                total = int(_git(root, "rev-list", "--count", *merges, *self._bound(), rev))
                whole = int(_git(root, "rev-list", "--count", *merges, rev)) if self._bound() else total
                # with a bound the newest are read, but places still count from the oldest
                out += [Share(repo, root, rev, lo, min(self.step, total - lo), whole) for lo in range(0, total, self.step)]
        return out or [Share("", "", "", 0, 0)]

    def read(self, share: Share) -> Iterator[tuple]:
        return getattr(self, f"_{self.table}")(share) if share.root else iter(())

    # ---- logs

    def _log(self, share: Share, *args: str) -> Iterator[tuple[list[str], list[bytes]]]:
        """Header fields and the NUL-separated rest of each commit."""
        head, rest = None, []
        bound = self._bound()
        window = [f"--skip={share.at}", f"--max-count={share.n}"]
        for token in _tokens(share.root, "log", "-z", "--topo-order", f"--format={META}", *args, *bound, *window, share.rev):
            token = token.lstrip(b"\n")
            if token.startswith(HEAD):
                if head is not None:
                    yield head, rest
                *fields, tail = _text(token[1:]).split("\x1f")
                head, rest = fields, [x.encode() for x in [tail.strip("\n")] if x]
            elif token:
                rest.append(token)
        if head is not None:
            yield head, rest

    def _commits(self, share: Share) -> Iterator[tuple]:
        for (sha, author, ts, committed, trailers), files in self._log(share, "--no-merges", "--no-renames", "--name-only"):
            yield share.repo, sha, author, datetime.fromisoformat(ts), datetime.fromisoformat(committed), trailers.strip(), [_text(f) for f in files]

    def _changes(self, share: Share) -> Iterator[tuple]:
        for k, ((sha, _, ts, committed, _), rest) in enumerate(self._log(share, "-M", "--name-status", "--diff-merges=off")):
            at, pos = 0, share.total - 1 - share.at - k
            while at < len(rest):
                status, pair = _text(rest[at])[:1], rest[at][:1] in (b"R", b"C")
                old, path = (_text(rest[at + 1]) if pair else None), _text(rest[at + 1 + pair])
                at += 2 + pair
                if self.pushed.takes(path):
                    yield share.repo, sha, datetime.fromisoformat(ts), datetime.fromisoformat(committed), pos, path, status, old

    # ---- trees

    def _tree(self, share: Share) -> Iterator[tuple[str, str, int]]:
        """path, blob, size of this share's files."""
        for token in _tokens(share.root, "ls-tree", "-r", "-z", "-l", share.rev, *[p.replace(":(literal)", "") for p in self.pushed.pathspec()]):
            meta, path = token.split(b"\t", 1)
            _, kind, blob, size = meta.split()
            if kind == b"blob" and zlib.crc32(path) % share.n == share.at:
                name = _text(path)
                if (self.all or is_source(name)) and self.pushed.takes(name):
                    yield name, _text(blob), int(size)

    def _files(self, share: Share) -> Iterator[tuple]:
        for path, blob, size in self._tree(share):
            yield share.repo, path, blob, size

    def _diff(self, share: Share) -> Iterator[tuple]:
        tokens = _tokens(share.root, "diff", "--no-renames", "-z", "--name-status", f"{self.since}..{share.rev}", *self.pushed.pathspec())
        for status, path in zip(tokens, tokens):
            if self.pushed.takes(_text(path)):
                yield share.repo, _text(path), _text(status)[:1]

    def _blobs(self, share: Share) -> Iterator[tuple]:
        """One batch process a task, one request and one answer at a time."""
        process = subprocess.Popen(["git", "-C", share.root, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)
        try:
            for path, blob, _ in self._tree(share):
                process.stdin.write(f"{blob}\n".encode())
                process.stdin.flush()
                kind = process.stdout.readline().split()
                if len(kind) == 3:  # otherwise it is missing
                    data = process.stdout.read(int(kind[2]) + 1)[:-1]
                    yield share.repo, path, _text(data)
        finally:
            process.stdin.close()
            process.kill()
            process.wait()
            process.stdout.close()


class GitSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_tables"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "commits")]

    def reader(self, schema) -> GitReader:
        return GitReader(dict(self.options))


def git_table(spark: SparkSession, table: str, repos: dict[str, str], **options) -> DataFrame:
    """One of the tables above over named clones."""
    if table not in SCHEMAS:
        raise ValueError(f"no table {table!r}; there are {', '.join(SCHEMAS)}")
    ship(spark)
    spark.dataSource.register(GitSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("git_tables").option("table", table).option("repos", json.dumps(repos))
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()
