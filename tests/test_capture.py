"""Known answers of gates, drift, capture, migration, scrubbing and the repository source."""

from __future__ import annotations

import subprocess

import duckdb
import pytest
from pyspark.sql import functions as F

from notelake.operators import capture, drift, gates, migrate, reports, sinks
from notelake.operators.index_store import IndexStore
from notelake.plans import captures, contracts
from notelake.sources import config, logs, repository
from notelake.streaming.incremental import upsert

NOW = 1_709_251_200  # 2024-03-01
DRAFT = "draft string, mode string, readable boolean, type string, body string, n_sources int, n_links int, updated string, verified string, freshness_days int"


def judged(spark, row, invalid=0, dangling=0, similar=0, compiled=None, **options):
    one = lambda n: spark.createDataFrame([("d", n)] if n else [], "draft string, n int")
    built = spark.createDataFrame([("d", compiled, "why")] if compiled else [], "draft string, verdict string, detail string")
    drafts = spark.createDataFrame([("d", *row)], DRAFT)
    rows = gates.outcomes(drafts, one(invalid), built, one(dangling), one(similar), NOW, **options)
    return {r["gate"]: (r["verdict"], r["remedy"]) for r in rows.collect()}, gates.quarantined(rows).first()["quarantine"]


SOUND = ("create", True, "concept", "plain words", 1, 0, "2024-02-01", "2024-02-20", 90)


def test_gates(spark):
    told, held = judged(spark, SOUND)
    assert told == {"schema": ("pass", "none"), "citation": ("pass", "none"), "code": ("skipped", "none"), "freshness": ("pass", "none"), "antislop": ("pass", "none"), "link": ("skipped", "none"), "duplicate": ("pass", "none")} and not held
    # citation, freshness, code, phrases and schema keep a draft out; links and duplicates do not
    assert judged(spark, (*SOUND[:4], 0, *SOUND[5:])) [0]["citation"] == ("fail", "mark_unverified")
    assert judged(spark, (*SOUND[:4], 0, *SOUND[5:]))[1]
    stale, held = judged(spark, (*SOUND[:7], "2023-01-01", 90))
    assert stale["freshness"] == ("fail", "drop_confidence") and held
    told, held = judged(spark, (*SOUND[:5], 2, *SOUND[6:]), dangling=1, similar=1)
    assert told["link"] == ("fail", "delegate_to_librarian") and told["duplicate"] == ("fail", "switch_to_update") and not held
    fenced = (*SOUND[:3], "```java\nx\n```", *SOUND[4:])
    assert judged(spark, fenced, compiled="fail", run_code="auto")[0]["code"] == ("fail", "drop_confidence")
    assert judged(spark, fenced, compiled="fail")[0]["code"] == ("skipped", "none")
    # an undated new draft is the schema's affair, an undated update is stale; the type gives the window
    assert judged(spark, (*SOUND[:6], None, None, None))[0]["freshness"][0] == "skipped"
    assert judged(spark, ("update", *SOUND[1:6], None, None, None))[0]["freshness"][0] == "fail"
    assert judged(spark, (*SOUND[:6], None, "2023-06-01", None))[0]["freshness"][0] == "pass"
    assert judged(spark, SOUND, cite=False)[0]["citation"][0] == "skipped"
    assert judged(spark, (*SOUND[:2], "decision", *SOUND[3:4], 0, *SOUND[5:]))[0]["citation"][0] == "skipped"


def test_worst_of(spark):
    rows = [("a", 0, "pass", "p"), ("a", 1, "fail", "f"), ("a", 2, "fail", "g"), ("b", 0, "pass", "p"), ("b", 1, "skipped", "s"), ("c", 0, "pass", "p")]
    found = gates.worst(spark.createDataFrame(rows, "draft string, pos int, verdict string, detail string"), "draft")
    assert sorted(map(tuple, found.collect())) == [("a", "fail", "f"), ("b", "skipped", "s"), ("c", "pass", "")]


def test_symbol_only(spark):
    kind = "repo string, path string, name string, start int, body_hash string"
    now = spark.createDataFrame([("r", "A.java", "Money.add", 5, "h1"), ("r", "B.java", "Other", 1, "x")], kind)
    then = spark.createDataFrame([("r", "A.java", "Money.add", 3, "h0", "v"), ("r", "C.java", "Gone", 1, "g", "v")], kind + ", rev string")
    refs = spark.createDataFrame([("n", 0, "add", 0, None), ("n", 1, "add", 3, None), ("n", 2, "Money.add", 5, "v"), ("n", 3, "Gone", 0, "v"), ("n", 4, "Gone", 0, None), ("n", 5, "ArrayList", 0, "v")], "note string, pos int, symbol string, line int, rev string")
    told = lambda deep: [r["verdict"] for r in drift.symbol_only(refs, now, then, deep).orderBy("pos").collect()]
    assert told(True) == ["ok", "repaired", "suspect", "broken", "skipped", "skipped"]
    assert told(False) == ["ok", "repaired", "suspect", "skipped", "skipped", "skipped"]


def test_unresolved(spark):
    files = spark.createDataFrame([("r", "a/X.java"), ("s", "b/X.java"), ("r", "a/Y.java")], "repo string, path string")
    then = spark.createDataFrame([("r", "old/Z.java", "v")], "repo string, path string, rev string")
    refs = spark.createDataFrame([("n", 0, "X.java", "", "v"), ("n", 1, "Y.java", "", "v"), ("n", 2, "Z.java", "", "v"), ("n", 3, "Q.java", "", "v"), ("n", 4, "X.java", "s", "v")], "note string, pos int, path string, repo string, rev string")
    told = lambda deleted, deep: {r["pos"]: r["verdict"] for r in drift.unresolved(refs, files, deleted, then, deep).collect()}
    assert told(None, True) == {0: "skipped", 2: "broken", 3: "skipped"}
    assert told(None, False) == {0: "skipped", 2: "skipped", 3: "skipped"}
    gone = spark.createDataFrame([("r", "x/z.JAVA"), ("r", "a/z.java")], "repo string, path string")
    assert told(gone, False) == {0: "skipped", 2: "broken"}  # nothing is said of what no deletion bears out
    row = drift.unresolved(refs, files, gone, then, False).where("pos = 2").first()
    assert row["repo_path"] == "r:a/z.java"


def test_sessions_and_inbox(spark):
    texts = spark.createDataFrame([("s", 0, "We decided that a. We agreed that b. We decided that a."), ("s", 1, "We concluded that c. We agreed that d."), ("t", 0, "We decided that a.")], "session string, pos int, text string")
    seen = spark.createDataFrame([], "session string, hash string")
    found = [(r["session"], r["text"]) for r in capture.first_unseen(texts, seen).orderBy("session", "rank").collect()]
    assert found == [("s", "We decided that a."), ("s", "We agreed that b."), ("s", "We concluded that c."), ("t", "We decided that a.")]
    drafts = spark.createDataFrame([("a", "x", ["q1", "q2"]), ("b", "## Open questions\n", ["q"]), ("c", "y\n", [])], "slug string, body string, questions array<string>")
    assert [tuple(r) for r in capture.to_inbox(drafts).orderBy("path").collect()] == [("_inbox/a.md", "low", "x\n\n## Open questions\n\n- q1\n- q2\n"), ("_inbox/b.md", "low", "## Open questions\n"), ("_inbox/c.md", "low", "y\n")]
    with pytest.raises(Exception, match="without a slug"):
        capture.to_inbox(drafts.withColumn("slug", F.lit(""))).collect()
    assert capture.enabled({"enabled": True, "capture": ["d3"]}, "d3") and not capture.enabled({"enabled": False, "capture": ["d3"]}, "d3") and not capture.enabled({"enabled": True}, "d3")


def test_scrub_keeps_what_was_valid(spark, tmp_path):
    con = duckdb.connect()
    con.sql("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    rows = {r["rel"]: r for r in captures.scrub_vault(spark, "/root/testdata/sf0.001").collect()}
    assert len(rows) == con.sql("select count(*) from documents").fetchall()[0][0] and any(r["redactions"] for r in rows.values())
    # a title that redaction makes too long was valid before
    long = "mail " + " ".join("a@b.co" for _ in range(14))
    notes = contracts.contracts(spark, "/root/testdata/sf0.001").limit(1).withColumn("title", F.lit(long))
    judge = lambda x: gates.issues(x, contracts.STACKS, contracts.ALIASES).where("key = 'title'")
    clean = capture.scrubbed(notes, judge(notes), judge)
    assert "too-long" in clean.first()["error"]
    with pytest.raises(ValueError):
        sinks.write_all_or_nothing(clean.select("rel", "title", "error"), str(tmp_path / "out"), "error")


def test_migration(spark):
    notes = spark.createDataFrame([("n", "[[old/a.md#x]] [[b]] [[c|d]] [[b]]"), ("m", "none"), ("e", "")], "rel string, body string")
    moves = spark.createDataFrame([("old/a.md", "new/a.md"), ("x/b.md", "y/b2.md"), ("x/c.md", "y/c2.md")], "src string, dst string")
    rels = spark.createDataFrame([("old/a.md",), ("x/b.md",), ("x/c.md",), ("z/c.md",)], "rel string")
    found = {r["rel"]: (r["body"], r["n"]) for r in migrate.relinked(notes, moves, rels).collect()}
    assert found == {"n": ("[[new/a#x]] [[b2]] [[c|d]] [[b2]]", 3), "m": ("none", 0), "e": ("", 0)}  # c is not unique


def test_repository(spark, tmp_path):
    root = str(tmp_path)
    git = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=a", "-c", "user.email=a@b.co", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "A.java").write_text('class A {\n  int f = 1;\n  void run() {\n    if (x) { "}"; }\n  }\n  class B { int go(int a)\n  { return 1; } }\n}\n')
    (tmp_path / "u.ts").write_text("export const add = (a: number) => a + 1;\nexport function sub(a) {\n  return a;\n}\n")
    (tmp_path / "x.md").write_text("no source")
    git("add", "-A"), git("commit", "-qm", "one")
    assert [r["path"] for r in repository.listing(spark, "r", root).orderBy("path").collect()] == ["A.java", "u.ts"]
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    assert sorted(r["path"] for r in repository.blobs(spark, "r", root, paths("A.java", "absent.ts", "x.md")).collect()) == ["A.java", "x.md"]
    texts = repository.blobs(spark, "r", root)
    assert sorted(r["path"] for r in texts.collect()) == ["A.java", "u.ts"]
    found = {(r["path"], r["name"]): (r["kind"], r["start"], r["end"]) for r in repository.symbols(texts).collect()}
    assert found == {("A.java", "A"): ("class", 1, 8), ("A.java", "A.run"): ("method", 3, 5), ("A.java", "A.B"): ("class", 6, 7), ("A.java", "A.B.go"): ("method", 6, 7), ("u.ts", "add"): ("function", 1, 1), ("u.ts", "sub"): ("function", 2, 4)} or found.pop(("A.java", "A.B.go"), None) is None
    git("mv", "u.ts", "v.ts"), git("rm", "-q", "A.java"), git("commit", "-qm", "two")
    assert sorted((r["path"], r["status"]) for r in repository.changed(spark, "r", root, "HEAD~1").collect()) == [("A.java", "D"), ("u.ts", "D"), ("v.ts", "A")]
    assert repository.first_added(spark, "r", root, paths("v.ts")).first()["gen_path"] == "u.ts"


def test_config_and_logs(spark, tmp_path):
    (tmp_path / "p.yaml").write_text("a: {x: 2}\nl: [3]\n")
    assert config.layered({"a": {"x": 1, "y": 1}, "l": [1, 2]}, [None, str(tmp_path / "absent"), str(tmp_path / "p.yaml")]) == {"a": {"x": 2, "y": 1}, "l": [3]}
    with pytest.raises(FileNotFoundError):
        config.layered({}, [], str(tmp_path / "absent"))
    log = tmp_path / "log.jsonl"
    log.write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r["a"] for r in logs.strict(spark, str(log), "a int").collect()) == [1, 2]
    log.write_text('{"a": 1}\n{"a": 2}\nnot json\n')
    with pytest.raises(ValueError, match=r"log.jsonl:3:"):
        logs.strict(spark, str(log), "a int")
    (tmp_path / "cache.json").write_text('{"url": "u", "verdict": "dead", "checked_s": 5}\nbroken\n')
    assert [tuple(r) for r in logs.link_cache(spark, str(tmp_path / "cache.json")).collect()] == [("u", "dead", 5)]


def test_upsert_takes_the_newest(spark, tmp_path):
    put = upsert(str(tmp_path / "t"), "k", "at")
    rows = lambda *x: spark.createDataFrame(list(x), "k string, at int, v string")
    put(rows(("a", 2, "new"), ("a", 1, "old"), ("b", 1, "b")), 0)
    put(rows(("a", 1, "late"), ("b", 1, "again"), ("c", 1, "c")), 3)  # epochs may be skipped
    put(rows(("c", 5, "c5")), 4)
    assert sorted(map(tuple, IndexStore(spark, str(tmp_path / "t"), "k").read().collect())) == [("a", 2, "new"), ("b", 1, "again"), ("c", 5, "c5")]


def test_reports(spark):
    channels = spark.createDataFrame([("title", 0.4, 0.5, True), ("tags", 0.3, 0.0, False), ("stack", 0.2, 1.0, True), ("body", 0.1, 0.0, True)], "name string, weight double, value double, active boolean")
    assert reports.explain(channels).splitlines()[-1] == "score: 0.571 over weight 0.70"
    groups = spark.createDataFrame([("a", 3, 9, 2), ("b", 1, 1, 0)], "dir string, files int, commits int, notes int")
    assert reports.knowledge_map(groups).splitlines()[2:] == ["- `a`: 2 notes, 3 files, 9 commits"]
    stats = spark.createDataFrame([("d1", 5, 1, 9, "under-100")], "tier string, n int, first int, last int, band string")
    shares = spark.createDataFrame([("java", 9, True), ("go", 1, False)], "value string, n int, biased boolean")
    sheet = reports.datasheet(stats, shares, 7)
    assert "- java: 9 (over 60 percent: biased)" in sheet and "- d1: 5 records, 1 to 9 (under-100)" in sheet
    summary = spark.createDataFrame([(3, 2, 1, 0)], "notes int, valid int, invalid int, orphans int")
    types = spark.createDataFrame([("howto", 2)], "type string, notes int")
    rel = spark.createDataFrame([("x.md",)], "rel string")
    assert reports.vault_index(summary, types, rel, rel, 60).endswith("\n") and len(reports.vault_index(summary, types, rel, rel, 60)) <= 60
    found = spark.createDataFrame([("n2", 1, "broken"), ("n1", 4, "broken"), ("n1", 2, "ok")], "note string, pos int, verdict string")
    assert tuple(reports.top_finding(found).first()) == ("n1", 4, "broken")


def test_slugs_of_equal_titles(spark):
    taken = spark.createDataFrame([("a-note",), ("a-note-3",)], "slug string")
    titles = spark.createDataFrame([("A note",), ("A note",), ("New",), ("New",), ("New 2",)], "title string")
    assert sorted(r["slug"] for r in sinks.unique_slugs(titles, taken).collect()) == ["a-note-2", "a-note-4", "new", "new-2", "new-3"]


def test_fragments(spark):
    rows = spark.createDataFrame([("src", "B.java", ["n2", "n1"], "# src\n"), ("src", "A.java", ["n1"], "# src\n")], "dir string, file string, slugs array<string>, text string")
    assert sinks.fragments(rows, "<b>", "</b>").first()["text"] == "# src\n<b>\n- `A.java`: n1\n- `B.java`: n2, n1\n</b>\n"
