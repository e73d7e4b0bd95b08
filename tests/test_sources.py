from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from notelake.operators.asks import topics
from notelake.operators.index_store import IndexStore
from notelake.sources import logs, vault
from notelake.streaming import incremental


@pytest.fixture
def notes(tmp_path):
    files = {
        "index.md": "# Home\n[[a]]",
        "notes/concept/a.md": "---\ntitle: A note\ntags: [x, 007]\nupdated: 2024-01-01\ntitle: Second\n---\nbody\n---\nmore",
        "notes/concept/crlf.md": "---\r\ntitle: C\r\n---\r\nbody",
        "notes/howto/bad.md": "---\ntitle: [open\n---\nx",
        "notes/howto/none.md": "---\ntitle: x\n----\nno frontmatter",
        "archive/old.md": "old",
        ".git/hidden.md": "no",
        "notes/skip.txt": "no",
    }
    for rel, text in files.items():
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_bytes(text.encode())
    return str(tmp_path)


def test_vault(spark, notes):
    rows = {r["rel"]: r for r in vault.load(spark, notes).collect()}
    assert set(rows) == {"index.md", "notes/concept/a.md", "notes/concept/crlf.md", "notes/howto/bad.md", "notes/howto/none.md", "archive/old.md"}
    a = rows["notes/concept/a.md"]
    assert (a["title"], a["body"], a["fm"]["tags"], a["keys"], a["note_type"]) == ("Second", "body\n---\nmore", ["x", "007"], ["title", "tags", "updated"], "concept")
    assert a["fm"]["updated"] == ["2024-01-01"]
    assert rows["notes/concept/crlf.md"]["title"] == "C" and rows["notes/concept/crlf.md"]["body"] == "body"
    assert rows["notes/howto/bad.md"]["fm_error"] and rows["notes/howto/bad.md"]["title"] == "bad"
    assert rows["notes/howto/none.md"]["keys"] == [] and rows["notes/howto/none.md"]["body"].startswith("---\n")
    assert [r for r in rows if rows[r]["is_content"]] and not rows["archive/old.md"]["is_content"]
    assert not rows["index.md"]["is_contract"] and rows["index.md"]["title"] == "Home"


def test_refresh(spark, notes):
    seen = vault.walk(spark, notes).select("rel", "mtime", "size")
    changed = seen.withColumn("size", F.when(F.col("rel") == "index.md", F.col("size") + 1).otherwise(F.col("size")))
    kept, stale = vault.refresh(seen, changed)
    assert kept.count() == 5 and [r["rel"] for r in stale.collect()] == ["index.md"]


def test_json_lines(spark, tmp_path):
    path = tmp_path / "asks.jsonl"
    path.write_text('{"ts":"2024-01-01T00:00:00Z","event":"ask","topic":"t"}\nnot json\n{"event":"other","topic":"t"}\n')
    assert topics(logs.permissive(spark, str(path), logs.ASK), spark.createDataFrame([("t",)], "slug string")).collect()[0][:2] == ("t", 1)
    with pytest.raises(Exception):
        logs.strict(spark, str(path), logs.ASK).collect()
    assert logs.strict(spark, str(tmp_path / "absent.jsonl"), logs.ASK).count() == 0


def test_commits_transcripts_and_manifests(spark, tmp_path):
    (tmp_path / "log").write_bytes(b"\0s1\x1fAda\x1f2024-01-01T00:00:00+00:00\n\na.go\nb.go\n\0s2\x1fBob\x1f2024-01-02T00:00:00+00:00\n\na.go\n\0bad\n")
    rows = logs.commit_log(spark, str(tmp_path / "log")).orderBy("sha").collect()
    assert [(r["sha"], r["author"], r["files"]) for r in rows] == [("s1", "Ada", ["a.go", "b.go"]), ("s2", "Bob", ["a.go"])]
    lines = [{"message": {"role": "assistant", "content": [{"type": "text", "text": "We decided that x."}, {"type": "tool"}]}}, {"message": {"role": "user", "content": [{"type": "text", "text": "no"}]}}]
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, lines)))
    assert [r["text"] for r in logs.assistant_texts(spark, str(tmp_path / "t.jsonl")).collect()] == ["We decided that x."]
    manifests = [("a/pom.xml", "<dependency><artifactId>x</artifactId><version>1</version></dependency>"), ("b/build.gradle", "implementation 'g:x:2'"), ("c/package.json", '{"dependencies":{"y":"^3"}}')]
    assert {tuple(r) for r in logs.dependencies(spark.createDataFrame(manifests, "path string, text string")).collect()} == {("x", "2"), ("y", "^3")}


def test_streams_equal_batches(spark, tmp_path):
    folder = tmp_path / "asks"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.json").write_text("\n".join(json.dumps({"ts": f"2024-01-0{1 + (i + k) % 9}T00:00:00Z", "event": "ask", "topic": f"t{i % 4}"}) for i in range(20)))
    stream = incremental.topic_counts(incremental.ask_stream(spark, str(folder), 1)).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    assert stream.awaitTermination(120)
    batch = incremental.topic_counts(spark.read.schema(logs.ASK).json(str(folder)))
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, batch.collect()))
    out = str(tmp_path / "latest")
    rows = incremental.ask_stream(spark, str(folder), 1).select("topic", F.col("ts").cast("string").alias("ts"))
    put = rows.writeStream.foreachBatch(incremental.upsert(out, "topic", "ts")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert put.awaitTermination(120)
    store = IndexStore(spark, out, "topic", order="ts")
    newest = spark.read.schema(logs.ASK).json(str(folder)).groupBy("topic").agg(F.max("ts").cast("string").alias("ts"))
    assert sorted(map(tuple, store.read().collect())) == sorted(map(tuple, newest.collect())) and store.versions() == [1, 2, 3]
    incremental.upsert(out, "topic", "ts")(rows_of_first(spark, folder), 0)  # a batch that is run again
    assert store.versions() == [1, 2, 3]


def rows_of_first(spark, folder):
    return spark.read.schema(logs.ASK).json(f"{folder}/0.json").select("topic", F.col("ts").cast("string").alias("ts"))
