"""Budget replay against a walk from call to call; drift memory as a stream against the batch, run by run; the functions of Spark SQL."""

from __future__ import annotations

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from notelake.functions import sql as names
from notelake.functions import text as T
from notelake.operators import ledger
from notelake.operators import timeline
from notelake.operators.history import confidence
from notelake.streaming import drift_memory as M


def walked(calls, chains, caps, present, default="none"):
    spent, out = {}, {}
    for call_id, day, at, stage, cost in sorted(calls, key=lambda c: (c[1], c[2], c[0])):
        room = lambda t: t in present and spent.get((day, t), 0) < caps.get(t, 0)
        chain = ["none"] if stage in ledger.LOCKED else chains.get(stage) or [default]
        usable = [c for c in chain if c == "none" or (room(c) if c in ledger.METERED else c in present)]
        engine = usable[0] if usable else "none"
        out[call_id] = (engine, any(c in ledger.METERED and not room(c) for c in chain))
        if engine in ledger.METERED:
            spent[day, engine] = spent.get((day, engine), 0) + cost
    return out


CHAINS = {"draft": ["api", "local"], "critique": ["advisor", "api"], "verify": ["api", "advisor", "none"], "host": ["host", "advisor"], "empty": []}


@pytest.mark.parametrize("cells, caps, present", [(3, {"api": 500, "advisor": 300}, ["api", "advisor", "local"]), (1024, {"api": 200}, ["api", "advisor"]), (7, {"api": 10**9, "advisor": 40}, ["advisor", "api"]), (1, {}, [])])
def test_replay(spark, monkeypatch, cells, caps, present):
    monkeypatch.setattr(timeline, "CELLS", cells)
    rng = random.Random(cells)
    stages = [*CHAINS, "write", "unknown"]
    calls = [(i, "hot" if rng.random() < 0.6 else rng.choice("abc"), rng.randrange(40), rng.choice(stages), rng.choice([0, 0, 5, 17, 60])) for i in range(400)]
    found = ledger.replay(spark.createDataFrame(calls, "call_id long, day string, at long, stage string, cost long").repartition(3), CHAINS, caps, present).collect()
    assert {r["call_id"]: (r["engine"], r["exhausted"]) for r in found} == walked(calls, CHAINS, caps, present)
    assert {r["engine"] for r in found} <= {*present, "none"}


def test_replay_edges(spark):
    schema = "call_id long, day string, at long, stage string, cost long"
    assert ledger.replay(spark.createDataFrame([], schema), CHAINS, {"api": 1}, ["api"]).count() == 0
    one = spark.createDataFrame([(1, "d", 1, "draft", 10), (2, "d", 2, "draft", 10)], schema)
    assert [r["engine"] for r in ledger.replay(one, {}, {"api": 5}, ["api"], default="api").orderBy("call_id").collect()] == ["api", "none"]


def test_memory_equals_the_batch_run_by_run(spark, tmp_path):
    """Three runs: broken, still broken, whole again; what the stream says is what the batch says with the memory carried over."""
    rng = random.Random(6)
    slugs = [f"n{i}" for i in range(12)]
    start = {s: rng.choice(["high", "medium", "low", None]) for s in slugs}
    runs = [{s: [(p, rng.choice(["broken", "ok", "ok", "suspect"])) for p in range(3)] for s in slugs if rng.random() < 0.8} for _ in range(3)]
    folder = tmp_path / "looks"
    folder.mkdir()
    notes = spark.createDataFrame([(s, r, start[s], f"sha{r}", f"day{r}") for r, run in enumerate(runs) for s in run], "slug string, run long, confidence string, sha string, day string")
    findings = spark.createDataFrame([(s, r, p, v, f"ref{p}") for r, run in enumerate(runs) for s in run for p, v in run[s]], "slug string, run long, pos int, verdict string, ref string")
    rows = [r.asDict() for r in M.looks(notes, findings).collect()]
    for r in range(3):
        seen = [next(x for x in rows if x["run"] == 0)] if r else []  # a look that was seen before
        (folder / f"{r}.json").write_text("\n".join(json.dumps(x) for x in [*(x for x in rows if x["run"] == r), *seen]))
        os.utime(folder / f"{r}.json", (1_700_000_000 + r, 1_700_000_000 + r))  # files come in the order of their times
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(M.LOOKS).option("maxFilesPerTrigger", 1).json(str(folder))
        query = M.remembered(stream).writeStream.outputMode("append").format("memory").queryName("moves").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert query.awaitTermination(180)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)
    moves = spark.table("moves").collect()
    held, memory = dict(start), {}
    for r, run in enumerate(runs):
        batch = confidence(
            spark.createDataFrame([(s, held[s]) for s in slugs], "slug string, confidence string"),
            spark.createDataFrame([(s, p, v) for s in run for p, v in run[s]], "slug string, pos int, verdict string"),
            spark.createDataFrame(list(memory.items()), "slug string, prior string"),
        ).collect()
        told = {m["slug"]: (m["action"], m["confidence"], m["remembered"]) for m in moves if m["run"] == r}
        assert told == {b["slug"]: (b["action"], b["confidence"], b["remembered"]) for b in batch} and told
        for b in batch:
            held[b["slug"]] = b["confidence"]
            memory.pop(b["slug"], None)
            if b["remembered"] is not None:
                memory[b["slug"]] = b["remembered"]
    actions = {m["action"] for m in moves}
    assert actions == {"demoted", "restored", "stamped"}
    for m in moves:
        if m["action"] == "restored":
            down = max((d for d in moves if d["slug"] == m["slug"] and d["action"] == "demoted" and d["run"] < m["run"]), key=lambda d: d["run"])
            assert m["from_sha"] == down["sha"] and down["line"].endswith("->low") and m["line"].startswith(f"restore {m['slug']} {down['sha']} -> {m['sha']}")


BODIES = ["`src/A.java:12` `A.b()` `src/A.java:12` ``", "`Money.add` ` Money.add ` `x/Y` `no` `bad name` `B.TSX#L7`", "`a\\b.kt` `Foo` `Foo.bar` `.java` `x.java:1234567`", None, "", "İΣς C++ & C# Straße -- " + "long title " * 12, "[[a.md#x|y]] `[[no]]` [[ ]]"]


def test_functions_of_sql_are_the_columns(spark):
    names.register(spark)
    rows = spark.createDataFrame(list(enumerate(BODIES)), "i int, t string")
    rows.createOrReplaceTempView("bodies")
    c = F.col("t")
    want = rows.select("i", T.tokens(c).alias("a"), T.terms(c).alias("b"), T.slug(c).alias("c"), T.is_slug(c).alias("d"), T.wikilinks(c).alias("e"), T.link_key(c).alias("f"), T.body_refs(c).alias("g"), T.short_hash(c, 8).alias("h")).collect()
    found = spark.sql("select i, note_tokens(t) a, note_terms(t) b, note_slug(t) c, note_is_slug(t) d, note_wikilinks(t) e, note_link_key(t) f, note_refs(t) g, note_short_hash(t, 8) h from bodies").collect()
    assert sorted(found) == sorted(want)


def test_refs_as_a_table(spark):
    names.register(spark)
    spark.createDataFrame([(str(i), t) for i, t in enumerate(BODIES)], "note string, body string").createOrReplaceTempView("bodies")
    table = spark.sql("select r.* from bodies b, lateral refs(b.note, b.body) r").collect()
    inline = spark.sql("select note, at, ref.* from (select note, note_refs(body) as refs from bodies) n, lateral posexplode(n.refs) r(at, ref)")
    assert sorted(table) == sorted(inline.collect()) and len(table) == 7
    plan = inline._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and "Join" not in plan and "Python" not in plan
