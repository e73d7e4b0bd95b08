"""Values and versions along time against plain loops; hot keys, ties, nulls, open ends."""

from __future__ import annotations

import random

import pytest

from notelake.operators import drift as D
from notelake.operators import history as H
from notelake.operators import timeline as T


@pytest.mark.parametrize("cells, span", [(1, 40), (7, 40), (1024, 3000)])
def test_last_before(spark, monkeypatch, cells, span):
    monkeypatch.setattr(T, "CELLS", cells)
    rng = random.Random(cells)
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", None])
    values = [(key(), rng.choice([None, rng.randrange(-span, span), rng.randrange(3)]), rng.choice([None, rng.randrange(99)])) for _ in range(300)]
    points = [(key(), rng.choice([None, rng.randrange(-span - 5, span + 5)])) for _ in range(300)]
    found = T.last_before(spark.createDataFrame(points, "k string, t int"), spark.createDataFrame(values, "k string, t int, value int"), ["k"], "t").collect()
    want = {}
    for k, t in points:
        if k is not None and t is not None:
            before = [(u, v) for j, u, v in values if j == k and u is not None and u <= t and v is not None]
            want[k, t] = max(before)[1] if before else None
    assert {(r["k"], r["t"]): r["value"] for r in found} == want and len(found) == len(want)


@pytest.mark.parametrize("cells", [1, 5, 1024])
def test_versions(spark, monkeypatch, cells):
    monkeypatch.setattr(T, "CELLS", cells)
    rng = random.Random(3)
    events = sorted({(rng.choice("aaab"), rng.randrange(200)) for _ in range(120)})
    found = {(r["k"], r["t"]): r["until"] for r in T.versions(spark.createDataFrame(events, "k string, t int"), ["k"], "t").collect()}
    assert found == {(k, t): min((u for j, u in events if j == k and u > t), default=None) for k, t in events}


@pytest.mark.parametrize("span, direct", [(1, 0), (15, 0), (16, 0), (17, 0), (300, 0), (70_000, 0), (300, 64), (300, 1000)])
def test_in_force(spark, monkeypatch, span, direct):
    """Every moment meets exactly the versions whose [since, until) has it, and each once, met directly or by blocks."""
    monkeypatch.setattr(T, "DIRECT", direct)
    rng = random.Random(span)
    held = [("k" if i % 3 else "other", i, rng.choice([None, rng.randrange(-span, span + 1)]), rng.choice([None, 0, 1, 5, span])) for i in range(150)]
    held = [(k, i, a, None if a is None or d is None else a + d) for k, i, a, d in held]
    points = [("k", p, rng.choice([None, rng.randrange(-2 * span, 3 * span)])) for p in range(150)] + [("k", p, a) for p, (_, _, a, _) in enumerate(held[:40], 150)]
    found = T.in_force(spark.createDataFrame(points, "k string, p int, t int"), spark.createDataFrame(held, "k string, i int, since int, until int"), ["k"], "t")
    want = [(p, i) for k, p, t in points for j, i, a, b in held if k == j and t is not None and a is not None and a <= t and (b is None or t < b)]
    assert sorted((r["p"], r["i"]) for r in found.collect()) == sorted(want)


def test_in_force_of_nothing(spark):
    points, held = spark.createDataFrame([("k", 1)], "k string, t int"), spark.createDataFrame([], "k string, since int, until int")
    assert T.in_force(points, held, ["k"], "t").count() == 0
    assert T.in_force(points.where("false"), spark.createDataFrame([("k", 1, None)], "k string, since int, until int"), ["k"], "t").count() == 0


def test_as_of_keeps_all_rows(spark):
    left = spark.createDataFrame([("k", 5, "x"), ("k", 5, "x"), ("k", 1, "y"), (None, 9, "z"), ("k", None, "w")], "key string, at int, value string")
    right = spark.createDataFrame([("k", 5, 2), ("k", 5, 7), ("k", 3, 1), (None, 1, 4)], "key string, when int, rev int")
    rows = sorted(map(tuple, H.as_of(left, right, "key", "at", "when", "rev").collect()), key=str)
    assert rows == sorted([("k", 5, "x", 7), ("k", 5, "x", 7), ("k", 1, "y", None), (None, 9, "z", None), ("k", None, "w", None)], key=str)


def test_each_note_meets_the_tree_of_its_own_verification(spark):
    """Two revisions after the note, one before it, none at all; a note without a date is never suspect."""
    e = [("r", "F", "C.m", 10, False, 1, "one"), ("r", "F", "C.m", 20, False, 1, "two"), ("r", "F", "C.m", 30, False, 4, "one"), ("r", "F", "C.gone", 10, False, 9, "g"), ("r", "F", "C.gone", 25, True, 9, "g"), ("r", "Old", "D", 5, False, 1, "d"), ("r", "Old", "D", 6, True, 1, "d")]
    states = D.held(spark.createDataFrame(e, "repo string, path string, name string, at int, gone boolean, start int, body_hash string"))
    cases = [
        # symbol, line, verified, verdict: the body of day 30 is that of day 10 again
        ("C.m", 4, 15, "ok"), ("C.m", 4, 20, "suspect"), ("m", 4, 29, "suspect"), ("m", 1, 30, "repaired"), ("C.m", 0, 10, "ok"), ("C.m", 4, 9, "ok"), ("C.m", 4, None, "ok"), ("C.m", 1, None, "repaired"),
        ("C.gone", 9, 15, "broken"), ("C.never", 0, 15, "broken"), ("", 0, 12, "suspect"), ("", 0, 22, "suspect"), ("", 0, 30, "ok"), ("", 0, 26, "suspect"), ("", 0, None, "ok"), ("", 0, 3, "ok"),
    ]
    refs = [("n", i, "r", "F", s, line, v) for i, (s, line, v, _) in enumerate(cases)] + [("n", 90, "r", "Old", "", 0, 5), ("n", 91, "r", "None", "D", 0, 5)]
    found = {r["pos"]: r["verdict"] for r in D.drift(spark.createDataFrame(refs, "note string, pos int, repo string, path string, symbol string, line int, verified int"), states).collect()}
    assert found == {i: c[3] for i, c in enumerate(cases)} | {90: "broken", 91: "broken"}


def test_body_hashes_are_fnv_of_the_body_with_single_blanks(spark):
    def fnv(data):
        h = 0xCBF29CE484222325
        for b in data:
            h = (h ^ b) * 0x100000001B3 % 2**64
        return f"{h:016x}"

    bodies = ["", " a\n\tb  c ", "a b c", "a b c", "x y", "a\x1cb", None, "é" * 50]
    rows = spark.createDataFrame(list(enumerate(bodies)), "i int, b string").select("i", D.body_hash("b").alias("h")).collect()
    assert [r["h"] for r in sorted(rows)] == [fnv(b"" if not b else t.encode()) if b is not None else None for b, t in zip(bodies, ["", "a b c", "a b c", "a b c", "x y", "a\x1cb", None, "é" * 50])]


def test_citations_move_once_and_hot_files_are_judged_the_same(spark, monkeypatch):
    """Citations meet the states of their file in one join; files beyond ``TREE`` states give what row by row gives."""
    rng = random.Random(8)
    e = {(rng.choice(["hot"] * 5 + ["F", "G"]), rng.choice(["C.m", "C.n", "D.m", "m", "solo"]), rng.randrange(40)): (rng.random() < 0.3, rng.randrange(4), rng.choice("xyz")) for _ in range(150)}
    events = [("r", p, n, at, *more) for (p, n, at), more in e.items()]
    states = D.held(spark.createDataFrame(events, "repo string, path string, name string, at int, gone boolean, start int, body_hash string")).cache()
    refs = [("n", i, rng.choice(["r", "r", "r", None]), rng.choice(["hot", "F", "G", "none"]), rng.choice(["", "C.m", "m", "n", "solo", "never"]), rng.randrange(4), rng.choice([None, *range(-2, 45)])) for i in range(300)]
    refs = spark.createDataFrame(refs, "note string, pos int, repo string, path string, symbol string, line int, verified int")
    want = sorted(map(str, D._drift_of_rows(refs, states).collect()))
    assert len(set(r.split("verdict=")[1] for r in want)) == 4
    met = D.drift(refs, states)
    assert met._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    for most in (1024, 20, 0):
        monkeypatch.setattr(D, "TREE", most)
        assert sorted(map(str, D.drift(refs, states).collect())) == want, most


def test_versions_without_cells(spark, monkeypatch):
    """Few rows a key need no cells; nulls of key or time match nothing either way."""
    events = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("b", 2, "z"), (None, 1, "n"), ("a", None, "n")], "k string, t int, v string")
    plain = T.versions(events, ["k"], "t")
    assert "cell" not in plain._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(T, "PLAIN", 0)
    assert sorted(map(tuple, T.versions(events, ["k"], "t").select(plain.columns).collect())) == sorted(map(tuple, plain.collect())) == [("a", 1, "y", 3), ("a", 3, "x", None), ("b", 2, "z", None)]


def test_last_before_without_cells(spark, monkeypatch):
    """few rows a key need no cells."""
    values = spark.createDataFrame([("a", 1, 5), ("a", 4, 6), ("a", 4, 9), ("b", None, 1)], "k string, t int, value int")
    points = spark.createDataFrame([("a", 0), ("a", 3), ("a", 4), ("b", 2), (None, 1)], "k string, t int")
    plain = T.last_before(points, values, ["k"], "t")
    assert "cell" not in plain._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(T, "PLAIN", 0)
    assert sorted(map(tuple, T.last_before(points, values, ["k"], "t").collect()), key=str) == sorted(map(tuple, plain.collect()), key=str) == [("a", 0, None), ("a", 3, 5), ("a", 4, 9), ("b", 2, None)]


def test_pointers_double_among_their_targets_alone(spark, monkeypatch):
    """a rename that nothing was renamed from takes no part in the rounds."""
    from notelake.operators import renames

    told, keep = [], renames.materialize
    monkeypatch.setattr(renames, "materialize", lambda df, label: told.append(keep(df, label)) or told[-1])
    chain = [("r", f"c{i}", 10 + i, "R" if i else "A", f"c{i - 1}" if i else None) for i in range(6)]
    leaves = [("r", f"leaf{i}", 100 + i, "R", "c0") for i in range(50)]
    found = {r["path"]: (r["origin_path"], r["origin_pos"]) for r in renames.origins(spark.createDataFrame(chain + leaves, "repo string, path string, pos long, status string, old_path string")).collect()}
    assert set(found.values()) == {("c0", 10)} and len(found) == 56
    assert [t.count() for t in told[2:]] == [4] * len(told[2:])  # c1 to c4


def test_citations_meet_their_status_once(spark, monkeypatch):
    """One join tells which citations are resolved."""
    monkeypatch.setattr(D, "resolved_in", lambda refs, files, by=None: spark.createDataFrame([(("n", 1), 2, "r:x"), (("n", 2), 1, "r:y")], "ref_id struct<note:string,pos:int>, n long, at string"))
    refs = spark.createDataFrame([("n", i, "a/b", "", None) for i in (1, 2, 3)], "note string, pos int, path string, repo string, rev string")
    files = spark.createDataFrame([("r", "x")], "repo string, path string")
    found = D.unresolved(refs, files, None, files, False)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
    assert sorted(map(tuple, found.collect())) == [("n", 1, "a/b", None, "skipped"), ("n", 3, "a/b", None, "skipped")]
