"""Known answers of the functions and operators."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from notelake.functions import score, text
from notelake.functions.dates import recall_stale
from notelake.operators import history, recall, similarity
from notelake.operators.components import connected_components


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("value, want", [((2, 2, 9), 0.588), ((2, 2, 4), 0.833), ((0, 2, 4), 0.0)])
def test_f2(spark, value, want):
    assert round(one(spark, score.f2(*map(F.lit, value))), 3) == want


def test_idf_is_capped(spark):
    assert one(spark, score.idf(F.lit(1), F.lit(10_000))) == 3.5
    assert abs(one(spark, score.idf(F.lit(500), F.lit(500))) - 0.6931471805599453) < 1e-12


def test_blend_leaves_inactive_channels_out(spark):
    on, off = F.lit(True), F.lit(False)
    assert round(one(spark, score.blend([("title", on, F.lit(1.0)), ("tags", off, F.lit(0.0)), ("body", on, F.lit(0.9))])), 3) == 0.98
    assert round(one(spark, score.blend([("title", on, F.lit(1.0)), ("tags", on, F.lit(0.0))])), 3) == 0.571


def test_terms(spark):
    assert one(spark, text.terms(F.lit("How does the Transactional Outbox pattern work?"))) == ["outbox", "pattern", "transactional"]
    assert one(spark, text.tokens(F.lit("e é ab İx"))) == ["é", "ab", "ix"]  # lengths are bytes


@pytest.mark.parametrize("title, want", [("Café & C++", "cafe-and-cplusplus"), ("Straße  #1", "strasse-sharp1"), ("", ""), ("---", ""), ("word " * 30, "-".join(["word"] * 16))])
def test_slug(spark, title, want):
    assert one(spark, text.slug(F.lit(title))) == want


def test_saturation(spark):
    words = F.array(*map(F.lit, ["a1", "a1", "a1", "a1"]))
    assert one(spark, score.saturated(words, F.array(F.lit("a1"), F.lit("b1")))) == 0.5


@pytest.mark.parametrize("verified, updated, days, want", [("2024-01-01", None, 10, True), ("2024-01-01", None, 0, False), (None, "2024-01-30", 10, False), (None, None, 10, True), ("bad", "2024-01-30T00:00:00Z", 10, False)])
def test_recall_stale(spark, verified, updated, days, want):
    s = lambda v: F.lit(v).cast("string")
    assert one(spark, recall_stale(s(verified), s(updated), F.lit(days), F.lit(1_706_659_200))) is want


@pytest.mark.parametrize("value, stale, want", [(0.85, False, "ANSWER_FROM_VAULT"), (0.85, True, "UPDATE(refresh)"), (0.849, False, "UPDATE(extend)"), (0.55, True, "UPDATE(extend)"), (0.549, False, "CREATE"), (None, False, "CREATE")])
def test_decide(spark, value, stale, want):
    assert one(spark, score.decide(F.lit(value).cast("double"), F.lit(stale))) == want


def test_canonical_ref(spark):
    assert tuple(one(spark, text.canonical_ref(F.lit("repo:src/A.java:12#A.b")))) == ("repo", "src/A.java", "A.b", 12)
    assert one(spark, text.canonical_ref(F.lit("nothing"))) is None


def test_recall_absent_terms_weigh_the_mean(spark):
    docs = spark.createDataFrame([("a.md", "", "", ["spring"], [], ""), ("b.md", "", "", [], [], "spring")], "rel string, slug string, title string, tags array<string>, stack array<string>, body string")
    asked = spark.createDataFrame([(1, "redis kafka spring", [])], "question_id long, question string, stack array<string>")
    found = {r["rel"]: r["score"] for r in recall.ranked(docs, asked).collect()}
    assert found["a.md"] == round(0.3 * (1 / 3) / 0.4, 3)
    assert found["b.md"] == round(1 / 9, 3)


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5), (None, 3)] + [(2000 + rng.randrange(60), 2000 + rng.randrange(60)) for _ in range(40)]
    parent: dict = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: root(x) for x in parent}


def test_components_without_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_minhash_is_near_jaccard(spark):
    base = [f"w{i}" for i in range(200)]
    docs = [("a", "g", " ".join(base)), ("b", "g", " ".join(base[:150] + [f"v{i}" for i in range(50)])), ("c", "h", " ".join(base)), ("d", "g", ""), ("e", "g", None)]
    frame = spark.createDataFrame(docs, "id string, grp string, text string")
    found = {(r["a"], r["b"]): r["score"] for r in similarity.minhash_pairs(frame).collect()}
    exact = {(r["a"], r["b"]): r["score"] for r in similarity.exact_pairs(frame).collect()}
    assert set(found) == set(exact) == {("a", "b")} and abs(found["a", "b"] - exact["a", "b"]) < 0.12


def test_minhash_as_written_out(spark):
    """Signatures and estimates in plain integers, over whole texts; the exact pairs are found again."""
    mask = 2**64 - 1

    def plain(words):
        hashes = []
        for w in words:
            h = 0xCBF29CE484222325
            for b in w.encode():
                h = (h ^ b) * 0x100000001B3 & mask
            hashes.append(h)
        maps = [((i * 0x9E3779B97F4A7C15 & mask) | 1, (i * 0xC2B2AE3D27D4EB4F + 0x165667B19E3779F9) & mask) for i in range(128)]
        return [min((a * h + b) & mask for h in hashes) for a, b in maps]

    rng = random.Random(3)
    base = [[f"t{k}w{rng.randrange(10**6)}é" for _ in range(60)] for k in range(5)]
    texts = {f"{k}-{m}": " ".join(f"n{m}x{j}" if rng.random() < 0.07 * m else w for j, w in enumerate(words)) for k, words in enumerate(base) for m in range(6)}
    texts |= {"copy": texts["0-0"], "copy2": texts["0-0"].replace(" ", "\n"), "one": "word"}
    frame = spark.createDataFrame([(i, "g", t) for i, t in texts.items()], "id string, grp string, text string")
    least = {i: min(j for j, u in texts.items() if set(u.split()) == set(t.split())) for i, t in texts.items()}
    reps = {i: t for i, t in texts.items() if least[i] == i}
    sig = {i: plain(set(t.lower().split())) for i, t in reps.items()}
    want = {}
    for a in reps:
        for b in reps:
            score = sum(x == y for x, y in zip(sig[a], sig[b])) / 128
            if a < b and score >= 0.4 and any(sig[a][2 * k : 2 * k + 2] == sig[b][2 * k : 2 * k + 2] for k in range(64)):
                want[a, b] = score
    assert {(r["a"], r["b"]): r["score"] for r in similarity.minhash_pairs(frame).collect()} == want
    sets = {i: set(t.split()) for i, t in reps.items()}
    exact = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in reps for b in reps if a < b and len(sets[a] & sets[b]) >= 0.4 * len(sets[a] | sets[b])}
    assert {(r["a"], r["b"]): round(r["score"], 9) for r in similarity.exact_pairs(frame).collect()} == {k: round(v, 9) for k, v in exact.items()}
    sure = [k for k, v in exact.items() if v >= 0.55]
    assert sure and sum(k in want for k in sure) >= 0.9 * len(sure)
    assert {r["id"]: r["rep"] for r in similarity.members(frame).collect()} == least and least["copy2"] == "0-0"


def test_halves_go_away_from_zero(spark):
    assert [one(spark, score.round3(F.lit(x))) for x in (0.0625, -0.0625, 0.0015, -0.0004)] == [0.063, -0.063, 0.002, 0.0]


def test_wide_commits_do_not_couple(spark):
    rows = [(s, "ada" if s < 3 else "bob", f) for s in range(1, 4) for f in ("a.go", "b.go")] + [(9, "bob", f"x{i}") for i in range(26)]
    changes = spark.createDataFrame(rows, "sha long, author string, file string")
    assert [tuple(r) for r in history.coupling(changes).collect()] == [("a.go", "b.go", 3)]
    owner = {r["file"]: (r["owner"], r["share"]) for r in history.owners(changes).collect()}
    assert owner["a.go"] == ("ada", 2 / 3)


def test_demote_then_restore(spark):
    notes = spark.createDataFrame([("n", "high")], "slug string, confidence string")
    none = spark.createDataFrame([], "slug string, prior string")
    finding = lambda v: spark.createDataFrame([("n", 1, v)], "slug string, pos long, verdict string")
    down = history.confidence(notes, finding("broken"), none).first()
    assert (down["action"], down["confidence"], down["remembered"]) == ("demoted", "low", "high")
    after = spark.createDataFrame([("n", "low")], "slug string, confidence string")
    up = history.confidence(after, finding("ok"), spark.createDataFrame([("n", "high")], "slug string, prior string")).first()
    assert (up["action"], up["confidence"], up["remembered"]) == ("restored", "high", None)
