"""Saved and patched indexes, probe times, slugs of a hot base."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from notelake.functions.text import host
from notelake.operators import pacing, sinks
from notelake.operators.index_store import IndexStore
from notelake.streaming import incremental

ROWS = "rel string, size long"


def size_of(path):
    return sum(p.stat().st_size for p in Path(path).rglob("*.parquet"))


def test_patches_write_what_they_touch(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "ix"), "rel", buckets=32)
    assert store.manifest() is None
    assert store.save(spark.createDataFrame([(f"n{i}", i) for i in range(3000)], ROWS)) == 1
    whole, opened = size_of(tmp_path), store.read()
    assert store.patch(spark.createDataFrame([("n1", 100), ("new", 7)], ROWS), spark.createDataFrame([("n2",), ("n1",), ("absent",)], "rel string")) == 2
    assert size_of(tmp_path) - whole < whole / 4  # at most four of 32 buckets
    now = {r["rel"]: r["size"] for r in store.read().collect()}
    assert len(now) == 3000 and (now["n1"], now["new"], "n2" in now) == (100, 7, False)
    assert {r["rel"]: r["size"] for r in opened.collect()} == {f"n{i}": i for i in range(3000)}  # the version that was opened
    assert store.read(1).count() == 3000 and store.patch(spark.createDataFrame([], ROWS)) is None
    assert store.patch(spark.createDataFrame([(None, 1)], ROWS)) == 3 and store.patch(spark.createDataFrame([(None, 2)], ROWS)) == 4
    assert [r["size"] for r in store.read().where("rel is null").collect()] == [2]
    assert store.vacuum(keep=1) >= 3 and store.versions() == [4] and store.read().count() == 3001


def test_a_writer_that_dies_leaves_the_old_index(spark, tmp_path, monkeypatch):
    store = IndexStore(spark, str(tmp_path / "ix"), "rel", buckets=4)
    store.save(spark.createDataFrame([("a", 1), ("b", 2)], ROWS))

    def dies(self, manifest):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(IndexStore, "_commit", dies)
        store.patch(spark.createDataFrame([("a", 9)], ROWS))
    assert sorted(map(tuple, store.read().collect())) == [("a", 1), ("b", 2)] and store.versions() == [1]
    # of two writers on one version the second fails, and the first holds
    late = store.manifest() | {"version": 2}
    assert store.patch(spark.createDataFrame([("a", 5)], ROWS)) == 2
    with pytest.raises(RuntimeError, match="another writer"):
        store._commit(late)
    assert sorted(map(tuple, store.read().collect())) == [("a", 5), ("b", 2)]


def test_the_newest_wins_in_any_order(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "ix"), "rel", buckets=3, order="size")
    store.save(spark.createDataFrame([("a", 5), ("a", 7), ("b", 1)], ROWS), epoch=0)
    store.patch(spark.createDataFrame([("a", 6), ("b", 3)], ROWS), epoch=1)
    assert store.patch(spark.createDataFrame([("b", 99)], ROWS), epoch=1) is None
    assert sorted(map(tuple, store.read().collect())) == [("a", 7), ("b", 3)]


def test_notes_heal_as_files_come(spark, tmp_path):
    folder, out = tmp_path / "notes", str(tmp_path / "ix")
    folder.mkdir()
    for k in range(6):
        (folder / f"n{k}.md").write_text(f"body {k}")
    put = lambda: incremental.note_stream(spark, str(folder), 2).writeStream.foreachBatch(incremental.upsert(out, "rel", "mtime", 8)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    put()
    store = IndexStore(spark, out, "rel", 8, "mtime")
    first = store.versions()
    assert {r["rel"]: r["body"] for r in store.read().collect()} == {f"n{k}.md": f"body {k}" for k in range(6)} and len(first) == 3
    (folder / "n9.md").write_text("late")
    put()
    assert store.read().count() == 7 and len(store.versions()) == 4


def test_probes_of_a_host_are_a_spacing_apart(spark):
    rng = random.Random(1)
    urls = [f"https://hot.example/{i}" for i in range(500)] + [f"https://h{i % 9}.example:80/{i}?q" for i in range(200)] + ["not a url", None, "https://hot.example/1"]
    last = spark.createDataFrame([("hot.example", 9_500), ("hot.example", 9_000), ("h1.example:80", 100)], "host string, last_ms long")
    rows = pacing.schedule(spark.createDataFrame([(u,) for u in rng.sample(urls, len(urls))], "url string").repartition(7), last, 10_000, 250).collect()
    assert Counter(r["url"] for r in rows) == Counter({u for u in urls if u})
    times = defaultdict(list)
    for r in rows:
        times[r["host"]].append(r["at_ms"])
    assert times["not a url"] == [10_000] and min(times["hot.example"]) == 10_000 and sorted(times["h1.example:80"])[0] == 10_000
    for at in times.values():
        assert all(b - a == 250 for a, b in zip(sorted(at), sorted(at)[1:]))
    later = pacing.schedule(spark.createDataFrame([("https://a.b/x",)], "url string"), spark.createDataFrame([("a.b", 9_900)], "host string, last_ms long"), 10_000, 250).first()
    assert (later["host"], later["at_ms"]) == ("a.b", 10_150)
    assert len({r["host"] for r in spark.createDataFrame([(u,) for u in urls if u], "url string").select(host("url").alias("host")).distinct().collect()}) == 11


def test_only_what_is_not_cached_is_due(spark):
    urls = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("d",), (None,)], "url string")
    cache = spark.createDataFrame([("a", "alive", 95), ("b", "alive", 10), ("c", "unreachable", 99)], "url string, verdict string, checked_s long")
    assert sorted(r["url"] for r in pacing.due(urls, cache, 100, 50).collect()) == ["b", "c", "d"]


@pytest.mark.parametrize("seed", range(2))
def test_slugs_of_a_hot_base(spark, seed):
    """Numbers are the free ones from 2 on, each once; equal titles have numbers in a row but for used ones."""
    rng = random.Random(seed)
    titles = [rng.choice(["???", "", "!", "A b", "a B", "c", None]) for _ in range(1500)] + ["untitled 7", "untitled-9"]
    taken = {"untitled", "c-2", "c-5", *(f"untitled-{rng.randrange(2, 900)}" for _ in range(300))}
    found = sinks.unique_slugs(spark.createDataFrame([(t,) for t in titles], "title string"), spark.createDataFrame([(t,) for t in taken], "slug string")).collect()
    slugs = [r["slug"] for r in found]
    assert len(set(slugs)) == len(slugs) == len(titles) and not set(slugs) & taken
    bases = {"untitled": lambda t: not (t or "").strip("?!") , "a-b": lambda t: (t or "").lower() == "a b", "c": lambda t: t == "c"}
    names = {"untitled-7", "untitled-9", *bases}
    for base, belongs in bases.items():
        mine = sorted(int(r["slug"].rsplit("-", 1)[1]) if r["slug"] != base else 1 for r in found if belongs(r["title"]))
        free = [n for n in range(1 if base not in taken else 2, 4000) if f"{base}-{n}" not in taken | names][: len(mine)]
        assert mine == free
