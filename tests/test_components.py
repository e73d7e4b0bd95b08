"""Components against union-find: hot centres in shares, and partitions that grow with the table."""

from __future__ import annotations

import random

import pytest

from notelake.operators import components as C


def _plain(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in list(parent)}


@pytest.mark.parametrize("hot", [1 << 20, 8])
def test_hot_centres(spark, monkeypatch, hot):
    """a centre goes in shares; the nodes found hot are told with their shares, and results stay."""
    monkeypatch.setattr(C, "HOT", hot)
    rng = random.Random(hot)
    edges = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(40)] + [(200 + rng.randrange(50), 200 + rng.randrange(50)) for _ in range(40)] + [(1, None), (7, 7), (3, 0)]
    found = C.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in found} == _plain(edges) and len(found) == len(_plain(edges))
    links = spark.createDataFrame([(i, 0) for i in range(1, 60)] + [(9, 2)], "u long, v long")
    settled, few = C._state(links, None, 3)
    assert not settled and (few is None if hot > 60 else few.collect() == [(0, 8)])
    if few is not None:
        again = C._state(links, few, 3)
        assert (again[0], again[1].collect()) == (False, few.collect())


def test_partitions_grow_with_the_table(spark, tmp_path, monkeypatch):
    """a star's shuffles have partitions by the size of the table."""
    spark.range(200_000).selectExpr("id + 1 as u", "cast(floor(id / 2) as long) as v").write.parquet(str(tmp_path / "links"))
    links = spark.read.parquet(str(tmp_path / "links"))
    few = C._parts(links)
    monkeypatch.setattr(C, "partitions", lambda df, megabytes, least: 17)
    assert few == spark.sparkContext.defaultParallelism
    assert "hashpartitioning(u" in (plan := C._star(links, True, None, C._parts(links))._jdf.queryExecution().executedPlan().toString()) and ", 17)" in plan
