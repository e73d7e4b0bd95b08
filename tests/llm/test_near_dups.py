"""Near duplicates against a brute force that knows nothing of the module: tuples of words, every pair that shares one."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from notelake.llm import near_dups
from notelake.session import table
from tests.llm.test_operators import LONG, edge_documents, empty


def folded(text):
    return tuple((text or "").encode("utf-8", "surrogatepass").lower().split())


def shingles(words, width=5):
    return {words[i : i + width] for i in range(max(1, len(words) - width + 1))} if words else set()


def brute_kept(texts):
    """The smallest id of every group of linked texts, and the number of links between unequal ones."""
    classes = defaultdict(list)
    for i, t in texts.items():
        classes[folded(t)].append(i)
    sets = {min(ids): shingles(words) for words, ids in classes.items()}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders, links = defaultdict(list), 0
    for i in sorted(sets):
        common = defaultdict(int)
        for s in sets[i]:
            for j in holders[s]:
                common[j] += 1
            holders[s].append(i)
        for j, both in common.items():
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                links += 1
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i for i in sets if root(i) == i}, links


def kept(spark, texts, parts=5):
    rows = near_dups.one_of_each(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(parts)).collect()
    assert len(rows) == len({r["doc_id"] for r in rows})
    return {r["doc_id"] for r in rows}


def planted(seed, n, words=20_000):
    """40 to 400 words, 0 to 3 edits in each 80: similarities on both sides of the bound."""
    rng, texts = random.Random(seed), {}
    word = lambda: f"v{rng.randrange(words)}"
    while len(texts) < n:
        base = [word() for _ in range(rng.randint(40, 400))]
        for _ in range(rng.choice([1, 2, 3, 5, 20])):
            some = list(base)
            for lo in range(0, len(base), 80):
                for _ in range(rng.randint(0, 3)):
                    some[min(len(base) - 1, lo + rng.randrange(80))] = word()
            texts[len(texts)] = " ".join(some)
    return texts


def test_planted(spark):
    texts = planted(1, 1200)
    want, links = brute_kept(texts)
    assert links > 300 and kept(spark, texts) == want


@pytest.mark.parametrize("small, meeting, block, salted", [(16, (128, 512), 4096, 10_000), (2, (3, 5), 7, 3)])
def test_dense_family(spark, monkeypatch, small, meeting, block, salted):
    """Runs, blocks, cells and salts of a few rows give what large ones give."""
    for name, value in (("SMALL", small), ("MEETING", meeting), ("BLOCK", block), ("SALTED", salted), ("FREQUENT", 2)):
        monkeypatch.setattr(near_dups, name, value)
    rng, texts = random.Random(5), {}
    for family in range(3):
        base = [f"f{family}w{rng.randrange(10**6)}" for _ in range(90)]
        for _ in range(60):
            some = list(base)
            for _ in range(rng.choice([1, 2, 3, 4, 5])):
                some[rng.randrange(90)] = f"w{rng.randrange(10**6)}"
            texts[len(texts)] = " ".join(some)
    assert kept(spark, texts) == brute_kept(texts)[0]


@pytest.mark.parametrize("piece", [1, 7, 1000])
def test_a_run_is_streamed(monkeypatch, piece):
    """Visitors of a hot shingle pass by in pieces: no more than owners and a piece are compared at once, and what is connected stays so."""
    monkeypatch.setattr(near_dups, "BLOCK", 20)
    rng, bound = np.random.default_rng(4), near_dups.Similarity(0.8)
    bases = [rng.integers(0, 2**64, 60, dtype=np.uint64) for _ in range(4)]
    sets = [np.unique(np.concatenate([bases[k % 4][: 60 - k % 3], rng.integers(0, 2**64, k % 5 + 200 * (k % 11 == 0), dtype=np.uint64)])) for k in range(400)]
    rows = sorted([(k % 3, k % 2, int(k >= 90), k, k % 50, len(x), near_dups.parity(x).tobytes()) for k, x in enumerate(sets)])
    pieces, stack = [], np.stack

    def watched(arrays, *a, **b):
        pieces.append(len(arrays))
        return stack(arrays, *a, **b)

    names = ["key", "cell", "role", "node", "grp", "size", "whole"]
    table_ = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[lo : lo + piece]], pa.binary() if c == 6 else pa.int64()) for c in range(7)], names=names) for lo in range(0, len(rows), piece)]
    monkeypatch.setattr(near_dups.np, "stack", watched)
    found = [tuple(x) for batch in near_dups._families(bound)(iter(table_)) for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
    monkeypatch.undo()
    assert max(pieces) <= 20

    def roots(pairs):
        up = list(range(400))
        top = lambda x: x if up[x] == x else top(up[x])
        for a, b in pairs:
            up[max(top(a), top(b))] = min(top(a), top(b))
        return [top(x) for x in range(400)]

    want = []
    for p in rows:
        for q in rows:
            if p[:2] == q[:2] and p[3] < q[3] and 0 in (p[2], q[2]) and p[4] != q[4] and bound.sizes(p[5], q[5]):
                x, y = (np.frombuffer(r[6], dtype=np.uint64) for r in (p, q))
                longs = min(len(x), len(y))
                if bound.distance(p[5], q[5], int(np.bitwise_count(near_dups.narrowed(x, longs) ^ near_dups.narrowed(y, longs)).sum())):
                    want.append((p[3], q[3]))
    assert set(found) <= set(want) and roots(found) == roots(want) and len(want) > 300


def test_repeats_inside_and_common_passages(spark):
    rng, texts = random.Random(8), {}
    words = lambda n: " ".join(f"r{rng.randrange(10**6)}" for _ in range(n))
    passage = words(60)
    for _ in range(30):
        body, line = words(300), words(12)
        texts[len(texts)] = f"{body}\n{line} {passage}"
        texts[len(texts)] = "\n".join([body, *[line] * 50, passage])
    for _ in range(40):  # a passage that is most of a short text, but not enough of it
        texts[len(texts)] = f"{passage} {words(25)}"
    want, _ = brute_kept(texts)
    assert len(want) == 70 and kept(spark, texts) == want


@pytest.mark.parametrize("sf", ["0.001", "0.1"])
def test_documents(spark, sf):
    docs = table(spark, f"/root/testdata/sf{sf}", "documents")
    want, _ = brute_kept({r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()})
    rows = near_dups.one_of_each(docs)
    assert rows.columns == docs.columns and sorted(r["doc_id"] for r in rows.collect()) == sorted(want)


def test_right_at_the_bound(spark):
    """Of 9 distinct shingles 8 in common of 10 are enough; one less is not."""
    w = [f"b{k}" for k in range(40)]
    texts = {0: " ".join(w[:13]), 1: " ".join(w[1:14]), 2: " ".join(["c", *w[20:32]]), 3: " ".join([*w[21:32], "d", "e"]), 4: "one two", 5: "One  TWO", 6: "one two three"}
    assert kept(spark, texts) == brute_kept(texts)[0] == {0, 2, 3, 4, 6}


def test_similarity_in_whole_numbers():
    bound = near_dups.Similarity(0.8)
    for x in range(1, 60):
        assert bound.prefix(x) == x - -(-4 * x // 5) + 1
        for y in range(x, 60):
            for both in range(0, x + 1):
                holds = 5 * both >= 4 * (x + y - both)
                assert bound.holds(both, x, y) == holds
                assert bound.distance(x, y, x + y - 2 * both) == holds
                assert not holds or bound.sizes(x, y)


def test_parity_never_exceeds_the_difference():
    rng = np.random.default_rng(2)
    for n, m in ((0, 5), (10, 10), (400, 380), (5000, 300)):
        common = rng.integers(0, 2**64, 200, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 2**64, k, dtype=np.uint64)])) for k in (n, m))
        maps = near_dups.parity(a), near_dups.parity(b)
        for longs in (8, min(map(len, maps))):
            p, q = (near_dups.narrowed(m, longs) for m in maps)
            assert int(np.bitwise_count(p ^ q).sum()) <= len(np.setxor1d(a, b))


def test_sets_and_fingerprints():
    words = [b"w%d" % k for k in range(9)]
    assert len(near_dups.shingle_set(words, 5)) == 5 and len(near_dups.shingle_set(words[:3], 5)) == 1
    assert near_dups.shingle_set(words[:3], 5) != near_dups.shingle_set(words[2::-1], 5)
    long = near_dups.shingle_set(near_dups.folded(" ".join(f"r{k}" for k in range(120_000))), 5)
    assert (near_dups.set_fingerprint(long) == near_dups.set_fingerprint(long, 10**9)).all()


def test_overlaps():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 300, n)).astype(np.uint64) for n in (0, 1, 50, 200, 90)]
    for step in (7, 4096):
        assert near_dups.overlaps(sets[:3], sets, step).tolist() == [[len(np.intersect1d(a, b)) for b in sets] for a in sets[:3]]
        assert near_dups.overlaps(sets[:1], sets, step).tolist() == [[0] * 5]


def test_edges(spark):
    """Nulls, empty and very long texts, repeated rows, clashing names."""
    rows = near_dups.one_of_each(edge_documents(spark)).collect()
    assert near_dups.one_of_each(edge_documents(spark)).columns == edge_documents(spark).columns
    # all texts without a word are one group, whose smallest id is null
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, (r["text"] or "")[:12]) for r in rows) == [(False, 0, ""), (False, 0, "a text witho"), (True, 4, "x"), (True, 5, "a b c d e f "), (True, 6, LONG[:12]), (True, 7, "the same lin")]
    assert near_dups.one_of_each(empty(spark)).count() == 0
    clash = spark.createDataFrame([(1, "a b", 2, "x", 3, 4), (2, "A b", 5, "y", 6, 7), (2, "A b", 5, "y", 6, 7), (3, None, 1, None, 1, 1)], "doc_id long, text string, node long, word string, maybe int, tkey int")
    assert sorted(tuple(r) for r in near_dups.one_of_each(clash).collect()) == [(1, "a b", 2, "x", 3, 4), (3, None, 1, None, 1, 1)]
