"""Tolerant as-of join, alignment of tokenizers, minimax shards: brute force, hot keys, edges."""

from __future__ import annotations

import hashlib
import json
import random
import zlib
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest

from notelake.llm import minimax_shards as M
from notelake.llm import token_alignment as T
from notelake.llm import tolerant_asof as A

# ---------------------------------------------------------------- 11


def brute_match(asks, orders, tolerance):
    out = {}
    for ask, key, at in asks:
        fits = [] if key is None or at is None else [o for o in orders if o[0] == key and o[1] is not None and at - tolerance <= o[1] <= at]
        loses = lambda v: (v is not None, v or 0)
        best = max(fits, key=lambda o: (o[1], loses(o[2]), loses(o[3])), default=None)
        out[ask] = (best[1], best[2], best[3], sum(o[1] == best[1] for o in fits)) if best else None
    return out


@pytest.mark.parametrize("most, fan", [(3, 4), (32, 32)])
def test_asof_brute_force(spark, most, fan):
    """One client holds most rows, many of them in a burst; ties, nulls, times before 1970, gaps beyond the tolerance."""
    rng = random.Random(most)
    hour, tolerance = A.HOUR, 30 * A.HOUR
    times = [lambda: rng.randrange(-200, 400) * hour, lambda: 5 * hour + rng.randrange(40), lambda: rng.randrange(600) * 1_000_000]
    some = lambda: rng.choice(times)()
    key = lambda: rng.choice([1, 1, 1, 1, 2, 3, None])
    asks = [(i, key(), rng.choice([some(), some(), None]) if i % 9 == 0 else some()) for i in range(300)]
    orders = [(key(), some() if i % 11 else None, rng.choice([None, 0, 1, 2]), rng.choice([None, i, i])) for i in range(400)]
    orders += orders[:20]
    found = A.tolerant_asof(spark.createDataFrame(asks, "ask long, key long, at long"), spark.createDataFrame(orders, "key long, at long, cents long, id long").repartition(3), ["cents", "id"], tolerance, most, fan)
    got = {r["ask"]: r["o"] and tuple(r["o"]) for r in found.collect()}
    assert got == brute_match(asks, orders, tolerance) and len(got) == len(asks)


def test_asof_splits_bound_the_pairs(spark):
    """A bucket in which every order has the same client: no click meets more orders than a bucket may hold."""
    asks = spark.createDataFrame([(i, 1, 3 * i + 1) for i in range(2000)], "ask long, key long, at long")
    orders = spark.createDataFrame([(1, 3 * i, i) for i in range(2000)], "key long, at long, id long")
    found = A.tolerant_asof(asks, orders, ["id"], 1_000_000, most=16, fan=16)
    assert found.where("o.at = at - 1 and o.n_tied = 1").count() == 2000
    rows, width = A._tied(orders, ["id"]).selectExpr("key", "0L as start", "o"), 1_000_000
    for level in range(5):
        split = rows.groupBy("key", "start").count().where("count > 16")
        if split.isEmpty():
            break
        width = -(-width // 16)
        rows = A._narrower(rows.join(split, ["key", "start"], "left_semi"), width, 16).cache()
        assert rows.count() <= 2000 + 16 * split.count()
    assert level == 4 and rows.agg({"o": "count"}).first()[0] >= 2000


def test_click_orders_contract(spark):
    """The query's rules: floors, second orders, copies, broken totals; the session's zone does not matter."""
    rng = random.Random(2)
    epoch = datetime(1970, 1, 1)
    day = lambda: datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(80 * 86400), microseconds=rng.choice([0, 0, 7]))
    clicks = [(i, day() if i % 10 else None, rng.choice([1, 1, 2, None]), "x", 1) for i in range(200)]
    clicks += clicks[:30] + [(None, day(), 1, "x", 1)]
    sales = [(rng.choice([i, i, 5]), rng.choice([1, 1, 2, None]), rng.choice([None, 1.005, 7.5, float("nan"), float("inf"), -3.0]), day() if i % 10 else None, i % 7, "at") for i in range(150)] + [(None, 1, 4.0, day(), 1, "at")]
    us = lambda t: None if t is None else (t - epoch) // timedelta(microseconds=1)
    h = lambda i: None if i is None else zlib.crc32(str(i).encode())
    floored = lambda t, i: t if t is None or i is None or h(i) % 2 == 0 else t - t % A.GRAIN
    asks = {i: (i, c, floored(us(t), i)) for i, t, c, *_ in clicks}
    orders = []
    for i, c, total, at, *_ in sales:
        cents = None if total is None or not np.isfinite(total) else int(np.floor(100 * total + 0.5))
        for sale in [i] if i is None or h(i) % 3 == 0 else [i, -1 - i]:
            orders.append((c, floored(us(at), i), cents, sale))
    want = brute_match(asks.values(), orders, A.TOLERANCE)
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        c = spark.createDataFrame(clicks, "click_id long, ts timestamp_ntz, client_id long, key string, at int")
        s = spark.createDataFrame(sales, "sale_id long, client_id long, total double, sold_at timestamp_ntz, priority int, at string")
        rows = A.click_orders(c, s).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert len(rows) == len(asks)
    for r in rows:
        w = want[r["click_id"]]
        assert (r["client_id"], r["ts_us"]) == asks[r["click_id"]][1:]
        assert (r["sale_id"], r["lag_us"], r["total_cents"], r["n_tied"]) == ((w[2], r["ts_us"] - w[0], w[1], w[3]) if w else (None, None, None, 0))


def test_asof_edges(spark):
    c, s = spark.createDataFrame([], "click_id long, ts timestamp_ntz, client_id long"), spark.createDataFrame([], "sale_id long, client_id long, total double, sold_at timestamp_ntz")
    assert A.click_orders(c, s).count() == 0
    one = spark.createDataFrame([(1, datetime(2024, 1, 1), 1)], "click_id long, ts timestamp_ntz, client_id long")
    assert [(r["sale_id"], r["n_tied"]) for r in A.click_orders(one, s).collect()] == [(None, 0)]


# ---------------------------------------------------------------- 12


def brute_alignment(texts):
    """The contract, one token at a time, with the tokenizers of the files."""
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = T.default_tokenizers()
    a_tok, b_tok, chars = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b), T._byte_chars()
    a_tok.encode_special_tokens = True
    a_bytes = lambda i: bytes(chars[c] for c in a_tok.id_to_token(i))

    def b_bytes(i):
        piece = b_tok.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if len(piece) == 6 and piece.startswith("<0x") else piece.replace("▁", " ").encode()

    docs = []
    for text in texts:
        text = text or ""
        a, b, whole = a_tok.encode(" " + text, add_special_tokens=False).ids, b_tok.encode(text), (" " + text).encode()
        if not text or b"".join(map(a_bytes, a)) != whole or b"".join(map(b_bytes, b)) != whole:
            docs.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(a_bytes(i)) for i in a]), np.cumsum([len(b_bytes(i)) for i in b])
        groups, p, q = [], 0, 0
        for end in sorted(set(ends_a.tolist()) & set(ends_b.tolist())):
            i, j = ends_a.tolist().index(end) + 1, ends_b.tolist().index(end) + 1
            groups.append((a[p:i], b[q:j]))
            p, q = i, j
        docs.append((a, b, groups))
    links = [[(x, y) for ga, gb in d[2] for x in ga for y in gb] if d else [] for d in docs]
    count = Counter(pair for one in links for pair in set(one))
    best: dict[int, int] = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    told = lambda gs: ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in gs)
    return [(len(d[0]), len(d[1]), len(d[2]), len(l), sum(count[p] == best[p[0]] for p in l), sum(count[p] for p in l), hashlib.sha256(told(d[2]).encode()).hexdigest()) if d else (0, 0, 0, 0, 0, 0, "") for d, l in zip(docs, links)]


TEXTS = [None, "", " ", "\n", "the cat sat", "the cat sat on the mat", "the cat sat", "a▁b", "日本語 мир \U0001f600 é", "<|endoftext|> <s> </s> <0x41> <unk>", "\x00\x1c\x85   \t\n q", "x" * 3000, "ab12" * 700, "lonely 1234567 don't WE'LL", "ÀÉ" * 400, "thé cät " * 50]


@pytest.mark.parametrize("batch, wide, salted", [(10**6, 4096, False), (60, 2, True)])
def test_alignment_brute_force(spark, monkeypatch, batch, wide, salted):
    rng = random.Random(4)
    texts = TEXTS + [" ".join(rng.choice(["the", "cat", "3.14", "über", "naïve", "token", "foo_bar", "\n\n", "  ", "-->"]) for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    if salted:
        monkeypatch.setattr(T, "partitions", lambda df: 2 * T.STRIPES + 3)
    rows = [(i, t, "s", 1) for i, t in enumerate(texts)]
    made = T._encode
    monkeypatch.setattr(T, "_encode", lambda *a: _with(made(*a), batch, wide))
    docs = spark.createDataFrame(rows + [(None, "the cat", "s", 1), rows[5]], "doc_id long, text string, stripe string, batch int").repartition(2)
    want = brute_alignment([*texts, "the cat", texts[5]])
    got = [(r["doc_id"], tuple(r[c] for c in (*T.FACTS[1:], "n_best", "count_sum", "groups_sha256"))) for r in T.align(docs).collect()]
    assert sorted(got, key=str) == sorted(zip([*range(len(texts)), None, 5], want), key=str)


def _with(run, batch, wide):
    """The task with small batches and few links before ids are made distinct (set in the worker)."""

    def small(batches):
        from notelake.llm import token_alignment as module

        kept = module.BATCH_CHARS, module.WIDE, module.AT_A_TIME
        module.BATCH_CHARS, module.WIDE, module.AT_A_TIME = batch, wide, max(wide, 50)
        run.__globals__.update(BATCH_CHARS=batch, WIDE=wide)
        try:
            yield from run(batches)
        finally:
            module.BATCH_CHARS, module.WIDE, module.AT_A_TIME = kept

    return small


def test_ranks_give_the_ids_of_the_file():
    tok = T.Tokenizers(*T.default_tokenizers())
    assert tok.ranks is not None
    rng = random.Random(9)
    letters = [chr(c) for c in range(0x250)] + list("‘’“”–—…") + ["'s", "'ll", "  ", "\n", "the ", " 12", "<|endoftext|>"]
    for _ in range(3000):
        text = " " + "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
        assert T._STRANGE.search(text) is None
        assert tok.ids_a(text).tolist() == tok.whole(text).tolist()


def test_ranks_are_left_where_ids_are_not_in_the_order_of_merges(tmp_path):
    path_a, path_b = T.default_tokenizers()
    with open(path_a, encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    (tmp_path / "a.json").write_text(json.dumps(spec), encoding="utf-8")
    assert T.Tokenizers(str(tmp_path / "a.json"), path_b).ranks is None


def test_arrays_come_back():
    for arrays in ([], [np.array([], dtype=np.int64)], [np.array([0, 255]), np.array([256]), np.array([1 << 16, 1 << 32, 1 << 40])]):
        assert [x.tolist() for x in T.unpacked(T.packed(*arrays))] == [list(map(int, x)) for x in arrays]


def test_alignment_edges(spark):
    assert T.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [tuple(r) for r in T.align(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


# ---------------------------------------------------------------- 13


def brute_cuts(sizes, k):
    """The law on all sizes at once."""
    ends = [0, *np.cumsum(sizes).tolist()]
    total = ends[-1]
    below, above = lambda y: max(e for e in ends if e <= y), lambda y: min(e for e in ends if e >= y)

    def feasible(c):
        x = 0
        for _ in range(k):
            x = below(x + c)
        return x >= total

    c = next(c for c in range(-(-total // k), total + 1) if feasible(c))
    least = [total]
    for _ in range(k - 1):
        least.append(above(max(0, least[-1] - c)))
    least = least[::-1]
    cuts = [0]
    for i in range(1, k):
        aim = total * i // k
        f, n = below(aim), above(aim)
        cuts.append(max(least[i - 1], min(f if aim - f <= n - aim else n, below(cuts[-1] + c))))
    return c, cuts[1:]


@pytest.mark.parametrize("seed", range(30))
def test_cuts_over_ranges_are_those_over_all_groups(seed, monkeypatch):
    """Ranges are divided until every cut is one boundary; sums by range are all that is read."""
    rng = random.Random(seed)
    n, k = rng.choice([0, 1, 3, 7, 60, 400]), rng.randrange(1, 9)
    groups = {rng.randrange(1 << M.KEY_BITS): rng.choice([1, 5, 5, 90, rng.randrange(1, 2000)]) for _ in range(n)}
    keys = sorted(groups)

    def sums(first, last, cells):
        step = -(-(last - first + 1) // cells)
        out: dict[int, list[int]] = {}
        for x in keys:
            if first <= x <= last:
                out.setdefault((x - first) // step, []).append(x)
        return [(xs[0], xs[-1], sum(groups[x] for x in xs)) for xs in out.values()]

    ranges, passes = M.Ranges(sums(0, (1 << M.KEY_BITS) - 1, 4)), 0
    while True:
        cuts, places = ranges.cuts(k)
        divided = ranges.unknown(places, 3)
        if not divided:
            break
        ranges = M.Ranges(ranges.rows(set(divided)) + [x for j in divided for x in sums(int(ranges.first[j]), int(ranges.last[j]), 4)])
        passes += 1
    c, want = brute_cuts([groups[x] for x in keys], k)
    assert [a for a, b in cuts] == [b for a, b in cuts] == want
    assert ranges.capacity(k) == (c, c)
    edges = [0, *want, sum(groups.values())]
    assert max(b - a for a, b in zip(edges, edges[1:])) == c if n else c == 0


def test_shards_hold(spark, monkeypatch):
    """A text of a third of all rows, two giants, repeated rows beyond a chunk; slots without gaps, few cells a pass."""
    monkeypatch.setattr(M, "CHUNK", 7)
    monkeypatch.setattr(M, "_sums", _checked(M._sums))
    rng = random.Random(1)
    rows = [(i, "copy " * 40, "x") for i in range(300)] + [(i, "w" * rng.randrange(1, 90) + str(i), "x") for i in range(600)] + [(5000, "repeated", "x")] * 50 + [(None, None, "x")] * 3 + [(7001, "", None), (7002, "z" * 40_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(5)
    found = M.sharded(docs).collect()
    assert len(found) == len(rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    shards: dict[int, list] = {}
    where: dict[tuple, set] = {}
    for r in found:
        shards.setdefault(r["shard"], []).append(r)
        where.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
    assert all(len(s) == 1 for s in where.values())
    for s in shards.values():
        assert sorted(r["slot"] for r in s) == list(range(len(s)))
    sizes = {s: sum(r["size"] for r in rs) for s, rs in shards.items()}
    giants = [300 * 201, 40_001]
    assert sorted(sizes.values())[-2:] == sorted(giants)
    rest = [v for v in sizes.values() if v not in giants]
    assert len(rest) == 6 and max(rest) - min(rest) <= 2 * max(92, 50 * 9)


def _checked(sums):
    def run(groups, cell):
        out = sums(groups, cell)
        assert len(out) <= M.CELLS
        return out

    return run


def test_shards_edges(spark):
    schema = "doc_id long, text string"
    assert M.sharded(spark.createDataFrame([], schema)).count() == 0
    assert [(r["shard"], r["slot"], r["size"]) for r in M.sharded(spark.createDataFrame([(1, None)], schema)).collect()] in ([(k, 0, 1)] for k in range(M.SHARDS))
    few = M.sharded(spark.createDataFrame([(i, "t" * i) for i in range(3)], schema)).collect()
    assert len({r["shard"] for r in few}) == 3
