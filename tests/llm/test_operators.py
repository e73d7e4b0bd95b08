"""The ten operators: edge cases, brute force, round trips, held-out accuracy."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest

from notelake.llm import bitsliced_topk, crf_quality, line_dedup, packing, poisson_mix, queries, secret_ledger, simhash_dedup, suffix_repeat, toxicity, warc_store
from notelake.llm.learn import Isotonic, Trees
from notelake.session import scratch, table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, state int, part int, label int"
LONG = "word " * 30_000 + "end"
EDGES = [None, "", " ", "\n\n", "x", "a b c d e f g h i j k", LONG, "the same line that is longer than forty characters, so it counts\nother"] + ["the same line that is longer than forty characters, so it counts"] * 6


def edge_documents(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing columns."""
    rows = [(i, t, "en", "s1" if i % 2 else None, 1, "r", "k", 1, 1, 1) for i, t in enumerate(EDGES)]
    rows += [rows[5], rows[5], (None, "a text without an id", None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def labels(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in "documents embeddings pages clicks sales".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def same(found, want):
    columns = sorted(found.columns)
    a = sorted((tuple(str(r[c]) for c in columns) for r in found.collect()))
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    assert a == sorted(tuple(str(r[i]) for i in order) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, db, name):
    same(queries.queries()[name](spark, SF), db.sql(queries.oracle_sql()[name]))


# ---------------------------------------------------------------- 1

ASSIGN = re.compile(r"((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def base_spans(text):
    spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(spans)


def test_secrets_brute_force(spark):
    rng = random.Random(5)
    bits = ["password", "PassWd", "token", "api_key", "APIKEY", "secret", ":", "=", " ", '"', "'", "AKIA", "ABCDEFGH12345678", "deadbeef" * 5, "é", "😀", "abc", "short", "Zz09+/_.=-", "\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(300)] + [None, "", "password: secret: abcdefghijkl", "AKIA" + "Q" * 12 + " x"]
    found = {r["doc_id"]: r for r in secret_ledger.secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        spans = base_spans(t or "")
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        assert found[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert found[i]["n_assign"] == sum(s[3] == "assign" for s in spans)
        assert set(filter(None, joined.split(","))) <= set(found[i]["spans"].split(","))


def test_ledger_scans_unseen_pairs_only(spark):
    ledger = scratch(spark, "test-ledger")
    first = spark.createDataFrame([("a", "token=abcdefgh1"), ("b", "token=abcdefgh1"), ("c", "plain")], "path string, text string")
    n = len(secret_ledger.RULES)
    assert secret_ledger.scan(first, ledger).count() == 2 * n  # two blobs
    assert secret_ledger.scan(first, ledger).count() == 2 * n
    more = first.union(spark.createDataFrame([("d", "new text")], first.schema))
    assert secret_ledger.scan(more, ledger).count() == 3 * n
    newer = tuple(secret_ledger.Rule(r.kind, 2, r.pattern, r.least, r.group) if r.kind == "hex" else r for r in secret_ledger.RULES)
    log = secret_ledger.scan(more, ledger, newer)
    assert log.count() == 3 * n + 3
    found = {r["path"]: len(r["spans"]) for r in secret_ledger.findings(more, log, newer).collect()}
    assert found == {"a": 1, "b": 1, "c": 0, "d": 0}


def test_secrets_of_very_many_matches(spark):
    """More matches than are walked at a time, also across the pieces, against plain regular expressions."""
    rng = random.Random(3)
    bits = ["token=abcdefgh1", "token=short", "AKIA" + "Z" * 14, "0123456789abcdef" * 2, "é word", "AKIA1", "secret: 'longer_value'", "\n", "😀"]
    texts = {i: " ".join(rng.choice(bits) for _ in range(n)) for i, n in enumerate([0, 1, 3, 255, 256, 257, 700, 3000])}
    rows = {r["doc_id"]: r for r in secret_ledger.secrets(spark.createDataFrame(list(texts.items()) + [(7, texts[7]), (8, texts[6])], "doc_id long, text string")).collect()}
    for i, text in [*texts.items(), (8, texts[6])]:
        spans = []
        for rank, rule in enumerate(secret_ledger.RULES):
            spans += [(m.start(), rank, m.end(), rule.kind) for m in re.finditer(rule.pattern, text) if len(m[rule.group]) >= rule.least]
        told = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
        base = ",".join(f"{k}:{a}:{b}" for a, rank, b, k in sorted(spans) if rank < 3)
        assert (rows[i]["spans"], rows[i]["base_sha256"]) == (told, hashlib.sha256(base.encode()).hexdigest())
        assert (rows[i]["n_assign"], rows[i]["n_access"], rows[i]["n_hex"]) == tuple(sum(x[1] == k for x in spans) for k in range(3))


def test_secrets_edges(spark):
    assert secret_ledger.secrets(empty(spark)).count() == 0
    assert secret_ledger.secrets(edge_documents(spark)).count() == len(EDGES) + 4


# ---------------------------------------------------------------- 2


def test_topk_edges(spark):
    inf, nan = float("inf"), float("nan")
    vectors = [(0, [0.5, -0.5]), (20, [0.5, -0.5]), (1, [0.5, -0.5]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 0.0]), (None, [1.0, 1.0]), (6, []), (7, [1.0]), (1, [0.5, -0.5]), (8, [1e6, -1e6]), (9, [-0.001, 0.0])]
    frame = spark.createDataFrame([(*v, 1) for v in vectors], "vec_id long, embedding array<float>, label int")
    found = sorted(tuple(r) for r in bitsliced_topk.nearest(frame).collect())
    big = 64 * 1_000_000
    assert [f for f in found if f[0] == 0] == [(0, 1, 8, 64 * big), (0, 2, 1, 2048), (0, 3, 1, 2048), (0, 4, 20, 2048), (0, 5, 9, -32)]
    assert bitsliced_topk.nearest(frame.where("vec_id is null")).count() == 0


def test_topk_blocks_do_not_matter(spark):
    rng = np.random.default_rng(2)
    frame = spark.createDataFrame([(i, rng.integers(-3, 4, 5).astype(float).tolist()) for i in range(400)], "vec_id long, embedding array<float>")
    rows = bitsliced_topk.quantised(frame)
    asked = rows.where("id % 20 = 0")
    whole = sorted(map(tuple, bitsliced_topk.top_k(rows, asked).collect()))
    assert whole == sorted(map(tuple, bitsliced_topk.top_k(rows, asked, rows_in_block=37, queries_in_group=(3, 3)).collect()))


def test_topk_as_the_sql_counts_repeated_ids_and_rows(spark):
    rng = np.random.default_rng(7)
    rows = [(int(i), rng.integers(-200, 200, int(n)).astype(float).tolist()) for i, n in zip(rng.integers(0, 60, 300), rng.choice([3, 4], 300))]
    rows += rows[:40] + [(20, rows[0][1]), (20, [1.5, 2.0, -3.0]), (20, [1.5, 2.0, -3.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    embeddings = frame.toPandas()  # noqa: F841
    want = sorted(tuple(map(int, r)) for r in duckdb.connect().sql(bitsliced_topk.ORACLE_SQL).fetchall())
    found = sorted(tuple(r) for r in bitsliced_topk.nearest(frame).select("query_id", "rank", "vec_id", "score").collect())
    assert found == want and any(r[0] == 20 for r in found) and not any(r[0] == r[2] for r in found)


def test_topk_is_exact_up_to_a_long(spark):
    frame = lambda *rows: spark.createDataFrame(list(rows), "vec_id long, embedding array<double>")
    found = bitsliced_topk.nearest(frame((0, [2.0**24, 1.0]), (1, [2.0**25 + 1, -(2.0**24)]), (2, [-(2.0**25), 3.5]))).collect()
    want = {i: 2**30 * int(x * 64) + 64 * int(y * 64) for i, x, y in ((1, 2**25 + 1, -(2**24)), (2, -(2**25), 3.5))}
    assert [(r["vec_id"], r["score"]) for r in found] == [(1, want[1]), (2, want[2])]
    for rows in ([(0, [2.0**58]), (1, [0.0])], [(0, [2.0**40]), (1, [2.0**30])]):
        with pytest.raises(Exception, match="beyond a long"):
            bitsliced_topk.nearest(frame(*rows)).collect()


# ---------------------------------------------------------------- 3


def test_warc_round_trip(spark, tmp_path):
    big, small = "<p>é\r\n\r\n</p>" * 200, "tiny"
    pages = spark.createDataFrame([(1, "u1", big, 0), (5, "u5", big, 0), (3, "u3", big, 0), (2, None, small, 0), (4, "u4", small, 0), (6, "u6", None, 0), (7, "u7", None, 0), (None, "n", "x", 0), (9, "u", "z" * 1000, 0), (9, "u", "z" * 1000, 0)], "page_id long, url string, html string, address int")
    store = warc_store.archive(pages)
    assert spark.read.parquet(store.payloads).count() == 5  # every distinct payload once, large or small
    told = {r["page_id"]: r for r in warc_store.restore(spark, store).collect()}
    assert {k: (v["record_type"], v["refers_to"]) for k, v in told.items()} == {1: ("revisit", 5), 5: ("response", None), 3: ("revisit", 5), 2: ("response", None), 4: ("response", None), 6: ("response", None), 7: ("response", None), None: ("response", None), 9: ("response", None)}
    assert told[1]["payload_digest"] == hashlib.sha1(big.encode()).hexdigest() and told[1]["payload_bytes"] == len(big.encode())
    records = {r["page_id"]: bytes(r["record"]) for r in warc_store.reconstruct(spark, store).collect()}
    assert records[5].endswith(big.encode() + b"\r\n\r\n") and records[5].startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")
    head, _, block = records[5].partition(b"\r\n\r\n")
    assert int(re.search(rb"Content-Length: (\d+)", head)[1]) == len(block) - 4
    warc_store.export(spark, store, str(tmp_path / "out"))
    text = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.count(b"WARC/1.1\r\n") == 10 and all(r in text for r in records.values())
    assert warc_store.archived(pages.limit(0)).count() == 0


def test_warc_edges(spark, tmp_path):
    """Very long and odd payloads, a target that looks like header lines, clashing columns; a damaged store is refused."""
    odd = ["\x00\r\n\r\n\u2028Content-Length: 3\r\n", "é" * 500, "a" * 999, "y" * 3_000_000, "\r\n\r\n"]
    url = "http://x/\r\nContent-Length: 1\u2028Content-Length: 2\u0085WARC-Refers-To: <urn:page:1>"
    rows = [(i, url, odd[i % len(odd)], "r", "a", "s", 1) for i in range(11)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record string, address string, sha1 string, payload_bytes int").repartition(3)
    found = {r["page_id"]: r for r in warc_store.archived(pages).collect()}
    for i, r in found.items():
        data = odd[i % 5].encode()
        top = max(k for k in range(11) if k % 5 == i % 5)
        again = top if len(data) >= 1000 and top != i else None
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(data), hashlib.sha1(data).hexdigest(), "revisit" if again is not None else "response", again)
    store = warc_store.archive(pages)
    damaged = warc_store.Archive(str(tmp_path / "payloads"), store.records)
    spark.read.parquet(store.payloads).withColumn("payload", warc_store.F.overlay("payload", warc_store.F.lit(b"!"), 1)).write.parquet(damaged.payloads)
    with pytest.raises(Exception, match="does not match its digest"):
        warc_store.restore(spark, damaged).collect()


# ---------------------------------------------------------------- 4


def brute_groups(texts, width, tau):
    prints = {i: int.from_bytes(simhash_dedup.fingerprint((t or "").encode(), width), "big") for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= tau:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (f"{prints[i]:016x}", root(i)) for i in texts}


def slow_fingerprint(text, width):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0d]+", text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode())
    parts = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_is_as_defined():
    for t in ["", "a", "a b", "A b C d é É", "x " * 700, "one two\x0bthree\x0cfour\r\nfive six"]:
        assert int.from_bytes(simhash_dedup.fingerprint(t.encode(), 3), "big") == slow_fingerprint(t, 3)


@pytest.mark.parametrize("block", [4096, 3])
def test_simhash_groups_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(simhash_dedup, "BLOCK", block)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(50)]
    texts = {}
    for g in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([2, 30, 200]))]
        for _ in range(rng.choice([1, 4, 9])):
            some = list(base)
            for _ in range(rng.randrange(3)):
                some[rng.randrange(len(some))] = rng.choice(words)
            texts[len(texts)] = " ".join(some)
    texts |= {1000: None, 1001: "", 1002: "  \n"}
    frame = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], "doc_id long, text string, fp int")
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash_dedup.simhash_groups(frame).collect()} == brute_groups(texts, 3, 3)


def test_every_allotment_finds_every_pair():
    rng = np.random.default_rng(1)
    units = [list(range(8 * i, 8 * i + 8)) for i in range(8)]
    for tau in (0, 3, 6):
        parts = simhash_dedup.choose_parts(1000, units, np.ones((4, 65536)), tau)
        for _ in range(300):
            flips = set(rng.choice(64, rng.integers(0, tau + 1), replace=False).tolist())
            assert any(len(flips & set(bits)) <= t for bits, t in parts)


def test_forest_keeps_connectivity_at_every_level():
    rng = np.random.default_rng(4)
    u, v, w = rng.integers(0, 40, 200), rng.integers(0, 40, 200), rng.integers(0, 5, 200)
    k = simhash_dedup.forest(u, v, w)

    def parts(a, b):
        label = np.arange(40)
        for _ in range(40):
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
        return label.tolist()

    for level in range(5):
        assert parts(u[w <= level], v[w <= level]) == parts(u[k][w[k] <= level], v[k][w[k] <= level])


def test_simhash_edges(spark):
    assert simhash_dedup.simhash_groups(empty(spark)).count() == 0
    texts = {r["doc_id"]: r["text"] for r in edge_documents(spark).collect() if r["doc_id"] is not None}
    found = simhash_dedup.simhash_groups(edge_documents(spark)).collect()
    assert len(found) == len(EDGES) + 4
    want = brute_groups(texts, 3, 3)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in found if r["doc_id"] is not None} == want
    # rows without an id take the group of their fingerprint
    assert {(r["fingerprint"], r["component_id"]) for r in found if r["doc_id"] is None} == {("0" * 16, 0), (f"{int.from_bytes(simhash_dedup.fingerprint(b'a text without an id', 3), 'big'):016x}", None)}


def test_no_plan_is_an_error():
    units = [list(range(8 * i, 8 * i + 8)) for i in range(8)]
    with pytest.raises(ValueError):
        simhash_dedup.choose_parts(1000, units, np.ones((4, 65536)), 40, most_probes=1)


# ---------------------------------------------------------------- 5 and 9


def test_trees_and_isotonic():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    trees = Trees.fit(x[:2000], y[:2000])
    s = trees.score(x[2000:])
    assert ((s > 0) == (y[2000:] > 0)).mean() > 0.95
    iso = Isotonic.fit(s, y[2000:])
    at = np.sort(rng.normal(0, 5, 200))
    assert (np.diff(iso(at)) >= 0).all() and 0 <= iso(at).min() and iso(at).max() <= 1


@pytest.mark.parametrize("module, function, target, least", [(toxicity, "toxicity", "toxic", 0.9), (crf_quality, "quality", "quality", 0.95)])
def test_held_out_accuracy(spark, module, function, target, least):
    sf = "/root/testdata/sf0.01"
    docs, known = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = getattr(module, function)(docs, known).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    truth = {r["doc_id"]: r[target] for r in known.collect()}
    out = [(r["score"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    wins = [(a > b) + 0.5 * (a == b) for a, x in out for b, y in out if x == 1 and y == 0]
    assert sum(wins) / len(wins) > least
    # labels of the held-out fold are not read
    flipped = known.withColumn(target, (1 - known[target]) * (module.F.crc32(known["doc_id"].cast("string")) % 5 == 0).cast("int") + known[target] * (module.F.crc32(known["doc_id"].cast("string")) % 5 != 0).cast("int"))
    again = {r["doc_id"]: r["score"] for r in getattr(module, function)(docs, flipped).collect()}
    assert again == {r["doc_id"]: r["score"] for r in rows}


def test_classifier_edges(spark):
    docs, none = edge_documents(spark), labels(spark)
    for module, function in ((toxicity, "toxicity"), (crf_quality, "quality")):
        rows = getattr(module, function)(docs, none).collect()
        assert len(rows) == len(EDGES) + 4 and all(r["score"] is not None for r in rows)
        assert getattr(module, function)(empty(spark), none).count() == 0
    odd = labels(spark, (None, 1, 1), (3, None, None), (4, 7, 7), (5, 1, 0), (5, 1, 0))
    assert toxicity.without_toxic(docs, odd).count() == len(EDGES) + 4


def test_field_passes_are_exact():
    rng = np.random.default_rng(3)
    field = crf_quality.Field(np.zeros(1), rng.normal(0, 1, (2, 2)))
    unary, first = rng.normal(0, 1, 5), np.array([0, 4, 5])
    p, _ = field.passes(unary, first)
    total, good = 0.0, np.zeros(4)
    for bits in range(16):
        y = [bits >> k & 1 for k in range(4)]
        w = np.exp(sum(unary[k] * y[k] for k in range(4)) + sum(field.move[y[k], y[k + 1]] for k in range(3)))
        total += w
        good += w * np.array(y)
    assert np.allclose(p[:4], good / total) and np.isclose(p[4], 1 / (1 + np.exp(-unary[4])))


# ---------------------------------------------------------------- 6


def test_mix_rates_and_edges(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "cast(id as string) as text", "case when id < 3000 then 'hot' when id < 3900 then 'mid' end as source")
    counts = {r["source"]: r["count"] for r in poisson_mix.mixed_documents(docs, targets={"hot": 1.0, "mid": 1.0, "": 2.0, "absent": 5.0}).groupBy("source").count().collect()}
    assert abs(counts["hot"] - 1000) < 150 and abs(counts["mid"] - 1000) < 150 and abs(counts[None] - 2000) < 400
    assert poisson_mix.mixed_documents(edge_documents(spark)).columns == edge_documents(spark).columns
    assert poisson_mix.mixture(empty(spark)).count() == 0
    keys = [r["order_key"] for r in poisson_mix.mix(docs).collect()]
    assert keys == sorted(keys)


# ---------------------------------------------------------------- 7


def brute_repeats(words):
    n = len(words)
    best = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and words[i + k] == words[j + k]:
                k += 1
            best[i] = max(best[i], k)
    return best


def test_suffix_array_brute_force():
    rng = random.Random(9)
    for _ in range(60):
        texts = [[rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.choice([0, 1, 3, 40]))] for _ in range(rng.randint(1, 4))]
        flat = [ord(w) for t in texts for w in t]
        owner = [i for i, t in enumerate(texts) for _ in t]
        assert suffix_repeat.suffix_lcp(np.array(flat, dtype=np.int64), np.array(owner, dtype=np.int64)).tolist() == sum(map(brute_repeats, texts), [])


def test_judge_brute_force(spark):
    rng = random.Random(2)
    texts = [t for t in EDGES if t != LONG] + ["\n".join(" ".join(rng.choice(["é", "b#", "c|", "$d"]) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(6))) for _ in range(80)]
    rows = {r["doc_id"]: r for r in suffix_repeat.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0d]+", t)
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        repeated = {k + d for k, w in enumerate(windows) if windows.count(w) > 1 for d in range(5)}
        full = [line for line in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", line)]
        failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(full) - len(set(full)), len(repeated), failed)
        assert not (r["kept"] and failed)


def test_judge_rejects_beyond_the_base_rule(spark):
    fresh = (f"w{i}" for i in range(10**6))
    some = lambda n: [next(fresh) for _ in range(n)]
    passage, short, pair = some(900), [some(12) for _ in range(6)], some(51)
    texts = [
        passage + some(8200) + passage,  # 18% covered, longest 900
        sum(([*p, *some(120), *p] for p in short), []),  # 14 to 17% covered, longest 12
        pair + some(2000) + pair,  # 5% covered, longest 51
        pair[:50] + some(2000) + pair[:50],
        some(500),
    ]
    rows = sorted(suffix_repeat.judge(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect())
    assert [r["longest_repeat"] for r in rows] == [900, 12, 51, 50, 0] and rows[1]["covered_words"] == 144
    assert not any(r["base_failed"] for r in rows)
    assert [r["kept"] for r in rows] == [False, False, False, True, True]


def test_judge_edges(spark):
    assert suffix_repeat.judge(empty(spark)).count() == 0
    rows = suffix_repeat.judge(edge_documents(spark)).collect()
    assert len(rows) == len(EDGES) + 4
    assert [r["n_repeat_words"] for r in rows if r["doc_id"] == 6] == [30_000]


# ---------------------------------------------------------------- 8


@pytest.mark.parametrize("partitions", [1, 4, 23])
def test_lines_brute_force(spark, partitions):
    rng = random.Random(7)
    pool = [f"{'Line' if k % 2 else 'line'} number {k} that is long enough to count as a key é" for k in range(12)] + ["short"]
    texts = {i: None if i == 3 else "\n".join(rng.choice(["", " ", "\t"]) + rng.choice(pool[: 1 + i % 13]).swapcase() * 1 for _ in range(rng.randrange(6))) for i in range(60)}
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(fold)
    held: dict = {}
    for i, t in texts.items():
        for line in (t or "").split("\n"):
            held.setdefault(key(line), set()).add(i)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    frame = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, place int")
    found = {r["doc_id"]: r for r in line_dedup.dedup_digests(frame).collect()}
    cut = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", before)
    for i, t in texts.items():
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 40 or len(held[key(x)]) < 5 or max(held[key(x)]) == i]
        assert (found[i]["n_lines"], found[i]["n_dropped"], found[i]["kept_sha256"]) == (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
        assert cut[i] == (None if t is None else "\n".join(kept))


def test_lines_edges(spark):
    assert line_dedup.dedup_digests(empty(spark)).count() == 0
    cut = line_dedup.dedup_lines(edge_documents(spark), n_chars="n_chars")
    assert cut.columns == edge_documents(spark).columns and cut.count() == len(EDGES) + 4
    assert sorted(r["doc_id"] for r in cut.collect() if r["text"] and r["text"].startswith("the same")) == [len(EDGES) - 1]


# ---------------------------------------------------------------- 10


def test_ids_are_the_tokenizer_s(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.default_tokenizer())
    texts = ["", " ", "<|endoftext|> x<|startoftext|>y", "don't I'LL we've 's", "ÄÖÜ ß İstanbul ΣΑΣ", "a\x1cb\x85c d", "²³ ½ 12.5%", "日本語テキスト と", "x" * 100, "😀 a_b__c", "ª º ŉ ſ Ÿ", "éå"] + [r["text"] for r in table(spark, SF, "documents").collect()]
    from notelake.llm.bpe import encoder

    for t, ids in zip(texts, encoder(packing.default_tokenizer()).encode(texts)):
        assert np.frombuffer(ids, dtype="<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


def test_ids_of_random_text():
    """Letters, marks, digits, signs and blanks of the Latin blocks and beyond, against the library."""
    from tokenizers import Tokenizer

    from notelake.llm.bpe import encoder

    plain, rng = Tokenizer.from_file(packing.default_tokenizer()), random.Random(11)
    pools = ["abcdefghij", "etaoinshrdlu ETAOIN", "0123456789", " \t\n\r\x0b\x0c\x1c\x85\xa0\u2009", "'stremvld", "".join(map(chr, range(0xA0, 0x180))), "!#$%&()*+-./:;<=>?@[]^_`{|}~", "ÀÉÎÕÜßſıİ\u0301\u0308ﬁ", "日本語한국어العربيةдруг😀𝒳", "<|endoftext|>"]
    texts = ["".join(rng.choice(rng.choice(pools[: rng.choice([2, 7, 10])])) for _ in range(rng.randrange(1, 80))) for _ in range(4000)]
    want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(ids, dtype="<u4").tolist() for ids in encoder(packing.default_tokenizer()).encode(texts)] == want


def test_pieces_of_all_documents_are_the_library_s(spark):
    """start, length and digest of every piece of a whole table, and the places without gaps."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.default_tokenizer())
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()
    want = {}
    for r, e in zip(docs, plain.encode_batch([r["text"] or "" for r in docs], add_special_tokens=False)):
        ids = np.array([*e.ids, 1], dtype="<u4")
        for k, lo in enumerate(range(0, len(ids), 4096)):
            want[r["doc_id"], k] = (lo, len(ids[lo : lo + 4096]), zlib.crc32(ids[lo : lo + 4096].tobytes()))
    rows = queries.queries()["op10_packing"](spark, "/root/testdata/sf0.01").collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    assert check_packing(rows, 4096) <= 1.02 * -(-sum(x[1] for x in want.values()) // 4096) + 1


def test_the_plan_does_not_grow_with_the_pieces():
    rng = random.Random(1)
    for counts in ({2500: 2 * 10**9, 1500: 10**9, 1400: 10**9}, {n: rng.randrange(1, 10**6) for n in range(1, 4097)}, {n: 10**6 for n in range(1400, 4097)}, {1: 10**9, 3000: 10**7, 4095: 10**6}):
        began = time.process_time()
        plan = packing.Plan(counts, 4096)
        assert len(plan.segments) < 3 * 4096 and time.process_time() - began < 10
        assert sum(n * length for length, _, n, _, _ in plan.segments) == sum(n * length for length, n in counts.items())


def check_packing(rows, capacity):
    by: dict = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_plans_hold_and_are_near_the_bound():
    rng = random.Random(4)
    for capacity in (10, 97, 4096):
        for _ in range(30):
            lengths = [rng.randint(1, capacity) if rng.random() < 0.6 else rng.randint(1, 1 + capacity // 5) for _ in range(rng.randrange(300))]
            counts: dict = {}
            for n in lengths:
                counts[n] = counts.get(n, 0) + 1
            plan = packing.Plan(counts, capacity)
            rank: dict = {}
            rows = []
            for length, first, n, seq, offset in plan.segments:
                assert first == rank.get(length, 0)
                rank[length] = first + n
                rows += [{"sequence_id": seq + k, "offset": offset, "length": length} for k in range(n)]
            assert rank == counts
            assert check_packing(rows, capacity) == plan.sequences if rows else plan.sequences == 0
            greedy: list = []
            for n in sorted(lengths, reverse=True):
                room = [k for k, g in enumerate(greedy) if g + n <= capacity]
                if room:
                    greedy[max(room, key=lambda k: greedy[k])] += n
                else:
                    greedy.append(n)
            assert plan.sequences <= len(greedy) + 1 and plan.sequences >= -(-sum(lengths) // capacity)


def test_reduction_is_optimal_where_it_settles_all():
    plan = packing.Plan({7: 2, 3: 2, 10: 1, 6: 1, 2: 1}, 10)
    assert plan.fixed == plan.sequences == 4


def test_packing_edges(spark):
    assert packing.pack_documents(empty(spark)).count() == 0
    rows = packing.pack_documents(edge_documents(spark)).collect()
    check_packing(rows, packing.CAPACITY)
    long = sorted((r["piece"], r["start"], r["length"]) for r in rows if r["doc_id"] == 6)
    assert [x[:2] for x in long] == [(k, 4096 * k) for k in range(len(long))] and sum(x[2] for x in long) == 30_002
    assert sum(r["doc_id"] == 5 for r in rows) == 3
    assert [(r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == 0] == [(1, zlib.crc32((1).to_bytes(4, "little")))]


def test_quality_query_line_by_line(spark):
    """Every score of the query against the field walked in plain loops, one document at a time."""
    docs, known = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = crf_quality.fit(docs, known)
    found = {r["doc_id"]: r for r in queries.queries()["op9_crf_quality"](spark, SF).collect()}
    move = np.exp(model.field.move)
    for r in docs.collect():
        x, size, first = crf_quality.line_features([(r["text"] or "").encode()])
        n = len(size)
        zero = np.zeros(x.shape[1])
        emit = []
        for t in range(n):
            own = np.concatenate([x[t], x[t - 1] if t else zero, x[t + 1] if t + 1 < n else zero, [1.0]])
            emit.append(np.array([1.0, np.exp(np.clip(own @ model.field.weight, -30, 30))]))
        forward, backward = [emit[0] / emit[0].sum()], [np.ones(2)]
        for t in range(1, n):
            f = np.array([sum(forward[-1][i] * move[i, j] for i in (0, 1)) * emit[t][j] for j in (0, 1)])
            forward.append(f / f.sum())
        for t in range(n - 1, 0, -1):
            b = np.array([sum(move[i, j] * emit[t][j] * backward[0][j] for j in (0, 1)) for i in (0, 1)])
            backward.insert(0, b / b.sum())
        good = [f[1] * b[1] / (f * b).sum() for f, b in zip(forward, backward)]
        raw = sum(g * (s + 1) for g, s in zip(good, size)) / sum(s + 1 for s in size)
        score = float(model.calibration(crf_quality._logit(np.array([raw])))[0])
        row = found.pop(r["doc_id"])
        assert abs(row["score"] - score) < 1e-6 and row["predicted"] == int(row["score"] >= 0.3)
    assert not found


def test_toxicity_query_one_by_one(spark):
    """Every score of the query against the same model on one text at a time."""
    docs, known = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = toxicity.fit(docs, known)
    found = {r["doc_id"]: r for r in queries.queries()["op5_toxicity"](spark, SF).collect()}
    for r in docs.collect():
        row = found.pop(r["doc_id"])
        score = float(model.scores(np.array([toxicity.features(r["text"] or "", model.words)]))[0])
        assert abs(row["score"] - score) < 1e-9 and row["predicted"] == int(row["score"] >= 0.5)
    assert not found
