"""Every stage of the pipeline against a brute-force version, on the smallest documents."""

from __future__ import annotations

import corpus_pipeline
from notelake.llm import poisson_mix, toxicity
from notelake.session import scratch, table
from tests.llm.test_near_dups import brute_kept
from tests.llm.test_operators import check_packing

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        path = scratch(spark, "test-stage")
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        before_rows, rows = docs.collect(), after.collect()
        if name == "toxicity":
            toxic = {r["doc_id"] for r in toxicity.toxicity(docs, table(spark, SF, "labels")).collect() if r["predicted"]}
            assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in before_rows if r["doc_id"] not in toxic)
        elif name == "line_dedup":
            held: dict = {}
            key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            for r in before_rows:
                for x in r["text"].split("\n"):
                    held.setdefault(key(x), set()).add(r["doc_id"])
            gone = lambda x, d: len(key(x)) >= 40 and len(held[key(x)]) >= 5 and max(held[key(x)]) != d
            want = {r["doc_id"]: "\n".join(x for x in r["text"].split("\n") if not gone(x, r["doc_id"])) for r in before_rows}
            assert {r["doc_id"]: r["text"] for r in rows} == want and all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] != dict((b["doc_id"], b["text"]) for b in before_rows)[r["doc_id"]])
        elif name == "simhash_near_dedup":
            assert sorted(r["doc_id"] for r in rows) == sorted(brute_kept({r["doc_id"]: r["text"] for r in before_rows})[0])
        elif name == "mixing":
            counts = {r["row"]["doc_id"]: r["count"] for r in poisson_mix.counted(docs, poisson_mix.rates(docs)).collect()}
            found: dict = {}
            for r in rows:
                found[r["doc_id"]] = found.get(r["doc_id"], 0) + 1
            assert found == {k: v for k, v in counts.items() if v}
        else:
            check_packing(rows, 4096)
            assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in before_rows}
        if name != "packing":
            assert after.columns == columns
        docs = after


def test_empty(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        path = scratch(spark, "test-stage")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.count() == 0
