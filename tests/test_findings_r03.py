"""Queries against their SQL on tables of a few odd rows that the driver's smallest tables lack."""

from __future__ import annotations

import itertools
import random
import re

import duckdb
import pytest

from notelake.operators import history, similarity
from notelake.plans.catalog import oracle_sql, queries
from notelake.session import partitions
from tests.test_catalog import rows

SF = "/root/testdata/sf0.001"


def same(spark, tmp_path, name: str, **tables: str) -> list:
    """The query on tables made by SQL over the smallest ones (the names it gives), after it was found equal to its own SQL."""
    con = duckdb.connect()
    for t in "documents pages events part lineitem orders".split():
        con.sql(f"copy ({tables.get(t, f'select * from {{}}').format(repr(f'{SF}/{t}.parquet'))}) to '{tmp_path}/{t}.parquet' (format parquet)")
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    found, want = queries()[name](spark, str(tmp_path)), con.sql(oracle_sql()[name])
    got = rows(found.columns, [tuple(r) for r in found.collect()])
    assert got == rows(want.columns, want.fetchall())
    return got[1]


def test_an_address_has_one_verdict(spark, tmp_path):
    # u is alive by one page and dead by another; v is dead by both
    pages = "select * from (values (3, 'u', 'abcd'), (4, 'u', 'abc'), (7, 'v', 'abcd'), (9, 'v', '')) t(page_id, url, html)"
    assert same(spark, tmp_path, "dead_urls_of_notes", pages=pages) == [(1.0, "n2"), (1.0, "n3")]


def test_slugs_of_more_documents_than_five_thousand(spark, tmp_path):
    got = same(spark, tmp_path, "slugs_given_out", documents="select range as doc_id, 'x' as text, 'en' as lang, '' as source, 1 as n_chars from range(5100)")
    assert len(got) == 5100 == len(set(got)) and ("None",) not in got and (None,) not in got


def test_paths_of_few_names_in_all_three_states(spark, tmp_path):
    got = same(spark, tmp_path, "path_resolution")
    assert {r[2] for r in got} == {"resolved", "ambiguous", "unresolved"}  # columns by name: ref_id, repo_path, status


def test_pairs_of_commits_are_made_in_tasks_of_bounded_input(spark, monkeypatch):
    lines = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet").selectExpr("l_orderkey as sha", "'' as author", "l_partkey as file")
    assert partitions(lines, 1) > 8
    monkeypatch.setattr(history, "PAIRED_MB", 1)
    assert f"hashpartitioning(sha, {partitions(lines, 1)})" in re.sub(r"#\d+L?", "", history.coupling(lines)._jdf.queryExecution().executedPlan().toString())


def _shuffled(spark) -> int:
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def _texts(n: int, words: int, of: int, seed: int) -> list:
    rng = random.Random(seed)
    return [(k, "g", " ".join(f"w{x}" for x in rng.sample(range(of), words))) for k in range(n)]


@pytest.mark.parametrize("pairs", [similarity.exact_pairs, similarity.minhash_pairs])
def test_unlike_notes_of_few_words_are_no_rows(spark, pairs):
    frame = spark.createDataFrame(_texts(400, 40, 160, 1), "id long, grp string, text string")
    before = _shuffled(spark)
    assert pairs(frame).where("score >= 0.45").count() == 0
    assert _shuffled(spark) - before < 12_000  # 79,800 pairs


def test_pairs_over_blocks_and_tiers_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 7)
    rng, texts = random.Random(5), []
    for k, size in enumerate([1, 2, 5, 12, 30, 60, 63, 64, 65, 100, 127, 128, 130, 160, 200, 300] * 4):
        texts.append((k, "gh"[k % 3 == 0], " ".join(f"w{x}" for x in rng.sample(range(330), size))))
    frame = spark.createDataFrame(texts, "id long, grp string, text string")
    sets, want = {}, {}
    for k, g, t in texts:
        sets.setdefault((g, frozenset(t.split())), k)
    for ((g, x), a), ((h, y), b) in itertools.combinations(sets.items(), 2):
        if g == h and len(x & y) / len(x | y) >= 0.4:
            want[min(a, b), max(a, b)] = len(x & y)
    assert len(want) > 20 and {(r["a"], r["b"]): r["common"] for r in similarity.exact_pairs(frame).collect()} == want


def _joined(df):
    """The columns that come out of each join of a plan."""
    found, todo = [], [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "Join":
            found.append(node.output().toString())
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return found


def test_gates_do_not_move_bodies(spark):
    """what a body tells is told where it is read."""
    from notelake.plans import contracts

    joined = _joined(contracts.gate_outcomes(spark, "/root/testdata/sf0.001"))
    assert joined and not [x for x in joined if "body#" in x]


def test_scrubbing_reads_each_text_once_and_moves_none(spark):
    """what was valid and is not any more is told from the row, as by the issues of all notes before and after."""
    from pyspark.sql import functions as F

    from notelake.operators import capture, gates
    from notelake.plans import captures, contracts

    assert not _joined(captures.scrub_vault(spark, "/root/testdata/sf0.001"))
    n = F.expr("cast(substr(rel, 2) as int)")
    long = F.lit("mail " + " ".join("a@b.co" for _ in range(14)))  # redaction makes it too long
    notes = contracts.contracts(spark, "/root/testdata/sf0.001").withColumn("title", F.when(n % 3 == 0, long).when(n % 3 == 1, F.col("title")).otherwise("x"))
    shown = lambda df: sorted(map(repr, df.select("rel", "title", "sources", "redactions", "body", "error").collect()))
    found = gates.issue_list(contracts.STACKS, contracts.ALIASES)
    for told, where in ((F.filter(found, lambda i: i["key"] == "title"), "key = 'title'"), (found, "true")):
        judge = lambda x, where=where: gates.issues(x, contracts.STACKS, contracts.ALIASES).where(where)
        got = shown(capture.scrubbed_alone(notes, told))
        assert got == shown(capture.scrubbed(notes, judge(notes), judge))
        assert where == "true" or any("too-long" in r for r in got)


def test_of_frequent_words_a_question_meets_its_best_alone(spark, monkeypatch):
    """as many rows as may be shown come of the titles that hold frequent words, and the ranks are those of all titles."""
    from notelake.operators import recall

    rng = random.Random(3)
    words = [f"w{k}" for k in range(8)] + [f"r{k}" for k in range(40)]
    title = lambda: " ".join(rng.choices(words, [30] * 8 + [1] * 40, k=rng.randint(0, 6)))
    docs = [(f"n{k:04}", "", title(), [rng.choice(["w1", "t2", ""])], [rng.choice(["w2", "s2"])][: k % 2], f"{title()} body") for k in range(1500)]
    frame = spark.createDataFrame(docs, "rel string, slug string, title string, tags array<string>, stack array<string>, body string")
    asked = spark.createDataFrame([(k, f"{title()} t{k % 3}", ["s2"][: k % 2]) for k in range(12)], "question_id long, question string, stack array<string>")
    shown = lambda: sorted(map(tuple, recall.ranked(frame, asked).collect()))
    monkeypatch.setattr(recall, "RARE", 10**6)
    want = shown()
    assert len(want) > 100
    met, kept = recall._frequent, []

    def spy(*args):
        out = met(*args)
        kept.append(out.groupBy("question_id").count().agg({"count": "max"}).first()[0])
        return out

    monkeypatch.setattr(recall, "_frequent", spy)
    monkeypatch.setattr(recall, "RARE", 100)
    for most in (4096, 3):
        monkeypatch.setattr(recall, "SETS", most)
        assert shown() == want
    assert len(kept) == 2 and max(kept) <= recall.LEADERS + recall.SHOWN
