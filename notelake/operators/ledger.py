"""The budget ledger replayed in the order of calls: each is admitted against what earlier calls of its day left.

A call walks the chain of its stage to the first candidate it may use: ``none`` always, an engine that is installed, a metered one while
its budget of the day lasts. Costs add up, so within a day a metered engine is spent at one call and stays so. Where nothing is spent yet, running sums over
the calls that come to an engine find that call; the earliest such call of a day is final, and what it turns away comes to
later engines. So as many rounds as there are metered engines settle all days at once, with no walk from call to call.

Running sums go over cells of time that carry their totals, so a day that holds most calls is no single sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelake.operators.timeline import celled
from notelake.session import materialize

METERED = ("api", "advisor")
# Stages that never use an engine.
LOCKED = ("recall", "write", "index")


def running_total(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """``rows`` with ``total``: the sum of ``value`` up to and with each row of its key, in the order of the columns ``order`` (the first a long)."""
    rows = celled(materialize(rows, "ledger"), order[0])
    within = F.sum(value).over(Window.partitionBy(*keys, "cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    cells = rows.groupBy(*keys, "cell").agg(F.sum(value).alias("sum"))
    before = F.sum("sum").over(Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("own", within).join(cells.select(*keys, "cell", before.alias("before")), [*keys, "cell"]).withColumn("total", F.col("own") + F.coalesce("before", F.lit(0))).drop("own", "before", "cell")


def _spent(engine: Column) -> Column:
    """Whether an engine's budget is gone before the call: no budget at all, or a call before this one used it up."""
    gone = F.lit(False)
    for m in METERED:
        gone = F.when(engine == m, F.col(f"closed_{m}") | F.coalesce(F.struct("at", "call_id") > F.col(f"last_{m}"), F.lit(False))).otherwise(gone)
    return gone


def replay(calls: DataFrame, chains: dict[str, list[str]], caps: dict[str, int], present: list[str], default: str = "none") -> DataFrame:
    """call_id, day, stage, engine, exhausted of every call.

    calls: call_id, day, at (a long; ties go by call_id), stage, cost (a whole number, none negative). chains: the candidates of a stage, in
    their order; a stage without one has ``default``. caps: the budget of metered engines a day. exhausted: a metered candidate of the chain, reached or not, is out of budget.
    """
    lists = F.create_map(*(x for s, c in chains.items() for x in (F.lit(s), F.array(*map(F.lit, c or [default]))))) if chains else F.lit(None)
    chain = F.when(F.col("stage").isin(*LOCKED), F.array(F.lit("none"))).otherwise(F.coalesce(F.try_element_at(lists, F.col("stage")) if chains else F.lit(None), F.array(F.lit(default))))
    base = calls.select("call_id", "day", F.col("at").cast("long").alias("at"), "stage", F.col("cost").cast("long").alias("cost"), chain.alias("chain"))
    base = materialize(base.withColumns({f"closed_{m}": F.lit(m not in present or caps.get(m, 0) <= 0) for m in METERED}), "calls")
    nothing = F.lit(None).cast(base.select(F.struct("at", "call_id").alias("o")).schema["o"].dataType)
    marks = base.select("day").distinct().withColumns({f"last_{m}": nothing for m in METERED})
    here = [*present, "none"]

    def assigned() -> DataFrame:
        usable = F.filter("chain", lambda c: c.isin(*here) & ((c == "none") | ~_spent(c)))
        return base.join(marks, "day").withColumn("engine", F.coalesce(F.try_element_at(usable, F.lit(1)), F.lit("none")))

    for _ in METERED:
        rows = assigned().where(F.col("engine").isin(*METERED)).select("day", "engine", "at", "call_id", "cost")
        totals = running_total(rows, ["day", "engine"], ["at", "call_id"], "cost")
        cap = F.create_map(*(x for m in METERED for x in (F.lit(m), F.lit(int(caps.get(m, 0))))))
        last = totals.where(F.col("total") >= F.element_at(cap, F.col("engine"))).groupBy("day", "engine").agg(F.min(F.struct("at", "call_id")).alias("last"))
        known = F.lit(False)
        for m in METERED:
            known = F.when(F.col("engine") == m, F.col(f"last_{m}").isNotNull()).otherwise(known)
        first = last.join(marks, "day").where(~known).groupBy("day").agg(F.min(F.struct("last", "engine")).alias("x"))
        found = marks.join(first, "day", "left")
        marks = materialize(found.select("day", *(F.when(F.col("x.engine") == m, F.col("x.last")).otherwise(F.col(f"last_{m}")).alias(f"last_{m}") for m in METERED)), "marks")
    out = F.exists("chain", lambda c: c.isin(*METERED) & _spent(c))
    return assigned().select("call_id", "day", "stage", "engine", out.alias("exhausted"))
