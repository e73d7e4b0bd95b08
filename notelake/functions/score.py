"""Score arithmetic of ranked retrieval, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Channel weights, and the bounds of the decision tree.
WEIGHTS = {"title": 0.4, "tags": 0.3, "stack": 0.2, "body": 0.1}
ANSWER, UPDATE, NEIGHBOUR = 0.85, 0.55, 0.30
IDF_CAP = 3.5


def f2(hits: Column, query_terms: Column, title_tokens: Column) -> Column:
    """Recall-weighted F-measure; 0 if any count is 0."""
    p, r = hits.cast("double") / title_tokens, hits.cast("double") / query_terms
    return F.when((hits > 0) & (query_terms > 0) & (title_tokens > 0), 5 * p * r / (4 * p + r)).otherwise(F.lit(0.0))


def idf(df: Column, n: Column) -> Column:
    return F.when((df > 0) & (n > 0), F.least(F.ln(1 + n.cast("double") / df), F.lit(IDF_CAP))).otherwise(F.lit(0.0))


def round3(x: Column) -> Column:
    """Three places, halves away from zero."""
    return F.when(x < 0, -F.floor(-x * 1000 + 0.5)).otherwise(F.floor(x * 1000 + 0.5)) / 1000


def saturated(words: Column, wanted: Column) -> Column:
    """Mean over the wanted terms of their counts, each up to three, by thirds; 0 without terms."""
    # the words are bound once; named inside the inner lambda they would be computed anew for each term
    bound = F.transform(F.array(words), lambda ws: F.aggregate(wanted, F.lit(0.0), lambda a, t: a + F.least(F.size(F.filter(ws, lambda w: w == t)), F.lit(3)) / F.lit(3.0)))
    return F.when(F.size(wanted) > 0, F.get(bound, F.lit(0)) / F.size(wanted)).otherwise(F.lit(0.0))


def blend(channels: list[tuple[str, Column, Column]]) -> Column:
    """(name, active, value): the weighted mean over the active channels, 0 if none is."""
    num = sum((F.when(active, WEIGHTS[n] * value).otherwise(F.lit(0.0)) for n, active, value in channels), F.lit(0.0))
    den = sum((F.when(active, F.lit(WEIGHTS[n])).otherwise(F.lit(0.0)) for n, active, _ in channels), F.lit(0.0))
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def decide(score: Column, stale: Column) -> Column:
    """The verdict on the top candidate; a null score is none."""
    return (
        F.when(score.isNull(), "CREATE")
        .when((score >= ANSWER) & ~stale, "ANSWER_FROM_VAULT")
        .when(score >= ANSWER, "UPDATE(refresh)")
        .when(score >= UPDATE, "UPDATE(extend)")
        .otherwise("CREATE")
    )
