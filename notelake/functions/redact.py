"""Redaction as chained replacements; each stage is counted before it is applied."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is redacted, in this order. Word bounds are ASCII, so they are spelt out.
STAGES = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[REDACTED-EMAIL]"),
    (r"(?:/Users|/home)/[A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.\-]+)*", "[REDACTED-PATH]"),
    (r"(?<![0-9A-Za-z_])(?:sk-|ghp_|AKIA)[A-Za-z0-9_-]{10,}(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))", "[REDACTED-KEY]"),
    (r"(?<![0-9A-Za-z_])(?=[A-Za-z]*[0-9])[A-Za-z0-9]{32,}(?![0-9A-Za-z_])", "[REDACTED-KEY]"),
]
# Fixed value: addresses that are redacted in exports.
INTERNAL_URL = (
    r"(?<![0-9A-Za-z_])https?://(?:localhost|127\.\d+\.\d+\.\d+|10\.\d+\.\d+\.\d+|192\.168\.\d+\.\d+|172\.(?:1[6-9]|2\d|3[01])\.\d+\.\d+|"
    r"[A-Za-z0-9.-]+\.(?:internal|local|localhost|test|corp|lan|intranet))(?::\d+)?\S*"
)


#: Plain words of which a text must hold one before the pattern of a stage is tried, as the patterns are far dearer.
HINTS = [["@"], ["/Users/", "/home/"], ["sk-", "ghp_", "AKIA"], []]


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _stage(pattern: str, mark: str, hints: list[str]) -> Callable[[Column], Column]:
    def stage(s: Column) -> Column:
        likely = s["text"].rlike(pattern)
        if hints:
            some = F.contains(s["text"], F.lit(hints[0]))
            for hint in hints[1:]:
                some = some | F.contains(s["text"], F.lit(hint))
            likely = some & likely
        done = F.struct(F.regexp_replace(s["text"], pattern, mark).alias("text"), (s["n"] + F.regexp_count(s["text"], F.lit(pattern))).alias("n"))
        return F.when(likely, done).otherwise(s)

    return stage


def redaction(text: Column, urls: bool = False) -> Column:
    """struct<text, n>: the redacted text and the number of replacements; with ``urls`` also internal addresses, for exports."""
    state = F.struct(text.alias("text"), F.lit(0).alias("n"))
    for (pattern, mark), hints in [*zip(STAGES, HINTS), *([((INTERNAL_URL, "[REDACTED-URL]"), ["://"])] if urls else [])]:
        state = _bound(state, _stage(pattern, mark, hints))
    return state


def redacted(text: Column, urls: bool = False) -> tuple[Column, Column]:
    """The redacted text and the number of replacements; null for a null text."""
    state = redaction(text, urls)
    return state["text"], F.when(text.isNotNull(), state["n"])
