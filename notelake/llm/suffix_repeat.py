"""Quality rules by suffix arrays: repeated passages, their coverage and the longest of them.

The words of many texts are numbered and laid end to end, each text closed by a number of its own.
Prefix doubling ranks the suffixes by their first 1, 2, 4, ... words and goes on only with those that
are still tied, so ordinary prose settles in a few rounds and a text of one repeated word takes the
logarithm of its length. The common prefix of neighbours in the suffix array is read off the ranks of
the rounds. The longest repeat that starts at a word is the larger of the common prefixes with its two
neighbours; the maximal repeated substrings are the intervals of these values, so the union of their
spans is the union of all such runs. A text fails if repeats of at least ``least`` words cover too
large a fraction of its words, or if the longest repeat has too many words, however long the text. The
spans lie inside repeated windows, so only a fraction below ``percent_repeated`` adds to the base rule.

The base rules (counts of words, symbols, lines that repeat, words in five-word windows that occur
twice) come from the same arrays.

Defined results: a null text has no words and fails the base rule; each row is judged alone, so
repeated rows and ids, nulls in ids and other columns change nothing; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.session import ship

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Limits:
    window: int = 5
    fewest_words: int = 10
    percent_repeated: int = 20
    #: Repeats of at least so many words are spans.
    least: int = 10
    #: Of the words, in spans: the published limit for ten-word repeats.
    most_covered: float = 0.1
    #: The longest repeat, in words.
    longest: int = 50


def suffix_lcp(symbols: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each place the length of the longest run of symbols that starts there and elsewhere in the same text.

    symbols: numbers of words; owner: number of the text of each place. Texts never match each other.
    """
    n = len(symbols)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    # the last place of each text gets a rank of its own as soon as a comparison runs over its end
    last = np.empty(n, dtype=bool)
    last[:-1] = owner[1:] != owner[:-1]
    last[-1] = True
    ends = np.flatnonzero(last)
    left = ends[np.cumsum(last) - last] - np.arange(n) + 1  # words from here to the end of the text
    key = owner.astype(np.int64) * (int(symbols.max()) + 2) + symbols
    _, dense, counts = np.unique(key, return_inverse=True, return_counts=True)
    tied = np.flatnonzero(counts[dense] > 1)
    # a class is ranked by the number of suffixes before it, so that ties have room to part
    rank = (np.cumsum(counts) - counts)[dense]
    levels = [rank]
    span = 1
    while len(tied):
        # second half: the rank of what follows; beyond the end, the place itself, below all ranks
        follow = tied + span
        inside = left[tied] > span
        second = np.where(inside, rank[np.minimum(follow, n - 1)] + n, n - 1 - tied)
        order = np.lexsort((second, rank[tied]))
        t, s = tied[order], second[order]
        r = rank[t]
        fresh = np.empty(len(t), dtype=bool)
        fresh[0] = True
        fresh[1:] = (r[1:] != r[:-1]) | (s[1:] != s[:-1])
        new = rank.copy()
        group_start = np.empty(len(t), dtype=bool)
        group_start[0] = True
        group_start[1:] = r[1:] != r[:-1]
        position = np.arange(len(t))
        begin = np.maximum.accumulate(np.where(group_start, position, 0))
        cls = np.maximum.accumulate(np.where(fresh, position, 0))
        new[t] = r + (cls - begin)
        rank = new
        levels.append(rank)
        span *= 2
        size = np.diff(np.append(np.flatnonzero(fresh), len(t)))
        tied = np.sort(t[np.repeat(size, size) > 1])
    return _longest(levels, n)


def _longest(levels: list[np.ndarray], n: int) -> np.ndarray:
    order = np.argsort(levels[-1], kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(max(0, n - 1), dtype=np.int64)
    live = np.flatnonzero(levels[0][a] == levels[0][b])
    pa_, pb_ = a[live], b[live]
    run = np.zeros(len(live), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        level, step = levels[k], 1 << k
        ok = (pa_ < n) & (pb_ < n)
        same = ok & (level[np.minimum(pa_, n - 1)] == level[np.minimum(pb_, n - 1)])
        run += np.where(same, step, 0)
        pa_, pb_ = pa_ + np.where(same, step, 0), pb_ + np.where(same, step, 0)
    common[live] = run
    best = np.zeros(n, dtype=np.int64)
    if n > 1:
        np.maximum.at(best, a, common)
        np.maximum.at(best, b, common)
    return best


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in a run."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + lengths, -1)
    return np.cumsum(step[:-1]) > 0


def repeats(texts: list[bytes], limits: Limits = Limits()) -> dict[str, np.ndarray]:
    """Word counts and repetition figures of each text."""
    number: dict[bytes, int] = {}
    get = number.setdefault
    symbols, sizes = [], []
    for data in texts:
        words = data.split()
        sizes.append(len(words))
        symbols += [get(w, len(number)) for w in words]
    size = np.array(sizes, dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), size)
    sym = np.array(symbols, dtype=np.int64)
    longest = suffix_lcp(sym, owner)
    place = np.arange(len(sym))
    sums = lambda flags: np.bincount(owner, weights=flags, minlength=len(texts)).astype(np.int64)
    w = np.flatnonzero(longest >= limits.window)
    repeated = covered(w, np.full(len(w), limits.window), len(sym))
    long = np.flatnonzero(longest >= limits.least)
    spans = covered(long, longest[long], len(sym))
    top = np.zeros(len(texts), dtype=np.int64)
    if len(sym):
        np.maximum.at(top, owner, longest)
    return {"n_words": size, "n_repeat_words": sums(repeated), "covered_words": sums(spans), "longest_repeat": top}


def judge(documents: DataFrame, limits: Limits = Limits(), doc_id: str = "doc_id", text: str = "text", batch_bytes: int = 2_000_000) -> DataFrame:
    """The base counts, base_failed, kept and the method's figures of every row."""

    def measure(ids: list, texts: list[bytes]) -> pa.RecordBatch:
        r = repeats(texts, limits)
        chars, marks, lines = [], [], []
        for data in texts:
            points = len(data) if data.isascii() else len(data.decode("utf-8", "surrogatepass"))
            chars.append(points - (len(data) - len(data.translate(None, SPACE))))
            marks.append(len(data) - len(data.translate(None, SYMBOLS)))
            if b"\n" in data:
                full = [x for x in data.split(b"\n") if x.strip(SPACE)]
                lines.append(len(full) - len(set(full)))
            else:
                lines.append(0)
        n, again = r["n_words"], r["n_repeat_words"]
        failed = (n < limits.fewest_words) | (100 * again > limits.percent_repeated * n)
        whole = np.maximum(n, 1)
        fine = (r["covered_words"] <= limits.most_covered * whole) & (r["longest_repeat"] <= limits.longest)
        long = pa.int64()
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, long), pa.array(n), pa.array(chars, long), pa.array(marks, long), pa.array(lines, long), pa.array(again), pa.array(failed), pa.array(fine & ~failed), pa.array(r["covered_words"]), pa.array(r["longest_repeat"])],
            names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words", "longest_repeat"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            some, size, lo = [], 0, 0
            for k, t in enumerate(texts):
                some.append((t.as_py() or "").encode("utf-8", "surrogatepass"))
                size += len(some[-1])
                if size >= batch_bytes or k + 1 == len(ids):
                    yield measure(ids[lo : k + 1], some)
                    some, size, lo = [], 0, k + 1

    ship(documents.sparkSession)
    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_words long, longest_repeat long"
    )
