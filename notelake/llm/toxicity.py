"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text: densities of two lexicons (seed words; words and beginnings of words learnt
from the training sample, since insults are inflected and compounded), the same after undoing digits and signs that stand for letters, how near second-person words
stand to lexicon words, capitals, punctuation and obfuscation rates, and the length. Labels, language,
source and id are no features.

The sample is bounded (``MAX_TRAINING_ROWS``); the lexicon and the trees are learnt from three quarters of it
and the calibration from the rest. Every document is scored, in one pass without a shuffle.

Defined results: a null or empty text has zero features and still gets a score; rows are judged one by
one, so repeated rows, ties and null ids change nothing (a null id is held out); without usable labels
every score is 0.5 less a margin, and nothing is predicted toxic; an empty table gives no rows; other
columns of either table are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.llm.learn import MAX_TRAINING_ROWS, Isotonic, Trees, held_out, training_sample
from notelake.llm.memory import trimmed
from notelake.session import materialize, ship

SEED_WORDS = frozenset("idiot idiots stupid moron moron loser losers trash scum pathetic worthless disgusting clown dumb fool ugly hate kill shut liar garbage filthy".split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre usted ustedes ti tus vosotros".split())
PLAIN = str.maketrans("013457@$!|", "oieastasii")
WORD = re.compile(r"[^\W_]+(?:[@$!*|_.\-]+[^\W_]+)*")
MIXED = re.compile(r"[A-Za-z]+[0-9@$!*|]+[A-Za-z]+")
NEAR = 5
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
MARKS = b".,;:!?'\"()-"
STEMS = (4, 5, 6, 8)
FEATURES = 19


class Lexicon:
    """Whole words, and beginnings of longer words, written with a hyphen."""

    def __init__(self, learnt: frozenset[str]):
        self.learnt = learnt
        self.whole = learnt | SEED_WORDS
        self.stems = frozenset(w[:-1] for w in learnt if w.endswith("-"))
        self.sizes = tuple(sorted({len(w) for w in self.stems}))
        self.heads = frozenset(w[: STEMS[0]] for w in self.whole | self.stems)

    def __contains__(self, token: str) -> bool:
        return token in self.whole or any(token[:k] in self.stems for k in self.sizes if len(token) >= k)


@dataclass
class Model:
    words: Lexicon
    trees: Trees | None
    calibration: Isotonic | None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), 0.49)
        return self.calibration(self.trees.score(x))


def features(text: str, lexicon: Lexicon) -> list[float]:
    data = text.encode("utf-8", "surrogatepass")
    size = len(data)
    tokens = WORD.findall(text.lower())
    n = len(tokens)
    per = 100.0 / n if n else 0.0
    head, heads, learnt_set = STEMS[0], lexicon.heads, lexicon.learnt
    hits = [i for i, t in enumerate(tokens) if t[:head] in heads and t in lexicon]
    seed = sum(tokens[i] in SEED_WORDS for i in hits)
    whole = sum(tokens[i] in learnt_set for i in hits)
    learnt = sum(tokens[i] in learnt_set or tokens[i] not in SEED_WORDS for i in hits)
    mixed = MIXED.findall(text) if size else []
    undone = sum(m.lower().translate(PLAIN) in lexicon for m in mixed)
    close, nearest = 0, 100.0
    if hits:
        you = [i for i, t in enumerate(tokens) if t in SECOND_PERSON]
        if you:
            gap = np.abs(np.searchsorted(you, hits)[:, None] + np.array([-1, 0])).clip(0, len(you) - 1)
            dist = np.abs(np.array(you)[gap] - np.array(hits)[:, None]).min(axis=1)
            close, nearest = int((dist <= NEAR).sum()), float(dist.min())
    upper, lower = size - len(data.translate(None, UPPER)), size - len(data.translate(None, LOWER))
    marks, shout, ask = size - len(data.translate(None, MARKS)), data.count(b"!"), data.count(b"?")
    stars = data.count(b"*") + data.count(b"@") + data.count(b"$")
    tight = float(min(np.diff(hits))) if len(hits) > 1 else 200.0
    part = 100.0 / size if size else 0.0
    return [
        seed * per, learnt * per, whole * per, float(len(hits)), float(len({tokens[i] for i in hits})), undone * per, float(undone), close * per, nearest, tight,
        100.0 * upper / (upper + lower) if upper + lower else 0.0, sum(map(str.isupper, text.split())) * per if upper > 5 else 0.0,
        marks * part, shout * part, ask * part, len(mixed) * per, stars * part, float(np.log1p(n)), float(size) / n if n else 0.0,
    ]


def learnt_words(sample: DataFrame, least_documents: int = 8, most: int = 600, odds: float = 3.5) -> frozenset[str]:
    """Words, and beginnings of words with a hyphen, that mark the label: in ``least_documents`` different texts or more, and with high log odds."""
    once = sample.groupBy(F.xxhash64("text").alias("same")).agg(F.first("text").alias("text"), F.max("label").alias("label"))
    totals = once.agg(F.sum("label").alias("all1"), F.sum(1 - F.col("label")).alias("all0")).first()
    all1, all0 = totals["all1"] or 0, totals["all0"] or 0
    found = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))
    longer = lambda n: F.transform(F.filter(found, lambda w: F.length(w) >= n), lambda w: F.concat(F.substring(w, 1, n), F.lit("-")))
    words = once.select("label", F.explode(F.array_distinct(F.flatten(F.array(found, *map(longer, STEMS))))).alias("word")).where(F.length("word").between(2, 40))
    counted = words.groupBy("word").agg(F.sum("label").alias("n1"), F.sum(1 - F.col("label")).alias("n0")).where(F.col("n1") >= least_documents)
    scored = counted.select("word", (F.log((F.col("n1") + 0.5) / F.lit(all1 + 1)) - F.log((F.col("n0") + 0.5) / F.lit(all0 + 1))).alias("s"), "n1")
    kept = scored.where((F.col("s") >= odds) & (F.col("n1") >= 0.01 * all1)).orderBy(F.col("s").desc(), "word").limit(most)
    return frozenset(r["word"] for r in kept.collect())


def _rows(words: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py() or "", words) for t in batch.column(0)], dtype=np.float64).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x.tolist(), pa.list_(pa.float64())), batch.column(2)], names=["label", "x", "part"])

    return run


def fit(documents: DataFrame, labels: DataFrame, most: int = MAX_TRAINING_ROWS) -> Model:
    ship(documents.sparkSession)
    sample = materialize(training_sample(documents, labels, "toxic", most).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)).cast("int")), "sample")  # read three times
    words = Lexicon(learnt_words(sample.where("part > 0")))  # what calibrates is not learnt from
    # ``most`` rows of numbers
    rows = sample.select("text", "label", "part").mapInArrow(_rows(words), "label int, x array<double>, part int").toArrow()
    y, part = rows.column("label").to_numpy().astype(float), rows.column("part").to_numpy()
    x = np.array(rows.column("x").to_pylist()).reshape(-1, FEATURES)
    if y.sum() < 3 or (1 - y).sum() < 3:
        return Model(words, None, None)
    order = np.lexsort((*x.T, y, part))  # the order in which rows came must not matter
    x, y, part = x[order], y[order], part[order]
    first = part > 0 if 0 < (part == 0).sum() < len(part) else np.ones(len(part), dtype=bool)
    trees = Trees.fit(x[first], y[first])
    rest = ~first if (~first).any() else first
    return Model(words, trees, Isotonic.fit(trees.score(x[rest]), y[rest]))


def _scorer(model: Model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py() or "", model.words) for t in batch.column(2)], dtype=np.float64).reshape(-1, FEATURES)
            s = model.scores(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def toxicity(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = fit(documents, labels)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").alias("text"))
    return rows.mapInArrow(_scorer(model, threshold), "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``documents`` that are not predicted toxic, as they came."""
    model = fit(documents, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            x = np.array([features(t.as_py() or "", model.words) for t in batch.column(at)], dtype=np.float64).reshape(-1, FEATURES)
            yield batch.filter(pa.array(model.scores(x) < threshold))

    return documents.mapInArrow(trimmed(run), documents.schema)
