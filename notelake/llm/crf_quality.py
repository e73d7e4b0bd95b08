"""Document quality by a linear-chain conditional random field over lines.

Every line has features of its own and of its two neighbours; the field labels lines good or bad. It is
trained on the lines of labelled documents, each with its document's label, by gradient steps on the exact
likelihood. A document's raw score is the mean of its lines' forward-backward marginals for *good*, weighed
by the lines' lengths; isotonic calibration on a quarter of the sample turns it into a probability.

The sample is bounded in documents and in lines (``MAX_TRAINING_ROWS``, ``MAX_TRAINING_LINES``), and so are the lines of
one of its documents (``MAX_LINES_OF_ONE``); documents beyond take no part in training. Every document is scored whole, in one pass without a shuffle. Class
counts come from running sums over the bytes of a batch, and the two passes of the field run over all
documents of a batch at once, so a text of very many lines costs time in proportion.

Defined results: a null or empty text is one empty line; rows are judged one by one, so repeated rows,
ties and null ids change nothing (a null id is held out); without usable labels every score is 0.5; an
empty table gives no rows; other columns of either table are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.llm.learn import Isotonic, held_out, training_sample
from notelake.session import ship

MAX_TRAINING_ROWS = 8_000
MAX_TRAINING_LINES = 300_000
MAX_LINES_OF_ONE = 6_000
OWN = 15

_KIND = np.zeros(256, dtype=np.int64)
_KIND[65:91] = 1
_KIND[97:123] = 2
_KIND[128:] = 2
_KIND[48:58] = 3
for _c in b".,;:!?'\"()-":
    _KIND[_c] = 4
for _c in b"#$%&*<>@^_~=+/\\{}[]`":
    _KIND[_c] = 5
_KIND[ord("|")] = 6


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines x OWN features, bytes of each line, first line of each text and the total)."""
    lines: list[bytes] = []
    first = [0]
    words, short, distinct, again, dup = [], [], [], [], []
    for data in texts:
        some = data.split(b"\n")
        seen: set[bytes] = set()
        for line in some:
            ws = line.split()
            words.append(len(ws))
            short.append(sum(map((4).__gt__, map(len, ws))))
            distinct.append(len(set(ws)))
            again.append(sum(map(eq, ws, ws[1:])))
            dup.append(line in seen)
            seen.add(line)
        lines += some
        first.append(len(lines))
    size = np.array([len(x) for x in lines], dtype=np.int64)
    kind = _KIND[np.frombuffer(b"".join(lines), dtype=np.uint8)]
    ends = np.cumsum(size)
    counts = []
    for k in range(1, 7):
        run = np.concatenate([[0], np.cumsum(kind == k, dtype=np.int64)])
        counts.append(run[ends] - run[ends - size])
    upper, lower, digit, mark, sign, pipe = counts
    n = np.array(words, dtype=float)
    w, b = np.maximum(n, 1), np.maximum(size, 1)
    tail = np.array([line.rstrip()[-1:] in (b".", b"!", b"?") for line in lines], dtype=float)
    head = np.array([line[:1].isupper() for line in lines], dtype=float)
    x = np.stack(
        [
            np.log1p(n) / 3, np.minimum((upper + lower) / w, 20) / 10, np.array(short) / w, np.array(distinct) / w, np.array(again) / w,
            (upper + lower) / b, digit / b * 4, np.minimum(sign / w, 5), np.minimum(pipe / w, 2) * 2, mark / b * 4,
            tail, head, np.array(dup, dtype=float), (n <= 1).astype(float), np.log1p(n) * (1 - np.array(distinct) / w),
        ],
        axis=1,
    )
    return x, size, np.array(first)


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after (zero beyond the ends), and a constant."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    return np.concatenate([x, before, after, np.ones((len(x), 1))], axis=1)


@dataclass
class Field:
    weight: np.ndarray
    move: np.ndarray  # 2 x 2, log

    def passes(self, unary: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of each line, and the expected number of moves (2 x 2) over all texts."""
        n = np.diff(first)
        order = np.argsort(-n, kind="stable")
        start, n = first[:-1][order], n[order]
        emit = np.stack([np.ones(len(unary)), np.exp(np.clip(unary, -30, 30))], axis=1)
        emit /= emit.sum(axis=1, keepdims=True)
        a = np.exp(self.move)
        forward, backward = np.empty_like(emit), np.empty_like(emit)
        longest = int(n[0]) if len(n) else 0
        live = np.searchsorted(-n, -np.arange(longest), side="left")  # texts with more than t lines
        for t in range(longest):
            at = start[: live[t]] + t
            f = emit[at] if t == 0 else (forward[at - 1] @ a) * emit[at]
            forward[at] = f / f.sum(axis=1, keepdims=True)
        backward[start + n - 1] = 0.5
        moves = np.zeros((2, 2))
        for t in range(longest - 1, 0, -1):
            at = start[: live[t]] + t
            later = emit[at] * backward[at]
            pair = forward[at - 1][:, :, None] * a[None] * later[:, None, :]
            moves += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            b = later @ a.T
            backward[at - 1] = b / b.sum(axis=1, keepdims=True)
        p = forward * backward
        return p[:, 1] / p.sum(axis=1), moves

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, first: np.ndarray, steps: int = 120, rate: float = 0.08, ridge: float = 1e-3) -> Field:
        """y: label of each line. Texts are weighed alike, however many lines they have."""
        n = np.diff(first)
        share = np.repeat(1 / n, n)
        field = Field(np.zeros(x.shape[1]), np.zeros((2, 2)))
        inner = np.ones(len(y), dtype=bool)
        inner[first[:-1]] = False
        i = np.flatnonzero(inner)
        seen = np.bincount(y[i - 1] * 2 + y[i], minlength=4).reshape(2, 2).astype(float)
        m, v = np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4)
        texts, moves_in_all = len(n), max(1.0, seen.sum())
        for step in range(1, steps + 1):
            p, moves = field.passes(x @ field.weight, first)
            g = np.concatenate([x.T @ ((y - p) * share) / texts - ridge * field.weight, ((seen - moves) / moves_in_all - 10 * ridge * field.move).ravel()])
            m, v = 0.9 * m + 0.1 * g, 0.98 * v + 0.02 * g * g
            up = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-8)
            field = Field(field.weight + up[:-4], np.clip(field.move + up[-4:].reshape(2, 2), -4, 4))
        return field

    def quality(self, texts: list[bytes]) -> np.ndarray:
        x, size, first = line_features(texts)
        return self.documents(x, size, first)

    def documents(self, x: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        p, _ = self.passes(with_neighbours(x, first) @ self.weight, first)
        long = size + 1.0
        top, all_ = np.concatenate([[0], np.cumsum(p * long)]), np.concatenate([[0], np.cumsum(long)])
        return (top[first[1:]] - top[first[:-1]]) / (all_[first[1:]] - all_[first[:-1]])


@dataclass
class Model:
    field: Field | None
    calibration: Isotonic | None

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.field is None:
            return np.full(len(texts), 0.5)
        return self.calibration(_logit(self.field.quality(texts)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


def fit(documents: DataFrame, labels: DataFrame, most: int = MAX_TRAINING_ROWS, most_lines: int = MAX_TRAINING_LINES, most_of_one: int = MAX_LINES_OF_ONE) -> Model:
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, size, first = line_features([(t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column(1)])
            raw = x.astype("<f4")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([raw[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary()), pa.array([size[a:b].tolist() for a, b in zip(first[:-1], first[1:])], pa.list_(pa.int64()))],
                names=["doc_id", "label", "x", "size"],
            )

    sample = training_sample(documents, labels, "quality", most).select("doc_id", "text", "label")
    sample = sample.where(F.size(F.split("text", "\n")) <= most_of_one)
    rows = sample.mapInArrow(run, "doc_id long, label int, x binary, size array<long>").toArrow().to_pylist()
    rows.sort(key=lambda r: (zlib.crc32(b"draw %d" % r["doc_id"]), r["doc_id"], r["x"]))  # lines are drawn by a hash of the id
    kept, lines = [], 0
    for r in rows:
        if lines + len(r["size"]) <= most_lines:
            kept.append(r)
            lines += len(r["size"])
    label = np.array([r["label"] for r in kept], dtype=np.int64)
    if not 2 < label.sum() < len(label) - 2:
        return Model(None, None)
    part = np.arange(len(kept)) % 4

    def joined(some: np.ndarray):
        picked = [kept[i] for i in np.flatnonzero(some)]
        n = [len(r["size"]) for r in picked]
        x = np.frombuffer(b"".join(r["x"] for r in picked), dtype="<f4").reshape(-1, OWN).astype(float)
        return x, np.concatenate([r["size"] for r in picked]), np.concatenate([[0], np.cumsum(n)]), np.repeat(label[some], n)

    x, _, first, y = joined(part != 0)
    field = Field.fit(with_neighbours(x, first), y, first)
    x, size, first, _ = joined(part == 0)
    return Model(field, Isotonic.fit(_logit(field.documents(x, size, first)), label[part == 0].astype(float)))


def quality(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, batch_bytes: int = 4_000_000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = fit(documents, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some, size, lo = [], 0, 0
            for k, t in enumerate(batch.column(2)):
                some.append((t.as_py() or "").encode("utf-8", "surrogatepass"))
                size += len(some[-1])
                if size >= batch_bytes or k + 1 == batch.num_rows:
                    s = model.scores(some)
                    part = batch.slice(lo, k + 1 - lo)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])
                    some, size, lo = [], 0, k + 1

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
