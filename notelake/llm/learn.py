"""What the classifiers share: the training sample, boosted trees, isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A classifier learns from at most so many labelled documents; all are scored.
MAX_TRAINING_ROWS = 20_000
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """The fold that no training reads; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(True))


def training_sample(documents: DataFrame, labels: DataFrame, target: str, most: int = MAX_TRAINING_ROWS) -> DataFrame:
    """doc_id, text, label (0/1) of at most ``most`` labelled rows outside the held-out fold, by a hash of their ids.

    The chosen ids are bounded by ``most``, so the join is a broadcast of a few hundred KB.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # an id repeated gives one text


@dataclass
class Trees:
    """Gradient-boosted trees of one depth, on binned features; scores are log odds."""

    edges: list[np.ndarray]
    base: float
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    leaf: np.ndarray  # trees x leaves

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, least: float = 5.0, ridge: float = 2.0) -> Trees:
        n, m = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) if n else np.zeros(0) for j in range(m)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1) if n else np.zeros((0, m), dtype=int)
        p0 = min(max((y.sum() + 1) / (n + 2), 1e-3), 1 - 1e-3)
        base = float(np.log(p0 / (1 - p0)))
        score = np.full(n, base)
        inner, leaves = 2**depth - 1, 2**depth
        feature, cut, leaf = np.zeros((trees, inner), dtype=np.int64), np.full((trees, inner), 2**30), np.zeros((trees, leaves))
        for t in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, dtype=np.int64)
            for level in range(depth):
                first, count = 2**level - 1, 2**level
                best = np.full(count, 1e-6)
                for j in range(m):
                    width = len(edges[j]) + 1
                    at = node * width + binned[:, j]
                    gs = np.bincount(at, weights=g, minlength=count * width).reshape(count, width).cumsum(axis=1)
                    hs = np.bincount(at, weights=h, minlength=count * width).reshape(count, width).cumsum(axis=1)
                    gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                    gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                    gain = np.where((hl * 4 >= least) & ((ht - hl) * 4 >= least), gain, 0)
                    if gain.shape[1]:
                        k = gain.argmax(axis=1)
                        top = gain[np.arange(count), k]
                        better = top > best
                        best = np.where(better, top, best)
                        feature[t, first : first + count][better] = j
                        cut[t, first : first + count][better] = k[better]
                here = first + node
                node = node * 2 + (binned[np.arange(n), feature[t, here]] > cut[t, here])
            gs, hs = np.bincount(node, weights=g, minlength=leaves), np.bincount(node, weights=h, minlength=leaves)
            leaf[t] = rate * gs / (hs + ridge)
            score = score + leaf[t][node]
        return Trees(edges, base, feature, cut, leaf)

    def score(self, x: np.ndarray) -> np.ndarray:
        n = len(x)
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)
        out, row, depth = np.full(n, self.base), np.arange(n), int(np.log2(self.leaf.shape[1]))
        for f, c, v in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(n, dtype=np.int64)
            for level in range(depth):
                here = 2**level - 1 + node
                node = node * 2 + (binned[row, f[here]] > c[here])
            out += v[node]
        return out


@dataclass
class Isotonic:
    """A rising map from scores to probabilities: pooled adjacent violators, joined by lines between the pools' centres."""

    at: np.ndarray
    value: np.ndarray

    @staticmethod
    def fit(score: np.ndarray, y: np.ndarray, prior: float = 1.0) -> Isotonic:
        if not len(score):
            return Isotonic(np.zeros(1), np.full(1, 0.5))
        order = np.argsort(score, kind="stable")
        s, v = score[order], y[order].astype(float)
        pools: list[list[float]] = []  # sum of y, weight, sum of score
        for a, b in zip(s.tolist(), v.tolist()):
            pools.append([b, 1.0, a])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                last = pools.pop()
                for k in range(3):
                    pools[-1][k] += last[k]
        total = np.array(pools)
        # the mean of a pool leans to the overall rate, so that small pools at the ends are not certain
        rate = y.mean()
        value = (total[:, 0] + prior * rate) / (total[:, 1] + prior)
        return Isotonic(total[:, 2] / total[:, 1], np.maximum.accumulate(value))

    def __call__(self, score: np.ndarray) -> np.ndarray:
        """Ties within a pool or beyond the ends stay in the order of the raw scores."""
        order = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        return np.clip(0.999 * np.interp(score, self.at, self.value) + 0.001 * order, 0.0, 1.0)
