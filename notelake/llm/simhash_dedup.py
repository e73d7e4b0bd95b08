"""Near-duplicate groups by SimHash, found with the generalised pigeonhole principle.

Every text becomes a 64-bit fingerprint of its word shingles; equal fingerprints are one node. If m
disjoint parts of the bits have thresholds t_i with sum(t_i) = tau - m + 1, two fingerprints that
differ in at most tau bits agree in some part i up to t_i bits (a part with t_i = -1 is skipped).

* Bits are grouped by correlation (from co-occurrence counts over all fingerprints), so that what
  repeats falls into one part. The units are eight bytes of correlated bits.
* For every way of joining neighbouring units to parts, dynamic programming allots the thresholds
  that cost least: probe rows, plus the candidate pairs that histograms over all fingerprints
  predict (the autocorrelation of a histogram of 2^16 values counts its pairs at every distance).
* Each fingerprint owns its own value of each part and visits the smaller values within t_i bits.
  Owners and visitors of one value meet in a sorted run, in the executors; distances are computed
  on whole arrays, and what leaves a run is a spanning forest of its links, shortest links first,
  never its pairs. A value with more owners than a block is dealt out over cells of owner blocks,
  so that every owner meets every other in exactly one cell.

Links then go to ``connected_components``. ``near_dups`` uses the same fingerprints and links to
nominate near duplicates by the Jaccard similarity of shingle sets.

Defined results: a null text is an empty one; texts without a word have fingerprint zero and are
linked like any other; a null id counts as smaller than any other inside, and its component is the
smallest id that is not null (null if there is none); repeated rows each come back; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.operators.components import connected_components
from notelake.session import materialize, partitions, ship

TAU = 3
SEED = 42
BLOCK = 4096
UNIT = 8
#: Microseconds that a probe row and a candidate pair cost, for the choice of parts.
ROW_US, PAIR_US = 2.0, 0.004
NO_ID = -(2**63)


# ---------------------------------------------------------------- fingerprints


def shingles(data: bytes, width: int) -> tuple[list[bytes], int]:
    """The words of a text and the number of its shingles; fewer words than ``width`` are one shingle."""
    words = data.lower().split()
    return words, (max(1, len(words) - width + 1) if words else 0)


def each_shingle(words: list[bytes], width: int, step: int = 50_000) -> Iterator[list[bytes]]:
    if 0 < len(words) < width:
        yield [b" ".join(words)]
        return
    n = len(words) - width + 1
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        yield [b" ".join(s) for s in zip(*(words[lo + k : hi + k] for k in range(width)))] if width > 1 else words[lo:hi]


def _ones(bits: np.ndarray) -> np.ndarray:
    """Column sums of a 0/1 matrix of bytes, in sums of 255 that fit a byte."""
    full = len(bits) // 255 * 255
    total = bits[full:].sum(axis=0, dtype=np.uint8).astype(np.int64)
    if full:
        total += bits[:full].reshape(-1, 255, bits.shape[1]).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return total


def fingerprint(data: bytes, width: int) -> bytes:
    """8 bytes; a bit is set if it is in over half the shingle hashes."""
    words, n = shingles(data, width)
    if not n:
        return bytes(8)
    total = 0
    for some in each_shingle(words, width):
        raw = np.frombuffer(b"".join([xxhash.xxh64_digest(s, SEED) for s in some]), dtype=np.uint8).reshape(-1, 8)
        total = total + _ones(np.unpackbits(raw, axis=1))
    return np.packbits(2 * total > n).tobytes()


def keyed(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc, text, tkey (a hash of the text): what names a row of a table whose ids may repeat."""
    return documents.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tkey"))


def fingerprints(documents: DataFrame, width: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, fp (the bit pattern in a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = b"".join([fingerprint((t.as_py() or "").encode("utf-8", "surrogatepass"), width) for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.frombuffer(raw, dtype=">i8").astype(np.int64))], names=["doc", "fp"])

    ship(documents.sparkSession)
    return keyed(documents, doc_id, text).drop("tkey").mapInArrow(run, "doc long, fp long")


# ---------------------------------------------------------------- the choice of parts


def _co_occurrence(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints have bits i and j both set (64 x 64), and how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((64, 64)), 0
        for batch in batches:
            fp = batch.column(0).to_numpy().astype(">i8")
            bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            total += (bits.T @ bits).astype(np.float64)
            n += len(fp)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097)), pa.array(np.append(total.ravel(), n).astype(np.int64))], names=["cell", "n"])

    rows = nodes.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # 4097 rows
    flat = np.zeros(4097)
    for r in rows:
        flat[r["cell"]] = r["n"]
    return int(flat[-1]), flat[:-1].reshape(64, 64)


def correlated_units(n: int, both: np.ndarray) -> list[list[int]]:
    """Eight lists of eight bits (0 is the highest); bits of one unit go together, and units of one pair."""
    if n < 2:
        return [list(range(8 * i, 8 * i + 8)) for i in range(8)]
    p = np.diag(both) / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    phi = np.abs((both / n - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(phi, 0)
    free, units = set(range(64)), []
    for k in range(8):
        left = sorted(free)
        if k % 2 == 0:
            unit = [max(left, key=lambda b: (phi[b, left].sum(), -b))]
        else:  # the second half of a pair goes on where the first stopped
            unit = [max(left, key=lambda b: (phi[b, units[-1]].sum(), -b))]
        free.discard(unit[0])
        while len(unit) < UNIT:
            b = max(sorted(free), key=lambda b: (phi[b, unit].sum(), -b))
            unit.append(b)
            free.discard(b)
        units.append(unit)
    return units


def _gather(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), dtype=np.int64)
    for k, b in enumerate(bits):
        out |= ((fp >> np.int64(63 - b)) & 1) << k
    return out


def _histograms(nodes: DataFrame, units: list[list[int]]) -> np.ndarray:
    """How many fingerprints have each of the 2^16 values of each pair of units: 4 x 65536 counts, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((4, 65536), dtype=np.int64)
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for i in range(4):
                counts[i] += np.bincount(_gather(fp, units[2 * i] + units[2 * i + 1]), minlength=65536)
        cell = np.flatnonzero(counts.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(counts.ravel()[cell])], names=["cell", "n"])

    got = nodes.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(4 * 65536)
    out[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(4, 65536)


def _at_distance(histogram: np.ndarray) -> np.ndarray:
    """Fraction of ordered pairs whose values differ in d bits, d = 0, 1, ...: an autocorrelation under xor."""
    size = len(histogram)
    f = histogram.astype(np.float64).copy()
    h = 1
    while h < size:
        f = f.reshape(-1, 2, h)
        f = np.stack([f[:, 0] + f[:, 1], f[:, 0] - f[:, 1]], axis=1).reshape(-1)
        h *= 2
    f = f * f
    h = 1
    while h < size:
        f = f.reshape(-1, 2, h)
        f = np.stack([f[:, 0] + f[:, 1], f[:, 0] - f[:, 1]], axis=1).reshape(-1)
        h *= 2
    pairs = np.maximum(f / size, 0)
    total = np.bincount(np.bitwise_count(np.arange(size, dtype=np.uint64)).astype(int), weights=pairs)
    return total / max(1.0, total.sum())


def allot(widths: list[int], cost: list[list[float]], budget: int) -> tuple[float, list[int]]:
    """Thresholds with sum ``budget``, each -1 or more, of least total cost; cost[i][t + 1] is that of part i at t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i in range(len(widths)):
        after: dict[int, tuple[float, list[int]]] = {}
        for spent, (c, ts) in best.items():
            for t in range(-1, len(cost[i]) - 1):
                k = spent + t
                if k not in after or c + cost[i][t + 1] < after[k][0]:
                    after[k] = (c + cost[i][t + 1], [*ts, t])
        best = after
    return best.get(budget, (float("inf"), []))


def choose_parts(n: int, units: list[list[int]], histograms: np.ndarray, tau: int, most_probes: int = 4000) -> list[tuple[list[int], int]]:
    """[(bits, threshold)] of the cheapest plan; every plan finds all links."""
    two = [_at_distance(h) for h in histograms]
    one = []
    for h in histograms:
        square = h.reshape(256, 256)  # the second unit is the higher byte
        one += [_at_distance(square.sum(axis=0)), _at_distance(square.sum(axis=1))]

    def spread(lo: int, hi: int) -> np.ndarray:
        out, k = np.ones(1), lo
        while k < hi:
            step = two[k // 2] if k % 2 == 0 and k + 2 <= hi else one[k]
            out = np.convolve(out, step)
            k += 2 if k % 2 == 0 and k + 2 <= hi else 1
        return out

    best: tuple[float, list] = (float("inf"), [])
    for cuts in range(2**7):
        edges = [0, *(k + 1 for k in range(7) if cuts >> k & 1), 8]
        parts = list(zip(edges[:-1], edges[1:]))
        cost = []
        for lo, hi in parts:
            width, near = UNIT * (hi - lo), np.cumsum(spread(lo, hi))
            row, balls = [0.0], 0
            for t in range(tau + 1):
                if t > width:
                    break
                balls += comb(width, t)
                if balls > most_probes:
                    break
                rows = n * (1 + (balls - 1) / 2)
                blocks = max(1.0, n * near[0] / BLOCK)  # a value with many owners is dealt out
                row.append(ROW_US * rows * blocks + PAIR_US * n * n * float(near[t]) * 0.5)
            cost.append(row)
        total, ts = allot([hi - lo for lo, hi in parts], cost, tau - len(parts) + 1)
        if total < best[0]:
            best = (total, [(sum(units[lo:hi], []), t) for (lo, hi), t in zip(parts, ts) if t >= 0])
    if not best[1]:
        raise ValueError(f"no plan finds all links within {tau} bits with {most_probes} probes of a part")
    return best[1]


# ---------------------------------------------------------------- probing and verifying


def _masks(bits: list[int], t: int) -> np.ndarray:
    """All flips of 1 to t of the bits."""
    single = [1 << (63 - b) for b in bits]
    return np.array([sum(c) for k in range(1, t + 1) for c in combinations(single, k)], dtype=np.uint64)


def _probes(parts: list[tuple[list[int], int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "key", "role", "fp"]
        plan = [(i, np.uint64(sum(1 << (63 - b) for b in bits)), _masks(bits, t)) for i, (bits, t) in enumerate(parts)]
        for batch in batches:
            whole = batch.column(0).to_numpy()
            fp = whole.view(np.uint64)
            for i, mask, flips in plan:
                own = fp & mask
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), i, dtype=np.int32)), pa.array(own.view(np.int64)), pa.array(np.zeros(len(fp), dtype=np.int32)), pa.array(whole)], names=names)
                for lo in range(0, len(flips), 256):
                    keys = own[:, None] ^ flips[None, lo : lo + 256]
                    row, col = np.nonzero(keys < own[:, None])
                    if len(row):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), i, dtype=np.int32)), pa.array(keys[row, col].view(np.int64)), pa.array(np.ones(len(row), dtype=np.int32)), pa.array(whole[row])], names=names)

    return run


def forest(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Indexes of the edges of a minimum spanning forest."""
    order = np.argsort(w, kind="stable")
    nodes, ends = np.unique(np.concatenate([u[order], v[order]]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    live = np.arange(len(u))
    taken = []
    while True:
        la, lb = label[a[live]], label[b[live]]
        live = live[la != lb]
        if not len(live):
            break
        la, lb = label[a[live]], label[b[live]]
        first = np.full(len(nodes), len(u), dtype=np.int64)
        np.minimum.at(first, la, live)
        np.minimum.at(first, lb, live)
        chosen = np.unique(first[first < len(u)])
        taken.append(chosen)
        root = np.arange(len(nodes))
        ca, cb = label[a[chosen]], label[b[chosen]]
        while True:  # components joined by the chosen edges take their smallest label
            ra, rb = root[ca], root[cb]
            low = np.minimum(ra, rb)
            before = root.copy()
            np.minimum.at(root, ra, low)
            np.minimum.at(root, rb, low)
            root = root[root]
            if (root == before).all() and (root[ca] == root[cb]).all():
                break
        label = root[label]
    return order[np.concatenate(taken)] if taken else np.zeros(0, dtype=np.int64)


def _links(tau: int, chunk: int = 1_000_000, most: int = 100_000):
    """Sorted probe rows in, links (a, b, h) out."""

    def search(rows: np.ndarray, old: int) -> Iterator[np.ndarray]:
        """rows: part, key, cell, role, fp; whole runs, but that the first ``old`` rows have met already."""
        new = np.empty(len(rows), dtype=bool)
        new[0] = True
        new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
        start = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
        owner = rows[:, 3] == 0
        owners_so_far = np.cumsum(owner)
        base = owners_so_far[start] - owner[start]
        # owners come first in a run: row r meets the owners of its run that come before it
        meets = owners_so_far - owner - base
        meets[:old] = 0
        fp = np.ascontiguousarray(rows[:, 4]).view(np.uint64)
        cuts = np.append(np.flatnonzero(new), len(rows))
        # runs of many owners and visitors meet as blocks of a matrix
        for k in np.flatnonzero(np.add.reduceat(meets, cuts[:-1]) > chunk // 20):
            lo, hi = int(cuts[k]), int(cuts[k + 1])
            own = np.arange(lo, lo + int(owner[lo:hi].sum()))
            rest = np.arange(max(lo, old), hi)
            mine = fp[own]
            step = max(1, min(256, chunk // len(own)))
            for c in range(0, len(rest), step):
                some = rest[c : c + step]
                r, o = np.nonzero(np.bitwise_count(fp[some][:, None] ^ mine[None, :]) <= tau)
                if len(r):
                    r, o = some[r], own[o]
                    before = o < r
                    yield from found(fp, r[before], o[before])
            meets[lo:hi] = 0
        todo = np.flatnonzero(meets)
        bound = np.cumsum(meets[todo])
        lo = 0
        while lo < len(todo):
            hi = max(lo + 1, int(np.searchsorted(bound, (bound[lo - 1] if lo else 0) + chunk, side="right")))
            m = meets[todo[lo:hi]]
            r = np.repeat(todo[lo:hi], m)
            o = start[r] + (np.arange(len(r)) - np.repeat(np.cumsum(m) - m, m))
            good = np.bitwise_count(fp[r] ^ fp[o]) <= tau
            yield from found(fp, r[good], o[good])
            lo = hi

    def found(fp: np.ndarray, r: np.ndarray, o: np.ndarray) -> Iterator[np.ndarray]:
        """A spanning forest of the links between rows r and o."""
        h = np.bitwise_count(fp[r] ^ fp[o]).astype(np.int64)
        a, b = fp[r].view(np.int64), fp[o].view(np.int64)
        good = a != b
        a, b, h = a[good], b[good], h[good]
        if len(a):
            k = forest(a, b, h)
            yield np.stack([np.minimum(a[k], b[k]), np.maximum(a[k], b[k]), h[k]], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, old = None, 0

        def out(some: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(some[:, k])) for k in range(3)], names=["a", "b", "h"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(batch.num_columns)], axis=1)
            if kept is not None:
                rows = np.concatenate([kept, rows])
            change = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1))
            last = int(change[-1]) + 1 if len(change) else 0
            if last:
                for some in search(rows[:last], old):
                    yield out(some)
                old = 0
            kept = rows[last:]
            if len(kept) > most:  # a run of many visitors: only its owners are needed from here on
                for some in search(kept, old):
                    yield out(some)
                kept = kept[kept[:, 3] == 0]
                old = len(kept)
        if kept is not None:
            for some in search(kept, old):
                yield out(some)

    return run


def dealt(rows: DataFrame, crowded: DataFrame, by: list[str], spread: list[str]) -> DataFrame:
    """``rows`` with ``cell``: the rows of a crowded key meet in cells, every two of them in exactly one.

    crowded: ``by`` and the number of blocks of such a key. A row belongs to one block by its hash; it
    owns the cell of that block (role 0) and visits (role 1) those of the blocks after it.
    """
    if crowded.isEmpty():
        return rows.withColumn("cell", F.lit(0))
    home = F.pmod(F.xxhash64(*spread), F.col("blocks")).cast("int")
    placed = rows.join(crowded, by, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("home", F.when(F.col("role") == 0, home).otherwise(F.lit(0)))
    return placed.withColumn("cell", F.explode(F.sequence("home", F.col("blocks") - 1))).withColumn("role", F.when((F.col("role") == 0) & (F.col("cell") == F.col("home")), 0).otherwise(1)).drop("blocks", "home")


def links(nodes: DataFrame, tau: int = TAU) -> DataFrame:
    """(a, b, h): links that connect whatever fingerprints within ``tau`` bits connect. nodes: distinct fp."""
    ship(nodes.sparkSession)
    n, both = _co_occurrence(nodes)
    units = correlated_units(n, both)
    parts = choose_parts(n, units, _histograms(nodes, units), tau)
    kind = "part int, key long, role int, fp long"
    probes = nodes.select("fp").mapInArrow(_probes(parts), kind)
    crowded = materialize(
        nodes.select("fp").mapInArrow(_probes([(bits, 0) for bits, _ in parts]), kind).groupBy("part", "key").count().where(F.col("count") > BLOCK).select("part", "key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")),
        "crowded",
    )
    order = ["part", "key", "cell", "role"]
    n = partitions(nodes, max(1, 64 // (4 * sum(1 + len(_masks(bits, t)) for bits, t in parts))))  # a fingerprint of 8 bytes gives at most so many rows of 28
    met = dealt(probes, crowded, ["part", "key"], ["fp"]).select(*order, "fp").repartition(n, "part", "key", "cell").sortWithinPartitions(*order)
    return met.mapInArrow(_links(tau), "a long, b long, h long")


def simhash_groups(documents: DataFrame, width: int = 3, tau: int = TAU, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    docs = materialize(fingerprints(documents, width, doc_id=doc_id, text=text), "fingerprints")
    nodes = materialize(docs.groupBy("fp").agg(F.min(F.when(F.col("doc") != NO_ID, F.col("doc"))).alias("first")), "nodes")
    groups = connected_components(links(nodes, tau))
    labelled = nodes.join(groups, nodes["fp"] == groups["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    named = labelled.join(least, "component").select("fp", "component_id")
    return docs.join(named, "fp").select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
