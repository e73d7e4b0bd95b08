"""Near duplicates by the Jaccard similarity of word shingles: SimHash first, an exact way for the rest.

Texts of equal words are one class (by a 128-bit hash). Classes whose SimHash fingerprints link (the
generalised pigeonhole of ``simhash_dedup``) are verified on their shingle sets and make the first
groups, so that a large family of copies is one group before any of its pairs is looked at.

What fingerprints miss is found by prefix filtering, which loses nothing. Shingles have one order over
the whole corpus, frequent ones last; sets of similarity t share one of their first n - ceil(t n) + 1.
Shingles that only one class or one group holds are dropped by an aggregate. The classes of each other
shingle meet in a task, where two necessary conditions hold candidates back: the ratio of the sizes, and
the distance of parity bitmaps, which never exceeds the symmetric difference of the sets. A class has a
bitmap of about two bits for each of its shingles, and one of 512 bits folded from it.

* Up to ``SMALL`` classes of one shingle meet on the folded bitmaps. Their candidate pairs are compared on the
  whole bitmaps, and what is left, little more than the links, is verified on the sets.
* More classes of one shingle meet on the whole bitmaps and hand on spanning forests of their candidates.
  They are verified; where its components then hold more than one group, their members meet in blocks
  and are compared on their sets, and each two blocks hand on a forest of verified links. A shingle of more
  classes than a block is dealt out over cells, and the rows of a frequent one are salted before that.

So no link is lost, and no group is gathered in a task or paired up as a whole. The order is learnt
from counts in windows of shingles; which shingles count as frequent changes work, never results.

Defined results: a null text is an empty one, and all texts without a word are one class; fewer words
than a shingle are one shingle; a null id counts as smaller than any other; of each group the row with
the smallest id stays (of equal ids that with the smallest hash of its text), rows repeated with one id
and text once; an empty table gives no rows; all columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.llm.memory import trimmed
from notelake.llm.sieve import sieve, sifted
from notelake.llm.simhash_dedup import BLOCK, NO_ID, TAU, _ones, dealt, forest, keyed, links
from notelake.operators.components import connected_components
from notelake.session import materialize, partitions, ship

#: Shingles that are counted at a time, and how often one must occur among them to count as frequent.
WINDOW, FREQUENT = 4_000_000, 3
#: Frequent shingles that are known everywhere, the most frequent first: a table of 2 MB.
KNOWN = 2**17
#: Occurrences of a shingle that go to one task unsalted.
SALTED = 10_000
#: Classes of one shingle that hand on all their candidate pairs.
SMALL = 64
#: Members of a component of candidates that meet in one task, of either side.
MEETING = (128, 512)
#: Bits of a folded parity bitmap, in longs.
LONGS = 8
MAPS = [f"m{k}" for k in range(LONGS)]


# ---------------------------------------------------------------- sets


def _spread(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of a 64-bit number."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(words: list[bytes], width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; hashes of words are combined by their places."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = max(1, len(words) - width + 1)
    total = np.zeros(n, dtype=np.uint64)
    for k, factor in enumerate(_spread(np.arange(1, min(width, len(words)) + 1, dtype=np.uint64)) | np.uint64(1)):
        total += each[k : k + n] * factor
    return np.unique(_spread(total))


def folded(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def set_fingerprint(hashes: np.ndarray, step: int = 50_000) -> np.ndarray:
    """8 bytes: a bit is set if it is in over half the hashes."""
    if not len(hashes):
        return np.zeros(8, dtype=np.uint8)
    total = sum(_ones(np.unpackbits(hashes[lo : lo + step].view(np.uint8).reshape(-1, 8), axis=1)) for lo in range(0, len(hashes), step))
    return np.packbits(2 * total > len(hashes))


def parity(hashes: np.ndarray) -> np.ndarray:
    """How many hashes fall on each bit, modulo two; a power of two of bits, two or more for each hash."""
    bits = max(64 * LONGS, 1 << (2 * len(hashes)).bit_length())
    count = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(count.astype(np.uint8)).view(np.uint64)


def narrowed(maps: np.ndarray, longs: int) -> np.ndarray:
    """Bitmaps (rows of longs) of fewer bits: those of the same sets."""
    while maps.shape[-1] > longs:
        half = maps.shape[-1] // 2
        maps = maps[..., :half] ^ maps[..., half:]
    return maps


class Similarity:
    """The bound num / den and what follows from it, in whole numbers."""

    def __init__(self, least: float):
        ratio = Fraction(least).limit_denominator(10_000)
        self.num, self.den = ratio.numerator, ratio.denominator

    def prefix(self, n: int) -> int:
        return n + (-self.num * n // self.den) + 1 if n else 0

    def sizes(self, x, y):
        return self.den * np.minimum(x, y) >= self.num * np.maximum(x, y)

    def distance(self, x, y, d):
        """Whether sets of sizes x and y may be so similar if at least d elements are in one alone."""
        return (self.den + self.num) * d <= (self.den - self.num) * (x + y)

    def holds(self, both, x, y):
        return self.den * both >= self.num * (x + y - both)


# ---------------------------------------------------------------- one row a text, and the frequent shingles

PRINTS = ["kind", "doc", "tkey", "s1", "s2", "fp", "size", *MAPS, "whole"]
TEXT, SHINGLE = 0, 1


def _prints(width: int):
    """Rows of PRINTS: one of kind TEXT for each text; of kind SHINGLE the frequent ones of a window, s1 with size occurrences."""

    def frequent(pending: list[np.ndarray]) -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(pending), return_counts=True)
        found, n = found[n >= FREQUENT], n[n >= FREQUENT]
        cols = {"kind": np.full(len(found), SHINGLE), "s1": found.view(np.int64), "size": n}
        return pa.RecordBatch.from_arrays([*(pa.array(cols.get(c, np.zeros(len(found))).astype(np.int64)) for c in PRINTS[:-1]), pa.nulls(len(found), pa.binary())], names=PRINTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, held = [], 0
        for batch in batches:
            raw, size, whole = [], [], []
            for t in batch.column(1):
                words = folded(t.as_py())
                hashes = shingle_set(words, width)
                maps = parity(hashes)
                raw += [xxhash.xxh3_128_digest(b" ".join(words)), set_fingerprint(hashes).tobytes(), narrowed(maps, LONGS).tobytes()]
                whole.append(maps.tobytes())
                size.append(len(hashes))
                pending.append(hashes)
                held += len(hashes)
                if held >= WINDOW:
                    yield frequent(pending)
                    pending, held = [], 0
            cols = np.frombuffer(b"".join(raw), dtype="<i8").reshape(-1, 3 + LONGS)
            zero = pa.array(np.full(len(size), TEXT, dtype=np.int64))
            yield pa.RecordBatch.from_arrays(
                [zero, batch.column(0), batch.column(2), *(pa.array(np.ascontiguousarray(cols[:, k])) for k in range(3)), pa.array(size, pa.int64()), *(pa.array(np.ascontiguousarray(cols[:, 3 + k])) for k in range(LONGS)), pa.array(whole, pa.binary())], names=PRINTS
            )
        if pending:
            yield frequent(pending)

    return run


def _prefixes(width: int, bound: Similarity, shared):
    """Rows key, salt, s1: the first shingles of every text in the common order; copies met by one task once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = shared.value
        seen: set[int] = set()
        for batch in batches:
            keys, salts, owners, lengths = [], [], [], []
            for t in batch.column(1):
                words = folded(t.as_py())
                s1 = int.from_bytes(xxhash.xxh3_128_digest(b" ".join(words))[:8], "little", signed=True)
                if s1 in seen:
                    continue
                seen = seen if len(seen) < 500_000 else set()
                seen.add(s1)
                hashes = shingle_set(words, width)
                p = bound.prefix(len(hashes))
                often = np.zeros(len(hashes), dtype=np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                    often = np.where(known[at] == hashes, counts[at], 0)
                    first = np.lexsort((hashes, often))[:p]
                    hashes, often = hashes[first], often[first]
                keys.append(hashes[:p])
                salts.append(np.where(often[:p] >= SALTED, 1 + np.uint64(s1 % 2**64) % np.maximum(1, often[:p] // SALTED).astype(np.uint64), 0).astype(np.int64))
                owners.append(s1)
                lengths.append(p)
            if owners:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(salts)), pa.array(np.repeat(np.array(owners, dtype=np.int64), lengths))], names=["key", "salt", "s1"])

    return run


def _held_by_several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows key, salt, s1 in that order in; out go, once each, those whose key (and salt) several s1 hold, and all salted ones."""
    last = None  # the row before, not handed on yet, and whether its key has had another
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([c.to_numpy() for c in batch.columns], axis=1)
        if last is not None:
            rows = np.concatenate([last[0], rows])
        fresh = np.append(True, (rows[1:] != rows[:-1]).any(axis=1))
        carried = last is not None and last[1]
        rows = rows[fresh]
        same = (rows[1:, :2] == rows[:-1, :2]).all(axis=1)
        several = np.append(carried, same) | np.append(same, False) | (rows[:, 1] > 0)
        out = rows[:-1][several[:-1]]
        last = (rows[-1:], bool(several[-1]))
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(out[:, 0])), pa.array(np.ascontiguousarray(out[:, 2]))], names=["key", "s1"])
    if last is not None and last[1]:
        yield pa.RecordBatch.from_arrays([pa.array(last[0][:, 0]), pa.array(last[0][:, 2])], names=["key", "s1"])


# ---------------------------------------------------------------- candidates of one shingle

FOLDED = ["key", "node", "grp", "size", *MAPS]
MET = ["key", "cell", "role", "node", "grp", "size", "whole"]


def _runs(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows in batches that end where a run of equal first ``by`` columns does."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(k).to_numpy() for k in range(by)], axis=1)
        head = np.array([kept[-1].column(k)[-1].as_py() for k in range(by)]) if kept else rows[0]
        change = np.flatnonzero(np.append((rows[0] != head).any(), (rows[1:] != rows[:-1]).any(axis=1)))
        if len(change):
            last = int(change[-1])
            yield pa.concat_batches([*kept, batch.slice(0, last)])
            kept = [batch.slice(last)]
        else:
            kept.append(batch)
    if kept:
        yield pa.concat_batches(kept)


def _starts(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal rows begin, and their lengths."""
    first = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]).any(axis=1)))
    return first, np.diff(np.append(first, len(rows)))


def _pairs(bound: Similarity, area: int = 1 << 18):
    """Rows of FOLDED by key in, all candidate pairs (a, b) out."""

    def of(rows: np.ndarray, first: np.ndarray, n: int) -> Iterator[np.ndarray]:
        """Runs of n rows that begin at ``first``."""
        p, q = np.triu_indices(n, 1)
        step = max(1, area // len(p))
        for lo in range(0, len(first), step):
            at = first[lo : lo + step, None]
            i, j = (at + p).ravel(), (at + q).ravel()
            good = (rows[i, 2] != rows[j, 2]) & bound.sizes(rows[i, 3], rows[j, 3])
            i, j = i[good], j[good]
            d = np.bitwise_count((rows[i, 4:] ^ rows[j, 4:]).view(np.uint64)).sum(axis=1, dtype=np.int64)
            near = bound.distance(rows[i, 3], rows[j, 3], d)
            yield np.sort(np.stack([rows[i[near], 1], rows[j[near], 1]], axis=1), axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs(batches, 1):
            rows = np.stack([c.to_numpy() for c in batch.columns], axis=1)
            first, size = _starts(rows[:, :1])
            found = [x for n in np.unique(size[size > 1]).tolist() for x in of(rows, first[size == n], n)]
            if found:
                some = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(some[:, k])) for k in (0, 1)], names=["a", "b"])

    return run


def _families(bound: Similarity, area: int = 1 << 21):
    """Rows of MET by key, cell and role in, spanning forests (a, b) of the candidates of each run out.

    A run's owners (role 0, about a block at most) are held; its visitors pass by, ``BLOCK`` at a time, and each piece hands on
    a forest of its own, so a task holds two blocks however long a run is.
    """

    def met(facts: np.ndarray, maps: list[np.ndarray], others: np.ndarray, visiting: list[np.ndarray], same: bool) -> np.ndarray:
        """facts: node, grp, size. A forest of the candidates between two sides, or within one (``same``)."""
        a = b = d = np.zeros(0, dtype=np.int64)
        width, wide = np.array([len(m) for m in maps]), np.array([len(m) for m in visiting])
        for longs in np.unique(width).tolist():
            mine = np.flatnonzero(width == longs)
            own = np.stack([maps[k] for k in mine])
            for other in np.unique(wide).tolist():
                if same and other < longs:
                    continue  # met as the other side
                rest, least = np.flatnonzero(wide == other), min(longs, other)
                left, right = narrowed(own, least), narrowed(np.stack([visiting[k] for k in rest]), least)
                step = max(1, area // (len(rest) * least))
                for lo in range(0, len(mine), step):
                    i, j = mine[lo : lo + step, None], rest[None, :]
                    fits = (facts[i, 1] != others[j, 1]) & bound.sizes(facts[i, 2], others[j, 2])
                    if same and other == longs:
                        fits &= i < j
                    if not fits.any():
                        continue
                    h = np.bitwise_count(left[lo : lo + step, None, :] ^ right[None, :, :]).sum(axis=2, dtype=np.int64)
                    r, o = np.nonzero(fits & bound.distance(facts[i, 2], others[j, 2], h))
                    a, b, d = np.concatenate([a, facts[mine[lo + r], 0]]), np.concatenate([b, others[rest[o], 0]]), np.concatenate([d, h[r, o]])
                    k = forest(a, b, d)
                    a, b, d = a[k], b[k], d[k]
        return np.sort(np.stack([a, b], axis=1), axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, facts, maps, among = None, np.zeros((0, 3), dtype=np.int64), [], True

        def told(some: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(some[:, k])) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(k).to_numpy() for k in range(6)], axis=1)
            for lo, n in zip(*_starts(rows[:, :3])):
                here = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in batch.column(6).slice(lo, n)]
                if current != tuple(rows[lo, :2]):
                    if not among:
                        yield from told(met(facts, maps, facts, maps, True))
                    current, facts, maps, among = tuple(rows[lo, :2]), np.zeros((0, 3), dtype=np.int64), [], True
                if rows[lo, 2] == 0:
                    facts, maps, among = np.concatenate([facts, rows[lo : lo + n, 3:]]), maps + here, False
                    continue
                if not among:
                    yield from told(met(facts, maps, facts, maps, True))
                    among = True
                for at in range(0, n, BLOCK):
                    yield from told(met(facts, maps, rows[lo + at : lo + min(n, at + BLOCK), 3:], here[at : at + BLOCK], False))
        if not among:
            yield from told(met(facts, maps, facts, maps, True))

    return run


# ---------------------------------------------------------------- verification


def overlaps(own: list[np.ndarray], met: list[np.ndarray], step: int = 4096) -> np.ndarray:
    """How many elements each set of ``own`` has in common with each of ``met``: products of slices of their bitmaps."""
    known = np.unique(np.concatenate(own))

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.searchsorted(known, flat)
        good = known[np.minimum(at, len(known) - 1)] == flat
        order = np.argsort(at[good], kind="stable")
        return at[good][order], row[good][order]

    out = np.zeros((len(own), len(met)), dtype=np.int64)
    if not len(known):
        return out
    sides = [(*places(own), len(own)), (*places(met), len(met))]
    for lo in range(0, len(known), step):
        width, maps = min(step, len(known) - lo), []
        for at, row, n in sides:
            p, q = np.searchsorted(at, [lo, lo + width])
            bits = np.zeros((n, width), dtype=np.float32)
            bits[row[p:q], at[p:q] - lo] = 1
            maps.append(bits)
        out += (maps[0] @ maps[1].T).astype(np.int64)
    return out


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [shingle_set(folded(t.as_py()), width).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["node", "words"])

    return run


def _alike(pairs: DataFrame, classes: DataFrame, bound: Similarity) -> DataFrame:
    """Those of the pairs (a, b) that their whole bitmaps leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(k).to_numpy() for k in (2, 3))
            d = np.zeros(batch.num_rows, dtype=np.int64)
            for k, (p, q) in enumerate(zip(batch.column(4), batch.column(5))):
                p, q = np.frombuffer(p.as_py(), dtype=np.uint64), np.frombuffer(q.as_py(), dtype=np.uint64)
                longs = min(len(p), len(q))
                d[k] = np.bitwise_count(narrowed(p, longs) ^ narrowed(q, longs)).sum(dtype=np.int64)
            keep = pa.array(bound.distance(x, y, d))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1)], names=["a", "b"])

    side = lambda end, size, maps: classes.select(F.col("node").alias(end), F.col("size").alias(size), F.col("whole").alias(maps))
    return pairs.join(side("a", "x", "p"), "a").join(side("b", "y", "q"), "b").select("a", "b", "x", "y", "p", "q").mapInArrow(trimmed(run), "a long, b long")


def _verified(pairs: DataFrame, words: DataFrame, bound: Similarity) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_py(), dtype=np.uint64), np.frombuffer(y.as_py(), dtype=np.uint64)
                keep.append(bool(bound.sizes(len(p), len(q)) and bound.holds(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q))))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 1)], names=["a", "b"])

    both = pairs.join(words.select(F.col("node").alias("a"), F.col("words").alias("p")), "a").join(words.select(F.col("node").alias("b"), F.col("words").alias("q")), "b")
    return both.select("a", "b", "p", "q").mapInArrow(trimmed(run), "a long, b long")


def _words_of(documents: DataFrame, classes: DataFrame, ends: DataFrame, width: int, doc_id: str, text: str) -> DataFrame:
    """node, words: the sets of the classes that ``ends`` names. Only their texts, and few others, are moved."""
    wanted = materialize(classes.join(ends, "node", "left_semi").select("node", "doc", "tkey"), "wanted")
    texts = sifted(keyed(documents, doc_id, text), sieve(wanted, "tkey"), "tkey").where("maybe").drop("maybe")
    gathered = texts.join(wanted, ["doc", "tkey"]).select("node", "text")
    return materialize(gathered.mapInArrow(trimmed(_sets(width)), "node long, words binary").dropDuplicates(["node"]), "sets")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


def _grouped(classes: DataFrame, near: DataFrame) -> DataFrame:
    """node, grp of every class."""
    groups = connected_components(near)
    return classes.select("node").join(groups, "node", "left").select("node", F.coalesce("component", "node").alias("grp"))


def near_links(documents: DataFrame, width: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(prints, classes, links): doc, tkey, s1, s2 of every text; classes of equal words (node, s1, s2, doc, tkey: their smallest row); links (a, b) of their nodes.

    The links connect exactly what pairs of classes of at least ``similarity`` connect.
    """
    spark, bound = documents.sparkSession, Similarity(similarity)
    ship(spark)
    rows = keyed(documents, doc_id, text).select("doc", "text", "tkey")
    every = materialize(rows.mapInArrow(trimmed(_prints(width)), ", ".join(f"{c} long" for c in PRINTS[:-1]) + ", whole binary"), "prints")
    prints = every.where(f"kind = {TEXT}")
    facts = ["fp", "size", *MAPS, "whole"]
    classes = materialize(
        prints.groupBy("s1", "s2").agg(F.min(F.struct("doc", "tkey")).alias("r"), *(F.first(c).alias(c) for c in facts)).select(F.monotonically_increasing_id().alias("node"), "s1", "s2", "r.doc", "r.tkey", *facts), "classes"
    )

    # what fingerprints nominate: the classes of one fingerprint and its first class, and the first classes of linked fingerprints
    first = classes.groupBy("fp").agg(F.min("node").alias("first"))
    linked = links(classes.select("fp").distinct(), TAU).select("a", "b").distinct()
    firsts = linked.join(first.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b").select("x", "y")
    alike = classes.join(first, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    nominated = materialize(alike.union(firsts), "nominated")
    words = _words_of(documents, classes, _ends(nominated), width, doc_id, text)
    near = materialize(_verified(nominated, words, bound), "near")
    groups = materialize(_grouped(classes, near), "groups")

    # the exact way for the rest
    top = every.where(f"kind = {SHINGLE}").groupBy("s1").agg(F.sum("size").alias("n")).orderBy(F.col("n").desc(), "s1").limit(KNOWN).toArrow()  # at most KNOWN rows
    known = top.column("s1").to_numpy().view(np.uint64)
    order = np.argsort(known)
    shared = spark.sparkContext.broadcast((known[order], top.column("n").to_numpy()[order]))
    n = partitions(documents, 16)
    held = rows.mapInArrow(trimmed(_prefixes(width, bound, shared)), "key long, salt long, s1 long").repartition(n, "key", "salt").sortWithinPartitions("key", "salt", "s1").mapInArrow(_held_by_several, "key long, s1 long")
    postings = materialize(held.join(classes.select("s1", "node").join(groups, "node"), "s1").select("key", "node", "grp"), "postings")
    mixed = materialize(postings.groupBy("key").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("key", "n"), "mixed")
    n = partitions(postings, 8)
    few = postings.join(mixed.where(F.col("n") <= SMALL).select("key"), "key", "left_semi").join(classes.select("node", "size", *MAPS), "node").select(*FOLDED)
    pairs = materialize(few.repartition(n, "key").sortWithinPartitions("key").mapInArrow(trimmed(_pairs(bound)), "a long, b long").distinct(), "pairs")
    pairs = _alike(pairs, classes, bound)
    many = postings.join(mixed.where(F.col("n") > SMALL).select("key"), "key", "left_semi").join(classes.select("node", "size", "whole"), "node").withColumn("role", F.lit(0))
    crowded = mixed.where(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    met = dealt(many, crowded, ["key"], ["node"]).select(*MET).repartition(n, "key", "cell").sortWithinPartitions("key", "cell", "role")
    families = materialize(met.mapInArrow(trimmed(_families(bound)), "a long, b long").distinct(), "families")
    found = materialize(pairs.union(families).distinct(), "candidates")
    more = classes.select("node").join(_ends(found), "node", "left_semi").join(words.select("node"), "node", "left_anti")
    sets = words.unionByName(_words_of(documents, classes, more, width, doc_id, text))
    near = materialize(near.union(_verified(found, sets, bound)), "near")
    near = near.union(_across(families, near, sets, classes, bound))
    return prints.select("doc", "tkey", "s1", "s2"), classes.select("node", "s1", "s2", "doc", "tkey"), near


def _across(candidates: DataFrame, near: DataFrame, words: DataFrame, classes: DataFrame, bound: Similarity) -> DataFrame:
    """Links (a, b) between groups of ``near`` that their components of ``candidates`` hold together.

    A forest of candidates keeps their components, not every pair, and its links may fail where others hold. So in
    every component with more than one group, all members outside its largest group (side 0) meet all members
    (side 1) of like size; both sides are dealt out in blocks, and of the links of two blocks a forest goes on.
    """
    groups = connected_components(near).select("node", F.col("component").alias("group"))
    members = connected_components(candidates).join(groups, "node", "left").select("node", "component", F.coalesce("group", "node").alias("group"))
    counted = members.groupBy("component", "group").agg(F.count("*").alias("n")).groupBy("component").agg(F.sum("n").alias("all"), F.max(F.struct("n", "group")).alias("main"), F.count("*").alias("groups"))
    mixed = counted.where("groups > 1 and all > 2").select("component", F.col("main.group").alias("main"))  # the one pair of two has been verified
    sized = members.join(mixed, "component").join(classes.select("node", "size"), "node")
    tier = F.when(F.col("size") > 0, F.floor(F.log("size") / float(np.log(1.01 * bound.den / bound.num)))).otherwise(-2).cast("int")  # sizes of linked sets are in one tier or in neighbours
    one = materialize(sized.select("node", "component", "group", tier.alias("tier"), (F.col("group") != F.col("main")).alias("other")), "members")
    sides = one.withColumn("side", F.lit(1)).withColumn("at", F.col("tier")).unionByName(one.where("other").withColumn("side", F.lit(0)).withColumn("at", F.explode(F.array(*(F.col("tier") + k for k in (-1, 0, 1))))))
    blocks = sides.groupBy("component", "at").agg(*(F.ceil(F.count(F.when(F.col("side") == k, 1)) / MEETING[k]).cast("int").alias(f"blocks{k}") for k in (0, 1))).where("blocks0 > 0 and blocks1 > 0")
    placed = sides.join(blocks, ["component", "at"])
    home, others = F.when(F.col("side") == 0, F.pmod(F.xxhash64("node"), F.col("blocks0"))).otherwise(F.pmod(F.xxhash64("node"), F.col("blocks1"))).cast("int"), F.when(F.col("side") == 0, F.col("blocks1")).otherwise(F.col("blocks0"))
    cells = placed.withColumn("home", home).withColumn("cell", F.explode(F.sequence(F.lit(0), others - 1))).select(
        "component", "at", F.when(F.col("side") == 0, F.col("home")).otherwise(F.col("cell")).alias("i"), F.when(F.col("side") == 0, F.col("cell")).otherwise(F.col("home")).alias("j"), "side", "group", "node"
    )
    rows = cells.join(words, "node")

    def meet(table: pa.Table) -> pa.Table:
        side, group, node = (table.column(c).to_numpy() for c in ("side", "group", "node"))
        sets = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in table.column("words")]
        own, met = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        out = np.zeros((0, 2), dtype=np.int64)
        if len(own) and len(met):
            size = np.array([len(x) for x in sets], dtype=np.int64)
            both = overlaps([sets[k] for k in own], [sets[k] for k in met])
            r, o = np.nonzero(bound.holds(both, size[own][:, None], size[met][None, :]) & (group[own][:, None] != group[met][None, :]))
            if len(r):
                a, b = own[r], met[o]
                k = forest(group[a], group[b], np.zeros(len(a), dtype=np.int64))
                out = np.stack([node[a[k]], node[b[k]]], axis=1)
        return pa.table({"a": np.ascontiguousarray(out[:, 0]), "b": np.ascontiguousarray(out[:, 1])})

    return rows.groupBy("component", "at", "i", "j").applyInArrow(meet, "a long, b long")


def one_of_each(documents: DataFrame, width: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``documents``, of each group of near duplicates only the one with the smallest id.

    A row that is alone in its group, as most are, is passed on where it is read; the others (and those that a
    filter of fixed size takes for one of them) are joined with the rows that stay.
    """
    prints, classes, near = near_links(documents, width, similarity, doc_id, text)
    grouped = classes.join(_grouped(classes, near), "node")
    kept = materialize(grouped.groupBy("grp").agg(F.min(F.struct("doc", "tkey")).alias("r"), F.count("*").alias("n")).select("r.doc", "r.tkey"), "kept")
    repeated = prints.groupBy("doc", "tkey").agg(F.count("*").alias("n"))
    crowd = repeated.join(kept.withColumn("stays", F.lit(True)), ["doc", "tkey"], "left").where("n > 1 or stays is null").select("tkey")
    bits = materialize(sieve(crowd, "tkey"), "crowd")

    inner = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns if c != text)).alias("row"), F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc"), F.col(text).alias(text))
    rows = sifted(inner.withColumn("tkey", F.xxhash64(F.coalesce(F.col(text), F.lit("")))), bits, "tkey")
    chosen = rows.where("maybe").join(kept, ["doc", "tkey"]).dropDuplicates(["doc", "tkey"])
    out = rows.where("not maybe").select("row", text).unionByName(chosen.select("row", text))
    return out.select(*((F.col(text) if c == text else F.col(f"row.`{c}`")).alias(c) for c in documents.columns))
