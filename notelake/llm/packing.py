"""Packing documents into sequences: Martello-Toth reduction, then best fit.

Texts are tokenised in the executors; what leaves a task is one row for each piece, with its length.
Lengths are at most the capacity C, so any corpus is one histogram of C counts, and packing is
solved on that histogram in the driver, in time and memory that depend on C alone:

* reduction, while it applies: a set of pieces that dominates every other set holding its largest
  piece is fixed as a sequence of its own (nothing else fits; an exact complement; one companion at
  most, then the largest that fits; two at most, if the largest single one outweighs every pair);
* best fit decreasing for the rest, over runs of equally filled sequences.

Every step of the two uses up a length, or a run of sequences of one filling, so their number depends on C
alone, however many pieces there are. The plan is a list of segments: the pieces of one length with ranks [r, r + n) go to sequences
s, s + 1, ... at one offset. Ranks need no sort: each task numbers its own pieces of each length,
and the counts by task and length give each task its first rank.

Defined results: a null or empty text is one piece that holds the end id alone; repeated rows and
null ids are packed like any other row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.llm.bpe import encoder
from notelake.llm.memory import trimmed
from notelake.session import materialize, ship

CAPACITY = 4096
END_ID = 1


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, at long"


def pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", batch_chars: int = 2_000_000) -> DataFrame:
    """One row for each piece; ``at`` numbers the pieces of one length within the task ``part``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        end = np.asarray([end_id], dtype="<u4").tobytes()
        width = 4 * capacity
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            lo = 0
            while lo < len(ids):
                some, size, hi = [], 0, lo
                while hi < len(ids) and (size < batch_chars or hi == lo):
                    some.append(texts[hi].as_py() or "")
                    size += len(some[-1])
                    hi += 1
                for doc, data in zip(ids[lo:hi], enc.encode(some)):
                    data += end
                    for k, a in enumerate(range(0, len(data), width)):
                        chunk = data[a : a + width]
                        n = len(chunk) // 4
                        for col, v in zip(out, (doc, k, a // 4, n, zlib.crc32(chunk), int(seen[n]))):
                            col.append(v)
                        seen[n] += 1
                lo = hi
            long = pa.int64()
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], long), pa.array(out[1], pa.int32()), pa.array(out[2], long), pa.array(out[3], long), pa.array(out[4], long), pa.array(np.full(len(out[0]), part, dtype=np.int32)), pa.array(out[5], long)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "at"],
            )

    ship(documents.sparkSession)
    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(trimmed(run), PIECES)


class Plan:
    """Segments (length, first rank, count, first sequence, offset) and the number of sequences."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left = capacity, np.zeros(capacity + 1, dtype=np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.rank = np.zeros(capacity + 1, dtype=np.int64)
        self.segments: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        self.fixed = self._reduce()
        self._best_fit()

    def _put(self, length: int, n: int, sequence: int, offset: int) -> None:
        self.segments.append((length, int(self.rank[length]), n, sequence, offset))
        self.rank[length] += n
        self.left[length] -= n

    def _fix(self, lengths: tuple[int, ...], n: int) -> None:
        offset = 0
        for length in lengths:
            self._put(length, n, self.sequences, offset)
            offset += length
        self.sequences += n

    def _largest(self, most: int, without: int) -> int:
        """The largest length up to ``most`` of which a piece is left besides one of ``without``; 0 if none."""
        for length in np.flatnonzero(self.left[: max(0, most) + 1])[::-1].tolist():
            if self.left[length] > (length == without):
                return length
        return 0

    def _smallest(self, without: int, n: int) -> list[int]:
        """The n smallest pieces besides one of ``without``."""
        found: list[int] = []
        for length in np.flatnonzero(self.left).tolist():
            found += [length] * int(min(n - len(found), self.left[length] - (length == without)))
            if len(found) == n:
                break
        return found

    def _reduce(self) -> int:
        """Fix dominating sets; the number of sequences fixed."""
        for j in range(self.capacity, 0, -1):
            while self.left[j]:
                room = self.capacity - j
                partner = self._largest(room, j)
                small = self._smallest(j, 3)
                n = int(self.left[j])
                if not partner:  # nothing goes with it
                    self._fix((j,), n)
                    continue
                times = n // 2 if partner == j else int(min(n, self.left[partner]))
                exact = partner == room
                one = len(small) < 2 or small[0] + small[1] > room
                # with two at most, the largest single one dominates if no pair weighs more
                two = len(small) < 3 or small[0] + small[1] + small[2] > room
                pair = self._pair(room, j) if two and not (exact or one) else None
                if exact or one or (pair is not None and partner >= pair):
                    # the test sees which lengths are left, and of each whether that is one, two, three or more:
                    # while four of both lengths remain it ends the same, so so many sets are fixed at once
                    self._fix((j, partner), times if exact else max(1, times - 4))
                    continue
                break
        return self.sequences

    def _pair(self, room: int, without: int) -> int:
        """The heaviest pair that fits in ``room``."""
        have = np.flatnonzero(self.left[: room + 1] > (np.arange(room + 1) == without)).tolist()
        best, lo, hi = 0, 0, len(have) - 1
        while lo <= hi:
            total = have[lo] + have[hi]
            if total > room:
                hi -= 1
                continue
            if lo != hi or self.left[have[lo]] - (have[lo] == without) >= 2:
                best = max(best, total)
            lo += 1
        return best

    def _best_fit(self) -> None:
        runs: dict[int, list[tuple[int, int]]] = {}  # room -> runs of sequences (first, count)
        open_ = np.zeros(self.capacity + 1, dtype=bool)

        def keep(room: int, first: int, n: int) -> None:
            if room:
                runs.setdefault(room, []).append((first, n))
                open_[room] = True

        for length in range(self.capacity, 0, -1):
            while self.left[length]:
                n = int(self.left[length])
                fits = int(np.argmax(open_[length:])) + length
                if open_[fits]:
                    first, count = runs[fits].pop()
                    open_[fits] = bool(runs[fits])
                    take = min(n, count)
                    self._put(length, take, first, self.capacity - fits)
                    keep(fits - length, first, take)
                    if take < count:
                        keep(fits, first + take, count - take)
                else:
                    each = self.capacity // length
                    count = max(1, n // each)
                    self._put(length, min(n, count), self.sequences, 0)
                    keep(self.capacity - length, self.sequences, min(n, count))
                    self.sequences += min(n, count)


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """rows: PIECES, written already. Adds sequence_id and offset."""
    by = rows.groupBy("length", "part").count()
    counts = {r["length"]: r["n"] for r in by.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most C rows
    plan = Plan(counts, capacity)
    seg = np.array(sorted(plan.segments), dtype=np.int64).reshape(-1, 5)
    # a key that orders by length and rank; counts stay far below 2**50
    key = (seg[:, 0].astype(np.int64) << 50) + seg[:, 1]
    shared = rows.sparkSession.sparkContext.broadcast((key, seg))
    from pyspark.sql import Window

    first = by.select("length", "part", (F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")).alias("first"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seg = shared.value
        for batch in batches:
            length = batch.column(3).to_numpy()
            rank = batch.column(5).to_numpy()
            k = np.searchsorted(key, (length << 50) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(seg[k, 3] + rank - seg[k, 1]), pa.array(seg[k, 4])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            )

    ranked = rows.join(first, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("at")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(documents: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row."""
    cut = materialize(pieces(documents, tokenizer or default_tokenizer(), capacity, end_id, doc_id, text), "pieces")
    return pack(cut, capacity)
