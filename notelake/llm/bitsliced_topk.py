"""Exact top-k by inner product over a bit-sliced index.

Components are quantised to integers. The index keeps, for blocks of rows, one bitmap for each bit of
each component (two's complement, so the top bit weighs negatively). A query's scores over a block are
a sum of bitmaps with weights: a set bit j of |q_d| adds the slices of component d, shifted by j; a
negative term adds the complement and a constant. Full adders reduce the bitmaps of each weight to one,
and what is left are the slices of all scores at once. The top rows are then selected from the most
significant slice downward, and ties at the boundary are resolved exactly, by the smaller id (rows of a
block are in order of their ids).

Rows are dealt to blocks by a hash of their place; the bitmaps of each block are built once and written as an index.
Queries are dealt to groups; every block meets every group in one task of bounded size, and each task
returns k rows for each query, of which a window keeps the best k.

Defined results: vectors that are null, empty or hold a null or a component that is not finite take no
part, and neither do null ids; the k best are among all rows with another id and as many components; a
row repeated counts as often as it stands there, as a candidate and as a query; fewer than k candidates
are all returned; components and scores are exact, and one beyond a long is an error; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notelake.session import materialize, ship

SCALE = 64
K = 20
ROWS_IN_BLOCK = 65_536
#: Queries that meet a block in one task: fewer of them where that leaves no task idle.
QUERIES_IN_GROUP = (128, 4096)
LONG = 2**63 - 1


def quantised(vectors: DataFrame, scale: int = SCALE, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """id, v array<long>: floor(scale * x); a component beyond a long is an error."""
    as_double = F.col(embedding).cast("array<double>")
    sound = F.forall(as_double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), as_double.alias("x"), sound.alias("sound"))
    whole = lambda x: F.when(F.abs(x * scale) < float(2**63), F.floor(x * scale)).otherwise(F.raise_error(F.lit("a component is beyond a long")).cast("long"))
    return rows.where(F.col("id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & F.col("sound")).select("id", F.transform("x", whole).alias("v"))


class Block:
    """Bitmaps of the components of some rows, which are in order of their ids."""

    def __init__(self, ids: np.ndarray, slices: np.ndarray, width: int):
        """slices: width rows of words for each component."""
        self.ids, self.n, self.width = ids, len(ids), width
        self.words = slices.shape[1]
        self.dimensions = len(slices) // width
        self.valid = _packed(np.ones((1, self.n), dtype=bool))[0]
        self.bitmaps = np.concatenate([slices, ~slices])

    @staticmethod
    def of(ids: np.ndarray, values: np.ndarray) -> Block:
        return Block(ids, *sliced(values))

    def scores(self, query: np.ndarray) -> tuple[np.ndarray, int]:
        """Slices of score - constant, least significant first, and the constant."""
        by_weight: list[list[int]] = []
        constant, complement = 0, self.dimensions * self.width
        for d in np.flatnonzero(query).tolist():
            q = int(query[d])
            j, rest = 0, abs(q)
            while rest:
                # signed digits: runs of ones cost two terms
                digit = 0 if not rest & 1 else (2 - (rest & 3))
                if digit:
                    rest -= digit
                    positive = (digit > 0) == (q > 0)
                    while len(by_weight) < self.width + j:
                        by_weight.append([])
                    for b in range(self.width):
                        plus = positive != (b == self.width - 1)  # the top bit weighs negatively
                        by_weight[b + j].append(d * self.width + b + (0 if plus else complement))
                        if not plus:  # -s = ~s - 1
                            constant -= 1 << (b + j)
                rest >>= 1
                j += 1
        slices: list[np.ndarray] = []
        carried: list[np.ndarray] = []
        w = 0
        while w < len(by_weight) or carried:
            # all bitmaps of a weight in one array: full adders take a third of its rows each
            own = self.bitmaps[by_weight[w]] if w < len(by_weight) else self.bitmaps[:0]
            stack, carried = np.concatenate([own, *carried]) if carried else own, []
            while len(stack) > 2:
                n = len(stack) // 3
                a, b, c, rest = stack[:n], stack[n : 2 * n], stack[2 * n : 3 * n], stack[3 * n :]
                t = a ^ b
                carry = a & b
                total = t ^ c
                t &= c
                carry |= t
                carried.append(carry)
                stack = np.concatenate([total, rest]) if len(rest) else total
            if len(stack) == 2:
                carried.append(stack[:1] & stack[1:])
                stack = stack[:1] ^ stack[1:]
            slices.append(stack[0] if len(stack) else np.zeros(self.words, dtype=np.uint64))
            w += 1
        return np.array(slices, dtype=np.uint64).reshape(-1, self.words), constant

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, list[int]]:
        """Ids and scores of the k best rows besides ``own``."""
        slices, constant = self.scores(query)
        ties = self.valid.copy()
        for p in range(*np.searchsorted(self.ids, [own, own + 1]).tolist() if own < LONG else (int(np.searchsorted(self.ids, own)), self.n)):
            ties[p >> 6] &= ~(np.uint64(1) << np.uint64(p & 63))
        sure = np.zeros(self.words, dtype=np.uint64)
        k = min(k, int(np.bitwise_count(ties).sum()))
        have = 0
        for s in slices[::-1]:
            high = ties & s
            n = have + int(np.bitwise_count(high).sum())
            if n > k:
                ties = high
            else:
                if n > have:
                    sure |= high
                    have = n
                ties &= ~s
                if n == k:
                    break
        rows = self._rows(sure)
        if have < k:
            rows = np.concatenate([rows, self._rows(ties)[: k - have]])
        word, bit = rows >> 6, (rows & 63).astype(np.uint64)
        totals = [constant] * len(rows)
        for w, s in enumerate(slices):
            for i in np.flatnonzero(s[word] >> bit & np.uint64(1)).tolist():
                totals[i] += 1 << w
        return self.ids[rows], totals

    @staticmethod
    def _rows(bitmap: np.ndarray) -> np.ndarray:
        words = np.flatnonzero(bitmap)
        if not len(words):
            return np.zeros(0, dtype=np.int64)
        bits = np.unpackbits(bitmap[words].view(np.uint8).reshape(len(words), 8), axis=1, bitorder="little")
        row, col = np.nonzero(bits)
        return words[row] * 64 + col


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of 0/1 as rows of words, least significant bit first."""
    packed = np.packbits(bits, axis=1, bitorder="little")
    out = np.zeros((len(bits), -(-bits.shape[1] // 64) * 8), dtype=np.uint8)
    out[:, : packed.shape[1]] = packed
    return out.view(np.uint64)


def sliced(values: np.ndarray) -> tuple[np.ndarray, int]:
    """The slices of all components (two's complement), and how many bits a component has."""
    width = max(int(values.max()).bit_length(), (-(int(values.min()) + 1)).bit_length()) + 1
    by_bit = [_packed((values.T >> b & 1).astype(bool)) for b in range(width)]
    return np.stack(by_bit, axis=1).reshape(-1, by_bit[0].shape[1]), width


INDEX = "block int, size int, width int, ids binary, slices binary"


def index(rows: DataFrame, rows_in_block: int = ROWS_IN_BLOCK) -> DataFrame:
    """The bitmaps of all rows (id, v), written: a row for each block and number of components (``size``)."""
    ship(rows.sparkSession)

    def build(table: pd.DataFrame) -> pd.DataFrame:
        values = np.stack(table["v"].to_list())
        order = np.lexsort((*values.T[::-1], table["id"].to_numpy()))
        slices, width = sliced(values[order])
        return pd.DataFrame({"block": table["block"].iloc[:1], "size": table["size"].iloc[:1], "width": [width], "ids": [table["id"].to_numpy()[order].tobytes()], "slices": [slices.tobytes()]})

    blocks = max(1, -(-rows.count() // rows_in_block))
    # by place, not by value, so that rows repeated many times go to all blocks
    dealt = rows.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("block"), F.size("v").alias("size"), "id", "v")
    return materialize(dealt.groupBy("block", "size").applyInPandas(build, INDEX), "bit-slices")


def _meet(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for width, ids, slices in zip(left["width"], left["ids"], left["slices"]):
            known = np.frombuffer(ids, dtype=np.int64)
            block = Block(known, np.frombuffer(slices, dtype=np.uint64).reshape(-1, -(-len(known) // 64)), int(width))
            for q, own, v in zip(right["q"].tolist(), right["id"].tolist(), right["v"]):
                found, totals = block.top(np.asarray(v), own, k)
                if totals and not -LONG - 1 <= min(totals) <= max(totals) <= LONG:
                    raise OverflowError(f"a score of {own} is beyond a long")
                out += [(q, int(i), t) for i, t in zip(found, totals)]
        return pd.DataFrame(out, columns=["q", "vec_id", "score"])

    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int = K, rows_in_block: int = ROWS_IN_BLOCK, queries_in_group: tuple[int, int] = QUERIES_IN_GROUP) -> DataFrame:
    """query_id, rank, vec_id, score. rows and queries: id, v of whole numbers."""
    spark = rows.sparkSession
    stored = index(rows, rows_in_block)
    asked = materialize(queries.groupBy("id", "v").agg(F.count("*").alias("times")).withColumn("q", F.monotonically_increasing_id()), "queries")
    m, cells = asked.count(), stored.count()
    each = -(-m * max(1, cells) // (2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    groups = max(1, -(-m // min(queries_in_group[1], max(queries_in_group[0], each))))
    sizes = stored.groupBy((F.col("block") + 0).alias("block"), (F.col("size") + 0).alias("size")).agg(F.count("*").alias("n")).drop("n")
    left = stored.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = asked.withColumn("group", F.pmod(F.xxhash64("id", "v"), F.lit(groups)).cast("int")).withColumn("size", F.size("v")).join(sizes, "size")
    best = left.groupBy("block", "size", "group").cogroup(right.select("block", "size", "group", "q", "id", "v").groupBy("block", "size", "group")).applyInPandas(_meet(k), "q long, vec_id long, score long")
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    told = ranked.join(asked.select("q", F.col("id").alias("query_id"), "times"), "q")
    return told.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times")))).select("query_id", "rank", "vec_id", "score")


def nearest(embeddings: DataFrame) -> DataFrame:
    """The 20 best rows for every id that 20 divides."""
    rows = quantised(embeddings)
    return top_k(rows, rows.where(F.col("id") % 20 == 0))


ORACLE_SQL = f"""
with v as (select row_number() over () as q, vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as v from embeddings
    where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
s as (select a.q, a.vec_id as query_id, b.vec_id, cast(list_dot_product(cast(a.v as double[]), cast(b.v as double[])) as bigint) as score
    from v a join v b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where a.vec_id % 20 = 0),
r as (select *, row_number() over (partition by q order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= {K}"""
