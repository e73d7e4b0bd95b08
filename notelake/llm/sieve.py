"""A bitmap of fixed size that keeps rows with large texts out of a join in which they have no partner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the bitmap: 2**18 rows of one long at most, whatever the input. A full one sends every row to the join.
BITS = 1 << 24


def _place(key: str) -> tuple[Column, Column]:
    return F.floor(F.pmod(F.col(key), F.lit(BITS)) / 64).cast("int"), F.expr(f"shiftleft(1L, cast(pmod(`{key}`, 64) as int))")


def sieve(rows: DataFrame, key: str) -> DataFrame:
    """sieve_word, sieve_bits: the bitmap of a hashed key (a long) of some rows."""
    word, bit = _place(key)
    return rows.select(word.alias("sieve_word"), bit.alias("bit")).groupBy("sieve_word").agg(F.bit_or("bit").alias("sieve_bits"))


def sifted(rows: DataFrame, bitmap: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``maybe``: false only if no row of the bitmap has this key."""
    word, bit = _place(key)
    joined = rows.withColumn("sieve_word", word).join(F.broadcast(bitmap), "sieve_word", "left")  # 2**18 rows at most
    return joined.withColumn("maybe", F.coalesce(F.col("sieve_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("sieve_word", "sieve_bits")
