"""A Bloom filter as one row, to keep rows that can't meet anything out of a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each key, bits that a key sets, and 64-bit words at most (16 MB): beyond that more rows pass than need to.
BITS, SET, MOST_WORDS = 16, 4, 2_000_000


def _word(keys: list[Column], words: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), *keys), F.lit(words)).cast("int")


def _mask(keys: list[Column]) -> Column:
    """The bits of a key, all in one word."""
    h, out = F.xxhash64(F.lit(2), *keys), F.lit(0).cast("long")
    for i in range(SET):
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    return out


def may_meet(rows: DataFrame, keys: list[str], others: DataFrame, other_keys: list[str]) -> DataFrame:
    """rows without those that surely have no partner among others by equal keys (none is lost; null keys go).

    The filter is an array of words in one row, of a size that follows the keys of others up to MOST_WORDS, and is
    broadcast; rows aren't shuffled. Key types must be the same on both sides.
    """
    n = others.count()
    words = max(1, min(MOST_WORDS, -(-n * BITS // 64)))
    theirs = [F.col(k) for k in other_keys]
    set_ = others.dropna(subset=other_keys).groupBy(_word(theirs, words).alias("w")).agg(F.bit_or(_mask(theirs)).alias("bits"))
    every = rows.sparkSession.range(words).select(F.col("id").cast("int").alias("w"))
    one = every.join(set_, "w", "left").agg(F.transform(F.array_sort(F.collect_list(F.struct("w", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))), lambda x: x["bits"]).alias("__words"))
    own = [F.col(k) for k in keys]
    marked = rows.dropna(subset=keys).withColumn("__one", F.lit(1)).join(F.broadcast(one.withColumn("__one", F.lit(1))), "__one")
    mask = _mask(own)
    return marked.where(F.get("__words", _word(own, words)).bitwiseAND(mask) == mask).drop("__one", "__words")
