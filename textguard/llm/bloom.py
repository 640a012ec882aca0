"""A blocked Bloom filter as a table of fixed size.

A key falls into one block of 512 bits and sets one bit in each of its eight words.
The table has at most ``2 ** log2_blocks`` rows of nine longs whatever the number of
keys, so it can always be broadcast; more keys only let more rows pass to the exact
join that has to follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG2_BLOCKS = 14
_WORDS = 8


def _block(key: str, log2_blocks: int) -> Column:
    return F.col(key).bitwiseAND(F.lit((1 << log2_blocks) - 1).cast("long")).cast("int")


def _bit(key: str, word: int) -> Column:
    """The key's bit in one word, from six bits of a second hash."""
    return F.expr(f"shiftleft(1L, cast(shiftright(xxhash64('bloom', `{key}`), {6 * word}) & 63 as int))")


def bloom_table(keys: DataFrame, key: str, log2_blocks: int = LOG2_BLOCKS) -> DataFrame:
    """``(block, w0 … w7)`` of the hashes in column ``key``."""
    placed = keys.select(_block(key, log2_blocks).alias("block"), *[_bit(key, i).alias(f"w{i}") for i in range(_WORDS)])
    return placed.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(_WORDS)])


def with_maybe(df: DataFrame, key: str, table: DataFrame, log2_blocks: int = LOG2_BLOCKS) -> DataFrame:
    """``df`` with ``_maybe``: whether the key may be among the filter's. A null never is."""
    own = table.select(*[F.col(c).alias(f"_bloom_{c}") for c in table.columns])
    hit = F.col(key).isNotNull()
    for i in range(_WORDS):
        hit = hit & (F.col(f"_bloom_w{i}").bitwiseAND(_bit(key, i)) != 0)
    probe = df.join(F.broadcast(own), _block(key, log2_blocks) == F.col("_bloom_block"), "left")
    return probe.select(*df.columns, F.coalesce(hit, F.lit(False)).alias("_maybe"))


def maybe_in(df: DataFrame, key: str, table: DataFrame, log2_blocks: int = LOG2_BLOCKS) -> DataFrame:
    """The rows of ``df`` whose key may be among the filter's keys."""
    hit = F.lit(True)
    for i in range(_WORDS):
        hit = hit & (F.col(f"w{i}").bitwiseAND(_bit(key, i)) != 0)
    probe = df.withColumn("block", _block(key, log2_blocks)).join(F.broadcast(table), "block")
    return probe.where(hit).select(*df.columns)
