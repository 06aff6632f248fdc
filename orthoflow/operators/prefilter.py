"""A blocked Bloom filter as rows of numbers: it drops rows next to the scan that a later equi join would drop.

The filter has one row per block of ``WORDS`` 32-bit words; a key sets one bit in each word of its block, so
a probe is one look-up.  It is sent to the tasks only while its size, which follows from the counted keys, is within
``MOST_BYTES``; beyond that rows go to the join as they are, which gives the same result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8
KEY_BITS = 16
BLOCK_BITS = 32 * WORDS
ROW_BYTES = 16 + 8 * (WORDS + 1)
MOST_BYTES = 32 << 20


def _masks(key: Column) -> list[Column]:
    bits = F.xxhash64(key, F.lit(7))
    five = lambda i: F.shiftright(bits, 5 * i).bitwiseAND(F.lit(31)).cast("int")
    return [F.call_function("shiftleft", F.lit(1).cast("long"), five(i)) for i in range(WORDS)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


@dataclass(frozen=True)
class KeyFilter:
    """What :func:`key_filter` has learnt of a set of keys; ``rows`` is None for a set that is too large to send."""

    blocks: int
    rows: DataFrame | None

    def keep(self, table: DataFrame, key: str) -> DataFrame:
        """Rows of ``table`` whose ``key`` may be in the set: all that are, and about 1 in 1,000 others."""
        if self.rows is None:
            return table
        probed = table.withColumn("_block", _block(F.col(key), self.blocks)).join(F.broadcast(self.rows), "_block")
        hit = reduce(and_, [F.col(f"_w{i}").bitwiseAND(m) == m for i, m in enumerate(_masks(F.col(key)))])
        return probed.where(hit).select(*[F.col(f"`{c}`") for c in table.columns])


def key_filter(keys: DataFrame, key: str = "key", most_bytes: int = MOST_BYTES) -> KeyFilter:
    """Filter of the distinct values of ``key`` in a stored table; bits have partial results on the map side."""
    distinct = keys.select(F.col(key).alias("key")).where("key is not null").distinct()
    n = distinct.count()
    blocks = max(1, -(-n * KEY_BITS // BLOCK_BITS))
    if min(n, blocks) * ROW_BYTES > most_bytes:
        return KeyFilter(blocks, None)
    masks = [m.alias(f"m{i}") for i, m in enumerate(_masks(F.col("key")))]
    by_block = distinct.select(_block(F.col("key"), blocks).alias("_block"), *masks).groupBy("_block")
    return KeyFilter(blocks, by_block.agg(*[F.bit_or(f"m{i}").alias(f"_w{i}") for i in range(WORDS)]))
