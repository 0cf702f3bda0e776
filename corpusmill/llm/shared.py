"""Helpers that the corpus operators share: hot-key joins, Bloom filters, running offsets, Arrow slices, text constants. scratch and discard are the library's durable tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.sources.tables import discard
from corpusmill.sources.tables import durable as scratch

__all__ = ["attach", "attach_some", "bloom_array", "bounded_batches", "byte_slices", "discard", "fresh", "in_bloom", "maybe_among", "running_start", "scratch"]

#: A word and a run of white space, as Java, Python and RE2 all read them.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Blocks of a Bloom filter that are broadcast at most: as rows of two longs, or as an array of 16 MB.
MAX_BROADCAST_BLOCKS, MAX_ARRAY_BLOCKS = 1 << 19, 1 << 21
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """From now on Arrow batches of the session hold at most that many rows, as texts are long. A smaller bound stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def byte_slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of an Arrow batch whose strings in a column take no more bytes than that, or are a single row."""
    ends = np.cumsum(pc.binary_length(batch[column]).fill_null(0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def attach(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, how: str = "inner", parts: int = 1000) -> DataFrame:
    """Join left with right, which has one row for each key and in `weight` the number of left's rows with that key.

    Keys with at least total / parts rows number `parts` at most, so they are broadcast and their rows never shuffle;
    the rest go through an ordinary join whose largest key has less than total / parts rows. Both inputs are read more
    than once: pass scratch tables.
    """
    heavy = right.where(F.col(weight) * parts >= total)
    hot = left.join(F.broadcast(heavy), key)
    rest = left.join(F.broadcast(heavy.select(key)), key, "left_anti").join(right, key, how)
    return hot.unionByName(rest)


def running_start(df: DataFrame, group: str, bucket: str, order: list[Column], size: str, out: str) -> DataFrame:
    """Add `out`, the sum of `size` over the rows of the group that come before a row.

    Rows are ordered by bucket, then `order`. Sums of buckets come first, so no task sorts more than one bucket of a
    group: a group may hold most rows.
    """
    base = df.groupBy(group, bucket).agg(F.sum(size).alias("__sum"))
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = base.select(group, bucket, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = df.join(base, [group, bucket])
    return placed.withColumn(out, F.col("__base") + F.coalesce(F.sum(size).over(within), F.lit(0))).drop("__base")


def bloom_block(h: Column, blocks: int) -> Column:
    """The 64-bit block of a Bloom filter that a hash belongs to."""
    return F.pmod(h, F.lit(blocks))


def bloom_bit(h: Column, i: int) -> Column:
    return F.shiftrightunsigned(h, 40 + 6 * i).bitwiseAND(63).cast("int")


def bloom_bits(h: Column) -> Column:
    """The two bits of a hash in its block."""
    one = F.lit(1).cast("long")
    return F.call_function("shiftleft", one, bloom_bit(h, 0)).bitwiseOR(F.call_function("shiftleft", one, bloom_bit(h, 1)))


def bloom_array(keys: DataFrame, key: str) -> np.ndarray:
    """A Bloom filter of the keys (a scratch table; longs that are hashes already) as an array of at most MAX_ARRAY_BLOCKS blocks; beyond 4 keys a block it lets more others through."""
    blocks = min(MAX_ARRAY_BLOCKS, 1 << max(10, (keys.count() // 4).bit_length()))
    h = F.col(key)
    found = keys.groupBy(bloom_block(h, blocks).alias("block")).agg(F.bit_or(bloom_bits(h)).alias("bits")).toArrow()
    bits = np.zeros(blocks, np.uint64)
    bits[found["block"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return bits


def in_bloom(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each of the keys (np.uint64) may be in a filter of bloom_array."""
    one, low = np.uint64(1), np.uint64(63)
    mask = one << (keys >> np.uint64(40) & low) | one << (keys >> np.uint64(46) & low)
    return bits[keys & np.uint64(len(bits) - 1)] & mask == mask


def maybe_among(left: DataFrame, keys: DataFrame, key: str, flag: str) -> DataFrame:
    """Add the boolean `flag`: false only if left's key is not among the keys (a scratch table of one column named key, without nulls).

    A broadcast Bloom filter tells. It has a block for 4 keys, at most MAX_BROADCAST_BLOCKS; beyond, blocks fill up and more rows go on to the exact join:
    2 % without a key among 2 million keys, 15 % among 8 million, 75 % among 32 million.
    """
    blocks = min(MAX_BROADCAST_BLOCKS, 1 << max(10, (keys.count() // 4).bit_length()))
    block, bits = fresh(left, "__block"), fresh(left, "__bits")
    h = F.xxhash64(key)
    there = keys.groupBy(bloom_block(h, blocks).alias(block)).agg(F.bit_or(bloom_bits(h)).alias(bits))
    met = left.withColumn(block, bloom_block(h, blocks)).join(F.broadcast(there), block, "left")
    return met.withColumn(flag, F.coalesce(F.col(bits), F.lit(0)).bitwiseAND(bloom_bits(h)) == bloom_bits(h)).drop(block, bits)


def attach_some(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """attach, where most rows of left have no partner: a Bloom filter keeps those from the shuffle."""
    flag = fresh(left, "__maybe")
    some = maybe_among(left, right.select(key), key, flag).where(F.col(flag)).drop(flag)
    return attach(some, right, key, weight, total)
