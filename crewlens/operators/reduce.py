"""Rows of a large table that may belong to the keys of a smaller one, without shuffling the large one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the key filter: its broadcast size is fixed (an eighth of that in bytes), whatever the tables' sizes.
FILTER_BITS = 1 << 26
_WORD = 32_768  # bits of one of Spark's bitmaps


def key_filter(keys: DataFrame, key: str, bits: int = FILTER_BITS) -> DataFrame:
    """(``_bucket``, ``_bits``): one bit for the hash of every key, as at most ``bits`` / 32768 bitmaps of 4 KB."""
    place = keys.where(F.col(key).isNotNull()).select((_place(F.col(key), bits) + 1).alias("_p"))
    return place.groupBy(F.bitmap_bucket_number("_p").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("_bits")
    )


def _place(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def _free_name(df: DataFrame, base: str) -> str:
    """``base``, lengthened until no column of ``df`` has that name; Spark takes names that differ in case as one."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def reduced_by_keys(big: DataFrame, keys: DataFrame, key: str, bits: int = FILTER_BITS) -> DataFrame:
    """Rows of ``big`` whose ``key`` may occur in ``keys``: no such row is lost, few others stay.

    A one-probe Bloom filter: ``keys`` become a bitmap of fixed size, which is
    broadcast, so ``big`` is filtered where it is scanned and only rows that
    matter reach the next shuffle. Exactness is left to the join that follows.
    Null keys never match.
    """
    found = key_filter(keys, key, bits)
    bucket, word, at, spot = (_free_name(big, c) for c in ("_bucket", "_bits", "_at", "_place"))
    found = found.select(F.col("_bucket").alias(bucket), F.col("_bits").alias(word))
    place = _place(F.col(key), bits) + 1
    marked = big.where(F.col(key).isNotNull()).withColumn(spot, F.bitmap_bit_position(place)).withColumn(at, F.bitmap_bucket_number(place))
    joined = marked.join(F.broadcast(found), marked[at] == found[bucket])
    byte = F.conv(F.hex(F.substr(word, F.floor(F.col(spot) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return joined.where(F.getbit(byte, F.pmod(F.col(spot), F.lit(8)).cast("int")) == 1).select(*[big[c] for c in big.columns])
