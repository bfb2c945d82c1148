"""Sets of sample ids as bitmaps: a word of 32,768 bits per key and stretch of ids, built and combined by built-in aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def bitmaps(df: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """``keys``, word, bits: the set of ids of each key; null and negative ids are in no set, repeated ones count once."""
    # the built-ins count from 1
    one = F.col(id_col).cast("bigint") + 1
    return df.where(one > 0).groupBy(*keys, F.bitmap_bucket_number(one).alias("word")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(one)).alias("bits"))


def cardinality(maps: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    """The number of ids of each key."""
    return maps.groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias(name))


def union(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.unionByName(b).groupBy(*keys, "word").agg(F.bitmap_or_agg("bits").alias("bits"))


def restrict(maps: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Each key's set intersected with one set (word, bits); words that both lack vanish."""
    both = maps.join(other.select("word", F.col("bits").alias("__other")), "word")
    pairs = both.select(*keys, "word", F.explode(F.array("bits", "__other")).alias("bits"))
    return pairs.groupBy(*keys, "word").agg(F.bitmap_and_agg("bits").alias("bits"))
