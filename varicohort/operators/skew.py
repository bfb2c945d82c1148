"""Per-key results when a few keys hold most rows: two-stage salted aggregation."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, Window, functions as F


@dataclass(frozen=True)
class Measure:
    """A measure in two steps: what one salt computes, and how the parts of a key become one.

    A distinct count is of this kind if the salt depends on the counted column alone: equal values then lie under one
    salt, and the parts add up.
    """

    name: str
    partial: Column
    merge: str = "sum"


MERGES = {"sum": F.sum, "min": F.min, "max": F.max}


def heavy_slots(keyed: DataFrame, keys: list[str], slots: int = 4096, least_share: float = 0.005) -> dict[int, int]:
    """The salts of every hash slot that holds more than ``least_share`` of all rows.

    All rows are counted. A key of that share is in such a slot for sure; what comes back has at most ``slots``
    numbers, of which at most 1 / least_share are heavy. Light keys in a heavy slot are salted too, which only costs
    them a few more parts.
    """
    slot = F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int").alias("slot")
    counts = {r[0]: r[1] for r in keyed.select(slot).groupBy("slot").count().collect()}
    least = least_share * sum(counts.values())
    return {s: ceil(n / least) for s, n in counts.items() if n > least}


def salted_aggregate(keyed: DataFrame, keys: list[str], measures: list[Measure], salt_on: list[str], slots: int = 4096, least_share: float = 0.005) -> DataFrame:
    """Aggregate by ``keys``: heavy keys get a salt and partial results per salt, which a second step merges by key.

    The salt is a hash of ``salt_on``: it spreads like a random one but is the same when a lost task runs again. Keys
    may be null (nulls form one group); an empty table gives no rows; repeated rows count as often as they occur.
    Other columns of ``keyed`` are ignored, but ``__salt`` must not be among them.
    """
    heavy = heavy_slots(keyed, keys, slots, least_share)
    salt = F.lit(0)
    if heavy:
        salts = F.create_map(*(F.lit(x) for pair in heavy.items() for x in pair))
        n = F.try_element_at(salts, F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int"))
        salt = F.coalesce(F.pmod(F.xxhash64(F.lit("salt"), *salt_on), n.cast("bigint")).cast("int"), F.lit(0))
    parts = keyed.withColumn("__salt", salt).groupBy(*keys, "__salt").agg(*(m.partial.alias(m.name) for m in measures))
    return parts.groupBy(*keys).agg(*(MERGES[m.merge](m.name).alias(m.name) for m in measures))


def keys_above(aggregated: DataFrame, count_col: str, share: float) -> DataFrame:
    """The groups that hold more than ``share`` of all rows counted in ``count_col``.

    The total is a one-row aggregate of the groups, taken as a scalar: no window over all rows, no cross join.
    """
    total = aggregated.agg(F.sum(count_col).alias("__total")).scalar()
    return aggregated.where(F.col(count_col) > F.lit(share) * total)


def running_total(df: DataFrame, by: list[str], bucket: str, order: list[str], value: str, name: str) -> DataFrame:
    """Sum of ``value`` over the rows before this one within ``by``, in the order of ``bucket``, then ``order``.

    In two steps: within buckets, and over the totals of the buckets. No task sees a whole group, whatever its size.
    """
    before = df.groupBy(*by, bucket).agg(F.sum(value).alias("__t"))
    before = before.withColumn("__before", F.coalesce(F.sum("__t").over(Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__t")
    within = F.coalesce(F.sum(value).over(Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("__within", within).join(before, [*by, bucket]).withColumn(name, F.col("__before") + F.col("__within")).drop("__before", "__within")


def next_value(df: DataFrame, by: list[str], bucket: str, order: str, value: str, name: str) -> DataFrame:
    """``value`` of the next row within ``by``, in the order of ``bucket``, then ``order``; null for the last.

    In two steps like ``running_total``: the last row of a bucket gets the first value of the next bucket.
    """
    firsts = df.groupBy(*by, bucket).agg(F.min(F.struct(order, value))[value].alias("__first"))
    after = firsts.withColumn("__after", F.lead("__first").over(Window.partitionBy(*by).orderBy(bucket))).drop("__first")
    w = Window.partitionBy(*by, bucket).orderBy(order)
    here = df.withColumn("__lead", F.lead(value).over(w)).withColumn("__last", F.lead(F.lit(True)).over(w).isNull())
    return here.join(after, [*by, bucket]).withColumn(name, F.when(F.col("__last"), F.col("__after")).otherwise(F.col("__lead"))).drop("__lead", "__last", "__after")
