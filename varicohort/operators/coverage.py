"""Capture regions: which technologies cover a position (a point-in-interval join)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from varicohort.session import can_broadcast

BIN_BP = 1 << 14


def merge_intervals(capture: DataFrame) -> DataFrame:
    """Disjoint intervals (tech_id, chrom, start0, end0) that cover the same positions; empty and null ones vanish."""
    c = capture.where("start0 < end0").select("tech_id", "chrom", "start0", "end0")
    w = Window.partitionBy("tech_id", "chrom").orderBy("start0", "end0")
    reach = F.max("end0").over(w.rowsBetween(Window.unboundedPreceding, -1))
    c = c.withColumn("new", (reach.isNull() | (F.col("start0") > reach)).cast("int"))
    c = c.withColumn("island", F.sum("new").over(w))
    return c.groupBy("tech_id", "chrom", "island").agg(F.min("start0").alias("start0"), F.max("end0").alias("end0")).drop("island")


def covering(positions: DataFrame, merged: DataFrame) -> DataFrame:
    """(chrom, pos, tech_id) of every position and kit with start0 < pos <= end0; at most one row each.

    Intervals are cut into bins, so that the join is an equality on (chrom, bin) with the interval as residual; they
    are broadcast only if their size is known to be small.
    """
    bins = merged.withColumn("bin", F.explode(F.sequence(((F.col("start0") + 1) / BIN_BP).cast("bigint"), (F.col("end0") / BIN_BP).cast("bigint"))))
    if can_broadcast(merged, 8 << 20):
        bins = F.broadcast(bins)
    p = positions.select("chrom", "pos").withColumn("bin", (F.col("pos") / BIN_BP).cast("bigint"))
    return p.join(bins, ["chrom", "bin"]).where("start0 < pos AND pos <= end0").select("chrom", "pos", "tech_id")


def segments(merged: DataFrame) -> DataFrame:
    """(chrom, start0, end0, kits): disjoint stretches in which the same kits cover every position, kits sorted.

    A position lies in one stretch at most, so joining with them never multiplies rows. There are at most twice as many
    stretches as intervals.
    """
    cuts = merged.select("chrom", F.explode(F.array("start0", "end0")).alias("start0")).distinct()
    pieces = cuts.withColumn("end0", F.lead("start0").over(Window.partitionBy("chrom").orderBy("start0"))).where("end0 IS NOT NULL")
    kits = covering(pieces.select("chrom", F.col("end0").alias("pos")), merged).groupBy("chrom", F.col("pos").alias("end0")).agg(F.sort_array(F.collect_list("tech_id")).alias("kits"))
    return pieces.join(kits, ["chrom", "end0"]).select("chrom", "start0", "end0", "kits")


def with_segment(rows: DataFrame, stretches: DataFrame, basis: DataFrame) -> DataFrame:
    """``rows`` (chrom, pos, ...) with the other columns of the stretch that each lies in, null where there is none.

    ``basis`` is the table behind ``stretches``; if it is known to be small they are broadcast, else both sides meet by
    (chrom, bin).
    """
    names = [c for c in stretches.columns if c not in ("chrom", "start0", "end0")]
    bins = stretches.withColumn("__bin", F.explode(F.sequence(((F.col("start0") + 1) / BIN_BP).cast("bigint"), (F.col("end0") / BIN_BP).cast("bigint")))).withColumnRenamed("chrom", "__chrom")
    if can_broadcast(basis, 8 << 20):
        bins = F.broadcast(bins)
    on = (F.col("chrom") == F.col("__chrom")) & ((F.col("pos") / BIN_BP).cast("bigint") == F.col("__bin")) & (F.col("start0") < F.col("pos")) & (F.col("pos") <= F.col("end0"))
    return rows.join(bins, on, "left").select(*rows.columns, *names)


def kit_patterns(positions: DataFrame, merged: DataFrame, technologies: DataFrame) -> DataFrame:
    """(chrom, pos, n_kits, kit_pattern): how many kits cover a position, and their names joined by +."""
    positions = positions.select("chrom", "pos").distinct()
    named = covering(positions, merged).join(F.broadcast(technologies.select("tech_id", "tech_name")), "tech_id")
    per = named.groupBy("chrom", "pos").agg(F.count("*").alias("n_kits"), F.array_join(F.sort_array(F.collect_set("tech_name")), "+").alias("kit_pattern"))
    return positions.join(per, ["chrom", "pos"], "left").select("chrom", "pos", F.coalesce("n_kits", F.lit(0)).alias("n_kits"), F.coalesce("kit_pattern", F.lit("")).alias("kit_pattern"))
