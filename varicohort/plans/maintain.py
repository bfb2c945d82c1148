"""Changes to a cohort's calls, as relations: merge, compaction, checks. ``database`` applies them to stored cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from varicohort.functions.chrom import CHROMS
from varicohort.plans.cohort import VARIANT, stored
from varicohort.session import can_broadcast


def merge_counts(existing: DataFrame, added: DataFrame) -> DataFrame:
    """chrom, n_new, n_updated: how many variants of the added calls are new, and how many were stored before.

    Merging is an append; the union of classes per variant and sample is what the calls are.
    """
    # with the bucket among the keys, a small addition prunes the files of the calls that are there
    keys = [*VARIANT, *(["bucket"] if "bucket" in existing.columns and "bucket" in added.columns else [])]
    new = stored(added).select(*keys).distinct()
    old = stored(existing).select(*keys).distinct().withColumn("__old", F.lit(True))
    return new.join(old, keys, "left").groupBy("chrom").agg(F.count_if(F.col("__old").isNull()).alias("n_new"), F.count_if(F.col("__old").isNotNull()).alias("n_updated"))


def _ids(samples: DataFrame) -> DataFrame:
    """The ids of ``samples``, once each; broadcast if they are known to be few, so that calls need not be shuffled to meet them."""
    ids = samples.select("sample_id").distinct()
    return F.broadcast(ids) if can_broadcast(samples) else ids


def compacted(calls: DataFrame, samples: DataFrame) -> DataFrame:
    """Calls of samples that are still there; variants without any such call vanish."""
    return stored(calls).join(_ids(samples), "sample_id", "left_semi")


def compact_counts(calls: DataFrame, samples: DataFrame) -> DataFrame:
    """One row: variants and rows of ``calls``, variants and rows that ``compacted`` leaves; the calls are read once."""
    c = calls.join(_ids(samples).withColumn("__here", F.lit(True)), "sample_id", "left")
    there = F.col("is_het") | F.col("is_hom") | F.col("is_fail")
    per = c.groupBy(*VARIANT).agg(F.count("*").alias("rows"), F.count_if(there).alias("there"), F.count_if(there & F.col("__here").isNotNull()).alias("left"))
    total = lambda k: F.coalesce(F.sum(k), F.lit(0))
    return per.agg(F.count_if(F.col("there") > 0), total("rows"), F.count_if(F.col("left") > 0), total("left"))


def check_calls(calls: DataFrame, samples: DataFrame) -> DataFrame:
    """severity, message, n of everything in the calls that should not be there; no row for a rule that holds."""
    known = _ids(samples).withColumn("__known", F.lit(True))
    flags = calls.join(known, "sample_id", "left").agg(
        F.count_if(~F.coalesce(F.col("chrom").isin(CHROMS), F.lit(False))).alias("unknown chromosome"),
        F.count_if(F.col("pos").isNull() | (F.col("pos") < 1)).alias("position below 1"),
        F.count_if(F.col("ref").isNull() | F.col("alt").isNull() | (F.col("ref") == F.col("alt"))).alias("missing or equal alleles"),
        F.count_if(F.col("__known").isNull()).alias("call of a removed sample"),
    )
    rules = {"unknown chromosome": "error", "position below 1": "error", "missing or equal alleles": "error", "call of a removed sample": "warning"}
    rows = flags.select(F.explode(F.array(*(F.struct(F.lit(sev).alias("severity"), F.lit(rule).alias("message"), F.col(f"`{rule}`").alias("n")) for rule, sev in rules.items()))).alias("r"))
    return rows.select("r.*").where("n > 0")
