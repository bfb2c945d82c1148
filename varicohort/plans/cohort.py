"""The cohort: one fact table of calls and its small dimensions."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from varicohort.functions.chrom import bucket, is_known, normalize_chrom
from varicohort.operators.coverage import merge_intervals, segments

VARIANT = ["chrom", "pos", "ref", "alt"]


@dataclass(frozen=True)
class Quality:
    """Thresholds of a quality-passing call; 0 is off. min_covered: such calls that a kit needs at a site."""

    min_dp: int = 0
    min_gq: int = 0
    min_qual: float = 0.0
    min_covered: int = 0

    @property
    def active(self) -> bool:
        return any(x > 0 for x in (self.min_dp, self.min_gq, self.min_qual, self.min_covered))

    def passes(self) -> Column:
        """Each active threshold must hold; a null fails it."""
        ok = F.lit(True)
        for c, least in (("dp", self.min_dp), ("gq", self.min_gq), ("qual", self.min_qual)):
            if least > 0:
                ok = ok & F.coalesce(F.col(c) >= least, F.lit(False))
        return ok


@dataclass(frozen=True)
class Cohort:
    """calls: VARIANT, sample_id, is_het, is_hom, is_fail, is_qp, one row per variant and sample.

    samples: sample_id, sample_name, sex, tech_id; technologies: tech_id, tech_name, always_covered; capture: disjoint
    intervals tech_id, chrom, start0, end0; sample_phenotype: sample_id, phenotype_code.
    """

    calls: DataFrame
    samples: DataFrame
    sample_phenotype: DataFrame
    technologies: DataFrame
    capture: DataFrame
    build: str = "GRCh37"
    quality: Quality = Quality()
    partitioned: bool = False  # calls have a column bucket that prunes files
    stretches: DataFrame | None = None  # capture as disjoint stretches with their kits, if stored
    memo: dict = field(default_factory=dict, compare=False, repr=False)  # small facts about the dimensions

    def coverage(self) -> DataFrame:
        """chrom, start0, end0, kits"""
        return self.stretches if self.stretches is not None else segments(self.capture)

    @property
    def spark(self) -> SparkSession:
        return self.calls.sparkSession

    def with_(self, **changes) -> "Cohort":
        if "capture" in changes:
            changes.setdefault("stretches", None)
        return replace(self, memo={}, **changes)


def classify(ingested: DataFrame, quality: Quality = Quality(), clean: bool = False) -> DataFrame:
    """Ingested records to calls: het is one copy, hom two (both only if the filter passed), fail any record that did not pass.

    Copies of three and more are none of these. Chromosomes become canonical and unknown contigs are dropped, as are
    records with a null key or sample. Records of one variant and sample are one call with the union of their classes.
    ``clean`` says that chromosomes are canonical and that there is one record of each, so that neither has to be seen to.
    """
    c = ingested if clean else ingested.withColumn("chrom", normalize_chrom(F.col("chrom"))).where(is_known(F.col("chrom")))
    c = c.where("pos IS NOT NULL AND ref IS NOT NULL AND alt IS NOT NULL AND sample_id IS NOT NULL")
    ok = F.coalesce(F.col("filter_pass"), F.lit(False))
    ac = F.coalesce(F.col("gt_ac"), F.lit(0))
    flags = {"is_het": ok & (ac == 1), "is_hom": ok & (ac == 2), "is_fail": ~ok, "is_qp": ok & (ac > 0) & quality.passes()}
    if clean:
        return c.select(*VARIANT, "sample_id", *(x.alias(k) for k, x in flags.items()))
    return c.groupBy(*VARIANT, "sample_id").agg(*(F.bool_or(x).alias(k) for k, x in flags.items()))


def make_cohort(ingested: DataFrame, samples: DataFrame, sample_phenotype: DataFrame, technologies: DataFrame, capture: DataFrame, build: str = "GRCh37", quality: Quality = Quality(), clean: bool = False) -> Cohort:
    """A cohort from ingested records (``clean``: see ``classify``); technologies need bed_path or always_covered."""
    if "always_covered" not in technologies.columns:
        technologies = technologies.withColumn("always_covered", F.col("bed_path").isNull())
    regions = merge_intervals(capture.withColumn("chrom", normalize_chrom(F.col("chrom"))))
    return Cohort(classify(ingested, quality, clean), samples, sample_phenotype, technologies, regions, build, quality)


def stored(calls: DataFrame) -> DataFrame:
    """Calls that make a variant exist: het, hom or fail."""
    return calls.where("is_het OR is_hom OR is_fail")


def bucketed(calls: DataFrame) -> DataFrame:
    return calls.withColumn("bucket", bucket(F.col("pos")))
