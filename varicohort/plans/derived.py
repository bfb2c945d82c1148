"""Analyses built from the measures: classes, ratios, errors, concordance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from varicohort.operators.filters import SampleFilter
from varicohort.operators.measures import measures
from varicohort.plans.cohort import VARIANT, Cohort

# Frequency classes and their rank on the benign scale.
CLASS_RANK = {"BA1": 3, "BS1": 2, "neutral": 1, "PM2": 0}


def frequency_class(ac: Column, af: Column, ba1: float = 0.05, bs1: float = 0.01, pm2: float = 0.0001) -> Column:
    """BA1 above ``ba1``, BS1 above ``bs1``, PM2 up to ``pm2`` (or, if that is 0, if nobody carries the allele), else neutral; null without AF."""
    rare = (ac == 0) if pm2 == 0 else (af <= pm2)
    return F.when(af.isNull(), None).when(af > ba1, "BA1").when(af > bs1, "BS1").when(rare, "PM2").otherwise("neutral")


def rare_enough(an: Column, ac: Column, least_an: int = 2000) -> Column:
    """PM2 is supported by absence only if enough alleles were seen."""
    return (ac == 0) & (an >= least_an)


def qc_band(n_fail: Column, n_eligible: Column) -> Column:
    """Band of the failure rate: ok below 5 %, review up to 15 %, bad above."""
    rate = F.try_divide(n_fail, n_eligible)
    return F.when(rate.isNull(), None).when(rate < 0.05, "ok").when(rate <= 0.15, "review").otherwise("bad")


def compare(cohort: Cohort, one: SampleFilter, other: SampleFilter, calls: DataFrame | None = None) -> DataFrame:
    """VARIANT with AC, AN, AF of both populations, a_ and b_; full outer join, a missing side has AC and AN 0 and null AF."""
    side = lambda sf, p: measures(cohort, sf, calls).select(*VARIANT, *(F.col(c).alias(p + c) for c in ("AC", "AN", "AF")))
    return side(one, "a_").join(side(other, "b_"), VARIANT, "full_outer").fillna(0, ["a_AC", "a_AN", "b_AC", "b_AN"])


def enrichment(pairs: DataFrame, least_an: int = 0) -> DataFrame:
    """Ratio of a_AF to b_AF; null unless both populations have ``least_an`` alleles and b_AF is not 0."""
    ok = (F.col("a_AN") >= least_an) & (F.col("b_AN") >= least_an)
    return pairs.withColumn("ratio", F.when(ok, F.try_divide(F.col("a_AF"), F.nullif(F.col("b_AF"), F.lit(0.0)))))


def naive_versus_aware(measured: DataFrame, n_samples: int) -> DataFrame:
    """AF over two alleles of every sample beside the capture-aware AF."""
    naive = F.lit(2 * n_samples)
    return measured.select(*VARIANT, "AC", "AN", "AF", naive.cast("bigint").alias("naive_AN"), (F.col("AC") / naive).alias("naive_AF"))


def error_metrics(compared: DataFrame, truth: str, estimate: str, by: list[str]) -> DataFrame:
    """n, mean, median and largest absolute error and root mean square per group; rows without both values are left out."""
    d = compared.where(F.col(truth).isNotNull() & F.col(estimate).isNotNull()).withColumn("e", F.abs(F.col(estimate) - F.col(truth)))
    return d.groupBy(*by).agg(F.count("*").alias("n"), F.avg("e").alias("mae"), F.median("e").alias("median_ae"), F.max("e").alias("max_ae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"))


def confusion(classified: DataFrame, truth: str, pred: str) -> DataFrame:
    return classified.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def _rank(c: str) -> Column:
    return reduce(lambda w, kv: w.when(F.col(c) == kv[0], kv[1]), list(CLASS_RANK.items())[1:], F.when(F.col(c) == "BA1", CLASS_RANK["BA1"]))


def directional_errors(classified: DataFrame, truth: str, pred: str) -> DataFrame:
    """One row: n, share moved towards pathogenic and benign, and how many true BS1 or BA1 were found as such."""
    d = classified.select(_rank(truth).alias("t"), _rank(pred).alias("p")).where("t IS NOT NULL AND p IS NOT NULL")
    rate = lambda cond: F.try_divide(F.count_if(cond), F.count("*"))
    return d.agg(F.count("*").alias("n"), rate(F.col("p") < F.col("t")).alias("toward_pathogenic"), rate(F.col("p") > F.col("t")).alias("toward_benign"), F.try_divide(F.count_if((F.col("t") >= 2) & (F.col("p") >= 2)), F.count_if(F.col("t") >= 2)).alias("bs1_recall"))


def concordance(pairs: DataFrame) -> DataFrame:
    """One row: n, R² of b_AF against a_AF (the truth), numbers of AC and AN mismatches, and keys on one side only."""
    both = F.col("a_AF").isNotNull() & F.col("b_AF").isNotNull()
    x, y = F.when(both, F.col("a_AF")), F.when(both, F.col("b_AF"))
    res = F.sum((x - y) * (x - y))
    tot = F.var_pop(x) * F.count(x)
    return pairs.agg(
        F.count(x).alias("n"), (1 - F.try_divide(res, tot)).alias("r2"), F.count_if(both & (F.col("a_AC") != F.col("b_AC"))).alias("ac_mismatch"), F.count_if(both & (F.col("a_AN") != F.col("b_AN"))).alias("an_mismatch"),
        F.count_if(F.col("b_AF").isNull()).alias("only_a"), F.count_if(F.col("a_AF").isNull()).alias("only_b"),
    )
