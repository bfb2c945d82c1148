"""Annotation of input variants: a left join that also answers for variants nobody carries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from varicohort.functions.chrom import normalize_chrom
from varicohort.operators.filters import SampleFilter
from varicohort.operators.measures import an_of, check_gates, flagged_samples, headcount, measures, with_position_facts
from varicohort.plans.cohort import VARIANT, Cohort
from varicohort.session import can_broadcast

INFO_FIELDS = {
    "AC": ("A", "Integer", "Allele count in the cohort"),
    "AN": ("1", "Integer", "Allele number in the cohort"),
    "AF": ("A", "Float", "Allele frequency in the cohort"),
    "N_HET": ("A", "Integer", "Heterozygous samples"),
    "N_HOM_ALT": ("A", "Integer", "Homozygous or hemizygous samples"),
    "N_HOM_REF": ("A", "Integer", "Samples without the allele"),
    "N_FAIL": ("1", "Integer", "Samples whose call failed a filter"),
    "N_NO_COVERAGE": ("A", "Integer", "Samples without sufficient evidence"),
}


@F.pandas_udf(T.StringType())
def ten_digits(values: pd.Series) -> pd.Series:
    """Numbers with ten significant digits and no trailing zeros, which no built-in format gives."""
    return pd.Series(np.char.mod("%.10g", values.to_numpy(float)), values.index).where(values.notna(), None)


def annotate(cohort: Cohort, records: DataFrame, sf: SampleFilter = SampleFilter()) -> DataFrame:
    """Measures per record and ALT: line_no, alt_no, chrom, pos, ref, alt, stored, AC, AN, AF and so on.

    records: line_no, chrom, pos, ref, alts (array). A variant that is not stored has AC 0 and all eligible samples as
    N_HOM_REF if AN > 0; if AN is 0 only AN is set. A record without ALT gives one row with alt null and AN 0.
    Equal variants on several lines are all answered.
    """
    check_gates(cohort, sf)
    r = records.select("line_no", normalize_chrom(F.col("chrom")).alias("chrom"), "pos", "ref", F.posexplode_outer("alts").alias("alt_no", "alt"))
    wanted = r.where("alt IS NOT NULL").select(*VARIANT)
    small = F.broadcast(wanted) if can_broadcast(records) else wanted
    m = measures(cohort, sf, cohort.calls.join(small, VARIANT, "left_semi")).drop("AN", "n_eligible").withColumn("stored", F.lit(True))
    heads = headcount(cohort, [sf], flagged_samples(cohort, [sf]))
    j = with_position_facts(r, cohort, heads).selectExpr("*", "__males[0] + __females[0] AS n_eligible", f"{an_of(cohort, '__males[0]', '__females[0]')} AS AN")
    j = j.join(m, VARIANT, "left")
    covered = F.coalesce(F.col("AN"), F.lit(0)) > 0
    zero = lambda c: F.when(covered, F.coalesce(c, F.lit(0).cast("bigint"))).alias(c)
    return j.select(
        "line_no", F.coalesce("alt_no", F.lit(0)).alias("alt_no"), *VARIANT, (F.coalesce("stored", F.lit(False)) & covered).alias("stored"), zero("AC"), F.when(F.col("alt").isNotNull(), F.coalesce("AN", F.lit(0))).otherwise(0).alias("AN"),
        F.when(covered, F.coalesce("AF", F.lit(0.0))).alias("AF"), zero("N_HET"), zero("N_HOM_ALT"), F.when(covered, F.coalesce("N_HOM_REF", F.col("n_eligible"))).alias("N_HOM_REF"), zero("N_FAIL"), zero("N_NO_COVERAGE"),
    )


def annotate_stats(annotated: DataFrame) -> DataFrame:
    """One row: n_variants (records), n_annotated (any ALT stored), n_uncovered (AN 0)."""
    per = annotated.groupBy("line_no").agg(F.max("AN").alias("AN"), F.bool_or("stored").alias("stored"))
    return per.agg(F.count("*").alias("n_variants"), F.count_if("stored").alias("n_annotated"), F.count_if(F.col("AN") == 0).alias("n_uncovered"))


def info_text(annotated: DataFrame, prefix: str = "COHORT_") -> DataFrame:
    """line_no and the text to add to INFO: values per ALT joined by commas, N_FAIL summed over ALTs; AN=0 alone if uncovered."""
    order = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("alt_no", c.alias("v")))), lambda s: s.v)
    n = lambda c: F.col(c).cast("string")
    g = annotated.groupBy("line_no").agg(F.max("AN").alias("AN"), *(order(n(c)).alias(c) for c in ("AC", "N_HET", "N_HOM_ALT", "N_HOM_REF", "N_NO_COVERAGE")), order(ten_digits("AF")).alias("AF"), F.sum("N_FAIL").alias("N_FAIL"))
    field = lambda k, v: F.concat(F.lit(f"{prefix}{k}="), v)
    text = F.concat_ws(";", *(field(k, n(k) if k in ("AN", "N_FAIL") else F.array_join(k, ",")) for k in INFO_FIELDS))
    return g.select("line_no", F.when(F.col("AN") == 0, F.lit(f"{prefix}AN=0")).otherwise(text).alias("info"))
