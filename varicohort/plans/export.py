"""Export of whole cohorts with columns or rows per group, as a table, as one CSV file or as a folder of them."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, functions as F

from varicohort.functions.chrom import BUCKET_BP, bucket, chrom_rank, normalize_chrom_text
from varicohort.operators.filters import SampleFilter
from varicohort.operators.measures import measures, measures_by_group
from varicohort.plans.cohort import VARIANT, Cohort
from varicohort.plans.queries import genomic_order
from varicohort.session import scratch, write_lines, written

BASE = ["AC", "AN", "AF", "N_HET", "N_HOM_ALT", "N_HOM_REF", "N_FAIL", "N_NO_COVERAGE"]


def group_axes(cohort: Cohort, by_sex: bool = False, by_tech: bool = False, by_phenotype: list[str] | None = None, all_groups: bool = False) -> DataFrame:
    """(sex, tech, phenotype), a row per group, from the dimensions in one plan: an axis is an array, their product is exploded.

    An axis that was not asked for is null.
    """
    listed = lambda df, c: df.where(F.col(c).isNotNull()).agg(F.sort_array(F.collect_set(c))).scalar()
    nothing = F.array(F.lit(None).cast("string"))
    sex = F.array(F.lit("male"), F.lit("female")) if by_sex or all_groups else nothing
    tech = listed(cohort.technologies, "tech_name") if by_tech or all_groups else nothing
    codes = F.array(*map(F.lit, sorted(set(by_phenotype)))) if by_phenotype else listed(cohort.sample_phenotype, "phenotype_code") if all_groups else nothing
    one = cohort.spark.range(1)
    for name, axis in (("sex", sex), ("tech", tech), ("phenotype", codes)):
        one = one.withColumn(name, F.explode(axis))
    return one.drop("id")


def build_groups(cohort: Cohort, base: SampleFilter, **axes) -> dict[str, SampleFilter]:
    """Label and filter of every group of ``group_axes``. Each group becomes columns of the export, so their number is that of columns."""
    rows = [{k: v for k, v in r.asDict().items() if v is not None} for r in group_axes(cohort, **axes).collect()]
    return {"_".join(r.values()): base.narrowed(**r) for r in rows if r}


def dump_long(cohort: Cohort, base: SampleFilter = SampleFilter(), groups: dict[str, SampleFilter] | None = None, calls: DataFrame | None = None) -> DataFrame:
    """VARIANT, label and BASE: a row per variant with AC > 0 in the base population and group; a group with AN 0 has AF 0.0."""
    m = measures_by_group(cohort, [base, *(groups or {}).values()], calls).where("g[0].AN > 0 AND g[0].AC > 0")
    labels = F.array(*map(F.lit, groups)) if groups else F.array().cast("array<string>")
    rows = m.select(*VARIANT, F.posexplode(F.slice("g", 2, len(groups or {}))).alias("__i", "m")).withColumn("label", F.get(labels, F.col("__i")))
    return rows.select(*VARIANT, "label", *(F.coalesce(f"m.{c}", F.lit(0.0)).alias(c) if c == "AF" else F.col(f"m.{c}").alias(c) for c in BASE))


def dump(cohort: Cohort, base: SampleFilter = SampleFilter(), groups: dict[str, SampleFilter] | None = None, chrom: str | None = None, start: int | None = None, end: int | None = None, include_ac_zero: bool = False) -> DataFrame:
    """VARIANT and BASE, and for each group the same columns with its label; unordered (see ``genomic_order``).

    Rows need AN > 0 and, unless ``include_ac_zero``, AC > 0 in the base population; a group with AN 0 has AF 0.0.
    Bounds may be half open and need ``chrom``.
    """
    calls = cohort.calls
    if chrom is not None:
        calls = calls.where(F.col("chrom") == normalize_chrom_text(chrom))
        for bound, op in ((start, "__ge__"), (end, "__le__")):
            if bound is not None:
                calls = calls.where(getattr(F.col("pos"), op)(bound))
                if cohort.partitioned:
                    calls = calls.where(getattr(F.col("bucket"), op)(bound // BUCKET_BP))
    elif start is not None or end is not None:
        raise ValueError("start and end need chrom")
    if not groups:
        out = measures(cohort, base, calls).select(*VARIANT, *BASE)
    else:
        m = measures_by_group(cohort, [base, *groups.values()], calls).where("g[0].AN > 0")
        field = lambda i, c: F.coalesce(F.col("g")[i][c], F.lit(0.0)) if c == "AF" else F.col("g")[i][c]
        out = m.select(*VARIANT, *(field(i, c).alias(f"{c}_{label}" if label else c) for i, label in enumerate(["", *groups]) for c in BASE))
    return out if include_ac_zero else out.where("AC > 0")


def plain_float(c: Column) -> Column:
    """A number from 0 to 1 in its shortest decimal form, with an exponent of two digits below 0.0001."""
    t = c.cast("string")
    digits = F.regexp_replace(F.regexp_extract(t, r"^(\d\.\d+)E", 1), r"\.0$", "")
    power = F.regexp_extract(t, r"E-(\d+)$", 1)
    return F.when(power == "", t).when(power == "4", F.concat(F.lit("0.000"), F.replace(digits, F.lit("."), F.lit("")))).otherwise(F.concat(digits, F.lit("e-"), F.lpad(power, 2, "0")))


def write_csv(df: DataFrame, output=None) -> dict:
    """Rows in genomic order as one CSV file, to a path, a URI, a file or standard output; null is empty.

    Gives n_rows, n_buckets, n_chroms. Sorted and formatted by the executors, see ``session.write_lines``.
    """
    spark = df.sparkSession
    with scratch(spark):
        rows = written(df, "dump")
        # alleles, chromosomes and numbers need no quotes
        text = [F.coalesce(plain_float(F.col(f"`{c}`")) if t == "double" else F.col(f"`{c}`").cast("string"), F.lit("")) for c, t in rows.dtypes]
        lines = rows.select(F.concat_ws(",", *text).alias("line"), chrom_rank(F.col("chrom")).alias("rank"), "pos", "alt", "ref")
        write_lines(lines, [",".join(df.columns)], sys.stdout if output is None else output, ["rank", "pos", "alt", "ref"])
        n = rows.agg(F.count("*").alias("n_rows"), F.countDistinct("chrom", bucket(F.col("pos"))).alias("n_buckets"), F.countDistinct("chrom").alias("n_chroms")).first()
    return n.asDict()


def write_csv_parts(df: DataFrame, folder: str) -> None:
    """The same rows as a folder of CSV files, each with the header; the names of the files follow the genomic order."""
    genomic_order(df).write.csv(folder, header=True)
