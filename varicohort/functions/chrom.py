"""Chromosome names, order and buckets as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The chromosomes a cohort can hold, in genomic order.
CHROMS = [f"chr{n}" for n in [*range(1, 23), "X", "Y", "M"]]
BUCKET_BP = 1_000_000


def normalize_chrom(c: Column) -> Column:
    """Blanks cut, any spelling of MT is chrM, ``chr`` put before names without it; null stays null."""
    t = F.regexp_replace(c, r"^\s+|\s+$", "")
    # most names are canonical already, which is cheaper to see than to bring about
    return F.when(c.isin(CHROMS), c).when(F.upper(t) == "MT", F.lit("chrM")).when(t.startswith("chr"), t).otherwise(F.concat(F.lit("chr"), t))


def normalize_chrom_text(name: str) -> str:
    """The same rule for one Python string."""
    name = name.strip()
    if name.upper() == "MT":
        return "chrM"
    return name if name.startswith("chr") else "chr" + name


def is_autosome(c: Column) -> Column:
    return normalize_chrom(c).isin(CHROMS[:22])


def is_sex_chrom(c: Column) -> Column:
    return normalize_chrom(c).isin("chrX", "chrY")


def is_mito(c: Column) -> Column:
    return normalize_chrom(c) == "chrM"


def is_known(c: Column) -> Column:
    return c.isin(CHROMS)


def chrom_rank(c: Column) -> Column:
    """1 to 25 in genomic order; unknown names last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, CHROMS)), c), F.lit(0)), F.lit(len(CHROMS) + 1))


def bucket(pos: Column) -> Column:
    """The 1 Mbp bucket of a position, by integer division."""
    p = pos.cast("bigint")
    return ((p - p % F.lit(BUCKET_BP)) / F.lit(BUCKET_BP)).cast("bigint")
