"""Synthetic cohorts: shared positions, mostly reference genotypes, all whole genome."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Share of reference, heterozygous and homozygous genotypes; span of positions; the one phenotype code.
SHARES = (0.95, 0.03, 0.02)
SPAN = 250_000_000
CODE = "E11.9"


def synthetic(spark: SparkSession, n_samples: int, n_variants: int, chroms: list[str], seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(ingested, samples, sample_phenotype, technologies); the same for the same arguments, however it is partitioned.

    Positions are uniform and repeated ones are dropped, so a chromosome may have a few variants less. Sexes alternate.
    """
    u = lambda *c: F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(1 << 53)) / F.lit(float(1 << 53))
    v = spark.range(n_variants).withColumn("chrom", F.explode(F.array(*map(F.lit, chroms))))
    v = v.select("chrom", (F.floor(u(F.lit("pos"), "chrom", "id") * SPAN) + 1).cast("int").alias("pos"), "id").groupBy("chrom", "pos").agg(F.min("id").alias("id"))
    base = lambda k: F.element_at(F.array(*map(F.lit, "ACGT")), (k % 4 + 1).cast("int"))
    k = F.pmod(F.xxhash64(F.lit(seed), F.lit("ref"), "chrom", "id"), F.lit(4))
    v = v.select("chrom", "pos", base(k).alias("ref"), base(k + 1 + F.pmod(F.xxhash64(F.lit("alt"), "chrom", "id"), F.lit(3))).alias("alt"))
    c = v.withColumn("sample_id", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1)))).withColumn("g", u(F.lit("gt"), "chrom", "pos", "sample_id"))
    ac = F.when(F.col("g") >= SHARES[0] + SHARES[1], 2).when(F.col("g") >= SHARES[0], 1).otherwise(0).cast("tinyint")
    null = F.lit(None)
    calls = c.withColumn("gt_ac", ac).where("gt_ac > 0").select("chrom", "pos", "ref", "alt", "gt_ac", "sample_id", F.lit(True).alias("filter_pass"), null.cast("int").alias("dp"), null.cast("int").alias("gq"), null.cast("float").alias("qual"))
    ids = spark.range(n_samples).select(F.col("id").cast("int").alias("sample_id"))
    samples = ids.select("sample_id", F.format_string("SYNTH_%06d", "sample_id").alias("sample_name"), F.when(F.col("sample_id") % 2 == 0, "male").otherwise("female").alias("sex"), F.lit(0).alias("tech_id"))
    codes = ids.select("sample_id", F.lit(CODE).alias("phenotype_code"))
    tech = spark.range(1).select(F.lit(0).alias("tech_id"), F.lit("WGS").alias("tech_name"), F.lit(None).cast("string").alias("bed_path"))
    return calls, samples, codes, tech
