"""Small text inputs: manifests, capture regions, request files, metadata updates."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The columns of a manifest.
REQUIRED = ("sample_name", "sex", "tech_name", "vcf_path", "phenotype_codes")


class ManifestError(ValueError):
    """A manifest that cannot be used."""


@dataclass(frozen=True)
class ManifestSample:
    sample_name: str
    sex: str
    tech_name: str
    vcf_path: str
    phenotype_codes: tuple[str, ...]


def tab_table(spark: SparkSession, path: str, needed: tuple[str, ...]) -> DataFrame:
    """The rows of a tab-separated text file with header: ``no``, which rises with the lines, and ``needed`` as trimmed text.

    Lines of nothing but white space are none. A missing cell is null; other columns are left out. A file without
    header line gives no rows; a header without a needed column raises ValueError.
    """
    lines = spark.read.text(path).withColumn("no", F.monotonically_increasing_id()).withColumn("value", F.regexp_replace("value", "^\ufeff", "")).where(F.col("value").rlike(r"\S"))
    top = lines.orderBy("no").first()
    if top is None:
        return spark.createDataFrame([], "no bigint, " + ", ".join(f"{c} string" for c in needed))
    header = [c.strip() for c in top["value"].split("\t")]
    if absent := sorted(set(needed) - set(header)):
        raise ValueError(f"{path}: no column {', '.join(absent)}")
    cells = F.split("value", "\t")
    return lines.where(F.col("no") > top["no"]).select("no", *(F.regexp_replace(F.get(cells, F.lit(header.index(c))), r"^\s+|\s+$", "").alias(c) for c in needed))


def problems(rows: DataFrame, rules: dict[str, Column], keys: list[str]) -> DataFrame:
    """``keys`` and problem: a row for every rule that a row of ``rows`` breaks (a rule that is null holds)."""
    broken = F.array_compact(F.array(*(F.when(cond, F.lit(name)) for name, cond in rules.items())))
    return rows.select(*keys, F.explode(broken).alias("problem"))


def listed_codes(text: Column) -> Column:
    """The codes of a comma-separated cell, trimmed, each once, in order."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda c: F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.array_distinct(F.filter(parts, lambda c: c != ""))


def manifest_problems(rows: DataFrame, key: str) -> DataFrame:
    """(key, problem) of manifest rows: what must be there, what it may be, and names that another row has as well."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    again = rows.groupBy("sample_name").agg(F.count("*").alias("__times")).where("__times > 1 AND sample_name != ''")
    marked = rows.join(again, "sample_name", "left")
    return problems(
        marked,
        {
            "no sample name": blank("sample_name"),
            "name of several rows": F.col("__times").isNotNull(),
            "sex is neither male nor female": ~F.coalesce(F.col("sex").isin("male", "female"), F.lit(False)),
            "no technology": blank("tech_name"),
            "no file": blank("vcf_path"),
            "no phenotype code": F.size(listed_codes(F.col("phenotype_codes"))) == 0,
        },
        [key],
    )


def read_manifest(spark: SparkSession, path: str, bed_dir: str | None = None) -> tuple[list[ManifestSample], dict[str, str | None]]:
    """Samples in order, and technologies by first appearance with their BED file (None: whole genome).

    The file is read as a table and checked by rules; everything that is wrong is said in one ManifestError. Relative
    VCF paths start from the manifest's folder. What comes back is a list, one entry per sample, as its files are opened.
    """
    try:
        rows = tab_table(spark, path, REQUIRED)
    except ValueError as e:
        raise ManifestError(str(e)) from None
    wrong = [(r["no"], r["problem"]) for r in manifest_problems(rows, "no").collect()]
    here = os.path.dirname(os.path.abspath(path))
    samples, techs = [], {}
    for r in rows.withColumn("codes", listed_codes(F.col("phenotype_codes"))).orderBy("no").collect():
        vcf, tech = os.path.join(here, r["vcf_path"] or ""), r["tech_name"] or ""
        whole_genome = tech.upper() == "WGS"
        bed = None if whole_genome else os.path.join(bed_dir or "", f"{tech}.bed")
        if r["vcf_path"] and not os.path.exists(vcf):
            wrong.append((r["no"], f"no such file {vcf}"))
        if tech and bed and tech not in techs and not (bed_dir and os.path.exists(bed)):
            wrong.append((r["no"], f"no capture regions of {tech!r}: " + (f"no such file {bed}" if bed_dir else "bed_dir was not given")))
        techs.setdefault(tech, bed)
        samples.append(ManifestSample(r["sample_name"], r["sex"], tech, vcf, tuple(r["codes"])))
    if not samples and not wrong:
        raise ManifestError(f"{path}: there are no samples")
    if wrong:
        raise ManifestError(f"{path}: {len(wrong)} problems: " + "; ".join(why for _, why in sorted(wrong)[:50]))
    return samples, techs


def read_bed(spark: SparkSession, paths: dict[int, str], kind: str = "int") -> DataFrame:
    """Capture intervals tech_id, chrom, start0, end0 of BED files by technology; comments and headers are skipped. kind: type of the positions."""
    empty = spark.createDataFrame([], f"tech_id int, chrom string, start0 {kind}, end0 {kind}")
    for tech_id, path in paths.items():
        c = F.split(F.col("value"), r"\s+")
        t = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|track\b|browser\b|$)"))
        empty = empty.unionByName(t.select(F.lit(tech_id).alias("tech_id"), c[0].alias("chrom"), c[1].cast(kind).alias("start0"), c[2].cast(kind).alias("end0")))
    return empty


def read_requests(path: str) -> list[tuple[str, int, str | None, str | None]]:
    """Batch file: chrom pos [ref [alt]] separated by white space, without header; a missing allele asks for any."""
    with open(path) as f:
        rows = [line.split() for line in f if line.strip()]
    return [(r[0], int(r[1]), r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None) for r in rows]


def read_updates(spark: SparkSession, path: str) -> list[dict[str, str]]:
    """Metadata updates: a tab-separated file with the columns sample_name, field, new_value; an update per line, in order."""
    rows = tab_table(spark, path, ("sample_name", "field", "new_value")).orderBy("no").drop("no").collect()
    return [{k: v or "" for k, v in r.asDict().items()} for r in rows]


def parse_locus(text: str) -> tuple[str, int]:
    """CHROM:POS"""
    chrom, _, pos = text.rpartition(":")
    if not chrom or not pos.replace(",", "").isdigit():
        raise ValueError(f"{text!r} is not CHROM:POS")
    return chrom, int(pos.replace(",", ""))


def parse_region(text: str) -> tuple[str, int, int]:
    """CHROM:START-END"""
    chrom, _, span = text.rpartition(":")
    a, dash, b = span.partition("-")
    if not chrom or not dash or not (a + b).isdigit():
        raise ValueError(f"{text!r} is not CHROM:START-END")
    return chrom, int(a), int(b)
