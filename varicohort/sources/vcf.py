"""VCF text as rows, with built-in functions only; plain or gzip files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from varicohort.functions.chrom import normalize_chrom
from varicohort.plans.annotate import INFO_FIELDS, info_text
from varicohort.session import can_broadcast, rows_table, write_lines

_BASES = r"^[ACGTNacgtn]+$"


def _plain_path(c: Column) -> Column:
    return F.regexp_replace(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), r"^file:/+", "/")


def _format_int(fields: Column, sample: Column, name: str) -> Column:
    """An integer of the sample by its FORMAT key; absent, not a number or negative gives null."""
    v = F.try_element_at(sample, F.nullif(F.array_position(fields, name), F.lit(0)).cast("int")).try_cast("int")
    return F.when(v >= 0, v)


def malformed(lines: DataFrame) -> DataFrame:
    """Body lines that are no single-sample records, with the reason: too few columns, or a position that is no number."""
    f = F.split("value", "\t")
    why = F.when(F.size(f) < 10, "columns").when(f[1].try_cast("int").isNull(), "position")
    return lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).withColumn("reason", why).where("reason IS NOT NULL")


def explode_calls(lines: DataFrame, strict: bool = True) -> DataFrame:
    """Ingested records of VCF body lines (sample_id, value): one per record and carried ALT.

    A malformed line (see ``malformed``) ends the job with its text, or is skipped if not ``strict``.

    Symbolic alleles and breakends are left out, ``*`` is skipped. Without a called allele a record that failed its
    filter gives one row per ALT with gt_ac 0, one that passed gives none. FILTER PASS or missing passes.
    """
    f = F.split("value", "\t")
    sound = (F.size("f") >= 10) & F.try_element_at("f", F.lit(2)).try_cast("int").isNotNull()
    if strict:
        sound = F.when(sound, True).otherwise(F.raise_error(F.concat(F.lit("malformed VCF line: "), F.substring("value", 1, 200))).cast("boolean"))
    r = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).withColumn("f", f).where(sound)
    r = r.select("sample_id", F.col("f")[0].alias("chrom"), F.col("f")[1].try_cast("int").alias("pos"), F.col("f")[3].alias("ref"), F.split(F.col("f")[4], ",").alias("alts"), F.col("f")[5].try_cast("float").alias("qual"), F.col("f")[6].isin("PASS", ".").alias("filter_pass"), F.split(F.col("f")[8], ":").alias("fmt"), F.split(F.col("f")[9], ":").alias("smp"))
    gt = F.try_element_at(F.col("smp"), F.nullif(F.array_position("fmt", "GT"), F.lit(0)).cast("int"))
    r = r.where(F.col("ref").rlike(_BASES) & F.col("pos").isNotNull()).withColumn("called", F.filter(F.split(F.coalesce(gt, F.lit(".")), r"[/|]"), lambda a: a.rlike(r"^\d+$")))
    r = r.select("*", _format_int(F.col("fmt"), F.col("smp"), "DP").alias("dp"), _format_int(F.col("fmt"), F.col("smp"), "GQ").alias("gq"), F.posexplode("alts").alias("no", "alt"))
    ac = F.size(F.filter("called", lambda a: a == (F.col("no") + 1).cast("string")))
    r = r.where(F.col("alt").rlike(_BASES)).withColumn("gt_ac", ac.cast("tinyint"))
    kept = (F.col("gt_ac") > 0) | ((F.size("called") == 0) & ~F.col("filter_pass"))
    return r.where(kept).select(normalize_chrom(F.col("chrom")).alias("chrom"), "pos", "ref", "alt", "gt_ac", "sample_id", "filter_pass", "dp", "gq", "qual")


def read_lines(spark: SparkSession, paths: dict[str, int]) -> DataFrame:
    """Lines of single-sample VCF files (path to sample id) with sample_id; files are read in parallel."""
    lines = spark.read.text(list(paths)).select("value", _plain_path(F.col("_metadata.file_path")).alias("path"))
    files = rows_table(spark, [(p, i) for p, i in paths.items()], "path string, sample_id int")
    return lines.join(F.broadcast(files) if can_broadcast(files) else files, "path")


def read_calls(spark: SparkSession, paths: dict[str, int]) -> DataFrame:
    """Ingested records of single-sample VCF files (path to sample id)."""
    if not paths:
        return spark.createDataFrame([], "chrom string, pos int, ref string, alt string, gt_ac tinyint, sample_id int, filter_pass boolean, dp int, gq int, qual float")
    return explode_calls(read_lines(spark, paths))


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """Records of a VCF in order: line_no, value, chrom, pos, ref, alts (null without ALT)."""
    t = spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id()).where(~F.col("value").startswith("#") & (F.col("value") != ""))
    f = F.split("value", "\t")
    return t.select("line_no", "value", f[0].alias("chrom"), f[1].cast("bigint").alias("pos"), f[3].alias("ref"), F.when(f[4] != ".", F.split(f[4], ",")).alias("alts"))


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Header lines of a VCF, in order; there are few, so they come to the driver."""
    return [r[0] for r in spark.read.text(path).where(F.col("value").startswith("#")).select("value").collect()]


def annotated_lines(sites: DataFrame, annotated: DataFrame, prefix: str = "COHORT_") -> DataFrame:
    """line_no and line: the records with the INFO fields added."""
    cells = F.split("value", "\t")
    cells = F.when(F.size(cells) >= 8, cells).otherwise(F.concat(cells, F.array_repeat(F.lit("."), F.lit(8) - F.size(cells))))
    old = F.element_at(cells, 8)
    info = F.when(old.isin("", "."), F.col("info")).otherwise(F.concat_ws(";", old, "info"))
    line = F.array_join(F.concat(F.slice(cells, 1, 7), F.array(info), F.slice(cells, 9, 1 << 30)), "\t")
    return sites.select("line_no", "value").join(info_text(annotated, prefix), "line_no", "left").select("line_no", line.alias("line"))


def write_annotated(sites: DataFrame, annotated: DataFrame, source: str, output: str, prefix: str = "COHORT_") -> None:
    """The records of ``source`` with the INFO fields added, in input order, as one VCF file at a path or URI.

    Sorted and formatted by the executors, see ``session.write_lines``.
    """
    head = header_of(sites.sparkSession, source)
    new = [f'##INFO=<ID={prefix}{k},Number={n},Type={t},Description="{d}">' for k, (n, t, d) in INFO_FIELDS.items()]
    at = next((i for i, x in enumerate(head) if x.startswith("#CHROM")), len(head))
    write_lines(annotated_lines(sites, annotated, prefix), [*head[:at], *new, *head[at:]], output, ["line_no"])
