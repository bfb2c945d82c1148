"""Query shapes: point, batch, region, carriers. All narrow the calls and use the one plan of ``measures``."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from varicohort.functions.chrom import BUCKET_BP, chrom_rank, normalize_chrom_text
from varicohort.operators.coverage import covering
from varicohort.operators.filters import SampleFilter
from varicohort.operators.measures import check_gates, flagged_samples, kit_gate, measures, per_technology
from varicohort.plans.cohort import VARIANT, Cohort
from varicohort.session import can_broadcast, rows_table

Key = tuple[int, str | None, str | None]


NARROW_BYTES = 32 << 20


def narrowed(cohort: Cohort, calls: DataFrame) -> DataFrame:
    """Calls of a few files in one task, if their size is known to be small: all that follows then needs no shuffle."""
    return calls.coalesce(1) if cohort.partitioned and can_broadcast(calls, NARROW_BYTES) else calls


def _near(chrom: str, start: int, end: int) -> str:
    """Condition on capture stretches that may cover positions of a range."""
    return f"chrom = '{normalize_chrom_text(chrom).replace(chr(92), '').replace(chr(39), '')}' AND start0 < {int(end)} AND end0 >= {int(start)}"


def slice_calls(cohort: Cohort, chrom: str, start: int, end: int) -> DataFrame:
    """Calls in an inclusive range; the bucket follows from the position, so that only its files are read."""
    c = cohort.calls.where((F.col("chrom") == normalize_chrom_text(chrom)) & F.col("pos").between(start, end))
    return c.where(F.col("bucket").between(start // BUCKET_BP, end // BUCKET_BP)) if cohort.partitioned else c


def point(cohort: Cohort, chrom: str, pos: int, sf: SampleFilter = SampleFilter(), ref: str | None = None, alt: str | None = None) -> DataFrame:
    """All stored alleles at a position; ref and alt may each be asked for."""
    c = slice_calls(cohort, chrom, pos, pos)
    for name, value in (("ref", ref), ("alt", alt)):
        if value is not None:
            c = c.where(F.col(name) == value)
    return measures(cohort, sf, narrowed(cohort, c), _near(chrom, pos, pos))


def region(cohort: Cohort, chrom: str, start: int, end: int, sf: SampleFilter = SampleFilter()) -> DataFrame:
    """Variants with start <= pos <= end."""
    return measures(cohort, sf, narrowed(cohort, slice_calls(cohort, chrom, start, end)), _near(chrom, start, end))


def region_multi(cohort: Cohort, regions: Iterable[tuple[str, int, int]], sf: SampleFilter = SampleFilter()) -> DataFrame:
    """Variants in any of the regions, each once however many regions it lies in.

    A few regions become a predicate that reaches the files; more are cut by bucket and semi-joined.
    """
    rs = sorted({(normalize_chrom_text(c), int(a), int(b)) for c, a, b in regions})
    calls = cohort.calls
    if len(rs) <= 64:
        cond = F.lit(False)
        for c, a, b in rs:
            one = (F.col("chrom") == c) & F.col("pos").between(a, b)
            cond = cond | (one & F.col("bucket").between(a // BUCKET_BP, b // BUCKET_BP) if cohort.partitioned else one)
        return measures(cohort, sf, narrowed(cohort, calls.where(cond)), " OR ".join(f"({_near(*x)})" for x in rs) or "false")
    r = rows_table(cohort.spark, rs, "r_chrom string, r_start bigint, r_end bigint").withColumn("r_bin", F.explode(F.sequence((F.col("r_start") / BUCKET_BP).cast("bigint"), (F.col("r_end") / BUCKET_BP).cast("bigint"))))
    inside = (F.col("chrom") == F.col("r_chrom")) & ((F.col("pos") / BUCKET_BP).cast("bigint") == F.col("r_bin")) & F.col("pos").between(F.col("r_start"), F.col("r_end"))
    return measures(cohort, sf, calls.join(F.broadcast(r) if can_broadcast(r) else r, inside, "left_semi"))


def _files_of(cohort: Cohort, keys: list[tuple[str, int, str | None, str | None]]) -> DataFrame:
    """Calls in the chromosomes and buckets of the keys: at most one list of buckets per chromosome, for pruning only."""
    where: dict[str, set[int]] = {}
    for c, p, *_ in keys:
        where.setdefault(normalize_chrom_text(c), set()).add(int(p) // BUCKET_BP)
    cond = F.lit(False)
    for c, buckets in sorted(where.items()):
        one = F.col("chrom") == c
        cond = cond | (one & F.col("bucket").isin(*sorted(buckets)) if cohort.partitioned else one)
    return narrowed(cohort, cohort.calls.where(cond))


def _requests(cohort: Cohort, keys: list[tuple[str, int, str | None, str | None]]) -> DataFrame:
    rows = [(i, normalize_chrom_text(c), int(p), r or None, a or None) for i, (c, p, r, a) in enumerate(keys)]
    return rows_table(cohort.spark, rows, "idx bigint, q_chrom string, q_pos bigint, q_ref string, q_alt string")


def batch_frame(cohort: Cohort, requests: DataFrame, sf: SampleFilter = SampleFilter(), calls: DataFrame | None = None) -> DataFrame:
    """Measures and ``idx`` for requested keys (idx, q_chrom, q_pos, q_ref, q_alt), each variant once with its least idx.

    A null allele asks for any. Keys without a stored variant, or with AN 0, give no row.
    """
    small = F.broadcast(requests) if can_broadcast(requests) else requests
    at = (F.col("chrom") == F.col("q_chrom")) & (F.col("pos") == F.col("q_pos"))
    key = at & (F.col("q_ref").isNull() | (F.col("ref") == F.col("q_ref"))) & (F.col("q_alt").isNull() | (F.col("alt") == F.col("q_alt")))
    m = measures(cohort, sf, (cohort.calls if calls is None else calls).join(small, key, "left_semi"))
    # the measures are constant within a variant: grouping by them keeps them without another join
    return m.join(small, key).groupBy(*m.columns).agg(F.min("idx").alias("idx"))


def batch(cohort: Cohort, chrom: str, keys: Iterable[Key], sf: SampleFilter = SampleFilter()) -> DataFrame:
    """Variants of one chromosome by exact key; repeated keys give one row."""
    return batch_multi(cohort, [(chrom, *k) for k in keys], sf).drop("idx")


def batch_multi(cohort: Cohort, keys: Iterable[tuple[str, int, str | None, str | None]], sf: SampleFilter = SampleFilter()) -> DataFrame:
    """Variants of several chromosomes with ``idx``, the place of the first request for it; spellings of a chromosome are one."""
    keys = list(keys)
    return batch_frame(cohort, _requests(cohort, keys), sf, _files_of(cohort, keys))


def variant_info(cohort: Cohort, chrom: str, pos: int, sf: SampleFilter = SampleFilter(), ref: str | None = None, alt: str | None = None) -> DataFrame:
    """Carriers of a variant: sample_id, sample_name, sex, tech_name, phenotypes, ref, alt, genotype, filter_pass.

    Carriers are taken from the whole sub-cohort, whether their kit covers the position or not: hom and het if the
    filter passed, alt with filter_pass false if a record failed. Samples of covering kits whose evidence gate fails
    are no_coverage with filter_pass null. The first of hom, het, fail, no_coverage counts for a sample and allele.
    """
    check_gates(cohort, sf)
    c = slice_calls(cohort, chrom, pos, pos)
    for name, value in (("ref", ref), ("alt", alt)):
        if value is not None:
            c = c.where(F.col(name) == value)
    flagged = flagged_samples(cohort, [sf])
    inside = flagged.where("inside")
    seen = c.where("is_het OR is_hom OR is_fail").join(inside.select("sample_id"), "sample_id")
    kind = F.when(F.col("is_fail"), "alt").when(F.col("is_hom"), "hom").otherwise("het")
    carriers = seen.select("sample_id", "ref", "alt", kind.alias("genotype"), (~F.col("is_fail")).alias("filter_pass"))
    on, fails = kit_gate(sf, cohort.quality.min_covered)
    if on:
        tech = per_technology(cohort, c, flagged)
        alleles = tech.groupBy(*VARIANT).agg(F.bool_or("has_class").alias("h")).where("h").drop("h")
        kits = covering(alleles.select("chrom", "pos").distinct(), cohort.capture).join(F.broadcast(cohort.technologies.where("NOT always_covered").select("tech_id")), "tech_id")
        grid = alleles.join(kits, ["chrom", "pos"]).join(tech.select(*VARIANT, "tech_id", "pass", "obs", "qp", "qp_all"), [*VARIANT, "tech_id"], "left").fillna(0, ["pass", "obs", "qp", "qp_all"])
        unsure = grid.where(fails).select("ref", "alt", "tech_id").join(inside.select("sample_id", "tech_id"), "tech_id").select("sample_id", "ref", "alt")
        unsure = unsure.join(carriers.select("sample_id", "ref", "alt"), ["sample_id", "ref", "alt"], "left_anti")
        carriers = carriers.unionByName(unsure.select("sample_id", "ref", "alt", F.lit("no_coverage").alias("genotype"), F.lit(None).cast("boolean").alias("filter_pass")))
    codes = cohort.sample_phenotype.groupBy("sample_id").agg(F.sort_array(F.collect_set("phenotype_code")).alias("phenotypes"))
    dims = cohort.samples.select("sample_id", "sample_name", "sex", "tech_id").join(cohort.technologies.select("tech_id", "tech_name"), "tech_id", "left")
    out = carriers.join(dims, "sample_id").join(codes, "sample_id", "left")
    return out.select("sample_id", "sample_name", "sex", "tech_name", F.coalesce("phenotypes", F.array().cast("array<string>")).alias("phenotypes"), "ref", "alt", "genotype", "filter_pass")


def genomic_order(df: DataFrame) -> DataFrame:
    return df.orderBy(chrom_rank(F.col("chrom")), "pos", "alt", "ref")
