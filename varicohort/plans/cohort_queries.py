"""The engine's queries on the derived cohort, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from varicohort.functions.chrom import bucket, chrom_rank, is_autosome, is_mito, is_sex_chrom, normalize_chrom
from varicohort.functions.ploidy import is_par, ploidy
from varicohort.operators import bitmaps as B
from varicohort.operators.coverage import covering, kit_patterns
from varicohort.operators.filters import SampleFilter
from varicohort.operators.measures import measures
from varicohort.plans import derived, queries as Q
from varicohort.plans.annotate import annotate, annotate_stats
from varicohort.plans.cohort import VARIANT, Quality
from varicohort.plans.export import BASE, build_groups, dump, dump_long
from varicohort.plans.star import QUALITY, TECHS, measures_sql, sql, star_cohort, star_ingested
from varicohort.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
ALL = SampleFilter()
V = "chrom, pos, ref, alt"


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], text: str) -> None:
    QUERIES[name], SQL[name] = run, text


def _code(*codes: str) -> str:
    return f"s.sample_id IN (SELECT sample_id FROM phen WHERE code IN ({', '.join(repr(c) for c in codes)}))"


def _measured(name: str, sf: SampleFilter = ALL, where: str = "true", variants: str = "true", run=None, build: str = "GRCh37", quality=None, **gates) -> None:
    q = quality or Quality()
    run = run or (lambda c: measures(c, sf))
    _add(name, lambda spark, d: run(star_cohort(spark, d, build, q)), sql(measures_sql(where, variants, build, q, **gates), "SELECT * FROM result"))


# --- measures and filters
_measured("af_all")
_measured("af_point", variants="chrom = 'chr1' AND pos = 27924", run=lambda c: Q.point(c, "1", 27924))
_measured("af_point_allele", variants="chrom = 'chr1' AND pos = 27924 AND alt = 'A'", run=lambda c: Q.point(c, "chr1", 27924, alt="A"))
_measured("af_region", variants="chrom = 'chrX' AND pos BETWEEN 500000 AND 2500000", run=lambda c: Q.region(c, "X", 500_000, 2_500_000))
f = SampleFilter.parse
_measured("filter_pheno_include", f(["BUILDING,Q1"]), _code("BUILDING", "Q1"))
_measured("filter_pheno_exclude", f(["^BUILDING"]), f"NOT ({_code('BUILDING')})")
_measured("filter_pheno_both", f(["Q1,Q2", "^MACHINERY"]), f"{_code('Q1', 'Q2')} AND NOT ({_code('MACHINERY')})")
_measured("filter_sex", f(sex="female"), "s.sex = 'female'")
_measured("filter_tech", f(tech=["KIT_A,KIT_B"]), "t.tech_name IN ('KIT_A', 'KIT_B')")
_measured("filter_tech_exclude", f(tech=["^WGS"]), "t.tech_name <> 'WGS'")
_measured("filter_combined", f(["Q0,Q3", "^BUILDING"], "male", ["^PANEL_C"]), f"{_code('Q0', 'Q3')} AND NOT ({_code('BUILDING')}) AND s.sex = 'male' AND t.tech_name <> 'PANEL_C'")
_measured("filter_unknown_code", f(["NONE"]), "false")
for chrom in ("chrX", "chrY", "chrM"):
    _measured(f"af_{chrom.lower()}", variants=f"chrom = '{chrom}'", run=lambda c, x=chrom: measures(c, ALL, c.calls.where(F.col("chrom") == x)))
_measured("af_grch38", build="GRCh38")
_measured("af_males_chrx", f(sex="male"), "s.sex = 'male'", "chrom = 'chrX'", lambda c: measures(c, SampleFilter(sex="male"), c.calls.where("chrom = 'chrX'")))

# --- evidence gates
_measured("nocov_min_pass", SampleFilter(min_pass=3), min_pass=3)
_measured("nocov_min_observed", SampleFilter(min_observed=5), min_observed=5)
_measured("nocov_min_quality", SampleFilter(min_quality_evidence=3), quality=QUALITY, min_quality_evidence=3)
_measured("nocov_min_covered", quality=QUALITY)
_measured("nocov_all", f(["^Q4"], "both", None, 2, 4, 3), f"NOT ({_code('Q4')})", quality=QUALITY, min_pass=2, min_observed=4, min_quality_evidence=3)

# --- query shapes
KEYS = [(27924, "T", "A"), (27924, "T", "C"), (59836, None, None), (27924, "T", "A"), (1, "A", "C"), (5, "A", "C")]
MULTI = [("X", 31913, None, None), ("1", 27924, "T", "A"), ("chrM", 7979, None, None), ("chrX", 31913, "A", "C"), ("MT", 7979, None, None), ("chr9", 5, None, None)]
REGIONS = [("chr1", 1, 200_000), ("1", 150_000, 400_000), ("chrY", 1, 10**7), ("X", 3_000_000, 3_100_000)]
_key = lambda ks: " OR ".join(f"(chrom = '{c}' AND pos = {p}" + (f" AND ref = '{r}' AND alt = '{a}'" if r else "") + ")" for c, p, r, a in ks)
_measured("batch", variants=_key([("chr1", *k) for k in KEYS]), run=lambda c: Q.batch(c, "1", KEYS))
_measured("batch_dedup", variants=_key([("chr1", *k) for k in KEYS[:2]]), run=lambda c: Q.batch(c, "chr1", [*KEYS[:2], *KEYS[:2]]))
_canon = {"X": "chrX", "1": "chr1", "MT": "chrM"}
_idx = "CASE " + " ".join(f"WHEN {_key([(_canon.get(c, c), p, r, a)])} THEN {i}" for i, (c, p, r, a) in enumerate(MULTI)) + " END"
_add("batch_multi", lambda spark, d: Q.batch_multi(star_cohort(spark, d), MULTI), sql(measures_sql(variants=_key([(_canon.get(c, c), p, r, a) for c, p, r, a in MULTI])), f"SELECT *, CAST({_idx} AS BIGINT) AS idx FROM result"))
_measured("region_multi", variants=" OR ".join(f"(chrom = '{_canon.get(c, c)}' AND pos BETWEEN {a} AND {b})" for c, a, b in REGIONS), run=lambda c: Q.region_multi(c, REGIONS))


def _flat_info(df: DataFrame) -> DataFrame:
    return df.withColumn("phenotypes", F.array_join("phenotypes", ","))


_INFO = """
SELECT c.sample_id, s.sample_name, s.sex, t.tech_name, (SELECT string_agg(code, ',' ORDER BY code) FROM phen p WHERE p.sample_id = c.sample_id) AS phenotypes, c.ref, c.alt,
  CASE WHEN c.fail THEN 'alt' WHEN c.hom THEN 'hom' ELSE 'het' END AS genotype, NOT c.fail AS filter_pass
FROM result_c c JOIN result_s f ON f.sample_id = c.sample_id JOIN samples s ON s.sample_id = c.sample_id JOIN tech t ON t.tech_id = s.tech_id
WHERE c.chrom = '{chrom}' AND c.pos = {pos} AND (c.het OR c.hom OR c.fail)"""
_add("variant_info", lambda spark, d: _flat_info(Q.variant_info(star_cohort(spark, d), "1", 27924, f(["^BUILDING"]))), sql(measures_sql(f"NOT ({_code('BUILDING')})", "chrom = 'chr1' AND pos = 27924"), _INFO.format(chrom="chr1", pos=27924)))
_add(
    "variant_info_nocov",
    lambda spark, d: _flat_info(Q.variant_info(star_cohort(spark, d), "chrX", 11968, SampleFilter(min_pass=4, min_observed=6))),
    sql(measures_sql("true", "chrom = 'chrX' AND pos = 11968"), _INFO.format(chrom="chrX", pos=11968) + """
UNION ALL
SELECT g.sample_id, s.sample_name, s.sex, te.tech_name, (SELECT string_agg(code, ',' ORDER BY code) FROM phen p WHERE p.sample_id = g.sample_id), g.ref, g.alt, 'no_coverage', NULL
FROM result_g g JOIN result_t t ON t.ref = g.ref AND t.alt = g.alt AND t.tech_id = g.tech_id JOIN samples s ON s.sample_id = g.sample_id JOIN tech te ON te.tech_id = s.tech_id
WHERE NOT g.always AND (t.n_pass < 4 OR t.n_obs < 6) AND NOT (g.het OR g.hom OR g.fail)"""),
)

# --- export and annotation
_BASE = ", ".join(BASE)
_add("dump", lambda spark, d: dump(star_cohort(spark, d)), sql(measures_sql(), f"SELECT {V}, {_BASE} FROM result WHERE AC > 0"))
_add("dump_all", lambda spark, d: dump(star_cohort(spark, d), f(["Q2"]), include_ac_zero=True), sql(measures_sql(_code("Q2")), f"SELECT {V}, {_BASE} FROM result"))
_add("dump_range", lambda spark, d: dump(star_cohort(spark, d), chrom="1", start=1_000_000), sql(measures_sql(variants="chrom = 'chr1' AND pos >= 1000000"), f"SELECT {V}, {_BASE} FROM result WHERE AC > 0"))


def _dump_sql(groups: list[tuple[str, str]], base: str = "true") -> str:
    parts = [measures_sql(base), *(measures_sql(w, name=f"g{i}", keep_an_zero=True) for i, (_, w) in enumerate(groups))]
    cols = [f"r.{c} AS {c}" for c in BASE]
    for i, (label, _) in enumerate(groups):
        cols += [f"coalesce(g{i}.{c}, {'0.0' if c == 'AF' else '0'}) AS \"{c}_{label}\"" for c in BASE]
    joins = " ".join(f"LEFT JOIN g{i} ON g{i}.chrom = r.chrom AND g{i}.pos = r.pos AND g{i}.ref = r.ref AND g{i}.alt = r.alt" for i in range(len(groups)))
    # AC / AN of a group without alleles is not a number there
    cols = [c.replace("coalesce(g", "coalesce(nullif(g", 1).replace(".AF, 0.0)", ".AF, 'nan'), 0.0)") if ".AF, 0.0)" in c else c for c in cols]
    return sql(", ".join(p.strip() for p in parts), f"SELECT r.chrom, r.pos, r.ref, r.alt, {', '.join(cols)} FROM result r {joins} WHERE r.AC > 0")


def _dump(base: SampleFilter = ALL, **axes) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        c = star_cohort(spark, d)
        return dump(c, base, build_groups(c, base, **axes))

    return run


_SEXES = [(s, f"s.sex = '{s}'") for s in ("male", "female")]
_KITS = [(n, f"t.tech_name = '{n}'") for n in sorted(n for _, n in TECHS)]
_add("dump_by_sex", _dump(by_sex=True), _dump_sql(_SEXES))
_add("dump_by_tech", _dump(by_tech=True), _dump_sql(_KITS))
_add("dump_by_phenotype", _dump(f(["Q0,Q1", "^MACHINERY"]), by_phenotype=["BUILDING", "Q1"]), _dump_sql([(c, f"{_code(c)} AND NOT ({_code('MACHINERY')})") for c in ("BUILDING", "Q1")], f"{_code('Q0', 'Q1')} AND NOT ({_code('MACHINERY')})"))


def _all_groups(spark: SparkSession, d: str) -> DataFrame:
    c = star_cohort(spark, d)
    return dump_long(c, ALL, build_groups(c, ALL, all_groups=True))


# every sex, technology and code: a row per variant and group, in sets again
_add(
    "dump_all_groups",
    _all_groups,
    sql(measures_sql(), f"""
SELECT {V}, label, CAST(coalesce(ac, 0) AS BIGINT) AS AC, CAST(coalesce(an, 0) AS BIGINT) AS AN, coalesce(ac / nullif(an, 0), 0.0) AS AF, coalesce(n_het, 0) AS N_HET, coalesce(n_hom, 0) AS N_HOM_ALT, coalesce(n - n_het - n_hom - n_fail, 0) AS N_HOM_REF, coalesce(n_fail, 0) AS N_FAIL, 0::BIGINT AS N_NO_COVERAGE
FROM (SELECT {V} FROM result WHERE AC > 0)
CROSS JOIN (SELECT sex || '_' || tech_name || '_' || code AS label, sex, tech_id, code FROM (VALUES ('male'), ('female')) x(sex), tech, (SELECT DISTINCT code FROM phen)) l
LEFT JOIN (SELECT {V}, sex, tech_id, code, sum(CASE WHEN p = 1 AND (het OR hom) THEN 1 WHEN p = 2 THEN CAST(het AS INT) + 2 * CAST(hom AS INT) ELSE 0 END) AS ac, sum(p) AS an, count(*) AS n, count(*) FILTER (WHERE het AND p = 2) AS n_het, count(*) FILTER (WHERE hom AND p = 2) + count(*) FILTER (WHERE (het OR hom) AND p = 1) AS n_hom, count(*) FILTER (WHERE fail) AS n_fail
  FROM (SELECT g.*, s.sex, f.code FROM result_g g JOIN samples s USING (sample_id) JOIN phen f USING (sample_id)) GROUP BY ALL) m USING ({V}, sex, tech_id, code)"""),
)


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Input variants: every part's variant as a record, each third one moved by one base, alleles of a position together."""
    p = star_ingested(spark, d).select(*VARIANT).distinct()
    p = p.withColumn("pos", F.when(F.col("pos") % 3 == 0, F.col("pos") + 1).otherwise(F.col("pos")))
    return p.groupBy("chrom", "pos", "ref").agg(F.sort_array(F.collect_set("alt")).alias("alts")).withColumn("line_no", F.col("pos").cast("bigint") * 10 + chrom_rank(F.col("chrom")) % 10)


_ANNOTATED = """
, shifted AS (SELECT DISTINCT chrom, CASE WHEN pos % 3 = 0 THEN pos + 1 ELSE pos END AS pos, ref, alt FROM calls),
rk AS (SELECT s.*, row_number() OVER (PARTITION BY chrom, pos, ref ORDER BY alt) - 1 AS alt_no, CAST(pos AS BIGINT) * 10 + CASE chrom WHEN 'chr1' THEN 1 WHEN 'chr2' THEN 2 WHEN 'chrX' THEN 3 WHEN 'chrY' THEN 4 ELSE 5 END AS line_no FROM shifted s),
apos AS (SELECT DISTINCT chrom, pos FROM shifted),
acov AS (SELECT DISTINCT p.chrom, p.pos, t.tech_id FROM apos p JOIN tech t ON t.always OR EXISTS (SELECT 1 FROM capture c WHERE c.tech_id = t.tech_id AND c.chrom = p.chrom AND p.pos > c.start0 AND p.pos <= c.end0)),
aan AS (SELECT k.chrom, k.pos, count(*) AS n, sum(CASE WHEN k.chrom = 'chrM' THEN 1 WHEN k.chrom = 'chrY' THEN CASE WHEN s.sex = 'male' THEN 1 ELSE 0 END WHEN k.chrom = 'chrX' AND s.sex = 'male' AND NOT (k.pos BETWEEN 60001 AND 2699520 OR k.pos BETWEEN 154931044 AND 155260560) THEN 1 ELSE 2 END) AS an
  FROM acov k JOIN result_s s ON s.tech_id = k.tech_id GROUP BY ALL),
ann AS (SELECT rk.line_no, CAST(rk.alt_no AS INT) AS alt_no, rk.chrom, rk.pos, rk.ref, rk.alt, r.AN IS NOT NULL AS stored, coalesce(a.an, 0) > 0 AS covered, coalesce(r.AC, 0) AS ac, CAST(coalesce(a.an, 0) AS BIGINT) AS an, coalesce(r.AF, 0.0) AS af,
  coalesce(r.N_HET, 0) AS n_het, coalesce(r.N_HOM_ALT, 0) AS n_hom_alt, coalesce(r.N_HOM_REF, a.n) AS n_hom_ref, coalesce(r.N_FAIL, 0) AS n_fail, coalesce(r.N_NO_COVERAGE, 0) AS n_no
  FROM rk LEFT JOIN aan a ON a.chrom = rk.chrom AND a.pos = rk.pos LEFT JOIN result r ON r.chrom = rk.chrom AND r.pos = rk.pos AND r.ref = rk.ref AND r.alt = rk.alt)
"""
_add(
    "annotate",
    lambda spark, d: annotate(star_cohort(spark, d), _records(spark, d), f(sex="female", min_pass=2)),
    sql(measures_sql("s.sex = 'female'", min_pass=2) + _ANNOTATED, "SELECT line_no, alt_no, chrom, pos, ref, alt, stored, an AS AN, " + ", ".join(f"CASE WHEN covered THEN {c} END AS {n}" for c, n in (("ac", "AC"), ("af", "AF"), ("n_het", "N_HET"), ("n_hom_alt", "N_HOM_ALT"), ("n_hom_ref", "N_HOM_REF"), ("n_fail", "N_FAIL"), ("n_no", "N_NO_COVERAGE"))) + " FROM ann"),
)
_add(
    "annotate_stats",
    lambda spark, d: annotate_stats(annotate(star_cohort(spark, d), _records(spark, d), f(sex="female", min_pass=2))),
    sql(measures_sql("s.sex = 'female'", min_pass=2) + _ANNOTATED, "SELECT count(*) AS n_variants, count(*) FILTER (WHERE stored) AS n_annotated, count(*) FILTER (WHERE an = 0) AS n_uncovered FROM (SELECT line_no, max(an) AS an, bool_or(stored) AS stored FROM ann GROUP BY line_no)"),
)

# --- coverage and ploidy
_POSITIONS = "(SELECT DISTINCT chrom, pos FROM calls)"
_add("capture_cover", lambda spark, d: (lambda c: covering(c.calls.select("chrom", "pos").distinct(), c.capture))(star_cohort(spark, d)), sql("x AS (SELECT 1)", f"SELECT DISTINCT p.chrom, p.pos, c.tech_id FROM {_POSITIONS} p JOIN capture c ON c.chrom = p.chrom AND p.pos > c.start0 AND p.pos <= c.end0"))
_add(
    "kits_per_position",
    lambda spark, d: (lambda c: kit_patterns(c.calls, c.capture, c.technologies))(star_cohort(spark, d)),
    sql("x AS (SELECT 1)", f"SELECT p.chrom, p.pos, count(DISTINCT t.tech_name) AS n_kits, coalesce(string_agg(DISTINCT t.tech_name, '+' ORDER BY t.tech_name), '') AS kit_pattern FROM {_POSITIONS} p LEFT JOIN capture c ON c.chrom = p.chrom AND p.pos > c.start0 AND p.pos <= c.end0 LEFT JOIN tech t ON t.tech_id = c.tech_id GROUP BY p.chrom, p.pos"),
)
_add("par_flag", lambda spark, d: star_cohort(spark, d).calls.select("chrom", "pos").distinct().select("chrom", "pos", F.expr(is_par("chrom", "pos", "GRCh37")).alias("par37"), F.expr(is_par("chrom", "pos", "GRCh38")).alias("par38")), sql("x AS (SELECT 1)", f"SELECT chrom, pos, chrom = 'chrX' AND (pos BETWEEN 60001 AND 2699520 OR pos BETWEEN 154931044 AND 155260560) OR chrom = 'chrY' AND (pos BETWEEN 10001 AND 2649520 OR pos BETWEEN 59034050 AND 59363566) AS par37, chrom = 'chrX' AND (pos BETWEEN 10001 AND 2781479 OR pos BETWEEN 155701383 AND 156030895) OR chrom = 'chrY' AND (pos BETWEEN 10001 AND 2781479 OR pos BETWEEN 56887903 AND 57217415) AS par38 FROM {_POSITIONS}"))
_add("ploidy_split", lambda spark, d: (lambda c: c.calls.join(c.samples, "sample_id").groupBy("chrom", "sex", F.expr(ploidy("chrom", "pos", "sex", "GRCh37")).alias("p")).agg(F.count("*").alias("n")))(star_cohort(spark, d)), sql("x AS (SELECT 1)", "SELECT chrom, sex, CASE WHEN chrom = 'chrM' THEN 1 WHEN chrom = 'chrY' THEN CASE WHEN sex = 'male' THEN 1 ELSE 0 END WHEN chrom = 'chrX' AND sex = 'male' AND NOT (pos BETWEEN 60001 AND 2699520 OR pos BETWEEN 154931044 AND 155260560) THEN 1 ELSE 2 END AS p, count(*) AS n FROM calls JOIN samples USING (sample_id) GROUP BY ALL"))

# --- ingest and index
_add("gt_classes", lambda spark, d: star_cohort(spark, d).calls.groupBy("chrom").agg(*(F.count_if(c).alias(f"n_{c[3:]}") for c in ("is_het", "is_hom", "is_fail"))), sql("x AS (SELECT 1)", "SELECT chrom, count(*) FILTER (WHERE filter_pass AND gt_ac = 1) AS n_het, count(*) FILTER (WHERE filter_pass AND gt_ac = 2) AS n_hom, count(*) FILTER (WHERE NOT filter_pass) AS n_fail FROM calls GROUP BY chrom"))
_add("quality_pass", lambda spark, d: star_cohort(spark, d, quality=QUALITY).calls.where("is_qp").groupBy(*VARIANT).agg(F.count("*").alias("n_qp")), sql("x AS (SELECT 1)", f"SELECT {V}, count(*) AS n_qp FROM calls WHERE gt_ac > 0 AND filter_pass AND coalesce(dp >= 20, false) AND gq >= 20 AND qual >= 15000 GROUP BY ALL"))
_add("bucket_counts", lambda spark, d: star_cohort(spark, d).calls.groupBy("chrom", bucket(F.col("pos")).alias("bucket")).agg(F.count("*").alias("n_calls"), F.countDistinct("pos", "ref", "alt").alias("n_variants")), sql("x AS (SELECT 1)", "SELECT chrom, CAST(pos // 1000000 AS BIGINT) AS bucket, count(*) AS n_calls, count(DISTINCT (pos, ref, alt)) AS n_variants FROM calls GROUP BY ALL"))
_add("bitmap_cardinality", lambda spark, d: _bitmaps(star_cohort(spark, d)), sql("x AS (SELECT 1)", f"SELECT {V}, count(*) AS n_stored, count(*) FILTER (WHERE filter_pass) AS n_carriers, count(*) FILTER (WHERE filter_pass AND sex = 'female') AS n_female_carriers FROM calls JOIN samples USING (sample_id) WHERE NOT filter_pass OR gt_ac IN (1, 2) GROUP BY ALL"))
_add("stored_variants", lambda spark, d: star_cohort(spark, d).calls.where("is_het OR is_hom OR is_fail").select(*VARIANT).distinct(), sql("x AS (SELECT 1)", f"SELECT DISTINCT {V} FROM calls WHERE NOT filter_pass OR gt_ac IN (1, 2)"))
_add("normalize_chrom", lambda spark, d: table(spark, d, "calls").select("chrom", normalize_chrom(F.col("chrom")).alias("canonical"), is_autosome(F.col("chrom")).alias("autosome"), is_sex_chrom(F.col("chrom")).alias("sex_chrom"), is_mito(F.col("chrom")).alias("mito")).groupBy("chrom", "canonical", "autosome", "sex_chrom", "mito").agg(F.count("*").alias("n")), "WITH c AS (SELECT chrom, CASE WHEN upper(trim(chrom)) = 'MT' THEN 'chrM' WHEN trim(chrom) LIKE 'chr%' THEN trim(chrom) ELSE 'chr' || trim(chrom) END AS canonical FROM calls) SELECT chrom, canonical, regexp_full_match(canonical, 'chr([1-9]|1[0-9]|2[0-2])') AS autosome, canonical IN ('chrX', 'chrY') AS sex_chrom, canonical = 'chrM' AS mito, count(*) AS n FROM c GROUP BY ALL")


def _bitmaps(c) -> DataFrame:
    """Sizes of the sets of all samples with a call, of the carriers, and of the carriers that are female."""
    carriers = B.bitmaps(c.calls.where("is_het OR is_hom"), VARIANT, "sample_id")
    failed = B.bitmaps(c.calls.where("is_fail"), VARIANT, "sample_id")
    females = B.bitmaps(c.samples.where("sex = 'female'"), [], "sample_id")
    out = B.cardinality(B.union(carriers, failed, VARIANT), VARIANT, "n_stored")
    for name, m in (("n_carriers", carriers), ("n_female_carriers", B.restrict(carriers, females, VARIANT))):
        out = out.join(B.cardinality(m, VARIANT, name), VARIANT, "left")
    return out.fillna(0, ["n_carriers", "n_female_carriers"])


# --- mutations, as relations before and after
def _old_and_new(c, cut: int = 500):
    return c.calls.where(F.col("sample_id") < cut), c.calls.where(F.col("sample_id") >= cut)


def _add_samples(spark: SparkSession, d: str) -> DataFrame:
    from varicohort.plans.maintain import merge_counts

    return merge_counts(*_old_and_new(star_cohort(spark, d)))


_STORED = f"SELECT DISTINCT {V} FROM calls WHERE (NOT filter_pass OR gt_ac IN (1, 2))"
_add("add_samples_merge", _add_samples, sql(f"o AS ({_STORED} AND sample_id < 500), n AS ({_STORED} AND sample_id >= 500)", "SELECT n.chrom, count(*) FILTER (WHERE o.pos IS NULL) AS n_new, count(*) FILTER (WHERE o.pos IS NOT NULL) AS n_updated FROM n LEFT JOIN o ON o.chrom = n.chrom AND o.pos = n.pos AND o.ref = n.ref AND o.alt = n.alt GROUP BY n.chrom"))
# --- derived analyses; the thresholds fit the derived cohort, whose largest AF is a few per cent
_T = dict(ba1=0.02, bs1=0.01, pm2=0.002)
_CLASS = "CASE WHEN {p}AF IS NULL THEN NULL WHEN {p}AF > 0.02 THEN 'BA1' WHEN {p}AF > 0.01 THEN 'BS1' WHEN {p}AF <= 0.002 THEN 'PM2' ELSE 'neutral' END"
_add("acmg_class", lambda spark, d: measures(star_cohort(spark, d), ALL).select(*VARIANT, derived.frequency_class(F.col("AC"), F.col("AF"), **_T).alias("cls"), derived.rare_enough(F.col("AN"), F.col("AC"), 1000).alias("pm2_supported")), sql(measures_sql(), f"SELECT {V}, {_CLASS.format(p='')} AS cls, AC = 0 AND AN >= 1000 AS pm2_supported FROM result"))
_PAIR = measures_sql("t.tech_name = 'WGS'", name="a").strip() + ", " + measures_sql(name="b").strip() + f", pairs AS (SELECT {', '.join(f'coalesce(a.{c}, b.{c}) AS {c}' for c in VARIANT)}, coalesce(a.AC, 0) AS a_AC, coalesce(a.AN, 0) AS a_AN, a.AF AS a_AF, coalesce(b.AC, 0) AS b_AC, coalesce(b.AN, 0) AS b_AN, b.AF AS b_AF FROM a FULL OUTER JOIN b ON a.chrom = b.chrom AND a.pos = b.pos AND a.ref = b.ref AND a.alt = b.alt)"
_pair = lambda spark, d: derived.compare(star_cohort(spark, d), SampleFilter(tech_include=("WGS",)), ALL)
_classes = lambda df: df.select(derived.frequency_class(F.col("a_AC"), F.col("a_AF"), **_T).alias("truth"), derived.frequency_class(F.col("b_AC"), F.col("b_AF"), **_T).alias("pred"))
_CLASSES = f"SELECT {_CLASS.format(p='a_')} AS truth, {_CLASS.format(p='b_')} AS pred FROM pairs"
_add("outer_compare", _pair, sql(_PAIR, "SELECT * FROM pairs"))
_add("acmg_confusion", lambda spark, d: derived.confusion(_classes(_pair(spark, d)), "truth", "pred"), sql(_PAIR, f"SELECT truth, pred, count(*) AS n FROM ({_CLASSES}) GROUP BY ALL"))
_RANK = "CASE {c} WHEN 'BA1' THEN 3 WHEN 'BS1' THEN 2 WHEN 'neutral' THEN 1 WHEN 'PM2' THEN 0 END"
_add("directional_errors", lambda spark, d: derived.directional_errors(_classes(_pair(spark, d)), "truth", "pred"), sql(_PAIR, f"SELECT count(*) AS n, count(*) FILTER (WHERE p < t) / count(*) AS toward_pathogenic, count(*) FILTER (WHERE p > t) / count(*) AS toward_benign, count(*) FILTER (WHERE t >= 2 AND p >= 2) / count(*) FILTER (WHERE t >= 2) AS bs1_recall FROM (SELECT {_RANK.format(c='truth')} AS t, {_RANK.format(c='pred')} AS p FROM ({_CLASSES})) WHERE t IS NOT NULL AND p IS NOT NULL"))
_add("concordance_r2", lambda spark, d: derived.concordance(_pair(spark, d)), sql(_PAIR, "SELECT count(*) FILTER (WHERE ok) AS n, 1 - sum((a_AF - b_AF) ** 2) FILTER (WHERE ok) / (var_pop(a_AF) FILTER (WHERE ok) * count(*) FILTER (WHERE ok)) AS r2, count(*) FILTER (WHERE ok AND a_AC <> b_AC) AS ac_mismatch, count(*) FILTER (WHERE ok AND a_AN <> b_AN) AS an_mismatch, count(*) FILTER (WHERE b_AF IS NULL) AS only_a, count(*) FILTER (WHERE a_AF IS NULL) AS only_b FROM (SELECT *, a_AF IS NOT NULL AND b_AF IS NOT NULL AS ok FROM pairs)"))
_add("enrichment_ratio", lambda spark, d: derived.enrichment(derived.compare(star_cohort(spark, d), f(["BUILDING"]), f(["^BUILDING"])), 100).select(*VARIANT, "ratio"), sql(measures_sql(_code("BUILDING"), name="a").strip() + ", " + measures_sql(f"NOT ({_code('BUILDING')})", name="b").strip(), "SELECT coalesce(a.chrom, b.chrom) AS chrom, coalesce(a.pos, b.pos) AS pos, coalesce(a.ref, b.ref) AS ref, coalesce(a.alt, b.alt) AS alt, CASE WHEN a.AN >= 100 AND b.AN >= 100 AND b.AF > 0 THEN a.AF / b.AF END AS ratio FROM a FULL OUTER JOIN b ON a.chrom = b.chrom AND a.pos = b.pos AND a.ref = b.ref AND a.alt = b.alt"))
_add("sex_af_ratio", lambda spark, d: derived.enrichment(derived.compare(star_cohort(spark, d), f(sex="female"), f(sex="male"))).select(*VARIANT, "a_AF", "b_AF", "ratio"), sql(measures_sql("s.sex = 'female'", name="a").strip() + ", " + measures_sql("s.sex = 'male'", name="b").strip(), "SELECT coalesce(a.chrom, b.chrom) AS chrom, coalesce(a.pos, b.pos) AS pos, coalesce(a.ref, b.ref) AS ref, coalesce(a.alt, b.alt) AS alt, a.AF AS a_AF, b.AF AS b_AF, CASE WHEN b.AF > 0 THEN a.AF / b.AF END AS ratio FROM a FULL OUTER JOIN b ON a.chrom = b.chrom AND a.pos = b.pos AND a.ref = b.ref AND a.alt = b.alt"))
_add("qc_fail_band", lambda spark, d: measures(star_cohort(spark, d), ALL).groupBy(derived.qc_band(F.col("N_FAIL"), F.col("n_eligible")).alias("band")).agg(F.count("*").alias("n"), F.sum("N_FAIL").alias("n_fail")), sql(measures_sql(), "SELECT CASE WHEN N_FAIL / n_eligible < 0.05 THEN 'ok' WHEN N_FAIL / n_eligible <= 0.15 THEN 'review' ELSE 'bad' END AS band, count(*) AS n, CAST(sum(N_FAIL) AS BIGINT) AS n_fail FROM result GROUP BY ALL"))


def _naive(spark: SparkSession, d: str) -> DataFrame:
    c = star_cohort(spark, d)
    return derived.naive_versus_aware(measures(c, ALL), c.samples.count())


_NAIVE = measures_sql().strip() + f", naive AS (SELECT {V}, AC, AN, AF, 2 * (SELECT count(*) FROM samples) AS naive_AN, AC / (2 * (SELECT count(*) FROM samples)) AS naive_AF FROM result)"
_add("naive_vs_aware", _naive, sql(_NAIVE, "SELECT * FROM naive"))


def _errors(spark: SparkSession, d: str) -> DataFrame:
    c = star_cohort(spark, d)
    kits = kit_patterns(c.calls, c.capture, c.technologies)
    return derived.error_metrics(_naive(spark, d).join(kits, ["chrom", "pos"]), "AF", "naive_AF", ["n_kits"])


_add("error_metrics", _errors, sql(_NAIVE + f", kits AS (SELECT p.chrom, p.pos, count(DISTINCT c.tech_id) AS n_kits FROM {_POSITIONS} p LEFT JOIN capture c ON c.chrom = p.chrom AND p.pos > c.start0 AND p.pos <= c.end0 GROUP BY p.chrom, p.pos), e AS (SELECT n_kits, abs(naive_AF - AF) AS e FROM naive n JOIN kits k ON k.chrom = n.chrom AND k.pos = n.pos)", "SELECT n_kits, count(*) AS n, avg(e) AS mae, median(e) AS median_ae, max(e) AS max_ae, sqrt(avg(e * e)) AS rmse FROM e GROUP BY n_kits"))
