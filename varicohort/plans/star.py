"""A deterministic cohort derived from the star-schema tables, as DataFrames and as DuckDB SQL.

The driver has no genomic tables; this derivation gives every operator of the engine data with an oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from varicohort.plans.cohort import Cohort, Quality, make_cohort
from varicohort.session import rows_table, table

QUALITY = Quality(min_dp=20, min_gq=20, min_qual=15000.0, min_covered=2)
# Fixed values of the derivation: technologies, of which 0 covers everything; bases; chromosomes with capture regions.
TECHS = [(0, "WGS"), (1, "KIT_A"), (2, "KIT_B"), (3, "PANEL_C")]
BASES = "ACGT"
CAPTURED = ["chr1", "chr2", "chrX", "chrY"]
STEP, WIDTH, SPACING = 40_000, 25_000, 3_989
INT_MAX, ROOM = (1 << 31) - 1, 10_000  # bed_regions moves capture regions by ROOM


def _last_part(spark: SparkSession, sf_dir: str) -> int | None:
    return table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0]


def positions_type(last: int) -> str:
    """int, as in the SQL, if positions up to ``last`` fit; else bigint, where the SQL's casts overflow."""
    return "int" if last <= INT_MAX else "bigint"


def star_ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingested records in INGEST_SCHEMA order, one per (variant, customer).

    A part is a variant, so the lines are grouped by numbers, where the join with the parts has left them, and get their
    variant afterwards. try: a condition on variants may be evaluated on lines without a part, whose keys fit in nothing.
    """
    k = F.col("p_partkey")
    g = F.expr("(p_partkey - p_partkey % 2) div 2")
    base = lambda k: F.element_at(F.array(*map(F.lit, BASES)), (k % 4 + 1).cast("int"))
    chrom = F.when((g % 8).isin(0, 3), "chrX").when(g % 8 == 1, "chrY").when(g % 8 == 2, "chrM").when(g % 8 == 4, "chr2").otherwise("chr1")
    kind = positions_type((_last_part(spark, sf_dir) or 0) // 2 * SPACING + 1)
    pos = F.try_add(F.try_multiply(g, F.lit(SPACING)), F.lit(1)).try_cast(kind)
    parts = table(spark, sf_dir, "part").groupBy("p_partkey").agg(F.count("*").alias("times"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(parts, li.l_partkey == parts.p_partkey)
    return j.groupBy("p_partkey", "o_custkey").agg(
        F.when(F.sum("times") >= 3, 3).when(F.bool_or(F.col("l_linenumber") % 3 == 0), 2).otherwise(1).cast("tinyint").alias("gt_ac"),
        (~F.bool_or(F.col("l_returnflag") == "R")).alias("filter_pass"),
        F.when(F.max("l_linenumber") < 7, F.max("l_quantity").cast("int")).alias("dp"),
        (10 * F.max("l_linenumber")).cast("int").alias("gq"),
        F.max("l_extendedprice").cast("float").alias("qual"),
    ).select(chrom.alias("chrom"), pos.alias("pos"), base(g).alias("ref"), base(g + 1 + k % 2).alias("alt"), "gt_ac", F.col("o_custkey").cast("int").alias("sample_id"), "filter_pass", "dp", "gq", "qual")


def _capture(spark: SparkSession, last: int | None) -> DataFrame:
    """Capture regions up to the last part, from ranges, as the optimizer knows their size: it would take that of an exploded sequence for one row's."""
    kind = positions_type((last or 0) * SPACING + WIDTH + ROOM)
    chroms = F.array(*map(F.lit, CAPTURED))
    kits = []
    for t in (1, 2, 3):
        n = 0 if last is None else last * SPACING // (STEP * t) + 1
        at = F.floor(F.col("id") / len(CAPTURED)) * STEP * t
        kits.append(spark.range(n * len(CAPTURED)).select(F.lit(t).alias("tech_id"), F.get(chroms, (F.col("id") % len(CAPTURED)).cast("int")).alias("chrom"), at.cast(kind).alias("start0"), (at + WIDTH).cast(kind).alias("end0")))
    return kits[0].unionByName(kits[1]).unionByName(kits[2])


def star_cohort(spark: SparkSession, sf_dir: str, build: str = "GRCh37", quality: Quality = Quality()) -> Cohort:
    c = table(spark, sf_dir, "customer")
    sid = F.col("c_custkey").cast("int")
    samples = c.select(sid.alias("sample_id"), F.concat(F.lit("S"), F.col("c_custkey")).alias("sample_name"), F.when(F.col("c_custkey") % 2 == 0, "male").otherwise("female").alias("sex"), (F.col("c_nationkey") % 4).cast("int").alias("tech_id"))
    codes = c.select(sid.alias("sample_id"), F.explode(F.array("c_mktsegment", F.concat(F.lit("Q"), F.col("c_custkey") % 5))).alias("phenotype_code"))
    tech = rows_table(spark, [(i, n, i == 0) for i, n in TECHS], "tech_id int, tech_name string, always_covered boolean")
    capture = _capture(spark, _last_part(spark, sf_dir))
    return make_cohort(star_ingested(spark, sf_dir), samples, codes, tech, capture, build, quality, clean=True)


COHORT_SQL = f"""
samples AS (SELECT CAST(c_custkey AS INT) AS sample_id, 'S' || c_custkey AS sample_name, CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS sex, CAST(c_nationkey % 4 AS INT) AS tech_id FROM customer),
phen AS (SELECT CAST(c_custkey AS INT) AS sample_id, c_mktsegment AS code FROM customer UNION SELECT CAST(c_custkey AS INT), 'Q' || (c_custkey % 5) FROM customer),
tech(tech_id, tech_name, always) AS (VALUES {", ".join(f"({i}, '{n}', {i == 0})" for i, n in TECHS)}),
part_v AS (SELECT p_partkey, (p_partkey - p_partkey % 2) // 2 AS g FROM part),
pv AS (SELECT p_partkey, CASE WHEN g % 8 IN (0, 3) THEN 'chrX' WHEN g % 8 = 1 THEN 'chrY' WHEN g % 8 = 2 THEN 'chrM' WHEN g % 8 = 4 THEN 'chr2' ELSE 'chr1' END AS chrom,
  CAST(g * {SPACING} + 1 AS INT) AS pos, substr('{BASES}', CAST(g % 4 + 1 AS INT), 1) AS ref, substr('{BASES}', CAST((g + 1 + p_partkey % 2) % 4 + 1 AS INT), 1) AS alt FROM part_v),
calls AS (SELECT chrom, pos, ref, alt, CAST(o_custkey AS INT) AS sample_id,
  CASE WHEN count(*) >= 3 THEN 3 WHEN bool_or(l_linenumber % 3 = 0) THEN 2 ELSE 1 END AS gt_ac, NOT bool_or(l_returnflag = 'R') AS filter_pass,
  CASE WHEN max(l_linenumber) < 7 THEN CAST(trunc(max(l_quantity)) AS INT) END AS dp, CAST(10 * max(l_linenumber) AS INT) AS gq, CAST(max(l_extendedprice) AS FLOAT) AS qual
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN pv ON l_partkey = p_partkey GROUP BY ALL),
capture AS (SELECT t AS tech_id, chrom, CAST(k * {STEP} * t AS INT) AS start0, CAST(k * {STEP} * t + {WIDTH} AS INT) AS end0
  FROM (SELECT t, chrom, unnest(range(CAST((SELECT max(p_partkey) FROM part) * {SPACING} // ({STEP} * t) + 1 AS BIGINT))) AS k
    FROM (VALUES (1), (2), (3)) x(t), (VALUES {", ".join(f"('{c}')" for c in CAPTURED)}) y(chrom)))
"""


def measures_sql(
    where: str = "true",
    variants: str = "true",
    build: str = "GRCh37",
    quality: Quality = Quality(),
    min_pass: int = 0,
    min_observed: int = 0,
    min_quality_evidence: int = 0,
    calls: str = "SELECT * FROM calls",
    samples: str = "SELECT * FROM samples",
    phen: str = "SELECT * FROM phen",
    name: str = "result",
    keep_an_zero: bool = False,
) -> str:
    """CTEs up to ``name``: the measures by plain sets, sample by sample.

    where: condition on s (a row of samples with tech_name); variants: condition on chrom, pos, ref, alt.
    """
    par = {"GRCh37": "pos BETWEEN 60001 AND 2699520 OR pos BETWEEN 154931044 AND 155260560", "GRCh38": "pos BETWEEN 10001 AND 2781479 OR pos BETWEEN 155701383 AND 156030895"}[build]
    q = quality
    qp = " AND ".join(["gt_ac > 0 AND filter_pass", *(f"coalesce({c} >= {v}, false)" for c, v in (("dp", q.min_dp), ("gq", q.min_gq), ("qual", q.min_qual)) if v > 0)])
    gates = []
    if min_pass or min_observed:
        gates.append(f"n_pass < {min_pass} OR n_obs < {min_observed}")
    if q.min_covered:
        gates.append(f"coalesce(qp_all, 0) < {q.min_covered}")
    if min_quality_evidence:
        gates.append(f"n_qp < {min_quality_evidence}")
    n = name
    return f"""
{n}_c AS (SELECT chrom, pos, ref, alt, sample_id, bool_or(coalesce(filter_pass, false) AND coalesce(gt_ac, 0) = 1) AS het, bool_or(coalesce(filter_pass, false) AND coalesce(gt_ac, 0) = 2) AS hom, bool_or(NOT coalesce(filter_pass, false)) AS fail, bool_or(coalesce({qp}, false)) AS qp FROM ({calls}) GROUP BY ALL),
{n}_s0 AS ({samples}), {n}_p0 AS ({phen}),
{n}_s AS (SELECT s.sample_id, s.sex, s.tech_id, t.always FROM {n}_s0 s JOIN tech t ON t.tech_id = s.tech_id WHERE s.sex IN ('male', 'female') AND ({where.replace("phen", f"{n}_p0")})),
{n}_v AS (SELECT DISTINCT chrom, pos, ref, alt FROM {n}_c WHERE (het OR hom OR fail) AND ({variants})),
{n}_k AS (SELECT DISTINCT p.chrom, p.pos, t.tech_id FROM (SELECT DISTINCT chrom, pos FROM {n}_v) p JOIN tech t ON t.always OR EXISTS (SELECT 1 FROM capture c WHERE c.tech_id = t.tech_id AND c.chrom = p.chrom AND p.pos > c.start0 AND p.pos <= c.end0)),
{n}_g AS (SELECT v.chrom, v.pos, v.ref, v.alt, s.tech_id, s.always, s.sample_id,
  CASE WHEN v.chrom = 'chrM' THEN 1 WHEN v.chrom = 'chrY' THEN CASE WHEN s.sex = 'male' THEN 1 ELSE 0 END WHEN v.chrom = 'chrX' AND s.sex = 'male' AND NOT ({par.replace("pos", "v.pos")}) THEN 1 ELSE 2 END AS p,
  coalesce(c.het, false) AS het, coalesce(c.hom, false) AS hom, coalesce(c.fail, false) AS fail, coalesce(c.qp, false) AS qp
  FROM {n}_v v JOIN {n}_k k ON k.chrom = v.chrom AND k.pos = v.pos JOIN {n}_s s ON s.tech_id = k.tech_id
  LEFT JOIN {n}_c c ON c.chrom = v.chrom AND c.pos = v.pos AND c.ref = v.ref AND c.alt = v.alt AND c.sample_id = s.sample_id),
{n}_q AS (SELECT c.chrom, c.pos, c.ref, c.alt, s.tech_id, count(*) FILTER (WHERE c.qp) AS qp_all FROM {n}_c c JOIN {n}_s0 s ON s.sample_id = c.sample_id GROUP BY ALL),
{n}_t AS (SELECT g.chrom, g.pos, g.ref, g.alt, g.tech_id, bool_or(always) AS always, count(*) AS n, count(*) FILTER (WHERE het OR hom) AS n_pass, count(*) FILTER (WHERE het OR hom OR fail) AS n_obs, count(*) FILTER (WHERE qp) AS n_qp, max(qp_all) AS qp_all
  FROM {n}_g g LEFT JOIN {n}_q q ON q.chrom = g.chrom AND q.pos = g.pos AND q.ref = g.ref AND q.alt = g.alt AND q.tech_id = g.tech_id GROUP BY g.chrom, g.pos, g.ref, g.alt, g.tech_id),
{n}_n AS (SELECT chrom, pos, ref, alt, sum(CASE WHEN NOT always AND ({" OR ".join(f"({x})" for x in gates) or "false"}) THEN n - n_obs ELSE 0 END) AS nocov FROM {n}_t GROUP BY ALL),
{n}_m AS (SELECT chrom, pos, ref, alt, sum(CASE WHEN p = 1 AND (het OR hom) THEN 1 WHEN p = 2 THEN CASE WHEN het THEN 1 ELSE 0 END + CASE WHEN hom THEN 2 ELSE 0 END ELSE 0 END) AS ac, sum(p) AS an, count(*) AS n_eligible,
  count(*) FILTER (WHERE het AND p = 2) AS n_het, count(*) FILTER (WHERE hom AND p = 2) + count(*) FILTER (WHERE (het OR hom) AND p = 1) AS n_hom, count(*) FILTER (WHERE fail) AS n_fail FROM {n}_g GROUP BY ALL),
{n} AS (SELECT m.chrom, m.pos, m.ref, m.alt, CAST(ac AS BIGINT) AS AC, CAST(an AS BIGINT) AS AN, ac / an AS AF, CAST(n_eligible AS BIGINT) AS n_eligible, CAST(n_het AS BIGINT) AS N_HET, CAST(n_hom AS BIGINT) AS N_HOM_ALT,
  CAST(n_eligible - n_het - n_hom - n_fail - nocov AS BIGINT) AS N_HOM_REF, CAST(n_fail AS BIGINT) AS N_FAIL, CAST(nocov AS BIGINT) AS N_NO_COVERAGE
  FROM {n}_m m JOIN {n}_n n ON n.chrom = m.chrom AND n.pos = m.pos AND n.ref = m.ref AND n.alt = m.alt{"" if keep_an_zero else " WHERE an > 0"})
"""


def sql(body: str, select: str, cohort: str = COHORT_SQL) -> str:
    return f"WITH {cohort}, {body}\n{select}"
