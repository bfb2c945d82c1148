"""Queries that drive stored cohorts, files and text formats, each with the SQL that gives the same rows.

A cohort is built in the shared folder from the star-schema tables and led through its life once per session, as far as a query
needs it: created from the samples up to the middle id, grown by the others, corrected, reduced, compacted. Generations are never
changed, so the state after each step can still be queried.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import DataType

from varicohort.database import Database, check_database
from varicohort.functions.chrom import chrom_rank, is_known, normalize_chrom
from varicohort.functions.times import instant_us
from varicohort.operators.coverage import merge_intervals
from varicohort.operators.filters import SampleFilter
from varicohort.operators.measures import measures
from varicohort.plans.annotate import annotate
from varicohort.plans.cohort import VARIANT, make_cohort
from varicohort.plans.cohort_queries import ALL, KEYS, MULTI, REGIONS, V, _ANNOTATED, _BASE, _canon, _idx, _INFO, _key, _records
from varicohort.plans.general import _CANON, _EPOCH
from varicohort.plans.star import QUALITY, ROOM, measures_sql, sql, star_cohort, star_ingested
from varicohort.session import fresh_path, rows_table, table, write_lines, written
from varicohort.sources.texts import manifest_problems, read_bed
from varicohort.sources.vcf import explode_calls, malformed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
f = SampleFilter.parse
_LIVES: dict[tuple[str, str], tuple[dict, Iterator[None]]] = {}


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], text: str) -> None:
    QUERIES[name], SQL[name] = run, text


def _is_there(root: str) -> bool:
    where, base = pafs.FileSystem.from_uri(root)
    return where.get_file_info(f"{base}/manifest.json").type == pafs.FileType.File


def life(spark: SparkSession, sf_dir: str, step: str = "compacted") -> dict:
    """States and answers of the cohort after each step of its life, which is led as far as ``step``, by this call or before."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _LIVES and not _is_there(_LIVES[key][0]["db"].root):  # the shared folder may have been emptied
        del _LIVES[key]
    if key not in _LIVES:
        seen: dict = {}
        _LIVES[key] = seen, _led(spark, sf_dir, seen)
    seen, led = _LIVES[key]
    try:
        while step not in seen:
            next(led)
    except BaseException:
        del _LIVES[key]
        raise
    return seen


def _led(spark: SparkSession, sf_dir: str, seen: dict) -> Iterator[None]:
    c = star_cohort(spark, sf_dir)
    path = fresh_path(spark, "cohort")
    middle = c.samples.agg(F.expr("int(max(sample_id) div 2)")).first()[0]
    old, new = (lambda df: df.where(F.col("sample_id") <= middle)), (lambda df: df.where(F.col("sample_id") > middle))
    records = written(star_ingested(spark, sf_dir), "records")
    db = Database.create(spark, path, old(records), old(c.samples), old(c.sample_phenotype), c.technologies, c.capture, quality=QUALITY)
    seen["csv"], seen["vcf"], seen["sites"], seen["db"] = f"{path}/dump.csv", f"{path}/annotated.vcf", f"{path}/sites.vcf", db
    seen["created"] = db.cohort
    yield
    seen["added_counts"] = db.add(new(records), new(c.samples), new(c.sample_phenotype))
    seen["added"] = db.cohort
    yield
    account = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("int").alias("sample_id"), "c_acctbal")
    named = db.cohort.samples.join(account, "sample_id").select("sample_name", "c_acctbal", "sample_id").orderBy("sample_id")
    updates = [{"sample_name": r[0], "field": "sex", "new_value": "female"} for r in named.where("c_acctbal > 9900").collect()]
    updates += [{"sample_name": r[0], "field": "phenotype_codes", "new_value": x} for r in named.where("c_acctbal BETWEEN 9800 AND 9950").collect() for x in ("Q7", " Q9,Q1 ,Q9")]
    db.update_sample_metadata(updates, "by account")
    seen["updated"] = db.cohort
    yield
    db.remove_samples([r[0] for r in named.where("c_acctbal < -500").collect()])
    seen["removed"] = db.cohort
    yield
    seen["kept"] = db.manifest  # of the state that is checked
    seen["compact"] = db.compact()
    seen["compacted"] = db.cohort
    yield


def _checked(spark: SparkSession, sf_dir: str) -> list[tuple[str, str]]:
    """What a check finds before compaction, which other queries do not wait for."""
    now = life(spark, sf_dir, "removed")
    if "check" not in now:
        now["check"] = check_database(spark, now["db"].root, now.get("kept"))
    return now["check"]


def _numbered(df: DataFrame) -> DataFrame:
    """The rows with ``ord``, their place in the order in which they come."""
    at = df.withColumn("__at", F.monotonically_increasing_id())
    return at.withColumn("ord", F.row_number().over(Window.orderBy("__at"))).drop("__at")


# --- the same cohort at each step, in SQL
_MIDDLE = "(SELECT CAST(max(c_custkey) // 2 AS INT) FROM customer)"
_RICH, _CODED, _GONE = (f"(SELECT CAST(c_custkey AS INT) FROM customer WHERE {x})" for x in ("c_acctbal > 9900", "c_acctbal BETWEEN 9800 AND 9950", "c_acctbal < -500"))
_HALF = dict(calls=f"SELECT * FROM calls WHERE sample_id <= {_MIDDLE}", samples=f"SELECT * FROM samples WHERE sample_id <= {_MIDDLE}")
_NEW_SEX = f"SELECT sample_id, sample_name, CASE WHEN sample_id IN {_RICH} THEN 'female' ELSE sex END AS sex, tech_id FROM samples"
_NEW_CODES = f"SELECT * FROM phen WHERE sample_id NOT IN {_CODED} UNION ALL SELECT sample_id, x FROM samples, (VALUES ('Q1'), ('Q9')) v(x) WHERE sample_id IN {_CODED}"
_LEFT = dict(samples=f"{_NEW_SEX} WHERE sample_id NOT IN {_GONE}", phen=f"SELECT * FROM ({_NEW_CODES}) WHERE sample_id NOT IN {_GONE}")
_RANK = "CASE chrom " + " ".join(f"WHEN 'chr{c}' THEN {i}" for i, c in enumerate([*range(1, 23), "X", "Y", "M"])) + " ELSE 99 END"
_Q = dict(quality=QUALITY)


def _ordered(body: str, order: str) -> str:
    return sql(body, f"SELECT *, row_number() OVER (ORDER BY {order}) AS ord FROM result")


def _shape(name: str, run: Callable[[Database], DataFrame], variants: str, order: str, where: str = "true", **gates) -> None:
    _add(name, lambda spark, d: _numbered(run(life(spark, d)["db"])), _ordered(measures_sql(where, variants, **_Q, **_LEFT_KEPT, **gates), order))


# after compaction only variants with a call of a sample that is left are stored
_LEFT_KEPT = _LEFT | dict(calls=f"SELECT * FROM calls WHERE sample_id NOT IN {_GONE}")
_code = lambda c: f"s.sample_id IN (SELECT sample_id FROM phen WHERE code = '{c}')"
_shape("stored_point", lambda db: db.query("1", 27924), "chrom = 'chr1' AND pos = 27924", "pos, alt, ref")
_shape("stored_point_gated", lambda db: db.query("chr1", 27924, alt="A", phenotype=["^BUILDING"], min_quality_evidence=1), "chrom = 'chr1' AND pos = 27924 AND alt = 'A'", "pos", f"NOT ({_code('BUILDING')})", min_quality_evidence=1)
_shape("stored_region", lambda db: db.query_region("X", 500_000, 2_500_000, sex="female", min_pass=2), "chrom = 'chrX' AND pos BETWEEN 500000 AND 2500000", "pos, alt, ref", "s.sex = 'female'", min_pass=2)
_shape("stored_region_multi", lambda db: db.query_region_multi(REGIONS), " OR ".join(f"(chrom = '{_canon.get(c, c)}' AND pos BETWEEN {a} AND {b})" for c, a, b in REGIONS), f"{_RANK}, pos, alt, ref")
_shape("stored_batch", lambda db: db.query_batch("1", KEYS), _key([("chr1", *k) for k in KEYS]), "pos, alt, ref")
_shape("stored_batch_multi", lambda db: db.query_batch_multi(MULTI, phenotype=["Q9", "Q2"]), _key([(_canon.get(c, c), p, r, a) for c, p, r, a in MULTI]), f"{_idx}, alt, ref", f"{_code('Q9')} OR {_code('Q2')}")
_add(
    "stored_variant_info",
    lambda spark, d: _numbered(life(spark, d)["db"].variant_info("1", 27924, phenotype=["^BUILDING"])).withColumn("phenotypes", F.array_join("phenotypes", ",")),
    sql(
        measures_sql(f"NOT ({_code('BUILDING')})", "chrom = 'chr1' AND pos = 27924", **_LEFT_KEPT),
        f"SELECT *, row_number() OVER (ORDER BY sample_id, alt, ref) AS ord FROM ({_INFO.format(chrom='chr1', pos=27924).replace('FROM phen p', 'FROM result_p0 p').replace('JOIN samples s', 'JOIN result_s0 s')})",
    ),
)

# --- states
_add("stored_created", lambda spark, d: measures(life(spark, d, "created")["created"], ALL), sql(measures_sql(**_Q, **_HALF), "SELECT * FROM result"))
_add("add_samples_query", lambda spark, d: measures(life(spark, d, "added")["added"], ALL), sql(measures_sql(**_Q), "SELECT * FROM result"))
_STORED = f"SELECT DISTINCT {V} FROM calls WHERE (NOT filter_pass OR gt_ac IN (1, 2))"
_add(
    "add_samples_counts",
    lambda spark, d: rows_table(spark, [tuple(life(spark, d, "added")["added_counts"][k] for k in ("n_samples", "n_new", "n_updated"))], "n_samples bigint, n_new bigint, n_updated bigint"),
    sql(f"o AS ({_STORED} AND sample_id <= {_MIDDLE}), n AS ({_STORED} AND sample_id > {_MIDDLE})", f"SELECT (SELECT count(*) FROM samples WHERE sample_id > {_MIDDLE}) AS n_samples, count(*) FILTER (WHERE o.pos IS NULL) AS n_new, count(*) FILTER (WHERE o.pos IS NOT NULL) AS n_updated FROM n LEFT JOIN o USING ({V})"),
)
_add("metadata_update_query", lambda spark, d: measures(life(spark, d, "updated")["updated"], f(["Q9", "Q3"])), sql(measures_sql(f"{_code('Q9')} OR {_code('Q3')}", **_Q, samples=_NEW_SEX, phen=_NEW_CODES), "SELECT * FROM result"))
_add("remove_samples_query", lambda spark, d: measures(life(spark, d, "removed")["removed"], ALL), sql(measures_sql(**_Q, **_LEFT), "SELECT * FROM result"))
_add("compact_query", lambda spark, d: measures(life(spark, d)["compacted"], ALL), sql(measures_sql(**_Q, **_LEFT_KEPT), "SELECT * FROM result"))
_add(
    "compact_counts",
    lambda spark, d: rows_table(spark, [tuple(life(spark, d)["compact"][k] for k in ("variants_before", "variants_removed", "rows_before", "rows_removed"))], "variants_before bigint, variants_removed bigint, rows_before bigint, rows_removed bigint"),
    # calls of three and more copies are in no class, but stored
    sql("x AS (SELECT 1)", f"SELECT count(DISTINCT ({V})) FILTER (WHERE any_class) AS variants_before, count(DISTINCT ({V})) FILTER (WHERE any_class) - count(DISTINCT ({V})) FILTER (WHERE any_class AND here) AS variants_removed, count(*) AS rows_before, count(*) FILTER (WHERE NOT (any_class AND here)) AS rows_removed FROM (SELECT *, NOT filter_pass OR gt_ac IN (1, 2) AS any_class, sample_id NOT IN {_GONE} AS here FROM calls)"),
)
_add("info_counts", lambda spark, d: life(spark, d, "removed")["db"].counts_frame(), sql(f"s AS ({_LEFT['samples']}), p AS ({_LEFT['phen']})", "SELECT 'all' AS axis, 'samples' AS value, count(*) AS n FROM s UNION ALL SELECT 'sex', sex, count(*) FROM s GROUP BY sex UNION ALL SELECT 'tech', tech_name, count(*) FROM s JOIN tech USING (tech_id) GROUP BY tech_name UNION ALL SELECT 'phenotype', code, count(*) FROM p GROUP BY code"))
_add("list_samples", lambda spark, d: _numbered(life(spark, d, "removed")["db"].samples_frame().drop("vcf_path", "ingested_at")).withColumn("phenotypes", F.array_join("phenotypes", ",")), sql(f"s AS ({_LEFT['samples']}), p AS ({_LEFT['phen']})", "SELECT s.sample_id, sample_name, sex, tech_name AS tech, coalesce((SELECT string_agg(code, ',' ORDER BY code) FROM p WHERE p.sample_id = s.sample_id), '') AS phenotypes, row_number() OVER (ORDER BY s.sample_id) AS ord FROM s JOIN tech USING (tech_id)"))
_add("next_id", lambda spark, d: rows_table(spark, [(life(spark, d)["db"].manifest["next_sample_id"], life(spark, d)["db"].manifest["sample_count"], life(spark, d)["db"].manifest["db_version"])], "next_id int, sample_count int, version string"), sql("x AS (SELECT 1)", f"SELECT CAST(max(sample_id) + 1 AS INT) AS next_id, CAST(count(*) FILTER (WHERE sample_id NOT IN {_GONE}) AS INT) AS sample_count, '1.2' AS version FROM samples"))
_add(
    "changelog_tail",
    lambda spark, d: _numbered(life(spark, d)["db"].changelog_frame().select("event_id", "event_type", F.size("sample_names").alias("n_names"), F.get_json_object("notes", "$.new").alias("new"), F.get_json_object("notes", "$.old").alias("old"))),
    sql(
        f"""e AS (SELECT 0 AS phase, 0 AS no, 'preprocess' AS event_type, CAST(count(*) AS INT) AS n_names, NULL::VARCHAR AS new, NULL::VARCHAR AS old FROM samples WHERE sample_id <= {_MIDDLE}
UNION ALL SELECT 1, 0, 'add_samples', CAST(count(*) AS INT), NULL, NULL FROM samples WHERE sample_id > {_MIDDLE}
UNION ALL SELECT 2, sample_id, 'UPDATE_SAMPLE', 1, 'female', sex FROM samples WHERE sample_id IN {_RICH}
UNION ALL SELECT 3, 2 * sample_id, 'UPDATE_SAMPLE', 1, 'Q7', (SELECT string_agg(code, ',' ORDER BY code) FROM phen p WHERE p.sample_id = s.sample_id) FROM samples s WHERE sample_id IN {_CODED}
UNION ALL SELECT 3, 2 * sample_id + 1, 'UPDATE_SAMPLE', 1, 'Q1,Q9', 'Q7' FROM samples WHERE sample_id IN {_CODED}
UNION ALL SELECT 4, 0, 'remove_samples', CAST(count(*) AS INT), NULL, NULL FROM samples WHERE sample_id IN {_GONE}
UNION ALL SELECT 5, 0, 'compact', NULL, NULL, NULL)""",
        "SELECT row_number() OVER (ORDER BY phase, no) AS event_id, event_type, n_names, new, old, row_number() OVER (ORDER BY phase DESC, no DESC) AS ord FROM e",
    ),
)
_add(
    "check_query",
    lambda spark, d: rows_table(spark, _checked(spark, d), "severity string, message string"),
    sql("x AS (SELECT 1)", f"SELECT 'warning' AS severity, 'call of a removed sample: ' || count(*) || ' calls' AS message FROM calls WHERE sample_id IN {_GONE} UNION ALL SELECT 'info', (SELECT count(*) FROM samples WHERE sample_id NOT IN {_GONE}) || ' samples, chromosomes chr1, chr2, chrX, chrY, chrM, version 1.2'"),
)


# --- sinks, read back
def _kind(db: Database) -> DataType:
    return db.cohort.calls.schema["pos"].dataType


def _csv(spark: SparkSession, d: str) -> DataFrame:
    now = life(spark, d)
    now["db"].dump(now["csv"], sex="female", include_ac_zero=True)
    back = spark.read.csv(now["csv"], header=True)
    return _numbered(back.select(*(F.col(c).cast("double" if c == "AF" else _kind(now["db"]) if c == "pos" else "string" if c in VARIANT else "bigint").alias(c) for c in back.columns)))


_add("dump_csv", _csv, sql(measures_sql("s.sex = 'female'", **_Q, **_LEFT_KEPT), f"SELECT {V}, {_BASE}, row_number() OVER (ORDER BY {_RANK}, pos, alt, ref) AS ord FROM result"))


def _vcf(spark: SparkSession, d: str) -> DataFrame:
    now = life(spark, d)
    r = _records(spark, d)
    line = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.lit("."), "ref", F.array_join("alts", ","), F.lit("."), F.lit("."), F.when(F.col("pos") % 2 == 0, "DP=3").otherwise("."))
    write_lines(r.select(line.alias("line"), "line_no"), ["##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"], now["sites"], ["line_no"])
    now["db"].annotate_vcf(now["sites"], now["vcf"], sex="female", min_pass=2)
    body = spark.read.text(now["vcf"]).where(~F.col("value").startswith("#"))
    c = F.split("value", "\t")
    return _numbered(body).select("ord", c[0].alias("chrom"), c[1].cast(_kind(now["db"])).alias("pos"), c[4].alias("alts"), c[7].alias("info"))


_ann = measures_sql("s.sex = 'female'", min_pass=2, **_Q, **_LEFT_KEPT) + _ANNOTATED
_list = lambda c: f"string_agg(CAST({c} AS VARCHAR), ',' ORDER BY alt_no)"
_add(
    "annotate_vcf",
    _vcf,
    sql(_ann, f"""
SELECT row_number() OVER (ORDER BY line_no) AS ord, chrom, pos, string_agg(alt, ',' ORDER BY alt_no) AS alts, CASE WHEN pos % 2 = 0 THEN 'DP=3;' ELSE '' END || CASE WHEN max(an) = 0 THEN 'COHORT_AN=0' ELSE
  'COHORT_AC=' || {_list("ac")} || ';COHORT_AN=' || max(an) || ';COHORT_AF=' || string_agg(printf('%.10g', af), ',' ORDER BY alt_no) || ';COHORT_N_HET=' || {_list("n_het")} || ';COHORT_N_HOM_ALT=' || {_list("n_hom_alt")}
  || ';COHORT_N_HOM_REF=' || {_list("n_hom_ref")} || ';COHORT_N_FAIL=' || CAST(sum(n_fail) AS BIGINT) || ';COHORT_N_NO_COVERAGE=' || {_list("n_no")} END AS info
FROM ann GROUP BY line_no, chrom, pos"""),
)
_twice = lambda spark, d: (lambda r: r.unionByName(r.withColumn("line_no", -F.col("line_no"))))(_records(spark, d))
_add(
    "annotate_repeats",
    lambda spark, d: annotate(star_cohort(spark, d), _twice(spark, d), f(sex="female", min_pass=2)).select("line_no", "alt_no", *VARIANT, "AC", "AN", "N_NO_COVERAGE"),
    sql(measures_sql("s.sex = 'female'", min_pass=2) + _ANNOTATED, f"SELECT line_no * sg AS line_no, alt_no, {V}, CASE WHEN covered THEN ac END AS AC, an AS AN, CASE WHEN covered THEN n_no END AS N_NO_COVERAGE FROM ann, (VALUES (1), (-1)) t(sg)"),
)


# --- ingest of VCF text: every record of calls as a line, in eight forms
def _lines(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "calls").withColumn("k", (F.col("call_id") % 8).cast("int"))
    text = lambda x: F.coalesce(F.col(x).cast("string"), F.lit("."))
    gt = F.element_at(F.array(*map(F.lit, ["0/0", "0/1", "1|1", "1/1/1"])), F.col("gt_ac").cast("int") + 1)
    gt = F.when(F.col("k") == 2, F.translate(gt, "1", "2")).when(F.col("k") == 3, "./.").when(F.col("k") == 5, "1/2").otherwise(gt)
    alts = F.when(F.col("k") == 1, F.concat("alt", F.lit(",*"))).when(F.col("k") == 2, F.concat(F.lit("<DEL>,"), "alt")).when(F.col("k") == 5, F.concat("alt", F.lit(","), "alt", F.lit("A"))).otherwise(F.col("alt"))
    passed = F.when(F.col("k") == 6, ".").when(F.coalesce("filter_pass", F.lit(False)), "PASS").otherwise("LowQ")
    fmt = F.when(F.col("k") == 4, "DP:GT").when(F.col("k") == 7, "GT").otherwise("GT:DP:GQ")
    sample = F.when(F.col("k") == 4, F.concat(F.lit("-5:"), gt)).when(F.col("k") == 7, gt).otherwise(F.concat_ws(":", gt, text("dp"), text("gq")))
    cells = ["chrom", F.col("pos").cast("string"), F.lit("."), "ref", alts, text("qual"), passed, F.lit("."), fmt, sample]
    good = c.where("chrom IS NOT NULL AND pos IS NOT NULL AND ref IS NOT NULL AND alt IS NOT NULL AND gt_ac BETWEEN 0 AND 3")
    return good.select("sample_id", F.concat_ws("\t", *cells).alias("value"))


_READ = f"""
c AS (SELECT call_id % 8 AS k, {_CANON} AS chrom, pos, ref, alt, gt_ac, sample_id, coalesce(filter_pass, false) AS ok, CASE WHEN dp >= 0 THEN dp END AS dp, CASE WHEN gq >= 0 THEN gq END AS gq, qual FROM calls
  WHERE chrom IS NOT NULL AND pos IS NOT NULL AND ref IS NOT NULL AND alt IS NOT NULL AND gt_ac BETWEEN 0 AND 3 AND regexp_full_match(ref, '[ACGTNacgtn]+') AND regexp_full_match(alt, '[ACGTNacgtn]+')),
o AS (SELECT chrom, pos, ref, alt, gt_ac, sample_id, k = 6 OR ok AS filter_pass, CASE WHEN k NOT IN (4, 7) THEN dp END AS dp, CASE WHEN k NOT IN (4, 7) THEN gq END AS gq, qual FROM c WHERE k NOT IN (3, 5) AND gt_ac > 0
  UNION ALL SELECT chrom, pos, ref, alt, 0, sample_id, false, dp, gq, qual FROM c WHERE k = 3 AND NOT ok
  UNION ALL SELECT chrom, pos, ref, alt || x, 1, sample_id, ok, dp, gq, qual FROM c, (VALUES (''), ('A')) v(x) WHERE k = 5)"""
_add("ingest_lines", lambda spark, d: explode_calls(_lines(spark, d)), f"WITH {_READ.strip()} SELECT chrom, pos, ref, alt, CAST(gt_ac AS TINYINT) AS gt_ac, sample_id, filter_pass, dp, gq, qual FROM o")


def _malformed(spark: SparkSession, d: str) -> DataFrame:
    v = written(_lines(spark, d), "lines")
    bad = v.withColumn("value", F.when(F.length("value") % 3 == 0, F.regexp_replace("value", "^([^\\t]*\\t)\\d+", "$1here")).when(F.length("value") % 3 == 1, F.regexp_replace("value", "\\t[^\\t]*$", "")).otherwise(F.col("value")))
    return malformed(bad.unionByName(v.select("sample_id", F.lit("#").alias("value"))).unionByName(v.select("sample_id", F.lit(" ").alias("value")))).groupBy("reason").agg(F.count("*").alias("n"))


QUERIES["malformed_lines"] = _malformed


# --- small text inputs
def _bed(spark: SparkSession, d: str) -> DataFrame:
    c = star_cohort(spark, d).capture
    moved = c.unionByName(c.withColumn("start0", F.col("start0") + ROOM).withColumn("end0", F.col("end0") + ROOM)).unionByName(c.where("start0 % 3 = 0"))
    paths = {}
    for t in (1, 2, 3):
        paths[t] = fresh_path(spark, f"bed{t}")
        lines = moved.where(F.col("tech_id") == t).select(F.concat_ws("\t", "chrom", F.col("start0").cast("string"), F.col("end0").cast("string"), F.lit("exon")).alias("value"))
        head = spark.createDataFrame([("track name=kit",), ("# comment",), ("",), ("browser position chr1",)], "value string")
        lines.unionByName(head).write.text(paths[t])
    return merge_intervals(read_bed(spark, paths, c.schema["end0"].dataType.simpleString()))


_add("bed_regions", _bed, sql("m AS (SELECT * FROM capture UNION ALL SELECT tech_id, chrom, start0 + 10000, end0 + 10000 FROM capture), w AS (SELECT *, max(end0) OVER (PARTITION BY tech_id, chrom ORDER BY start0, end0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM m), g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start0 > reach THEN 1 ELSE 0 END) OVER (PARTITION BY tech_id, chrom ORDER BY start0, end0 ROWS UNBOUNDED PRECEDING) AS island FROM w)", "SELECT tech_id, chrom, min(start0) AS start0, max(end0) AS end0 FROM g GROUP BY tech_id, chrom, island"))
_add(
    "manifest_problems",
    lambda spark, d: manifest_problems(table(spark, d, "manifest"), "row_id"),
    r"""WITH m AS (SELECT *, count(*) OVER (PARTITION BY sample_name) AS times FROM manifest)
SELECT row_id, 'no sample name' AS problem FROM m WHERE coalesce(sample_name, '') = '' UNION ALL SELECT row_id, 'name of several rows' FROM m WHERE times > 1 AND sample_name <> ''
UNION ALL SELECT row_id, 'sex is neither male nor female' FROM m WHERE coalesce(sex NOT IN ('male', 'female'), true) UNION ALL SELECT row_id, 'no technology' FROM m WHERE coalesce(tech_name, '') = ''
UNION ALL SELECT row_id, 'no file' FROM m WHERE coalesce(vcf_path, '') = '' UNION ALL SELECT row_id, 'no phenotype code' FROM m WHERE regexp_full_match(coalesce(phenotype_codes, ''), '[,\s]*')""",
)


# --- the engine on the domain tables as they are
def domain_cohort(spark: SparkSession, d: str):
    """calls, samples, technologies and sample_phenotype: of repeated rows of a sample the one ingested last counts; kits without BED file cover everything."""
    s = table(spark, d, "samples").where("sample_id IS NOT NULL")
    latest = F.max(F.struct(F.coalesce(instant_us(F.col("ingested_at")), F.lit(-1)).alias("at"), F.coalesce("sample_name", F.lit("")).alias("sample_name"), F.coalesce("sex", F.lit("")).alias("sex"), F.coalesce("tech_id", F.lit(-1)).alias("tech_id")))
    samples = s.groupBy("sample_id").agg(latest.alias("x")).select("sample_id", "x.sample_name", "x.sex", "x.tech_id")
    codes = table(spark, d, "sample_phenotype").where("sample_id IS NOT NULL").select("sample_id", "phenotype_code").distinct()
    capture = spark.createDataFrame([], "tech_id int, chrom string, start0 int, end0 int")
    return make_cohort(table(spark, d, "calls"), samples, codes, table(spark, d, "technologies").select("tech_id", "tech_name", "bed_path"), capture)


_KNOWN = ", ".join(f"'chr{c}'" for c in [*range(1, 23), "X", "Y", "M"])
DOMAIN_SQL = f"""
samples AS (SELECT sample_id, x.sample_name, x.sex, x.tech_id FROM (SELECT sample_id, max(struct_pack(at := coalesce({_EPOCH.format(c="ingested_at")}, -1), sample_name := coalesce(sample_name, ''), sex := coalesce(sex, ''), tech_id := coalesce(tech_id, -1))) AS x FROM main.samples WHERE sample_id IS NOT NULL GROUP BY sample_id)),
phen AS (SELECT DISTINCT sample_id, phenotype_code AS code FROM sample_phenotype WHERE sample_id IS NOT NULL),
tech AS (SELECT tech_id, tech_name, bed_path IS NULL AS always FROM technologies),
capture AS (SELECT 1 AS tech_id, '' AS chrom, 0 AS start0, 0 AS end0 WHERE false),
calls AS (SELECT * FROM (SELECT {_CANON} AS chrom, pos, ref, alt, gt_ac, sample_id, filter_pass, dp, gq, qual FROM main.calls) WHERE chrom IN ({_KNOWN}) AND pos IS NOT NULL AND ref IS NOT NULL AND alt IS NOT NULL AND sample_id IS NOT NULL)
"""
_add("domain_measures", lambda spark, d: measures(domain_cohort(spark, d), f(sex="female")), sql(measures_sql("s.sex = 'female'"), "SELECT * FROM result", DOMAIN_SQL))
