"""The training-data queries of the core (p1 to p6) and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from varicohort.functions.chrom import normalize_chrom
from varicohort.functions.times import instant_us, naive_us
from varicohort.operators.compaction import ROWS_PER_ROW_GROUP, compact
from varicohort.operators.history import snapshot_changes, snapshots_from_updates, validity
from varicohort.operators.multivalue import split_packed
from varicohort.operators.orphans import month_of, orphans
from varicohort.operators.repair import check_manifest_lines
from varicohort.operators.skew import Measure, keys_above, salted_aggregate
from varicohort.session import table, written

CONTENT = ["chrom", "pos", "ref", "alt", "gt_ac", "sample_id", "filter_pass", "dp", "gq", "qual"]


def compact_calls(spark: SparkSession, sf_dir: str):
    """Consolidate the ingested records; see ``operators.compaction``.

    What a record takes is what each more row adds to the bytes of a small file, by least squares over the listing.
    """
    content = {c: F.col(c) for c in CONTENT} | {"chrom": normalize_chrom(F.col("chrom")), "qual": F.col("qual") + F.lit(0.0).cast("float")}
    row_bytes = table(spark, sf_dir, "call_files").agg(F.regr_slope("n_bytes", "n_rows")).first()[0]
    return compact(table(spark, sf_dir, "calls"), content, "call_id", "file_id", ["sample_id", "chrom"], row_bytes)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that the consolidation set aside, as an equal one lies in a file with a smaller id."""
    return compact_calls(spark, sf_dir).repeats.select("call_id").distinct()


def p1_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the published files hold, by kind: rows and id sum, and whether all are within the size asked for by more than a row group."""
    c = compact_calls(spark, sf_dir)
    most = c.manifest["file_bytes"] + ROWS_PER_ROW_GROUP * 100
    return c.files.groupBy("kind").agg(F.sum("rows").alias("n_rows"), F.sum("id_sum").cast("bigint").alias("id_sum"), F.bool_and(F.col("bytes") <= most).alias("well_sized"))


def p1_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the listing of small files says against what they hold: number of files, claimed and actual rows by status."""
    held = table(spark, sf_dir, "calls").groupBy("file_id").agg(F.count("*").alias("held"))
    listed = table(spark, sf_dir, "call_files").select("file_id", F.col("n_rows").alias("claim"), F.lit(True).alias("listed"))
    j = listed.join(held, "file_id", "full_outer")
    rows, claim = F.coalesce("held", F.lit(0)), F.col("claim")
    status = F.when(F.col("listed").isNull(), "not listed").when(claim.isNull(), "no claim").when(claim == rows, "as claimed").when(rows == 0, "empty").otherwise("wrong claim")
    return j.groupBy(status.alias("status")).agg(F.count("*").alias("n_files"), F.sum(claim.cast("bigint")).alias("claimed"), F.sum(rows).alias("held"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = [r[0] for r in table(spark, sf_dir, "phenotype_terms").select("code").where("code IS NOT NULL").distinct().collect()]  # a fixed table
    return split_packed(table(spark, sf_dir, "manifest"), "phenotype_codes", ["row_id"], codes=codes).distinct()


def _unwrapped(text: Column) -> Column:
    """Take off all wrappings of JSON text that was encoded as a JSON string, however many there are.

    A wrapping adds two quotes, and a character for every quote and backslash inside: n wrappings need more than n * n
    characters, so that a fold of that many steps sees them all. Its steps do nothing once the text is bare.
    """
    step = lambda t: F.when(F.ltrim(t).startswith('"'), F.try_variant_get(F.try_parse_json(t), "$", "string")).otherwise(t)
    most = F.ceil(F.sqrt(F.length(text))).cast("int")
    return F.when(F.ltrim(text).startswith('"'), F.aggregate(F.sequence(F.lit(1), most), text, lambda t, _: step(t))).otherwise(text)


def sex_entries(changelog: DataFrame) -> DataFrame:
    """Counting entries (sample_name, at, event_id, entry_no, old, new) of the changelog's notes."""
    # an entry that counts has the letters sex somewhere, or an escape that may stand for them
    e = changelog.where(F.col("notes").contains("sex") | F.col("notes").contains("\\u"))
    e = e.select("event_id", instant_us(F.col("event_time")).alias("at"), F.trim(_unwrapped(F.trim("notes"))).alias("n"))
    # a parser may accept what follows a complete value, so both ends are looked at
    framed = lambda a, b: F.col("n").startswith(a) & F.col("n").endswith(b)
    e = e.where(framed("[", "]") | framed("{", "}")).withColumn("v", F.try_parse_json("n"))
    entries = F.when(F.col("n").startswith("["), F.try_variant_get("v", "$", "array<variant>")).otherwise(F.array("v"))
    e = e.select("event_id", "at", F.posexplode(entries).alias("entry_no", "v"))
    # only entries that are strings again are parsed again
    e = e.withColumn("v", F.when(F.schema_of_variant("v") == "STRING", F.try_parse_json(_unwrapped(F.try_variant_get("v", "$", "string")))).otherwise(F.col("v")))
    field = lambda k: F.try_variant_get("v", f"$.{k}", "string")
    tidy = lambda k: F.lower(F.regexp_replace(field(k), r"^\s+|\s+$", ""))
    # through a generator, so that the condition is not evaluated on the JSON again
    parsed = F.struct(field("sample").alias("sample_name"), field("field").alias("field"), tidy("old").alias("old"), tidy("new").alias("new"))
    e = e.select("at", "event_id", "entry_no", F.explode(F.array(parsed)).alias("x")).select("x.*", "at", "event_id", "entry_no")
    return e.where((F.col("field") == "sex") & F.col("new").isin("male", "female")).drop("field")


def sex_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of every sample's sex: (sample_name, value, valid_from, valid_to, inserted), times in microseconds."""
    log = table(spark, sf_dir, "changelog")
    named = log.where(F.col("event_type").isin("preprocess", "add_samples")).select(instant_us(F.col("event_time")).alias("at"), F.explode(F.from_json("sample_names", "array<string>")).alias("sample_name"))
    begun = named.groupBy("sample_name").agg(F.min("at").alias("at"))
    snapshots = snapshots_from_updates(sex_entries(log), "sample_name", "at", ["event_id", "entry_no"], "old", "new", begun)
    return validity(snapshot_changes(written(snapshots, "snapshots"), "sample_name"), "sample_name")  # read as before and after


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a sample has a second version if one version ends or does not begin it
    h = sex_history(spark, sf_dir).where("valid_to IS NOT NULL OR NOT inserted")
    return h.select("sample_name", F.col("value").alias("sex"), F.col("valid_from").alias("valid_from_us")).distinct()


def p3_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version of every sample's sex with the time it was valid; the last one has no end."""
    return sex_history(spark, sf_dir).select("sample_name", F.col("value").alias("sex"), F.col("valid_from").alias("valid_from_us"), F.col("valid_to").alias("valid_to_us"))


def p4_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and measures per key (canonical chrom, pos, alt)."""
    c = table(spark, sf_dir, "calls").select(normalize_chrom(F.col("chrom")).alias("chrom"), "pos", "alt", "call_id", "sample_id", "gt_ac", "filter_pass", "dp", "qual")
    return salted_aggregate(
        c,
        ["chrom", "pos", "alt"],
        [
            Measure("n_rows", F.count("*")),
            Measure("n_pass", F.sum(F.coalesce(F.col("filter_pass"), F.lit(False)).cast("bigint"))),
            Measure("sum_ac", F.sum(F.col("gt_ac").cast("bigint"))),
            Measure("n_dp", F.count("dp")),
            Measure("sum_dp", F.sum(F.col("dp").cast("bigint"))),
            Measure("min_qual", F.min("qual"), "min"),
            Measure("max_qual", F.max("qual"), "max"),
        ],
        ["call_id"],
    )


def p4_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct samples per key: not mergeable by itself, so the salt follows the sample."""
    c = table(spark, sf_dir, "calls").select(normalize_chrom(F.col("chrom")).alias("chrom"), "pos", "alt", "sample_id")
    return salted_aggregate(c, ["chrom", "pos", "alt"], [Measure("n_samples", F.countDistinct("sample_id"))], ["sample_id"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "calls").select(normalize_chrom(F.col("chrom")).alias("chrom"), "pos", "alt", "call_id")
    counted = salted_aggregate(c, ["chrom", "pos", "alt"], [Measure("n_rows", F.count("*"))], ["call_id"])
    return keys_above(counted, "n_rows", 0.01).select("chrom", "pos", "alt")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = check_manifest_lines(table(spark, sf_dir, "manifest_lines"))
    return checked.select("line_id", F.explode("reasons").alias("reason")).distinct()


def p5_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid rows of the manifest lines."""
    checked = check_manifest_lines(table(spark, sf_dir, "manifest_lines"))
    return checked.where(F.size("reasons") == 0).select("line_id", "sample_name", "sex", "tech_name", "vcf_path", "phenotype_codes")


def number_key(text: Column) -> Column:
    """The spelling that equal numbers share, digits without outer zeros and an exponent; text that is no number stays.

    Compared as text, so that nothing is rounded however many digits there are.
    """
    shape = r"^([+-]?)(?=\.?\d)(\d*)\.?(\d*)(?:[eE]([+-]?\d{1,9}))?$"
    part = lambda k: F.regexp_extract(text, shape, k)
    digits = F.concat(part(2), part(3))
    short = F.regexp_replace(digits, "0+$", "")
    power = F.coalesce(part(4).try_cast("int"), F.lit(0)) - F.length(part(3)) + F.length(digits) - F.length(short)
    bare = F.regexp_replace(short, "^0+", "")
    sign = F.when(part(1) == "-", "-").otherwise("")
    return F.when(~text.rlike(shape), text).when(bare == "", "0").otherwise(F.concat(sign, bare, F.lit("e"), power.cast("string")))


def orphan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tab, month_key, row_key, at): one row per reference without target."""
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    samples, tech, terms = (table(spark, sf_dir, t) for t in ("samples", "technologies", "phenotype_terms"))
    own = instant_us(F.col("ingested_at"))
    sp = table(spark, sf_dir, "sample_phenotype").select(F.col("link_id").alias("row_key"), "sample_id", naive_us(F.col("assigned_at")).alias("at"))
    a = orphans(sp, ["sample_id"], samples.select("sample_id", own.alias("since")), ["sample_id"], "simple", "at", "since")
    sm = samples.select(F.col("sample_id").cast("bigint").alias("row_key"), "tech_id", own.alias("at"))
    b = orphans(sm, ["tech_id"], tech.select("tech_id", naive_us(F.col("added_at")).alias("since")), ["tech_id"], "simple", "at", "since")
    key = trim(F.col("bitmap_key"))
    bm = table(spark, sf_dir, "precomputed_bitmaps").select(F.col("bitmap_id").alias("row_key"), "bitmap_type", F.when(key == "", None).when(F.col("bitmap_type") == "tech", number_key(key)).otherwise(key).alias("bitmap_key"), naive_us(F.col("built_at")).alias("at"))
    always = F.lit(None).cast("bigint")
    targets = (
        tech.select(F.lit("tech").alias("t"), number_key(F.col("tech_id").cast("string")).alias("k"), naive_us(F.col("added_at")).alias("since"))
        .unionByName(terms.select(F.lit("phenotype").alias("t"), F.col("code").alias("k"), naive_us(F.col("added_at")).alias("since")))
        .unionByName(spark.createDataFrame([("sex", "male"), ("sex", "female")], "t string, k string").withColumn("since", always))
    )
    c = orphans(bm, ["bitmap_type", "bitmap_key"], targets, ["t", "k"], "simple", "at", "since")
    named = lambda df, tab: df.select(F.lit(tab).alias("tab"), month_of(F.col("at")).alias("month_key"), "row_key")
    return named(a, "sample_phenotype").unionByName(named(b, "samples")).unionByName(named(c, "precomputed_bitmaps"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_rows(spark, sf_dir).distinct()


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of rows without target per table and month."""
    return orphan_rows(spark, sf_dir).groupBy("tab", "month_key").agg(F.count("*").alias("n_rows"))


_CANON = "CASE WHEN upper(trim(chrom)) = 'MT' THEN 'chrM' WHEN trim(chrom) LIKE 'chr%' THEN trim(chrom) ELSE 'chr' || trim(chrom) END"
_EPOCH = "CASE WHEN regexp_full_match(trim({c}), '[0-9]+') THEN CAST(trim({c}) AS BIGINT) * 1000000 ELSE epoch_us(CAST(CASE WHEN regexp_matches(trim({c}), '(Z|[+-][0-9]{{2}}:[0-9]{{2}})$') THEN trim({c}) ELSE trim({c}) || '+00:00' END AS TIMESTAMPTZ)) END"

QUERIES = {f.__name__: f for f in (p1_found, p1_files, p1_claims, p2_found, p3_found, p3_history, p4_found, p4_measures, p4_samples, p5_found, p5_loaded, p6_found, p6_report)}

_ORPHANS = f"""
WITH s AS (SELECT sample_id, CAST(tech_id AS BIGINT) AS tech_id, {_EPOCH.format(c="ingested_at")} AS own_at FROM samples),
sf AS (SELECT sample_id, CASE WHEN count(*) = count(own_at) THEN min(own_at) END AS since FROM s GROUP BY sample_id),
b AS (SELECT bitmap_id, bitmap_type AS t, nullif(trim(bitmap_key), '') AS k, epoch_us(built_at) AS own_at FROM precomputed_bitmaps),
tf AS (SELECT tech_id, CASE WHEN count(*) = count(added_at) THEN min(epoch_us(added_at)) END AS since FROM technologies GROUP BY tech_id),
targets AS (SELECT 'phenotype' AS t, code AS k, CASE WHEN count(*) = count(added_at) THEN min(epoch_us(added_at)) END AS since FROM phenotype_terms GROUP BY code UNION ALL SELECT 'sex', 'male', NULL UNION ALL SELECT 'sex', 'female', NULL),
found AS (
  SELECT 'sample_phenotype' AS tab, p.link_id AS row_key, epoch_us(p.assigned_at) AS own_at FROM sample_phenotype p LEFT JOIN sf ON sf.sample_id = p.sample_id
  WHERE p.sample_id IS NOT NULL AND (sf.sample_id IS NULL OR sf.since > epoch_us(p.assigned_at))
  UNION ALL
  SELECT 'samples', s.sample_id, s.own_at FROM s LEFT JOIN tf g ON g.tech_id = s.tech_id WHERE s.tech_id IS NOT NULL AND (g.tech_id IS NULL OR g.since > s.own_at)
  UNION ALL
  SELECT 'precomputed_bitmaps', b.bitmap_id, b.own_at FROM b LEFT JOIN targets x ON x.t = b.t AND x.k = b.k WHERE b.k IS NOT NULL AND b.t <> 'tech' AND (x.k IS NULL OR x.since > b.own_at)
  UNION ALL
  SELECT 'precomputed_bitmaps', b.bitmap_id, b.own_at FROM b LEFT JOIN tf g ON CAST(g.tech_id AS DOUBLE) = TRY_CAST(b.k AS DOUBLE) WHERE b.k IS NOT NULL AND b.t = 'tech' AND (g.tech_id IS NULL OR g.since > b.own_at)
), named AS (SELECT tab, CASE WHEN own_at IS NULL THEN 'unknown' ELSE strftime(make_timestamp(own_at), '%Y-%m') END AS month_key, CAST(row_key AS BIGINT) AS row_key FROM found)
"""

SQL = {
    "p1_found": f"""
WITH c AS (SELECT call_id, file_id, {_CANON} AS chrom, pos, ref, alt, gt_ac, sample_id, filter_pass, dp, gq, qual FROM calls)
SELECT call_id FROM (SELECT call_id, file_id, min(file_id) OVER (PARTITION BY chrom, pos, ref, alt, gt_ac, sample_id, filter_pass, dp, gq, qual) AS first_file FROM c) WHERE file_id > first_file
""",
    "p1_files": f"""
WITH c AS (SELECT call_id, file_id, {_CANON} AS chrom, pos, ref, alt, gt_ac, sample_id, filter_pass, dp, gq, qual FROM calls),
f AS (SELECT call_id, file_id > min(file_id) OVER (PARTITION BY chrom, pos, ref, alt, gt_ac, sample_id, filter_pass, dp, gq, qual) AS again FROM c)
SELECT CASE WHEN again THEN 'repeats' ELSE 'kept' END AS kind, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(call_id) AS BIGINT) AS id_sum, true AS well_sized FROM f GROUP BY 1
""",
    "p1_claims": """
WITH h AS (SELECT file_id, count(*) AS held FROM calls GROUP BY file_id), f AS (SELECT file_id, n_rows AS claim, true AS listed FROM call_files),
j AS (SELECT claim, listed, coalesce(held, 0) AS held FROM f FULL OUTER JOIN h ON h.file_id = f.file_id)
SELECT CASE WHEN listed IS NULL THEN 'not listed' WHEN claim IS NULL THEN 'no claim' WHEN claim = held THEN 'as claimed' WHEN held = 0 THEN 'empty' ELSE 'wrong claim' END AS status,
  count(*) AS n_files, CAST(sum(claim) AS BIGINT) AS claimed, CAST(sum(held) AS BIGINT) AS held FROM j GROUP BY ALL
""",
    "p4_found": f"SELECT chrom, pos, alt FROM (SELECT {_CANON} AS chrom, pos, alt FROM calls) GROUP BY chrom, pos, alt HAVING count(*) > 0.01 * (SELECT count(*) FROM calls)",
    "p4_measures": f"""
SELECT chrom, pos, alt, count(*) AS n_rows, CAST(sum(CASE WHEN filter_pass THEN 1 ELSE 0 END) AS BIGINT) AS n_pass, CAST(sum(gt_ac) AS BIGINT) AS sum_ac,
  count(dp) AS n_dp, CAST(sum(dp) AS BIGINT) AS sum_dp, min(qual) AS min_qual, max(qual) AS max_qual
FROM (SELECT {_CANON} AS chrom, pos, alt, filter_pass, gt_ac, dp, qual FROM calls) GROUP BY chrom, pos, alt
""",
    "p4_samples": f"SELECT chrom, pos, alt, count(DISTINCT sample_id) AS n_samples FROM (SELECT {_CANON} AS chrom, pos, alt, sample_id FROM calls) GROUP BY chrom, pos, alt",
    "p6_found": _ORPHANS + "SELECT DISTINCT tab, month_key, row_key FROM named",
    "p6_report": _ORPHANS + "SELECT tab, month_key, count(*) AS n_rows FROM named GROUP BY tab, month_key",
}


# The next three say the same as the operators in other words: tokens by regular expression instead of quote pieces,
# replay by windows instead of snapshot differences, full matches instead of the least-cost parse.
SQL["p2_found"] = r"""
WITH m AS (SELECT row_number() OVER () AS rid, row_id, phenotype_codes FROM manifest),
t AS (SELECT rid, row_id, unnest(regexp_extract_all(phenotype_codes, '"(?:[^"]|"")*"|''(?:[^'']|'''')*''|[^,;|/\s]+|[,;|/\t\r\n]')) AS tok, generate_subscripts(regexp_extract_all(phenotype_codes, '"(?:[^"]|"")*"|''(?:[^'']|'''')*''|[^,;|/\s]+|[,;|/\t\r\n]'), 1) AS ord FROM m),
k AS (SELECT *, CASE WHEN regexp_full_match(tok, '[,;|/\t\r\n]') THEN 'cut' WHEN regexp_full_match(tok, '"(?:[^"]|"")*"') THEN 'double' WHEN regexp_full_match(tok, '''(?:[^'']|'''')*''') THEN 'single' WHEN regexp_full_match(tok, '[A-Z]{2}-?[0-9]{2,3}(\.[0-9])?') THEN 'code' ELSE 'word' END AS kind FROM t),
q AS (SELECT *, lag(kind) OVER (PARTITION BY rid ORDER BY ord) AS before FROM k),
g AS (SELECT *, sum(CASE WHEN kind = 'word' AND before = 'word' THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY ord) AS grp FROM q),
v AS (SELECT rid, row_id, grp, trim(CASE any_value(kind) WHEN 'double' THEN replace(substr(any_value(tok), 2, length(any_value(tok)) - 2), '""', '"') WHEN 'single' THEN replace(substr(any_value(tok), 2, length(any_value(tok)) - 2), '''''', '''') ELSE string_agg(tok, ' ' ORDER BY ord) END) AS item FROM g WHERE kind <> 'cut' GROUP BY rid, row_id, grp)
SELECT DISTINCT row_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY grp) AS INT) AS item_no, item FROM v WHERE item <> ''
"""
_UNWRAP = "CASE WHEN json_valid({x}) AND json_type({x}) = 'VARCHAR' THEN json_extract_string({x}, '$') ELSE {x} END"
SQL["p3_found"] = f"""
WITH l AS (SELECT event_id, event_type, sample_names, notes, {_EPOCH.format(c="event_time")} AS t FROM changelog),
n1 AS (SELECT event_id, t, {_UNWRAP.format(x="notes")} AS n FROM l WHERE t IS NOT NULL), n2 AS (SELECT event_id, t, {_UNWRAP.format(x="n")} AS n FROM n1), n3 AS (SELECT event_id, t, {_UNWRAP.format(x="n")} AS n FROM n2 WHERE json_valid(n)),
e0 AS (SELECT event_id, t, CASE json_type(n) WHEN 'ARRAY' THEN CAST(json_extract(n, '$[*]') AS VARCHAR[]) WHEN 'OBJECT' THEN [n] END AS es FROM n3),
e1 AS (SELECT event_id, t, unnest(es) AS e, generate_subscripts(es, 1) AS no FROM e0),
e2 AS (SELECT event_id, t, no, {_UNWRAP.format(x="e")} AS e FROM e1),
e AS (SELECT event_id, t, no, json_extract_string(e, '$.sample') AS s, lower(trim(json_extract_string(e, '$.old'))) AS old, lower(trim(json_extract_string(e, '$.new'))) AS new FROM e2 WHERE json_extract_string(e, '$.field') = 'sex'),
c AS (SELECT * FROM e WHERE new IN ('male', 'female') AND s IS NOT NULL),
b AS (SELECT s, min(t) AS t FROM (SELECT t, unnest(CAST(json_extract_string(sample_names, '$[*]') AS VARCHAR[])) AS s FROM l WHERE event_type IN ('preprocess', 'add_samples') AND sample_names IS NOT NULL) GROUP BY s),
i AS (SELECT s, t, arg_max(new, (event_id, no)) AS v FROM c GROUP BY s, t),
f AS (SELECT s, old AS v FROM c QUALIFY row_number() OVER (PARTITION BY s ORDER BY t, event_id, no) = 1),
st AS (SELECT f.s, -1 AS k, b.t, f.v FROM f LEFT JOIN b ON b.s = f.s UNION ALL SELECT s, row_number() OVER (PARTITION BY s ORDER BY t), t, v FROM i),
ch AS (SELECT *, lag(v) OVER (PARTITION BY s ORDER BY k) AS pv FROM st),
ve AS (SELECT s, t, v, count(*) OVER (PARTITION BY s) AS n FROM ch WHERE k = -1 OR v IS DISTINCT FROM pv)
SELECT DISTINCT s AS sample_name, v AS sex, t AS valid_from_us FROM ve WHERE n >= 2
"""
SQL["p3_history"] = SQL["p3_found"].rpartition("SELECT DISTINCT")[0].replace("SELECT s, t, v, count(*) OVER (PARTITION BY s) AS n", "SELECT s, t, v, lead(t) OVER (PARTITION BY s ORDER BY k) AS t2") + "SELECT s AS sample_name, v AS sex, t AS valid_from_us, t2 AS valid_to_us FROM ve"
SQL["p5_found"] = r"""
WITH raw AS (SELECT line_id, batch_id, line_no, regexp_replace(line_text, '\r$', '') AS x FROM manifest_lines),
h AS (SELECT batch_id, string_split(regexp_replace(min(x), '[^a-z_\t]', '', 'g'), chr(9)) AS h FROM raw WHERE line_no = 1 GROUP BY batch_id),
r AS (SELECT line_id, batch_id, line_no, h, regexp_full_match(x, '("([^"]|"")*"|[^"\t]*)(\t("([^"]|"")*"|[^"\t]*))*') AS ok, regexp_extract_all(x, '(?:^|\t)("(?:[^"]|"")*"|[^"\t]*)', 1) AS c FROM raw JOIN h USING (batch_id) WHERE line_no > 1 AND trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)) <> ''),
s AS (SELECT *, CASE WHEN NOT ok THEN 'quoting' WHEN len(c) <> len(h) THEN 'columns' END AS bad, list_transform(['sample_name', 'sex', 'vcf_path'], lambda n: coalesce(c[list_position(h, n)], '')) AS q FROM r),
u AS (SELECT *, list_transform(q, lambda v: trim(CASE WHEN v LIKE '"%' THEN replace(substr(v, 2, length(v) - 2), '""', '"') ELSE v END)) AS v FROM s WHERE bad IS NULL),
w AS (SELECT *, min(line_no) OVER (PARTITION BY batch_id, v[1]) AS first_no FROM u)
SELECT DISTINCT line_id, reason FROM (
  SELECT line_id, bad AS reason FROM s WHERE bad IS NOT NULL
  UNION ALL SELECT line_id, 'sex' FROM w WHERE v[2] NOT IN ('male', 'female')
  UNION ALL SELECT line_id, 'vcf_path' FROM w WHERE v[3] = '' OR contains(v[3], ' ') OR NOT regexp_matches(v[3], '\.vcf(\.gz)?$')
  UNION ALL SELECT line_id, 'sample_name' FROM w WHERE v[1] = '' OR line_no > first_no)
"""
SQL["p5_loaded"] = SQL["p5_found"].rpartition("SELECT DISTINCT")[0].replace("['sample_name', 'sex', 'vcf_path']", "['sample_name', 'sex', 'vcf_path', 'tech_name', 'phenotype_codes']") + r"""
SELECT line_id, v[1] AS sample_name, v[2] AS sex, v[4] AS tech_name, v[3] AS vcf_path, v[5] AS phenotype_codes FROM w
WHERE v[2] IN ('male', 'female') AND v[3] <> '' AND NOT contains(v[3], ' ') AND regexp_matches(v[3], '\.vcf(\.gz)?$') AND v[1] <> '' AND line_no <= first_no
"""


