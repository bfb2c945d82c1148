"""Files to cohort and back: build, queries, changes, annotation, command line."""

import gzip
import json
import os
import pathlib
import warnings

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import DataFrameReader

from varicohort import cli
from varicohort.database import Database, UpdateError, next_version
from varicohort.operators.filters import CohortWarning
from varicohort.plans import export
from varicohort.plans.cohort import Quality
from varicohort.sources.synth import synthetic
from varicohort.sources.texts import ManifestError, parse_locus, parse_region, read_manifest, read_requests, read_updates

VCF = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t{}\n"
ROWS = {
    "A": ["1\t1500\t.\tA\tT\t50\tPASS\t.\tGT:DP:GQ\t0/1:30:99", "chr1\t1600\t.\tG\tC,*\t.\tPASS\t.\tGT\t1|2", "chrX\t5000000\t.\tA\tG\t9\tPASS\t.\tGT:DP\t1:12"],
    "B": ["chr1\t1500\t.\tA\tT\t50\tLowQ\t.\tGT\t./.", "chr1\t1700\t.\tG\tC\t.\tPASS\t.\tGT\t./.", "chr1\t1800\t.\tG\t<DEL>\t.\tPASS\t.\tGT\t0/1", "MT\t100\t.\tC\tA\t.\t.\t.\tGT\t1/1"],
    "C": ["chr1\t1500\t.\tA\tT,G\t50\tPASS\t.\tDP:GT\t-5:1/2", "chrUn_1\t5\t.\tA\tT\t.\tPASS\t.\tGT\t0/1", "chr1\t1900\t.\tA\tT\t.\tPASS\t.\tGT\t0/0"],
    "D": [],
}


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    for n, rows in ROWS.items():
        (d / f"{n}.vcf").write_text(VCF.format(n) + "".join(r + "\n" for r in rows))
    (d / "KIT.bed").write_text("# x\ntrack name=k\n1\t999\t1600\tx\nchrX\t0\t6000000\n")
    head = "sample_name\tsex\ttech_name\tvcf_path\tphenotype_codes\n"
    (d / "m.tsv").write_text(head + "A\tmale\twgs\tA.vcf\tP1, P2\n\nB\tfemale\tKIT\tB.vcf\tP1\nC\tfemale\twgs\tC.vcf\tP3\n")
    (d / "more.tsv").write_text(head + "D\tmale\tKIT\tD.vcf\tP1\n")
    (d / "bad.tsv").write_text(head + "A\tman\twgs\tA.vcf\tP1\n")
    (d / "in.vcf").write_text("##fileformat=VCFv4.1\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\nchr1\t1500\t.\tA\tT,G\t.\t.\tDP=5\n1\t1501\t.\tA\tC\t.\t.\t.\nchr1\t1502\t.\tA\t.\t.\t.\t.\n")
    return d


@pytest.fixture
def db(spark, files, tmp_path):
    return Database.create_from_manifest(spark, str(tmp_path / "db"), str(files / "m.tsv"), "GRCh37", str(files))


def one(df):
    (r,) = df.collect()
    return r.asDict()


def test_manifest_errors(spark, files, tmp_path):
    s, t = read_manifest(spark, str(files / "m.tsv"), str(files))
    assert [x.phenotype_codes for x in s] == [("P1", "P2"), ("P1",), ("P3",)] and list(t) == ["wgs", "KIT"] and t["wgs"] is None
    with pytest.raises(ManifestError, match="neither male nor female"):
        read_manifest(spark, str(files / "bad.tsv"))
    with pytest.raises(ManifestError, match="bed_dir"):
        read_manifest(spark, str(files / "m.tsv"))
    (tmp_path / "y.tsv").write_text("sample_name\tsex\ttech_name\tvcf_path\tphenotype_codes\nA\tman\tKIT\tnone.vcf\t,\nA\tmale\n")
    with pytest.raises(ManifestError, match="9 problems") as e:  # all at once
        read_manifest(spark, str(tmp_path / "y.tsv"))
    assert all(x in str(e.value) for x in ("several rows", "no phenotype code", "no such file", "bed_dir", "no technology"))
    for body in ("", "sample_name\tsex\n", "sample_name\tsex\ttech_name\tvcf_path\tphenotype_codes\nA\tmale\twgs\tnone.vcf\tP\n"):
        (tmp_path / "x.tsv").write_text(body)
        with pytest.raises(ManifestError):
            read_manifest(spark, str(tmp_path / "x.tsv"))


def test_ingest_rules(db):
    got = {(r.chrom, r.pos, r.ref, r.alt, r.sample_id, r.is_het, r.is_hom, r.is_fail) for r in db.cohort.calls.collect()}
    assert got == {
        ("chr1", 1500, "A", "T", 0, True, False, False), ("chr1", 1600, "G", "C", 0, True, False, False), ("chrX", 5000000, "A", "G", 0, True, False, False),
        ("chr1", 1500, "A", "T", 1, False, False, True), ("chrM", 100, "C", "A", 1, False, True, False),
        ("chr1", 1500, "A", "T", 2, True, False, False), ("chr1", 1500, "A", "G", 2, True, False, False),
    }


def test_malformed_lines(spark, tmp_path):
    from varicohort.sources.vcf import explode_calls, malformed, read_lines

    (tmp_path / "x y+z.vcf").write_text(VCF.format("X") + "\n".join([ROWS["A"][0], "chr1\tten\t.\tA\tT\t.\t.\t.\tGT\t0/1", "chr1\t5\t.\tA", ""]))
    lines = read_lines(spark, {str(tmp_path / "x y+z.vcf"): 3})
    assert {(r.sample_id, r.reason) for r in malformed(lines).collect()} == {(3, "position"), (3, "columns")}
    assert explode_calls(lines, strict=False).count() == 1
    with pytest.raises(Exception, match="malformed VCF line"):
        explode_calls(lines).collect()


def test_queries(db):
    r = one(db.query("1", 1500, alt="T"))
    assert (r["AC"], r["AN"], r["N_HET"], r["N_FAIL"], r["N_HOM_REF"], r["n_eligible"]) == (2, 6, 2, 1, 0, 3)
    assert one(db.query("chr1", 1600))["AN"] == 6  # end of the interval is inside
    assert one(db.query("MT", 100))["n_eligible"] == 2  # the kit does not cover it, its carrier is not eligible
    assert one(db.query("chrX", 5_000_000)) | {"AF": None} == {"chrom": "chrX", "pos": 5000000, "ref": "A", "alt": "G", "AC": 1, "AN": 5, "AF": None, "n_eligible": 3, "N_HET": 0, "N_HOM_ALT": 1, "N_HOM_REF": 2, "N_FAIL": 0, "N_NO_COVERAGE": 0}
    assert [(r.pos, r.alt) for r in db.query_region("chr1", 1500, 1600).collect()] == [(1500, "G"), (1500, "T"), (1600, "C")]
    assert [(r.chrom, r.alt) for r in db.query_batch_multi([("X", 5000000, "A", "G"), ("1", 1500, None, None), ("chrX", 5000000, "A", "G")]).collect()] == [("chrX", "G"), ("chr1", "G"), ("chr1", "T")]
    assert db.query_region_multi([("chr1", 1, 2000), ("1", 1500, 1500)]).count() == 3
    with pytest.warns(CohortWarning, match="chr9"):
        assert db.query("9", 5).count() == 0
    with pytest.warns(CohortWarning, match="P9"):
        assert db.query("chr1", 1500, phenotype=["P9"]).count() == 0
    with pytest.raises(ValueError):
        db.query("chr1", 1500, min_quality_evidence=1)


def test_variant_info(db):
    got = [(r.sample_name, r.alt, r.genotype, r.filter_pass) for r in db.variant_info("chr1", 1500, alt="T").collect()]
    assert got == [("A", "T", "het", True), ("B", "T", "alt", False), ("C", "T", "het", True)]
    assert [(r.sample_name, r.genotype) for r in db.variant_info("chr1", 1600, "G", "C", min_pass=1).collect()] == [("A", "het"), ("B", "no_coverage")]
    with pytest.warns(CohortWarning, match="Multiple"):
        db.variant_info("chr1", 1500)


def test_pruning(db):
    from varicohort.plans.queries import slice_calls

    plan = slice_calls(db.cohort, "chr1", 1500, 1500)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(chrom" in plan and "bucket" in plan.split("PartitionFilters")[1].split("PushedFilters")[0] and "GreaterThanOrEqual(pos,1500)" in plan


def test_dump_and_annotate(db, files, tmp_path):
    stats = db.dump(str(tmp_path / "o.csv"), by_sex=True)
    lines = (tmp_path / "o.csv").read_text().split("\n")
    assert stats == {"n_rows": 4, "n_buckets": 2, "n_chroms": 2} and lines[0].startswith("chrom,pos,ref,alt,AC,AN,AF,") and lines[0].endswith("N_NO_COVERAGE_female")
    assert [x.split(",")[:4] for x in lines[1:-1]] == [["chr1", "1500", "A", "G"], ["chr1", "1500", "A", "T"], ["chr1", "1600", "G", "C"], ["chrX", "5000000", "A", "G"]]  # nobody eligible carries the chrM variant
    assert db.annotate_vcf(str(files / "in.vcf"), str(tmp_path / "o.vcf")) == {"n_variants": 3, "n_annotated": 1, "n_uncovered": 1}
    body = [x.split("\t") for x in (tmp_path / "o.vcf").read_text().splitlines() if x[0] != "#"]
    assert body[0][7] == "DP=5;COHORT_AC=2,1;COHORT_AN=6;COHORT_AF=0.3333333333,0.1666666667;COHORT_N_HET=2,1;COHORT_N_HOM_ALT=0,0;COHORT_N_HOM_REF=0,2;COHORT_N_FAIL=1;COHORT_N_NO_COVERAGE=0,0"
    assert body[1][7].startswith("COHORT_AC=0;COHORT_AN=6;COHORT_AF=0;") and body[2][7] == "COHORT_AN=0"
    export.write_csv_parts(db.dump_frame(by_sex=True), str(tmp_path / "parts"))
    back = db.spark.read.csv(str(tmp_path / "parts"), header=True)
    assert sorted(back.columns) == sorted(lines[0].split(",")) and back.count() == 4
    db.dump(f"file://{tmp_path}/o2.csv.gz", by_sex=True)
    assert gzip.open(tmp_path / "o2.csv.gz", "rt").read() == (tmp_path / "o.csv").read_text()
    assert sum(x.startswith("##INFO=<ID=COHORT_") for x in (tmp_path / "o.vcf").read_text().splitlines()) == 8


def test_changes(db, files):
    with pytest.raises(UpdateError):
        db.add_samples(str(files / "m.tsv"), str(files))
    with pytest.raises(UpdateError):
        db.remove_samples(["A", "Z"])
    with pytest.raises(UpdateError):
        db.update_sample_metadata([{"sample_name": "A", "field": "sex", "new_value": "female"}, {"sample_name": "A", "field": "age", "new_value": "3"}])
    assert one(db.query("chr1", 1500, alt="T"))["AN"] == 6
    assert db.add_samples(str(files / "more.tsv"), str(files)) == {"n_samples": 1, "n_new": 0, "n_updated": 0}
    assert one(db.query("chr1", 1500, alt="T"))["AN"] == 8 and db.manifest["db_version"] == "1.1"
    db.update_sample_metadata([{"sample_name": "A", "field": "sex", "new_value": "female"}, {"sample_name": "A", "field": "phenotype_codes", "new_value": "P7,P1,P7"}], "why")
    assert one(db.query("chrX", 5_000_000))["AN"] == 7 and db.get_all_phenotypes() == ["P1", "P3", "P7"]
    assert json.loads(db.changelog(1)[0]["notes"]) == {"sample": "A", "field": "phenotype_codes", "old": "P1,P2", "new": "P1,P7", "operator_note": "why"}
    db.remove_samples(["D", "C"])
    assert [s["sample_name"] for s in db.list_samples()] == ["A", "B"] and db.manifest["next_sample_id"] == 4
    assert one(db.query("chr1", 1500, alt="G"))["AC"] == 0  # stays until compaction
    assert ("warning", "call of a removed sample: 2 calls") in db.check()
    assert db.compact()["variants_removed"] == 1
    assert db.query("chr1", 1500, alt="G").count() == 0 and [s for s, _ in db.check()] == ["info"]
    db.set_db_version("2.0-x")
    assert Database(db.spark, db.root).info()["db_version"] == "2.0-x" and next_version("2.0-x") == "2.0-x.1" and next_version("7") == "8"
    assert [e["event_type"] for e in db.changelog()] == ["version_set", "compact", "remove_samples", "UPDATE_SAMPLE", "UPDATE_SAMPLE", "add_samples", "preprocess"]


def test_changes_of_samples_list_no_calls_again(db, monkeypatch):
    read, asked = DataFrameReader.parquet, []
    monkeypatch.setattr(DataFrameReader, "parquet", lambda self, *paths, **o: (asked.extend(paths), read(self, *paths, **o))[1])
    db.update_sample_metadata([{"sample_name": "A", "field": "sex", "new_value": "female"}])
    db.remove_samples(["B"])
    assert asked and not [p for p in asked if "/calls/" in p]
    assert [r["sample_name"] for r in db.list_samples()] == ["A", "C"] and one(db.query("chr1", 1600))["AC"] == 1


def test_check_of_damaged_folders(spark, db, tmp_path):
    import shutil

    from varicohort.database import check_database

    where = db.root.removeprefix("file://")
    assert check_database(spark, str(tmp_path / "none")) == [("error", "manifest.json is missing")]
    assert {s for s, _ in check_database(spark, where)} == {"info"}
    calls = sorted(str(p) for p in pathlib.Path(f"{where}/calls").rglob("*.parquet"))
    t = pq.read_table(max(calls, key=os.path.getsize), partitioning=None)
    bad = f"{os.path.dirname(calls[0])}/part-9.parquet"
    pq.write_table(t.sort_by([("pos", "descending")]) if t["pos"].combine_chunks()[0] != t["pos"].combine_chunks()[-1] else pa.concat_tables([t, t.set_column(t.schema.get_field_index("pos"), "pos", pa.array([1] * t.num_rows, pa.int32()))]), bad)
    assert [m.endswith("is not in order of position") for _, m in check_database(spark, where)] == [True]
    pq.write_table(t.drop_columns(["alt"]), bad)
    assert "lacks columns alt" in check_database(spark, where)[0][1]
    with open(bad, "wb") as f:
        f.write(b"PAR1 no parquet")
    assert "cannot be read" in check_database(spark, where)[0][1]
    os.remove(bad)
    shutil.rmtree(f"{where}/dims/{db.manifest['dims']}/capture")
    assert check_database(spark, where) == [("error", f"dims/{db.manifest['dims']}/capture is missing")]
    with open(f"{where}/manifest.json", "w") as f:
        f.write("{}")
    assert ("error", "manifest lacks genome_build") in check_database(spark, where)
    with open(f"{where}/manifest.json", "w") as f:
        f.write("{")
    assert "cannot be parsed" in check_database(spark, where)[0][1]


def test_a_broken_build_goes_on(spark, files, tmp_path, monkeypatch):
    from varicohort import database

    build = lambda **a: Database.create_from_manifest(spark, str(tmp_path / "b"), str(files / "m.tsv"), "GRCh37", str(files), **a)
    store, write, wrote = database._store_dims, database._write_calls, []
    monkeypatch.setattr(database, "_store_dims", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        build()
    monkeypatch.setattr(database, "_store_dims", store)
    monkeypatch.setattr(database, "_write_calls", lambda *a: (wrote.append(1), write(*a)))
    assert one(build().query("chr1", 1600))["AN"] == 6 and not wrote  # the calls were there
    build(force=True, quality=Quality(min_dp=5))
    assert wrote == [1]


def test_quality_build(spark, files, tmp_path):
    db = Database.create_from_manifest(spark, str(tmp_path / "q"), str(files / "m.tsv"), "GRCh37", str(files), quality=Quality(min_dp=20, min_covered=1))
    assert db.manifest["schema_version"] == "3.0"
    assert one(db.query("chr1", 1600))["N_NO_COVERAGE"] == 1  # the kit has no evidence there
    assert one(db.query("chr1", 1500, alt="T", min_quality_evidence=1))["N_NO_COVERAGE"] == 0  # its only sample failed


def test_command_line(spark, db, files, tmp_path, capsys):
    run = lambda *a: (cli.main([*a], spark), capsys.readouterr().out)[1]
    assert "AC=2  AN=6  AF=0.3333" in run("query", "--db", db.root, "--locus", "chr1:1500", "--alt", "T")
    assert run("query", "--db", db.root, "--locus", "chr9:1", "--no-warn").strip() == "No variants found for the given filters."
    (tmp_path / "r.txt").write_text("chr1 1500 A T\n\n1 1600\n")
    assert read_requests(str(tmp_path / "r.txt"))[1] == ("1", 1600, None, None)
    assert len(json.loads(run("query", "--db", db.root, "--from-file", str(tmp_path / "r.txt"), "--format", "json"))) == 2
    assert run("query", "--db", db.root, "--region", "chr1:1-1600", "--format", "tsv").count("\n") == 4
    assert '"filter": "FAIL"' in run("variant-info", "--db", db.root, "--locus", "chr1:1500", "--alt", "T", "--format", "json")
    assert "WGS" not in run("info", "--db", db.root) and "\tP1,P2\t" in run("info", "--db", db.root, "--samples", "--format", "tsv")
    run("update-db", "--db", db.root, "--update-sample", "B", "--set-sex", "male", "--compact")
    assert run("version", "show", "--db", db.root).strip() == "1.1" and "[info]" in run("check", "--db", db.root)
    (tmp_path / "u.tsv").write_text("sample_name\tfield\tnew_value\n\nA\tsex\tfemale\n")
    assert read_updates(spark, str(tmp_path / "u.tsv")) == [{"sample_name": "A", "field": "sex", "new_value": "female"}]
    with pytest.raises(SystemExit):
        cli.main(["query", "--db", db.root], spark)
    assert parse_locus("HLA:1:5") == ("HLA:1", 5) and parse_region("chr1:5-9") == ("chr1", 5, 9)
    with pytest.raises(ValueError):
        parse_locus("chr1")


def test_synthetic_and_benchmark(spark):
    a, b = (sorted(map(tuple, synthetic(spark, 20, 50, ["chr1", "chr2"], 7)[0].repartition(n).collect()), key=str) for n in (1, 5))
    assert a == b and {r[4] for r in a} <= {1, 2} and a != sorted(map(tuple, synthetic(spark, 20, 50, ["chr1", "chr2"], 8)[0].collect()), key=str)
    from varicohort.benchmark import run_benchmark_with_synth

    report = run_benchmark_with_synth(spark, 20, 50)
    assert {"point_cold", "point_warm", "batch_100", "batch_1000", "region_1mbp", "export", "build_s"} <= set(report)


def test_shortest_decimals(spark):
    from pyspark.sql import functions as F

    from varicohort.session import rows_table

    xs = [0.0, 1.0, 0.5, 1 / 3, 0.001, 0.000999, 0.0001, 0.00012345, 9.9e-5, 5e-05, 1 / 30000, 2.5e-10]
    got = rows_table(spark, [(x,) for x in xs], "x double").select("x", export.plain_float(F.col("x")).alias("t")).collect()
    assert {r.x: r.t for r in got} == {x: repr(x) for x in xs}


def test_streaming_append(spark, tmp_path):
    from varicohort.streaming.append import append_calls

    for n in (1, 2):
        synthetic(spark, 10, 20, ["chr1"], n)[0].write.mode("append").parquet(str(tmp_path / "in"))
        append_calls(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(str(tmp_path / "in")).count()


@pytest.fixture(autouse=True)
def quiet():
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", ResourceWarning)
        yield
