"""Command line: ``python -m varicohort.cli COMMAND --help``."""

from __future__ import annotations

import argparse
import json
import sys
import warnings

from varicohort import printers
from varicohort.database import Database, check_database
from varicohort.operators.filters import CohortWarning
from varicohort.plans.cohort import Quality
from varicohort.session import build_session
from varicohort.sources.texts import parse_locus, parse_region, read_requests, read_updates


def _filters(p: argparse.ArgumentParser) -> None:
    p.add_argument("--db", required=True)
    p.add_argument("--phenotype", action="append", default=[], help="codes to include, ^CODE to exclude; repeatable, commas allowed")
    p.add_argument("--sex", default="both", choices=["male", "female", "both"])
    p.add_argument("--tech", action="append", default=[], help="technologies to include, ^NAME to exclude")
    for name in ("--min-pass", "--min-observed", "--min-quality-evidence"):
        p.add_argument(name, type=int, default=0)
    p.add_argument("--no-warn", action="store_true")


def _sf(a: argparse.Namespace) -> dict:
    return {k: getattr(a, k) for k in ("phenotype", "sex", "tech", "min_pass", "min_observed", "min_quality_evidence")}


def _commas(values: list[str]) -> list[str]:
    return [t.strip() for v in values for t in v.split(",") if t.strip()]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="varicohort")
    top.add_argument("--master", default="local[*]")
    sub = top.add_subparsers(dest="command", required=True)
    fmt = lambda p, *c: p.add_argument("--format", dest="fmt", default=c[0], choices=c)

    q = sub.add_parser("query", help="allele frequencies at a locus, in a region, or of a list")
    _filters(q)
    mode = q.add_mutually_exclusive_group(required=True)
    mode.add_argument("--locus")
    mode.add_argument("--region")
    mode.add_argument("--from-file")
    q.add_argument("--ref")
    q.add_argument("--alt")
    fmt(q, "text", "json", "tsv")

    v = sub.add_parser("variant-info", help="carriers of a variant")
    _filters(v)
    v.add_argument("--locus", required=True)
    v.add_argument("--ref")
    v.add_argument("--alt")
    fmt(v, "text", "json", "tsv")

    n = sub.add_parser("annotate", help="add INFO fields to a VCF")
    _filters(n)
    n.add_argument("--input", required=True)
    n.add_argument("--output", required=True)
    n.add_argument("--prefix", default="COHORT_")

    d = sub.add_parser("dump", help="export as CSV")
    _filters(d)
    d.add_argument("--output", "-o")
    d.add_argument("--chrom")
    d.add_argument("--start", type=int)
    d.add_argument("--end", type=int)
    for flag in ("--by-sex", "--by-tech", "--all-groups", "--all-variants"):
        d.add_argument(flag, action="store_true")
    d.add_argument("--by-phenotype", action="append", default=[])

    i = sub.add_parser("info", help="what a cohort holds")
    i.add_argument("--db", required=True)
    what = i.add_mutually_exclusive_group()
    what.add_argument("--samples", action="store_true")
    what.add_argument("--changelog", action="store_true")
    fmt(i, "table", "tsv", "json")

    w = sub.add_parser("version", help="show or set the version label")
    w.add_argument("action", choices=["show", "set"])
    w.add_argument("--db", required=True)
    w.add_argument("new_version", nargs="?")

    c = sub.add_parser("create-db", help="build a cohort from single-sample VCF files")
    c.add_argument("--manifest", required=True)
    c.add_argument("--output-dir", required=True)
    c.add_argument("--genome-build", required=True, choices=["GRCh37", "GRCh38"])
    c.add_argument("--bed-dir")
    c.add_argument("--force", action="store_true")
    c.add_argument("--db-version", default="1.0")
    c.add_argument("--min-dp", type=int, default=0)
    c.add_argument("--min-gq", type=int, default=0)
    c.add_argument("--min-qual", type=float, default=0.0)
    c.add_argument("--min-covered", type=int, default=0)

    u = sub.add_parser("update-db", help="remove, re-label, add, compact; in this order")
    u.add_argument("--db", required=True)
    u.add_argument("--remove-samples", action="append", default=[])
    u.add_argument("--add-samples", action="append", default=[])
    u.add_argument("--compact", action="store_true")
    u.add_argument("--update-sample")
    u.add_argument("--set-sex", choices=["male", "female"])
    u.add_argument("--set-phenotype")
    u.add_argument("--update-samples-file")
    u.add_argument("--operator-note")
    u.add_argument("--bed-dir")
    u.add_argument("--db-version")

    k = sub.add_parser("check", help="integrity of a cohort")
    k.add_argument("--db", required=True)

    b = sub.add_parser("benchmark", help="times of the query shapes")
    b.add_argument("--n-samples", type=int, default=1000)
    b.add_argument("--n-variants", type=int, default=10_000)
    b.add_argument("--output", default="benchmark_report.json")
    b.add_argument("--db")
    return top


def main(argv: list[str] | None = None, spark=None) -> int:
    top = parser()
    a = top.parse_args(argv)
    if getattr(a, "no_warn", False):
        warnings.filterwarnings("ignore", category=CohortWarning)
    if a.command == "dump" and a.chrom is None and (a.start is not None or a.end is not None):
        top.error("--start and --end need --chrom")
    spark = spark or build_session(a.master)
    rows = lambda df: [r.asDict() for r in df.collect()]
    say = print

    if a.command == "create-db":
        Database.create_from_manifest(spark, a.output_dir, a.manifest, a.genome_build, a.bed_dir, a.db_version, Quality(a.min_dp, a.min_gq, a.min_qual, a.min_covered), a.force)
        return 0
    if a.command == "benchmark":
        from varicohort.benchmark import run_benchmark, run_benchmark_with_synth

        report = run_benchmark(Database(spark, a.db)) if a.db else run_benchmark_with_synth(spark, a.n_samples, a.n_variants)
        with open(a.output, "w") as f:
            json.dump(report, f, indent=2)
        return 0
    if a.command == "check":
        found = check_database(spark, a.db)
        say("\n".join(f"[{s}] {m}" for s, m in found))
        return int(any(s == "error" for s, _ in found))
    db = Database(spark, a.db)
    if a.command == "query":
        if a.locus:
            out = db.query(*parse_locus(a.locus), ref=a.ref, alt=a.alt, **_sf(a))
        elif a.region:
            out = db.query_region(*parse_region(a.region), **_sf(a))
        else:
            out = db.query_batch_multi(read_requests(a.from_file), **_sf(a))
        say(printers.results(rows(out), a.fmt))
    elif a.command == "variant-info":
        chrom, pos = parse_locus(a.locus)
        say(printers.carriers(rows(db.variant_info(chrom, pos, a.ref, a.alt, **_sf(a))), (chrom, pos, a.ref or ".", a.alt or "."), a.fmt))
    elif a.command == "annotate":
        say(json.dumps(db.annotate_vcf(a.input, a.output, a.prefix, **_sf(a))))
    elif a.command == "dump":
        stats = db.dump(a.output, chrom=a.chrom, start=a.start, end=a.end, by_sex=a.by_sex, by_tech=a.by_tech, by_phenotype=_commas(a.by_phenotype), all_groups=a.all_groups, include_ac_zero=a.all_variants, **_sf(a))
        print(json.dumps(stats), file=sys.stderr)
    elif a.command == "info":
        say(printers.records(db.list_samples(), a.fmt) if a.samples else printers.records(db.changelog(), a.fmt) if a.changelog else printers.info(db.info(), a.fmt))
    elif a.command == "version":
        if a.action == "set":
            if not a.new_version:
                top.error("version set needs a version")
            db.set_db_version(a.new_version)
        say(db.manifest["db_version"])
    elif a.command == "update-db":
        updates = read_updates(spark, a.update_samples_file) if a.update_samples_file else []
        if a.update_sample:
            updates += [{"sample_name": a.update_sample, "field": f, "new_value": v} for f, v in (("sex", a.set_sex), ("phenotype_codes", a.set_phenotype)) if v is not None]
        if not (a.remove_samples or a.add_samples or a.compact or updates):
            top.error("nothing to do")
        if a.remove_samples:
            db.remove_samples(_commas(a.remove_samples))
        if updates:
            db.update_sample_metadata(updates, a.operator_note)
        for m in a.add_samples:
            say(json.dumps(db.add_samples(m, a.bed_dir, None, a.db_version)))
        if a.compact:
            say(json.dumps(db.compact()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
