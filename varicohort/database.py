"""Stored cohorts: a folder of Parquet generations and one manifest that names the current ones.

Every change writes new generations beside the old ones and then replaces the manifest by a rename, so a reader sees the
state before or after, and a failed change leaves nothing but unnamed files.

  calls/gen-N/chrom=../bucket=../   one row per variant and sample, sorted by position
  dims/gen-N/<table>/               samples, sample_phenotype, technologies, capture, changelog
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import warnings
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from varicohort.functions.chrom import CHROMS, normalize_chrom, normalize_chrom_text
from varicohort.functions.ploidy import PAR
from varicohort.operators.coverage import merge_intervals, segments
from varicohort.operators.filters import CohortWarning, SampleFilter
from varicohort.operators.measures import measures
from varicohort.plans import export, queries as Q
from varicohort.plans.annotate import annotate, annotate_stats
from varicohort.plans.cohort import VARIANT, Cohort, Quality, bucketed, classify
from varicohort.plans.maintain import check_calls, compact_counts, compacted, merge_counts
from varicohort.session import can_broadcast, rows_table, scratch, written
from varicohort.sources.texts import listed_codes, problems, read_bed, read_manifest
from varicohort.sources.vcf import read_calls, read_sites, write_annotated

DIMS = {
    "samples": "sample_id int, sample_name string, sex string, tech_id int, vcf_path string, ingested_at string",
    "sample_phenotype": "sample_id int, phenotype_code string",
    "technologies": "tech_id int, tech_name string, bed_path string, always_covered boolean",
    "capture": "tech_id int, chrom string, start0 int, end0 int",
    "stretches": "chrom string, start0 int, end0 int, kits array<int>",
    "changelog": "event_id bigint, event_type string, event_time string, sample_names array<string>, notes string",
}
CALLS = "chrom string, pos int, ref string, alt string, sample_id int, is_het boolean, is_hom boolean, is_fail boolean, is_qp boolean, bucket bigint"


def _schema(table: str, wide: list[str]) -> str:
    """Of the calls or a dimension; positions of the tables in ``wide`` (a manifest's key) are bigint."""
    text = CALLS if table == "calls" else DIMS[table]
    return re.sub(r"\b(pos|start0|end0) int\b", r"\1 bigint", text) if {"stretches": "capture"}.get(table, table) in wide else text


def _wide(calls: DataFrame | None, capture: DataFrame | None) -> list[str]:
    """Which of calls and capture have bigint positions."""
    has = lambda df, *names: df is not None and "bigint" in {t for n, t in df.dtypes if n in names}
    return [t for t, there in (("calls", has(calls, "pos")), ("capture", has(capture, "start0", "end0"))) if there]


class UpdateError(ValueError):
    """A change that is not possible; nothing was written."""


def _uri(path: str) -> str:
    return path.rstrip("/") if "://" in path else "file://" + os.path.abspath(path)


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


def next_version(version: str) -> str:
    """The last numeric part plus one; ``.1`` is added to a version that does not end in a number."""
    head, dot, tail = version.rpartition(".")
    return f"{head}{dot}{int(tail) + 1}" if tail.isdigit() else f"{version}.1"


def _read_manifest(root: str) -> dict:
    where, base = pafs.FileSystem.from_uri(root)
    with where.open_input_stream(f"{base}/manifest.json") as f:
        return json.loads(f.read())


def _write_manifest(root: str, manifest: dict) -> None:
    where, base = pafs.FileSystem.from_uri(root)
    where.create_dir(base, recursive=True)
    with where.open_output_stream(f"{base}/manifest.json.tmp") as f:
        f.write(json.dumps(manifest, indent=2).encode())
    where.move(f"{base}/manifest.json.tmp", f"{base}/manifest.json")


def _write_calls(calls: DataFrame, path: str) -> None:
    """Files per chromosome and bucket; a rebalance splits buckets that are too large for one task and joins small ones."""
    bucketed(calls).hint("rebalance", "chrom", "bucket").sortWithinPartitions("chrom", "bucket", "pos", "alt", "ref").write.partitionBy("chrom", "bucket").parquet(path)


def _goes_on(root: str, began: dict) -> bool:
    """Whether an unfinished build of this kind left all its calls."""
    where, base = pafs.FileSystem.from_uri(root)
    exists = lambda p: where.get_file_info(f"{base}/{p}").type != pafs.FileType.NotFound
    if exists("manifest.json") or not exists("build.json") or not exists("calls/gen-1/_SUCCESS"):
        return False
    with where.open_input_stream(f"{base}/build.json") as f:
        return json.loads(f.read()) == began


def _note_build(root: str, began: dict) -> None:
    where, base = pafs.FileSystem.from_uri(root)
    where.create_dir(base, recursive=True)
    with where.open_output_stream(f"{base}/build.json") as f:
        f.write(json.dumps(began).encode())


def _clear(root: str, part: str) -> None:
    where, base = pafs.FileSystem.from_uri(root)
    if where.get_file_info(f"{base}/{part}").type == pafs.FileType.Directory:
        where.delete_dir(f"{base}/{part}")


def _stamp(path: str) -> tuple:
    s = os.stat(path)
    return path, s.st_size, s.st_mtime_ns


class Database:
    """The public interface to a stored cohort. Query methods give DataFrames; ``None`` arguments do not restrict."""

    def __init__(self, spark: SparkSession, path: str, manifest: dict | None = None):
        """``manifest`` is that of an earlier state; changes are made to the current one only."""
        self.spark, self.root = spark, _uri(path)
        self._gens: dict[tuple[str, bool], DataFrame] = {}
        self._load(manifest)

    def _generation(self, gen: str, wide: list[str]) -> DataFrame:
        """Calls of a generation. Its many folders are listed once, as generations never change."""
        key = gen, "calls" in wide
        if key not in self._gens:
            self._gens[key] = self.spark.read.schema(_schema("calls", wide)).parquet(f"{self.root}/calls/{gen}")
        return self._gens[key]

    def _load(self, manifest: dict | None = None) -> None:
        self.manifest = manifest or _read_manifest(self.root)
        m = self.manifest
        wide = m.get("wide", [])
        dims = {t: self.spark.read.schema(_schema(t, wide)).parquet(f"{self.root}/dims/{m['dims']}/{t}") for t in DIMS}
        self.changes = dims["changelog"]
        gens = [self._generation(g, wide) for g in m["calls"]]
        calls = gens[0]
        for g in gens[1:]:
            calls = calls.unionByName(g)
        # merge of generations: samples are added once and ids are never used again, so rows stay unique
        self.cohort = Cohort(calls, dims["samples"], dims["sample_phenotype"], dims["technologies"], dims["capture"], m["genome_build"], Quality(**m["coverage_filter"]), True, dims["stretches"])
        self._known: tuple[set[str], set[str]] | None = None
        self._chroms: set[str] | None = None

    # --- creation

    @classmethod
    def create(cls, spark: SparkSession, path: str, ingested: DataFrame, samples: DataFrame, sample_phenotype: DataFrame, technologies: DataFrame, capture: DataFrame | None = None, genome_build: str = "GRCh37", db_version: str = "1.0", quality: Quality = Quality(), event: str = "preprocess", source: str | None = None) -> "Database":
        """Store a cohort of ingested records and dimensions (missing columns of the dimensions become null).

        ``source`` names what the records come from. If a build from the same source, with the same settings, broke off
        after its calls were written, they are used again.
        """
        if genome_build not in PAR:
            raise ValueError(f"genome build is one of {', '.join(sorted(PAR))}")
        root = _uri(path)
        began = {"source": source, "genome_build": genome_build, "quality": quality.__dict__}
        if source is None or not _goes_on(root, began):
            _clear(root, "calls/gen-1")
            _note_build(root, began)
            _write_calls(classify(ingested, quality), f"{root}/calls/gen-1")
        if "always_covered" not in technologies.columns:
            technologies = technologies.withColumn("always_covered", F.col("bed_path").isNull())
        _clear(root, "dims")
        names = [r[0] for r in samples.select("sample_name").orderBy("sample_id").collect()]
        n, top = samples.agg(F.count("*"), F.max("sample_id")).first()
        log = rows_table(spark, [(1, event, _now(), names, f"{n} samples ingested")], DIMS["changelog"])
        m = {"genome_build": genome_build, "version": "1.0", "db_version": db_version, "sample_count": n, "next_sample_id": (-1 if top is None else top) + 1, "schema_version": "3.0" if quality.active else "2.0", "pass_only_filter": True, "coverage_filter": quality.__dict__, "created_at": _now(), "calls": ["gen-1"], "dims": None, "generation": 1, "wide": _wide(ingested, capture)}
        regions = merge_intervals(capture) if capture is not None else spark.createDataFrame([], DIMS["capture"])
        _store_dims(spark, root, m, {"samples": samples, "sample_phenotype": sample_phenotype.distinct(), "technologies": technologies, "capture": regions, "changelog": log})
        return cls(spark, path)

    @classmethod
    def create_from_manifest(cls, spark: SparkSession, path: str, manifest: str, genome_build: str, bed_dir: str | None = None, db_version: str = "1.0", quality: Quality = Quality(), force: bool = False) -> "Database":
        """Build from single-sample VCF files. An existing cohort is kept unless ``force``."""
        where, base = pafs.FileSystem.from_uri(_uri(path))
        if where.get_file_info(f"{base}/manifest.json").type != pafs.FileType.NotFound and not force:
            return cls(spark, path)
        s, t = read_manifest(spark, manifest, bed_dir)
        samples, codes, techs, capture, calls = _from_manifest(spark, s, t, 0, {})
        source = hashlib.sha256(repr((s, sorted(t.items()), [_stamp(x.vcf_path) for x in s])).encode()).hexdigest()
        return cls.create(spark, path, calls, samples, codes, techs, capture, genome_build, db_version, quality, source=None if force else source)

    # --- queries

    def filter(self, phenotype=None, sex="both", tech=None, min_pass=0, min_observed=0, min_quality_evidence=0) -> SampleFilter:
        sf = SampleFilter.parse(phenotype, sex, tech, min_pass, min_observed, min_quality_evidence)
        if self._known is None:
            c = self.cohort
            self._known = set(self.get_all_phenotypes()), {r[0] for r in c.technologies.select("tech_name").collect()}
        sf.check(*self._known)
        return sf

    def known_chroms(self) -> set[str]:
        """Chromosomes with calls, from the names of the folders."""
        if self._chroms is None:
            where, base = pafs.FileSystem.from_uri(self.root)
            names = (f.base_name for g in self.manifest["calls"] for f in where.get_file_info(pafs.FileSelector(f"{base}/calls/{g}")))
            self._chroms = {n.removeprefix("chrom=") for n in names if n.startswith("chrom=")}
        return self._chroms

    def _warn(self, *chroms: str) -> None:
        for c in sorted({normalize_chrom_text(c) for c in chroms} - self.known_chroms()):
            warnings.warn(f"Chromosome {c!r} has no data in this cohort. Available: {sorted(self.known_chroms())!r}", CohortWarning, stacklevel=3)

    def query(self, chrom: str, pos: int, ref: str | None = None, alt: str | None = None, **sf) -> DataFrame:
        """All alleles stored at a position, by (pos, alt, ref)."""
        self._warn(chrom)
        return Q.point(self.cohort, chrom, pos, self.filter(**sf), ref, alt).orderBy("pos", "alt", "ref")

    def query_batch(self, chrom: str, variants, **sf) -> DataFrame:
        self._warn(chrom)
        return Q.batch(self.cohort, chrom, variants, self.filter(**sf)).orderBy("pos", "alt", "ref")

    def query_batch_multi(self, variants, **sf) -> DataFrame:
        """In the order of first requests."""
        variants = list(variants)
        self._warn(*(v[0] for v in variants))
        return Q.batch_multi(self.cohort, variants, self.filter(**sf)).orderBy("idx", "alt", "ref").drop("idx")

    def query_region(self, chrom: str, start: int, end: int, **sf) -> DataFrame:
        self._warn(chrom)
        return Q.region(self.cohort, chrom, start, end, self.filter(**sf)).orderBy("pos", "alt", "ref")

    def query_region_multi(self, regions, **sf) -> DataFrame:
        regions = list(regions)
        self._warn(*(r[0] for r in regions))
        return Q.genomic_order(Q.region_multi(self.cohort, regions, self.filter(**sf)))

    def variant_info(self, chrom: str, pos: int, ref: str | None = None, alt: str | None = None, **sf) -> DataFrame:
        """Carriers by sample id; warns if several alleles are there and none was asked for."""
        self._warn(chrom)
        out = Q.variant_info(self.cohort, chrom, pos, self.filter(**sf), ref, alt).orderBy("sample_id", "alt", "ref")
        if ref is None and alt is None:
            alts = [r[0] for r in Q.slice_calls(self.cohort, chrom, pos, pos).where("is_het OR is_hom OR is_fail").select("alt", "ref").distinct().orderBy("alt").collect()]
            if len(alts) > 1:
                warnings.warn(f"Multiple alleles found at {chrom}:{pos} ({', '.join(alts)}): give ref and alt to choose one.", CohortWarning, stacklevel=2)
        return out

    def dump_frame(self, chrom=None, start=None, end=None, by_sex=False, by_tech=False, by_phenotype=None, all_groups=False, include_ac_zero=False, **sf) -> DataFrame:
        base = self.filter(**sf)
        groups = export.build_groups(self.cohort, base, by_sex=by_sex, by_tech=by_tech, by_phenotype=by_phenotype, all_groups=all_groups)
        return export.dump(self.cohort, base, groups, chrom, start, end, include_ac_zero)

    def dump(self, output=None, **args) -> dict:
        """Export to CSV in genomic order; gives n_rows, n_buckets, n_chroms."""
        return export.write_csv(self.dump_frame(**args), output)

    def annotate_vcf(self, source: str, output: str, prefix: str = "COHORT_", **sf) -> dict:
        """Add the INFO fields to a VCF; gives n_variants, n_annotated, n_uncovered."""
        with scratch(self.spark):
            sites = read_sites(self.spark, source)
            a = written(annotate(self.cohort, sites, self.filter(**sf)), "annotated")
            write_annotated(sites, a, source, output, prefix)
            return annotate_stats(a).first().asDict()

    def measures(self, **sf) -> DataFrame:
        return measures(self.cohort, self.filter(**sf))

    # --- descriptions

    def get_all_phenotypes(self) -> list[str]:
        return sorted(r[0] for r in self.cohort.sample_phenotype.select("phenotype_code").distinct().collect() if r[0] is not None)

    def counts_frame(self) -> DataFrame:
        """(axis, value, n): samples in all, by sex, by technology and by phenotype code."""
        c = self.cohort
        one = lambda df, axis, col: df.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n")).select(F.lit(axis).alias("axis"), "value", "n")
        every = c.samples.agg(F.count("*").alias("n")).select(F.lit("all").alias("axis"), F.lit("samples").alias("value"), "n")
        return every.unionByName(one(c.samples, "sex", "sex")).unionByName(one(c.samples.join(c.technologies, "tech_id"), "tech", "tech_name")).unionByName(one(c.sample_phenotype, "phenotype", "phenotype_code"))

    def info(self) -> dict:
        m = self.manifest
        by: dict[str, dict] = {"all": {}, "sex": {}, "tech": {}, "phenotype": {}}
        for r in self.counts_frame().collect():
            by[r["axis"]][r["value"]] = r["n"]
        return {
            "db_path": self.root, "db_version": m.get("db_version", "unknown"), "genome_build": m["genome_build"], "schema_version": m["schema_version"], "created_at": m.get("created_at"), "updated_at": m.get("updated_at"),
            "sample_count": by["all"].get("samples", 0), "by_sex": by["sex"], "by_tech": by["tech"], "by_phenotype": by["phenotype"], "changelog_recent": self.changelog(5),
        }

    def samples_frame(self) -> DataFrame:
        """Samples by id with technology and sorted codes."""
        c = self.cohort
        codes = c.sample_phenotype.groupBy("sample_id").agg(F.sort_array(F.collect_set("phenotype_code")).alias("phenotypes"))
        s = c.samples.join(c.technologies.select("tech_id", F.col("tech_name").alias("tech")), "tech_id").join(codes, "sample_id", "left")
        return s.select("sample_id", "sample_name", "sex", "tech", F.coalesce("phenotypes", F.array().cast("array<string>")).alias("phenotypes"), "vcf_path", "ingested_at").orderBy("sample_id")

    def list_samples(self) -> list[dict]:
        return [r.asDict() for r in self.samples_frame().collect()]

    def changelog_frame(self, limit: int | None = None) -> DataFrame:
        """Events, the latest first."""
        log = self.changes.orderBy(F.desc("event_id"))
        return log if limit is None else log.limit(limit)

    def changelog(self, limit: int | None = None) -> list[dict]:
        return [r.asDict() for r in self.changelog_frame(limit).collect()]

    # --- changes

    def _commit(self, changes: dict[str, DataFrame], events: list[tuple], manifest: dict) -> None:
        last = self.changes.agg(F.max("event_id")).first()[0] or 0
        log = rows_table(self.spark, [(last + i, *e) for i, e in enumerate(events, 1)], DIMS["changelog"])
        c = self.cohort
        dims = {"samples": c.samples, "sample_phenotype": c.sample_phenotype, "technologies": c.technologies, "capture": c.capture} | changes
        dims["changelog"] = self.changes.unionByName(log)
        if "capture" not in changes:
            dims["stretches"] = c.stretches
        _store_dims(self.spark, self.root, manifest, dims)
        self._load()

    def add_samples(self, manifest: str, bed_dir: str | None = None, genome_build: str | None = None, db_version: str | None = None) -> dict:
        """Add the samples of a manifest: new ids, never used ones; known technologies by exact name."""
        m = dict(self.manifest)
        if genome_build is not None and genome_build != m["genome_build"]:
            raise UpdateError(f"Genome build {genome_build} differs from the cohort's {m['genome_build']}")
        s, t = read_manifest(self.spark, manifest, bed_dir)
        new = rows_table(self.spark, [(x.sample_name,) for x in s], "sample_name string")
        if twice := [r[0] for r in self.cohort.samples.join(new, "sample_name", "left_semi").select("sample_name").orderBy("sample_name").limit(50).collect()]:
            raise UpdateError(f"Samples are in the cohort already: {', '.join(twice)}")
        techs = {r["tech_name"]: r["tech_id"] for r in self.cohort.technologies.collect()}
        samples, codes, new_techs, capture, calls = _from_manifest(self.spark, s, t, m["next_sample_id"], techs)
        return self.add(calls, samples, codes, new_techs, capture, db_version)

    def add(self, ingested: DataFrame, samples: DataFrame, sample_phenotype: DataFrame, technologies: DataFrame | None = None, capture: DataFrame | None = None, db_version: str | None = None) -> dict:
        """Append calls and samples whose ids are at least the manifest's next_sample_id. Gives counts of variants."""
        m, c = dict(self.manifest), self.cohort
        low, top, n = samples.agg(F.min("sample_id"), F.max("sample_id"), F.count("*")).first()
        if n == 0:
            return {"n_samples": 0, "n_new": 0, "n_updated": 0}
        if low < m["next_sample_id"]:
            raise UpdateError(f"New sample ids start at {m['next_sample_id']}")
        gen = f"gen-{m['generation'] + 1}"
        path = f"{self.root}/calls/{gen}"
        _write_calls(classify(ingested, c.quality), path)
        m["wide"] = sorted({*m.get("wide", []), *_wide(ingested, capture)})
        self._gens.pop((gen, "calls" in m["wide"]), None)  # of an attempt that failed
        counts = merge_counts(c.calls, self._generation(gen, m["wide"])).agg(F.sum("n_new"), F.sum("n_updated")).first()
        m |= {"calls": [*m["calls"], gen], "next_sample_id": top + 1, "sample_count": c.samples.count() + n, "updated_at": _now(), "db_version": db_version or next_version(m["db_version"])}
        names = [r[0] for r in samples.select("sample_name").orderBy("sample_id").collect()]
        changes = {"samples": _fit(c.samples, "samples").unionByName(_fit(samples, "samples")), "sample_phenotype": _fit(c.sample_phenotype, "sample_phenotype").unionByName(_fit(sample_phenotype.distinct(), "sample_phenotype"))}
        if technologies is not None:
            changes["technologies"] = _fit(c.technologies, "technologies").unionByName(_fit(technologies, "technologies"))
        if capture is not None:
            changes["capture"] = merge_intervals(c.capture.unionByName(_fit(capture, "capture", m["wide"])))
        self._commit(changes, [("add_samples", _now(), names, f"{n} samples ingested")], m)
        return {"n_samples": n, "n_new": counts[0] or 0, "n_updated": counts[1] or 0}

    def remove_samples(self, names: list[str]) -> None:
        """Take samples out of the dimensions; their calls no longer count. Variants stay until the cohort is compacted."""
        if not names:
            return
        c = self.cohort
        asked = rows_table(self.spark, [(n,) for n in dict.fromkeys(names)], "sample_name string")  # a table, as a condition of many names is slow to plan
        ids = {r["sample_name"]: r["sample_id"] for r in c.samples.join(asked, "sample_name", "left_semi").select("sample_name", "sample_id").collect()}
        if missing := [n for n in names if n not in ids]:
            raise UpdateError(f"Samples not found: {', '.join(missing)}")
        gone = list(ids.values())
        taken = rows_table(self.spark, [(i,) for i in gone], "sample_id int")
        keep = lambda df: df.where("sample_id IS NOT NULL").join(taken, "sample_id", "left_anti").select(*df.columns)
        m = dict(self.manifest) | {"sample_count": c.samples.count() - len(gone), "updated_at": _now()}
        self._commit({"samples": keep(c.samples), "sample_phenotype": keep(c.sample_phenotype)}, [("remove_samples", _now(), list(dict.fromkeys(names)), f"{len(gone)} samples removed")], m)

    def update_sample_metadata(self, updates: list[dict], operator_note: str | None = None) -> list[dict]:
        """Change sex or phenotype_codes (all codes are replaced). Every row is checked before anything is written.

        Updates of one sample follow each other: the old value of an entry is what the update before it set.
        """
        if not updates:
            return []
        c = self.cohort
        given = [(i, *(str(u.get(k) or "").strip() for k in ("sample_name", "field", "new_value"))) for i, u in enumerate(updates)]
        u = rows_table(self.spark, given, "no int, sample_name string, field string, new_value string")
        u = u.join(c.samples.select("sample_name", "sample_id", "sex"), "sample_name", "left").withColumn("codes", listed_codes(F.col("new_value")))
        rules = {
            "there is no such sample": F.col("sample_id").isNull(),
            "only sex and phenotype_codes can be changed": ~F.col("field").isin("sex", "phenotype_codes"),
            "sex is male or female": (F.col("field") == "sex") & ~F.col("new_value").isin("male", "female"),
            "at least one code is needed": (F.col("field") == "phenotype_codes") & (F.size("codes") == 0),
        }
        if wrong := problems(u, rules, ["no", "sample_name", "field", "new_value"]).orderBy("no").collect():
            raise UpdateError("; ".join(f"{r['sample_name']!r} {r['field']} {r['new_value']!r}: {r['problem']}" for r in wrong))
        have = c.sample_phenotype.join(u.select("sample_id").distinct(), "sample_id", "left_semi").groupBy("sample_id").agg(F.array_join(F.sort_array(F.collect_set("phenotype_code")), ",").alias("have"))
        is_sex = F.col("field") == "sex"
        turns = Window.partitionBy("sample_id", "field").orderBy("no")
        u = u.withColumn("new", F.when(is_sex, F.col("new_value")).otherwise(F.array_join(F.sort_array("codes"), ","))).join(have, "sample_id", "left")
        u = u.withColumn("old", F.coalesce(F.lag("new").over(turns), F.when(is_sex, F.col("sex")).otherwise(F.coalesce("have", F.lit("")))))
        u = u.withColumn("last", F.lead("no").over(turns).isNull())
        done = written(u.select("no", "sample_id", "sample_name", "field", "old", "new", "codes", "last"), "updates")
        note = {"operator_note": operator_note} if operator_note else {}
        # The keys of an entry and the event's name, as in stored changelogs.
        entries = [{"sample": r["sample_name"], "field": r["field"], "old": r["old"], "new": r["new"]} | note for r in done.orderBy("no").collect()]
        events = [("UPDATE_SAMPLE", _now(), [e["sample"]], json.dumps(e)) for e in entries]
        last = done.where("last")
        sexes = last.where(is_sex).select("sample_id", F.col("new").alias("new_sex"))
        fresh = last.where(~is_sex)
        samples = c.samples.join(sexes, "sample_id", "left").withColumn("sex", F.coalesce("new_sex", "sex"))
        codes = c.sample_phenotype.join(fresh.select("sample_id"), "sample_id", "left_anti").select("sample_id", "phenotype_code").unionByName(fresh.select("sample_id", F.explode("codes").alias("phenotype_code")))
        m = dict(self.manifest)
        self._commit({"samples": _fit(samples, "samples"), "sample_phenotype": codes}, events, m | {"updated_at": _now(), "db_version": next_version(m["db_version"])})
        return entries

    def compact(self) -> dict:
        """Rewrite the calls without those of removed samples; variants that nobody carries any more vanish."""
        m, c = dict(self.manifest), self.cohort
        before, rows, after, left = compact_counts(c.calls, c.samples).first()
        gen = f"gen-{m['generation'] + 1}"
        _write_calls(compacted(c.calls, c.samples).drop("bucket"), f"{self.root}/calls/{gen}")
        m |= {"calls": [gen], "last_compact": _now(), "updated_at": _now()}
        self._commit({}, [("compact", _now(), None, f"rows before: {rows}")], m)
        return {"variants_before": before, "variants_removed": before - after, "rows_before": rows, "rows_removed": rows - left}

    def set_db_version(self, version: str) -> None:
        self._commit({}, [("version_set", _now(), None, version)], dict(self.manifest) | {"db_version": version, "updated_at": _now()})

    def check(self) -> list[tuple[str, str]]:
        """(severity, message) of everything that is wrong or worth knowing."""
        out, m, c = [], self.manifest, self.cohort
        if m.get("genome_build") not in PAR:
            out.append(("error", f"unknown genome build {m.get('genome_build')!r}"))
        n = c.samples.count()
        if n != m.get("sample_count"):
            out.append(("warning", f"manifest says {m.get('sample_count')} samples, there are {n}"))
        top = c.samples.agg(F.max("sample_id")).first()[0]
        if top is not None and top >= m["next_sample_id"]:
            out.append(("error", f"sample id {top} is not below next_sample_id {m['next_sample_id']}"))
        kits = {r[0] for r in c.technologies.where("NOT always_covered").select("tech_id").collect()} - {r[0] for r in c.capture.select("tech_id").distinct().collect()}
        out += [("warning", f"technology {k} has no capture region") for k in sorted(kits)]
        if twice := c.samples.groupBy("sample_id").count().where("count > 1").count():
            out.append(("error", f"{twice} sample ids are not unique"))
        out += [(r["severity"], f"{r['message']}: {r['n']} calls") for r in check_calls(c.calls, c.samples).collect()]
        chroms = sorted((r[0] for r in c.calls.select("chrom").distinct().collect()), key=lambda x: CHROMS.index(x) if x in CHROMS else 99)
        out.append(("info", f"{n} samples, chromosomes {', '.join(chroms) or 'none'}, version {m.get('db_version')}"))
        return out


def check_database(spark: SparkSession, path: str, manifest: dict | None = None) -> list[tuple[str, str]]:
    """(severity, message) for a folder that may not even be a cohort; stops at what makes the rest impossible.

    ``manifest`` is that of an earlier state, to check that one.
    """
    root = _uri(path)
    where, base = pafs.FileSystem.from_uri(root)
    try:
        m = manifest or _read_manifest(root)
    except FileNotFoundError:
        return [("error", "manifest.json is missing")]
    except ValueError as e:
        return [("error", f"manifest.json cannot be parsed: {e}")]
    out = [("error", f"manifest lacks {k}") for k in ("genome_build", "db_version", "schema_version", "sample_count", "next_sample_id", "coverage_filter", "calls", "dims") if k not in m]
    if out:
        return out
    parts = [*(f"calls/{g}" for g in m["calls"]), *(f"dims/{m['dims']}/{t}" for t in DIMS)]
    out = [("error", f"{p} is missing") for p in parts if where.get_file_info(f"{base}/{p}").type != pafs.FileType.Directory]
    out += [(r["severity"], r["message"]) for r in check_files(spark, root, parts).orderBy("message").limit(1000).collect()]
    return out or Database(spark, path, manifest).check()


def check_files(spark: SparkSession, root: str, parts: list[str]) -> DataFrame:
    """(severity, message) for every stored file that cannot be read to its end, lacks a column, or is not in order of its position."""
    where, base = pafs.FileSystem.from_uri(root)
    listed = [(p, f.path) for p in parts for f in where.get_file_info(pafs.FileSelector(f"{base}/{p}", recursive=True, allow_not_found=True)) if f.path.endswith(".parquet")]
    want = {p: [x.split()[0] for x in (CALLS if p.startswith("calls") else DIMS[p.rpartition("/")[2]]).split(", ")] for p in parts}
    files = rows_table(spark, listed, "part string, path string").repartition(max(1, min(len(listed) // 8, 10_000)), "path")

    def look(batches):
        fs, _ = pafs.FileSystem.from_uri(root)
        for b in batches:
            found = []
            for part, path in zip(b["part"].to_pylist(), b["path"].to_pylist()):
                name = path.removeprefix(base).lstrip("/")
                try:
                    with pq.ParquetFile(fs.open_input_file(path)) as f:
                        lost = [c for c in want[part] if c not in {*f.schema_arrow.names, "chrom", "bucket"}]
                        if lost:
                            found.append(f"{name} lacks columns {', '.join(lost)}")
                        before = None
                        for rows in f.iter_batches():
                            if not part.startswith("calls") or lost or not rows.num_rows:
                                continue
                            pos = rows["pos"].to_numpy()
                            if (pos[1:] < pos[:-1]).any() or before is not None and pos[0] < before:
                                found.append(f"{name} is not in order of position")
                                break
                            before = pos[-1]
                except (OSError, pa.ArrowException) as e:
                    found.append(f"{name} cannot be read: {str(e).splitlines()[0][:100]}")
            yield pa.RecordBatch.from_arrays([pa.array(["error"] * len(found), pa.string()), pa.array(found, pa.string())], names=["severity", "message"])

    return files.mapInArrow(look, "severity string, message string")


def _fit(df: DataFrame, dim: str, wide: list[str] = []) -> DataFrame:
    """The columns of a dimension in order and type; those that are missing are null."""
    schema = df.sparkSession.createDataFrame([], _schema(dim, wide)).schema
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def _one_file(df: DataFrame) -> DataFrame:
    """In one file if that is known to be small, else as many as there are tasks."""
    return df.coalesce(1) if can_broadcast(df, 64 << 20) else df


def _store_dims(spark: SparkSession, root: str, manifest: dict, dims: dict[str, DataFrame]) -> None:
    manifest["generation"] = manifest.get("generation", 0) + 1
    gen = f"gen-{manifest['generation']}"
    if "stretches" not in dims:
        dims = dims | {"stretches": segments(dims["capture"])}
    with ThreadPoolExecutor(4) as pool:  # small independent jobs
        list(pool.map(lambda kv: _one_file(_fit(kv[1], kv[0], manifest.get("wide", []))).write.parquet(f"{root}/dims/{gen}/{kv[0]}"), dims.items()))
    manifest["dims"] = gen
    _write_manifest(root, manifest)


def _from_manifest(spark: SparkSession, samples, techs, first_id: int, known: dict[str, int]):
    """Dimensions and ingested records of a parsed manifest; technologies that are not known get the next ids."""
    ids, fresh = dict(known), []
    for name, bed in techs.items():
        if name not in ids:
            ids[name] = max(ids.values(), default=-1) + 1
            fresh.append((ids[name], name, bed, bed is None))
    rows = [(first_id + k, s.sample_name, s.sex, ids[s.tech_name], s.vcf_path, _now()) for k, s in enumerate(samples)]
    codes = [(first_id + k, c) for k, s in enumerate(samples) for c in dict.fromkeys(s.phenotype_codes)]
    capture = read_bed(spark, {i: bed for i, _, bed, _ in fresh if bed})
    capture = capture.withColumn("chrom", normalize_chrom(F.col("chrom")))
    calls = read_calls(spark, {s.vcf_path: first_id + k for k, s in enumerate(samples)})
    return rows_table(spark, rows, DIMS["samples"]), rows_table(spark, codes, DIMS["sample_phenotype"]), rows_table(spark, fresh, DIMS["technologies"]), capture, calls


def variant_info(spark: SparkSession, path: str, chrom: str, pos: int, ref: str | None = None, alt: str | None = None, phenotype=None, sex: str = "both", tech=None) -> DataFrame:
    """Carriers of a variant of a stored cohort."""
    return Database(spark, path).variant_info(chrom, pos, ref, alt, phenotype=phenotype, sex=sex, tech=tech)
