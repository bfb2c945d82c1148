"""Times of the query shapes on a stored cohort."""

from __future__ import annotations

import statistics
import time
from collections.abc import Callable

from pyarrow import fs as pafs
from pyspark.sql import SparkSession

from varicohort.database import Database
from varicohort.session import fresh_path
from varicohort.sources.synth import synthetic


def _times(run: Callable[[], object], n: int) -> dict:
    took = []
    for _ in range(n):
        t = time.perf_counter()
        run()
        took.append(1000 * (time.perf_counter() - t))
    return {"median_ms": statistics.median(took), "min_ms": min(took), "max_ms": max(took), "n": n}


# Times in milliseconds that a native engine aims at; a Spark job has fixed costs of its own.
TARGETS = {"point_cold": 100, "point_warm": 25, "batch_100": 200, "region_1mbp": 500}


def run_benchmark(db: Database, repeats: int = 5) -> dict:
    """Point (cold and warm), batch of 100 and 1000, region of 1 Mbp and export, on the cohort's first variants."""
    keys = [tuple(r) for r in db.cohort.calls.select("chrom", "pos", "ref", "alt").distinct().orderBy("chrom", "pos", "alt").limit(1000).collect()]
    if not keys:
        return {"variants": 0}
    chrom, pos = keys[0][:2]
    report = {"variants": len(keys), "point_cold": _times(lambda: db.query(chrom, pos).collect(), 1), "point_warm": _times(lambda: db.query(chrom, pos).collect(), repeats)}
    for n in (100, 1000):
        report[f"batch_{n}"] = _times(lambda: db.query_batch_multi(keys[:n]).collect(), repeats)
    report["region_1mbp"] = _times(lambda: db.query_region(chrom, pos, pos + 1_000_000).collect(), repeats)
    report["export"] = _times(lambda: db.dump_frame().write.format("noop").mode("overwrite").save(), 1)
    report["targets"] = {k: {"limit_ms": v, "met": report[k]["median_ms"] < v} for k, v in TARGETS.items()}
    return report


def run_benchmark_with_synth(spark: SparkSession, n_samples: int = 1000, n_variants: int = 10_000, seed: int = 42) -> dict:
    where = fresh_path(spark, "bench")
    try:
        calls, samples, codes, tech = synthetic(spark, n_samples, n_variants, ["chr1"], seed)
        t = time.perf_counter()
        db = Database.create(spark, f"{where}/db", calls, samples, codes, tech)
        return {"n_samples": n_samples, "n_variants": n_variants, "build_s": time.perf_counter() - t} | run_benchmark(db)
    finally:
        fs, base = pafs.FileSystem.from_uri(where)
        fs.delete_dir(base)
