"""Part keys so large that positions do not fit in an int: the queries give what the SQL gives with bigint positions."""

import os
import re

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest

from varicohort import database
from varicohort.database import Database
from varicohort.operators.coverage import merge_intervals
from varicohort.plans import cohort_queries, stored_queries
from varicohort.plans.star import _capture
from varicohort.session import can_broadcast, rows_table

TABLES = ["customer", "part", "orders", "lineitem"]
FAR = 1_120_000  # times SPACING / 2 is beyond an int; a multiple of 16 keeps chromosomes and bases
QUERIES, SQL = cohort_queries.QUERIES | stored_queries.QUERIES, cohort_queries.SQL | stored_queries.SQL
NAMES = [
    "acmg_class",
    "af_chrm",
    "af_grch38",
    "af_point_allele",
    "annotate_repeats",
    "batch",
    "bed_regions",
    "capture_cover",
    "compact_counts",
    "directional_errors",
    "dump_all",
    "dump_by_sex",
    "dump_range",
    "filter_combined",
    "filter_pheno_include",
    "filter_tech_exclude",
    "info_counts",
    "list_samples",
    "metadata_update_query",
    "nocov_all",
    "nocov_min_pass",
    "outer_compare",
    "qc_fail_band",
]


@pytest.fixture(scope="module")
def far(sf, tmp_path_factory):
    """Every other pair of parts, and their lines, moved by FAR."""
    d = tmp_path_factory.mktemp("far")
    for t in TABLES:
        rows = pq.read_table(f"{sf}/{t}.parquet")
        for key in {"part": ["p_partkey"], "lineitem": ["l_partkey"]}.get(t, []):
            moved = pa.array([k + FAR if k // 16 % 2 else k for k in rows[key].to_pylist()], pa.int64())
            rows = rows.set_column(rows.schema.get_field_index(key), key, moved)
        pq.write_table(rows, d / f"{t}.parquet")
    assert pc.max(rows["l_partkey"]).as_py() // 2 * 3989 > 1 << 31
    return str(d)


def text(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def far_later(far, tmp_path_factory):
    """The same with every other customer moved beyond the ids that add_samples_merge begins with."""
    d = tmp_path_factory.mktemp("later")
    for t in TABLES:
        rows = pq.read_table(f"{far}/{t}.parquet")
        for key in {"customer": ["c_custkey"], "orders": ["o_custkey"]}.get(t, []):
            rows = rows.set_column(rows.schema.get_field_index(key), key, pa.array([k + 1000 * (k % 2) for k in rows[key].to_pylist()], pa.int64()))
        pq.write_table(rows, d / f"{t}.parquet")
    return str(d)


@pytest.mark.parametrize("name", NAMES)
def test_far(spark, far, name):
    same_as_sql(spark, far, name)


def test_far_added(spark, far_later):
    same_as_sql(spark, far_later, "add_samples_merge")


def test_compacted_without_check(spark, far, tmp_path, monkeypatch):
    """Compaction waits for no check, which can still be made of the state before; stretches are made with the regions only."""
    os.symlink(far, tmp_path / "again")
    made, make = [], database.segments
    with monkeypatch.context() as m:
        m.setattr(database, "segments", lambda c: made.append(c) or make(c))
        m.setattr(stored_queries, "check_database", None)
        same_as_sql(spark, str(tmp_path / "again"), "compact_counts")
    assert len(made) == 1
    same_as_sql(spark, str(tmp_path / "again"), "check_query")


def test_repeated_and_missing_parts(spark, sf, tmp_path):
    """Part rows twice, three times and not at all: a line counts once for each row of its part."""
    for t in TABLES:
        rows = pq.read_table(f"{sf}/{t}.parquet")
        if t == "part":
            rows = pa.concat_tables([rows.slice(5), rows.slice(20, 60), rows.slice(40, 20)])
        pq.write_table(rows, tmp_path / f"{t}.parquet")
    same_as_sql(spark, str(tmp_path), "gt_classes")
    same_as_sql(spark, str(tmp_path), "quality_pass")


def same_as_sql(spark, far, name):
    df = QUERIES[name](spark, far)
    rows = sorted(tuple(text(r[c]) for c in df.columns) for r in df.collect())
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{far}/{t}.parquet'")
    cur = con.execute(re.sub(r"AS INT\) AS (pos|start0|end0)\b", r"AS BIGINT) AS \1", SQL[name]))
    at = [d[0] for d in cur.description]
    assert rows and rows == sorted(tuple(text(r[at.index(c)]) for c in df.columns) for r in cur.fetchall())


def test_size_of_capture_is_known(spark):
    assert can_broadcast(merge_intervals(_capture(spark, 19_999)), 8 << 20)
    assert not can_broadcast(merge_intervals(_capture(spark, 1_199_999)), 8 << 20)
    assert _capture(spark, None).count() == 0


def test_stored_positions_become_wide(spark, tmp_path):
    calls = lambda kind, *rows: rows_table(spark, [("chr1", p, "A", "C", 1, s, True, None, None, None) for p, s in rows], f"chrom string, pos {kind}, ref string, alt string, gt_ac tinyint, sample_id int, filter_pass boolean, dp int, gq int, qual float")
    dims = lambda i: (rows_table(spark, [(i, f"s{i}", "male", 0)], "sample_id int, sample_name string, sex string, tech_id int"), rows_table(spark, [(i, "Q")], "sample_id int, phenotype_code string"))
    techs = rows_table(spark, [(0, "WGS", True)], "tech_id int, tech_name string, always_covered boolean")
    db = Database.create(spark, str(tmp_path / "db"), calls("int", (5, 0)), *dims(0), techs)
    assert dict(db.measures().dtypes)["pos"] == "int"
    db.add(calls("bigint", (5, 1), (3_000_000_000, 1)), *dims(1))
    assert [(r["pos"], r["AC"]) for r in Database(spark, db.root).measures().orderBy("pos").collect()] == [(5, 2), (3_000_000_000, 1)]
    assert [r["AC"] for r in db.query("1", 3_000_000_000).collect()] == [1]
    assert [r["AC"] for r in db.query_batch("1", [(3_000_000_000, None, None)]).collect()] == [1]
    assert os.path.exists(tmp_path / "db/manifest.json")
