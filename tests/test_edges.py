"""The dealt operators on empty tables, and on tables with nulls everywhere, repeated rows and clashing extra columns."""

import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from varicohort.plans import general

TABLES = ["calls", "call_files", "samples", "technologies", "sample_phenotype", "precomputed_bitmaps", "phenotype_terms", "changelog", "manifest", "manifest_lines"]
CLASH = ["item", "item_no", "at", "n_rows", "slot", "n", "since", "value", "snap", "reason", "reasons", "name", "header", "edits", "tab", "row_key", "v", "e", "__since", "before", "old", "new"]


def dirty(t: pa.Table, keep: int = 400) -> pa.Table:
    """Rows, the first ones once more, one row per column with a null there, and one with nulls only."""
    t = t.slice(0, keep)
    parts = [t, t.slice(0, 30)]
    for i, f in enumerate(t.schema):
        parts.append(t.slice(i, 1).set_column(i, f, pa.nulls(1, f.type)))
    parts.append(pa.table({f.name: pa.nulls(1, f.type) for f in t.schema}, schema=t.schema))
    out = pa.concat_tables(parts)
    for c in CLASH:
        if c not in out.column_names:
            out = out.append_column(c, pa.array(["x"] * out.num_rows))
    return out


@pytest.fixture(scope="module")
def made(sf, tmp_path_factory):
    d = tmp_path_factory.mktemp("edges")
    for kind in ("empty", "dirty"):
        os.makedirs(d / kind)
        for t in TABLES:
            rows = pq.read_table(f"{sf}/{t}.parquet")
            pq.write_table(rows.slice(0, 0) if kind == "empty" else dirty(rows), d / kind / f"{t}.parquet")
    return d


def text(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(general.QUERIES))
def test_empty(spark, made, name):
    assert general.QUERIES[name](spark, str(made / "empty")).collect() == []


@pytest.mark.parametrize("name", sorted(general.QUERIES))
def test_dirty(spark, made, name):
    df = general.QUERIES[name](spark, str(made / "dirty"))
    rows = sorted(tuple(text(r[c]) for c in df.columns) for r in df.collect())
    if name in general.SQL:
        con = duckdb.connect()
        con.execute("SET timezone = 'UTC'")
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{made}/dirty/{t}.parquet'")
        cur = con.execute(general.SQL[name])
        at = [d[0] for d in cur.description]
        want = sorted(tuple(text(r[at.index(c)]) for c in df.columns) for r in cur.fetchall())
        if name.endswith("_found"):
            rows, want = sorted(set(rows)), sorted(set(want))
        assert rows == want
    else:
        assert rows
