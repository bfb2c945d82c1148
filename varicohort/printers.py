"""Results as text, TSV and JSON. Rows come as dicts."""

from __future__ import annotations

import json
from collections.abc import Iterable

# The columns of the outputs, and below the lines for empty ones.
RESULT = ["chrom", "pos", "ref", "alt", "AC", "AN", "AF", "n_eligible", "N_HET", "N_HOM_ALT", "N_HOM_REF", "N_FAIL", "N_NO_COVERAGE"]
CARRIER = ["sample_id", "sample_name", "sex", "tech", "phenotypes", "genotype", "filter"]


def _tsv(header: list[str], rows: Iterable[list]) -> str:
    return "\n".join("\t".join(map(str, r)) for r in [header, *rows])


def _table(header: list[str], rows: list[list[str]]) -> str:
    widths = [max(len(str(r[i])) for r in [header, *rows]) for i in range(len(header))]
    lines = [header, ["-" * w for w in widths], *rows]
    return "\n".join("  ".join(str(c).ljust(w) for c, w in zip(r, widths)) for r in lines)


def results(rows: list[dict], fmt: str) -> str:
    if fmt == "json":
        return json.dumps([{k: r[k] for k in RESULT} for r in rows], indent=2)
    af = lambda r, spec: "NA" if r["AF"] is None else format(r["AF"], spec)
    if fmt == "tsv":
        return _tsv(RESULT, ([af(r, ".6f") if k == "AF" else r[k] for k in RESULT] for r in rows))
    if not rows:
        return "No variants found for the given filters."
    line = lambda r: f"{r['chrom']}:{r['pos']} {r['ref']}>{r['alt']}  " + "  ".join(f"{k}={af(r, '.4f') if k == 'AF' else r[k]}" for k in RESULT[4:])
    return "\n".join(map(line, rows))


def carriers(rows: list[dict], variant: tuple, fmt: str) -> str:
    state = lambda r: None if r["filter_pass"] is None else "PASS" if r["filter_pass"] else "FAIL"
    row = lambda r, codes, none: [r["sample_id"], r["sample_name"], r["sex"], r["tech_name"], codes, r["genotype"], none if state(r) is None else state(r)]
    if fmt == "json":
        return json.dumps({"variant": dict(zip(RESULT[:4], variant)), "samples": [dict(zip(CARRIER, row(r, r["phenotypes"], None))) for r in rows]}, indent=2)
    if fmt == "tsv":
        return _tsv(CARRIER, (row(r, ",".join(r["phenotypes"]), "") for r in rows))
    if not rows:
        return "No carriers found for the given filters."
    return _table(CARRIER, [row(r, ",".join(r["phenotypes"]) or ".", "-") for r in rows])


def records(rows: list[dict], fmt: str) -> str:
    """Any list of records, such as samples and changelog entries."""
    if fmt == "json":
        return json.dumps(rows, indent=2)
    flat = lambda v: "" if v is None else ",".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v)
    header = list(rows[0]) if rows else []
    body = [[flat(r[k]) for k in header] for r in rows]
    return _tsv(header, body) if fmt == "tsv" else _table(header, body) if rows else "No entries."


def info(facts: dict, fmt: str) -> str:
    if fmt == "json":
        return json.dumps(facts, indent=2)
    rows = []
    for k, v in facts.items():
        if isinstance(v, dict):
            rows += [[k, x, n] for x, n in sorted(v.items(), key=lambda kv: str(kv[0]))]
        elif not isinstance(v, list):
            rows.append([k, "", v])
    return _tsv(["field", "key", "value"], rows) if fmt == "tsv" else _table(["field", "key", "value"], rows)
